"""Substring deduplication: near-duplicate paragraphs by MinHash bands, and passages inside others.

Paragraphs are lines of at least MIN_WORDS words.  Equal paragraphs are one node, however frequent.
Nodes get MinHash signatures of their word shingles, cut into bands that are tuned for recall at the
similarity asked for; nodes that collide in a band are joined, their exact Jaccard similarity is taken
from the shingles of the whole paragraphs, and the links' connected components are the clusters.  The
first paragraph of a cluster, in the order of document and line, stays; the others go.

A passage that stands inside other text has no line of its own, so the words of each document are also
cut into short pieces at places that the words themselves choose (local minima of a hash over word
pairs): the same passage is cut alike wherever it stands.  What is compared is a window: two adjacent
pieces, or more until they have MIN_WORDS words, the same length that makes a line a paragraph.  Windows
are compared by hash alone.  The first copy of a window is the first one in text that the paragraph step
leaves, and the window goes from every document behind that, also where a part of it has gone as a
paragraph.  So what goes is text that stays in the first copy, or that an even earlier document holds.  Shorter runs, pieces that occur in different
documents or apart from each other, and windows that one document repeats, stay.

What goes is a range of words; the task that removes it hashes the words again and leaves the range
alone if they differ from those that were matched.  duplicate_of names the documents that still hold
what went: where a first copy has itself lost words to an earlier document, that one is named.

Frequent paragraphs, windows and bands: counts and first places are combined before they are shuffled,
and each occurrence is joined with one row for its content, never with the other occurrences; Spark
splits such a join where a key is frequent.  The distinct paragraphs of a band value are first compared
with one of them, by a join.  That decides pairs and most families of near copies; the paragraphs of a
value that are still in different components are dealt out in blocks of BLOCK, and each pair of blocks
is a task's work of its own.

Words are compared without regard to A-Z or a-z and to white space.  Null texts are empty; empty texts and
those without words stay.  Documents are ordered by id and, where ids are equal or null, by a hash of the
text; null ids come first.  Rows that repeat an id and text are one document and get the same result.
An empty table gives no rows; all other columns stay, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import released, scratch, ship, utf8, written
from loomwright.llm.components import components
from loomwright.llm.simhash import forest_pairs

SHINGLE, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.995, 4
MIN_WORDS, REACH = 20, 4
#: Words that are handled at once; paragraphs of a block; shared shingles that are counted at once.
BATCH_WORDS, BLOCK, COUNTED = 200_000, 256, 1 << 21

_P = np.uint64(0x9E3779B97F4A7C15)  # any odd number
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
FIRST_ID = -(1 << 63)


def tune(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The number of bands of `rows` minima by which pairs of that similarity collide with that recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest as digest

    return np.fromiter(map(digest, words), np.uint64, len(words))


def range_hashes(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the words start..start+n, wherever they stand."""
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(h), _P)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(h), _P_INVERSE)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)], dtype=np.uint64)])
    return mix((total[start + n] - total[start]) * back[start] + n.astype(np.uint64))


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash for each place where `size` words begin."""
    m = max(0, len(h) - size + 1)
    out = np.zeros(m, np.uint64)
    for k in range(size):
        out = out * _P + h[k : k + m]
    return mix(out)


def signatures(h: np.ndarray, start: np.ndarray, n: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """Band keys (one row a paragraph) of paragraphs that have a shingle at least."""
    s, count = shingles(h), n - SHINGLE + 1
    at = np.cumsum(count) - count
    own = s[np.arange(count.sum()) + np.repeat(start - at, count)]
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 1 << 63, (bands, rows, 2)).astype(np.uint64) | np.uint64(1)
    out = np.zeros((len(n), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(n), b + 1, np.uint64)
        for a, c in factors[b]:
            key = mix(key * _P + np.minimum.reduceat((own ^ c) * a, at)) if len(at) else key
        out[:, b] = key
    return out


def piece_starts(h: np.ndarray, doc: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Where pieces begin: the first word of a document, and local minima of a hash over word pairs."""
    n = len(h)
    pair = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    pair[:-1] = np.where(doc[:-1] == doc[1:], mix(h[:-1] * _P + h[1:]), pair[:-1])
    low = pair < np.iinfo(np.uint64).max
    for k in range(1, min(reach, n - 1) + 1):
        same = doc[k:] == doc[:-k]
        low[k:] &= ~same | (pair[k:] < pair[:-k])
        low[:-k] &= ~same | (pair[:-k] < pair[k:])
    low[0] = True
    low[1:] |= doc[1:] != doc[:-1]
    return np.flatnonzero(low)


def piece_windows(h: np.ndarray, doc: np.ndarray, run_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First words and numbers of words of the windows: from each piece on, the fewest pieces of its document,
    two at least, that have run_words words.  A run of two or more pieces is covered up to its last word, as
    pieces inside a document have more than REACH words."""
    starts = piece_starts(h, doc)
    edges = np.append(starts, len(h))
    last = np.maximum(np.arange(len(starts)) + 2, np.searchsorted(edges, starts + run_words))
    inside = last < len(edges)
    starts, end = starts[inside], edges[last[inside]]
    own = end <= np.searchsorted(doc, doc[starts], "right")
    return starts[own], (end - starts)[own]


def line_blocks(text: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes, or one line, that end at line breaks."""
    at = 0
    while len(text) - at > size:
        end = text.find(b"\n", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text


def hashed_lines(text: bytes) -> tuple[np.ndarray, list[int]]:
    """The hashes of a text's words, and how many words each line has that has any."""
    h, n = [], []
    for block in line_blocks(text.lower()):
        own = [w for x in block.split(b"\n") if (w := x.split())]
        n += map(len, own)
        h.append(hashed(list(chain.from_iterable(own))))
    return np.concatenate(h), n


def _parts(docs: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[list, list, list[np.ndarray], list[list[int]]]]:
    """Documents together: their ids and text hashes, and what hashed_lines gives for each."""
    held: tuple[list, list, list, list] = [], [], [], []
    size = 0
    for d, r, text in docs:
        h, n = hashed_lines(text)
        for x, y in zip(held, (d, r, h, n)):
            x.append(y)
        size += len(h)
        if size >= BATCH_WORDS:
            yield held
            held, size = ([], [], [], []), 0
    if held[0]:
        yield held


def _key(id_column: str, text_column: str) -> list[Column]:
    """What tells documents apart, and orders them."""
    return [F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(FIRST_ID)).alias("d"), F.xxhash64(utf8(f"`{text_column}`")).alias("r")]


def units(df: DataFrame, id_column: str, text_column: str, bands: int) -> DataFrame:
    """d, r, start and n (words of the document), h, and keys: the bands of a paragraph, null for a window of pieces."""
    ship(df.sparkSession)
    kinds = pa.schema([("d", pa.int64()), ("r", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("keys", pa.list_(pa.int64()))])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, hashes, lines in _parts(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                line_n = np.array([n for own in lines for n in own], np.int64)
                if not len(line_n):
                    continue
                line_doc = np.repeat(np.arange(len(ids)), [len(own) for own in lines])
                doc = np.repeat(line_doc, line_n)
                h = np.concatenate(hashes)
                first = np.searchsorted(doc, np.arange(len(ids)))  # of each document, among all words
                start = np.cumsum(line_n) - line_n
                long = line_n >= MIN_WORDS
                p_start, p_n, p_doc = start[long], line_n[long], line_doc[long]
                keys = signatures(h, p_start, p_n, bands)
                s_start, s_n = piece_windows(h, doc)
                all_start, all_n, all_doc = (np.concatenate(x) for x in ((p_start, s_start), (p_n, s_n), (p_doc, doc[s_start])))
                offsets = np.concatenate([np.arange(len(p_n) + 1) * bands, np.full(len(s_n), len(p_n) * bands)]).astype(np.int32)
                none = np.concatenate([np.zeros(len(p_n), bool), np.ones(len(s_n), bool)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "d": np.array(ids, np.int64)[all_doc],
                        "r": np.array(texts, np.int64)[all_doc],
                        "start": (all_start - first[all_doc]).astype(np.int32),
                        "n": all_n.astype(np.int32),
                        "h": range_hashes(h, all_start, all_n).view(np.int64),
                        "keys": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)), mask=pa.array(none)),
                    },
                    schema=kinds,
                )

    rows = df.select(*_key(id_column, text_column), utf8(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(run, "d long, r long, start int, n int, h long, keys array<long>")


def right_places(h: np.ndarray, spans: list[dict]) -> list[dict]:
    """The spans whose words have the hash they were matched by."""
    start, n = (np.array([x[k] for x in spans], np.int64) for k in ("start", "n"))
    ok = start + n <= len(h)
    right = np.zeros(len(spans), bool)
    right[ok] = range_hashes(h, start[ok], n[ok]).view(np.int64) == np.array([x["h"] for x in spans], np.int64)[ok]
    return [x for x, r in zip(spans, right) if r]


def paragraph_shingles(df: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """wanted: d, r, start, n, h.  h and its shingles (ascending, distinct)."""
    ship(df.sparkSession)
    lists = wanted.groupBy("d", "r").agg(F.collect_list(F.struct("start", "n", "h")).alias("wanted"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_h, out_s = [], []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = hashed_lines(text)[0]
                for x in right_places(h, own):
                    out_h.append(x["h"])
                    out_s.append(np.unique(shingles(h[x["start"] : x["start"] + x["n"]]).view(np.int64)))
            yield pa.RecordBatch.from_pydict({"h": pa.array(out_h, pa.int64()), "s": pa.array(out_s, pa.list_(pa.int64()))})

    rows = df.select(*_key(id_column, text_column), utf8(f"`{text_column}`").alias("text"))
    rows = rows.join(lists, ["d", "r"]).select("text", "wanted")
    return rows.mapInArrow(run, "h long, s array<long>")


def jaccard_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of left, j of right) of sets that are that similar, or i < j within left: the shared members
    are counted for some right sets at a time."""
    own = right is None
    right = left if own else right
    if not left or not right:
        return
    n_left, n_right = (np.array([len(s) for s in x]) for x in (left, right))
    flat = np.concatenate(left)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(left)), n_left)[order]
    for at in range(0, len(right), 32):
        part = right[at : at + 32]
        names, of = np.concatenate(part), np.repeat(np.arange(len(part)), n_right[at : at + 32])
        low, high = np.searchsorted(flat, names), np.searchsorted(flat, names, "right")
        each = high - low
        both = np.zeros(len(left) * len(part), np.int64)
        edges = np.concatenate([[0], np.cumsum(each)])
        for a in range(0, int(edges[-1]), COUNTED):
            k = np.arange(a, min(a + COUNTED, int(edges[-1])))
            x = np.searchsorted(edges, k, "right") - 1
            both += np.bincount(owner[low[x] + k - edges[x]] * len(part) + of[x], minlength=len(both))
        both = both.reshape(len(left), len(part))
        union = n_left[:, None] + n_right[None, at : at + 32] - both
        i, j = np.nonzero(both >= similarity * union - 1e-6)
        j = j + at
        ok = i < j if own else np.ones(len(i), bool)
        yield i[ok], j[ok]


def compared(rows: DataFrame, similarity: float) -> DataFrame:
    """rows: key, i, j (a pair of blocks), block (i or j), h, label, s.  Links a, b that connect all of a pair of
    blocks that are similar enough and not of one label."""
    ship(rows.sparkSession)

    def group(i: int, j: int, block: list[int], h: list[int], label: list[int], s: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        block_, h_ = np.array(block), np.array(h, np.int64)
        order = np.lexsort((h_, block_ != i))
        label_ = np.array(label, np.int64)[order]
        sets = [s[k] for k in order]
        cut_ = int((block_ == i).sum())
        _, first, inverse = np.unique(label_, return_index=True, return_inverse=True)
        groups = first[inverse]  # the first position of each label
        if i == j:
            pairs = jaccard_pairs(sets, None, similarity)
        else:
            pairs = ((a, b + cut_) for a, b in jaccard_pairs(sets[:cut_], sets[cut_:], similarity))
        a, b = forest_pairs(groups, pairs, lambda a, b: np.ones(len(a), bool))
        return h_[order][a], h_[order][b]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])
        for batch in batches:
            out = []
            for *now, block, h, label, s in zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6)):
                if now != key:
                    if len(held[0]) > 1:
                        out.append(group(*key[1:], *held))
                    key, held = now, ([], [], [], [])
                for x, y in zip(held, (block, h, label, s.values.to_numpy().copy())):
                    x.append(y)
            if out:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out])})
        if len(held[0]) > 1:
            a, b = group(*key[1:], *held)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    rows = rows.select("key", "i", "j", "block", "h", "label", "s")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def jaccard(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def clusters(df: DataFrame, nodes: DataFrame, similarity: float, id_column: str, text_column: str) -> DataFrame:
    """nodes: h, first, keys.  node and component of the nodes that are similar to another one."""
    keyed = nodes.select(F.explode("keys").alias("key"), "h")
    groups = written(keyed.groupBy("key").agg(F.min("h").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "groups")
    met = written(keyed.join(groups, "key").select("key", "h", "pivot", "n"), "met")
    pairs = written(met.where("h <> pivot").select("h", "pivot").distinct(), "pairs")
    wanted = pairs.select("h").unionByName(pairs.select(F.col("pivot").alias("h"))).distinct()
    places = nodes.join(wanted, "h").select("first.d", "first.r", "first.start", "first.n", "h")
    sets = written(paragraph_shingles(df, places, id_column, text_column), "sets")
    tested = pairs.join(sets, "h").join(sets.select(F.col("h").alias("pivot"), F.col("s").alias("t")), "pivot")
    found = written(components(tested.where(jaccard("s", "t") >= similarity).select(F.col("h").alias("a"), F.col("pivot").alias("b"))), "found")
    # values of three nodes or more that one comparison with each hasn't connected
    members = met.where("n > 2").join(found, met["h"] == found["node"], "left").select("key", "h", "n", F.coalesce("component", "h").alias("label"))
    members = written(members, "members")
    open_ = written(members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "open")
    if open_.isEmpty():
        return found
    b = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key", "h"), b).cast("int").alias("block")
    rest = members.join(open_, "key").join(sets, "h").select("key", "h", "label", "s", own, F.explode(F.sequence(F.lit(0), b - 1)).alias("other"))
    rest = rest.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stars.unionByName(compared(rest, similarity)))


def repeated_paragraphs(df: DataFrame, paragraphs: DataFrame, similarity: float, id_column: str, text_column: str) -> DataFrame:
    """d, r, start, n, h, x (the cluster), keep (the place that stays) of the paragraphs that go."""
    nodes = written(paragraphs.groupBy("h").agg(F.min(F.struct("d", "r", "start", "n")).alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys")), "nodes")
    with scratch(df.sparkSession, "clusters") as keep_:
        found = keep_(clusters(df, nodes, similarity, id_column, text_column), "found").withColumnRenamed("node", "h")
    member = nodes.join(found, "h", "left").select("h", F.coalesce("component", "h").alias("x"), "first", "copies")
    keep = member.groupBy("x").agg(F.min("first").alias("keep"), F.sum("copies").alias("n_all")).where("n_all > 1").select("x", "keep")
    of_node = written(member.join(written(keep, "keep"), "x").select("h", "x", "keep"), "of_node")  # tables, so that the joins can be split
    again = paragraphs.join(of_node, "h").where(~F.struct("d", "r", "start").eqNullSafe(F.struct("keep.d", "keep.r", "keep.start")))
    return again.select("d", "r", "start", "n", "h", "x", "keep")


def per_document(rows: DataFrame, run, schema: str) -> DataFrame:
    """run((d, r), a batch of all rows of that document, in order of start) -> column dict, for each document."""
    ship(rows.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            d, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.flatnonzero((d[1:] != d[:-1]) | (r[1:] != r[:-1])) + 1
            if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (d[0], r[0]):
                yield from whole(held)
                held = []
            held.append(batch.slice(0, int(new[0]) if len(new) else len(d)))
            if len(new):
                yield from whole(held)
                if len(new) > 1:
                    yield from whole([batch.slice(int(new[0]), int(new[-1] - new[0]))])
                held = [batch.slice(int(new[-1]))]
        if held:
            yield from whole(held)

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of some documents."""
        t = pa.Table.from_batches(parts).combine_chunks()
        columns = {n: t.column(n).to_numpy() for n in t.column_names}
        d, r = columns["d"], columns["r"]
        edges = np.concatenate([[0], np.flatnonzero((d[1:] != d[:-1]) | (r[1:] != r[:-1])) + 1, [len(d)]])
        out = [x for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if (x := run({n: c[a:b] for n, c in columns.items()}))]
        if out:
            yield pa.RecordBatch.from_pydict({n: np.concatenate([x[n] for x in out]) for n in out[0]})

    return rows.repartition("d", "r").sortWithinPartitions("d", "r", "start").mapInArrow(each, schema)


def overlapped(start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words of each range start..end the ranges a..b cover."""
    gone = np.zeros(int(max(end.max(initial=0), b.max(initial=0))) + 2, np.int64)
    np.add.at(gone, a, 1)
    np.add.at(gone, b, -1)
    upto = np.concatenate([[0], np.cumsum(np.cumsum(gone) > 0)])
    return upto[end] - upto[start]


def untouched(windows: DataFrame, gone: DataFrame) -> DataFrame:
    """The windows that no range of gone overlaps (both: d, r, start, n)."""

    def run(own: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        w = ~own["gone"]
        if not w.any():
            return None
        if not w.all():
            start, end = own["start"], own["start"] + own["n"]
            w[w] = overlapped(start[w], end[w], start[~w], end[~w]) == 0
        return {k: own[k][w] for k in ("d", "r", "start", "n", "h")}

    rows = windows.select("d", "r", "start", "n", "h", F.lit(False).alias("gone")).unionByName(gone.select("d", "r", "start", "n", F.lit(0).cast("long").alias("h"), F.lit(True).alias("gone")))
    return per_document(rows, run, "d long, r long, start int, n int, h long")


def repeated_windows(windows: DataFrame, gone: DataFrame) -> DataFrame:
    """d, r, start, n, h, x (h), keep (the place of its first copy) of the windows that go: those of documents
    behind the one that holds the first copy in text that the paragraphs leave."""
    seen = windows.groupBy("h").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.min("r").alias("p"), F.max("r").alias("q"))
    seen = written(seen.where("a < b OR p < q").select("h"), "seen")
    again = written(windows.join(seen, "h", "left_semi"), "again")
    first = untouched(again, gone).groupBy("h").agg(F.min(F.struct("d", "r", "start", "n")).alias("keep"))
    rows = again.join(written(first, "first"), "h").where(F.struct("d", "r") > F.struct("keep.d", "keep.r"))
    return rows.select("d", "r", "start", "n", "h", F.col("h").alias("x"), "keep")


def holders(gone: DataFrame) -> DataFrame:
    """piece, x, docs: who holds the text of the clusters and windows whose first copy has lost words.  A first
    copy's lost words are held where the windows that took them have their own first copies, which are
    earlier, and so on until nothing is lost."""
    keeps = gone.groupBy("piece", "x").agg(F.first("keep").alias("keep"))

    def run(own: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        k = own["kept"]
        if k.all() or not k.any():
            return None
        start, end = own["start"], own["start"] + own["n"]
        lost = overlapped(start[k], end[k], start[~k], end[~k])
        a, b = np.sort(start[~k]), np.sort(end[~k])  # windows begin and end in the same order
        low, high = np.searchsorted(b, start[k], "right"), np.searchsorted(a, end[k], "left")
        each = np.where(lost > 0, high - low, 0)
        at = np.repeat(np.arange(len(each)), each)
        place = np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return {"piece": own["piece"][k][at], "x": own["x"][k][at], "holds": (lost < own["n"][k])[at], "d": own["d"][k][at], "by": own["x"][~k][np.argsort(start[~k], kind="stable")][place]}

    ranges = keeps.select("keep.*", "piece", "x", F.lit(True).alias("kept"))
    ranges = ranges.unionByName(gone.where("piece").select("d", "r", "start", "n", "piece", "x", F.lit(False).alias("kept")))
    lost = written(per_document(ranges, run, "piece boolean, x long, holds boolean, d long, by long"), "lost")
    first = keeps.where("piece").select(F.col("x").alias("by"), F.col("keep.d").alias("kd"))
    of_window = lost.where("piece").select(F.col("x").alias("by"), "holds", F.col("by").alias("next")).distinct()
    out = lost.where("holds").select("piece", "x", "d").distinct()
    open_ = lost.select("piece", "x", "by").distinct()
    while not open_.isEmpty():
        flag = of_window.select("by", "holds").distinct()
        held = open_.join(first, "by").join(flag, "by", "left").where("coalesce(holds, true)").select("piece", "x", F.col("kd").alias("d"))
        out = written(out.unionByName(held).distinct(), "holders")
        open_ = written(open_.join(of_window, "by").select("piece", "x", F.col("next").alias("by")).distinct(), "open")
    return out.groupBy("piece", "x").agg(F.array_sort(F.collect_set("d")).alias("docs"))


def removals(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """d, r, start, n, h, piece (false for a paragraph), docs (the documents that hold the text that goes)."""
    with scratch(df.sparkSession, "substring") as keep:
        rows = written(units(df, id_column, text_column, tune(similarity)), "units")
        paragraphs = repeated_paragraphs(df, rows.where("keys IS NOT NULL"), similarity, id_column, text_column)
        paragraphs = written(paragraphs.withColumn("piece", F.lit(False)), "paragraphs")
        windows = repeated_windows(rows.where("keys IS NULL").select("d", "r", "start", "n", "h"), paragraphs)
        gone = written(paragraphs.unionByName(windows.withColumn("piece", F.lit(True))), "gone")
        where = written(holders(gone), "docs")
        docs = F.coalesce("docs", F.array("keep.d")).alias("docs")
        return keep(gone.join(where, ["piece", "x"], "left").select("d", "r", "start", "n", "h", "piece", docs), "removals")


def cut(text: bytes, spans: list[dict]) -> tuple[bytes, int, int, list[int]]:
    """The text less the spans whose words match, how many ranges and words went, and who holds them."""
    h = hashed_lines(text)[0]
    gone = np.zeros(len(h) + 1, np.int8)
    kept: set[int] = set()
    for x in right_places(h, spans):
        gone[x["start"] : x["start"] + x["n"]] = 1
        kept.update(x["docs"])
    words = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone])))
    out, at = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        front, back = words[a - 1][1] if a else 0, words[b][0] if b < len(words) else len(text)
        before, after = text[front : words[a][0]], text[words[b - 1][1] : back]
        out.append(text[at:front])
        if a and b < len(words):
            out.append(max(before, after, key=lambda x: x.count(b"\n")))
        elif not a:
            out.append(before)
        at = back
    out.append(text[at:])
    return b"".join(out), len(edges) // 2, int(gone.sum()), sorted(kept)


def dedup_substrings(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows with their texts less what other documents hold, and n_removed (ranges), removed_words and
    duplicate_of (ids of the documents that hold what went) in place of columns of those names."""
    extra = ("n_removed", "removed_words", "duplicate_of")
    lists = removals(df, id_column, text_column, similarity).groupBy(F.col("d").alias("sd"), F.col("r").alias("sr")).agg(F.collect_set(F.struct("start", "n", "h", "docs")).alias("spans"))
    columns = [c for c in df.columns if c not in extra]
    own = [(utf8(f"`{c}`") if c == text_column else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]  # names that nothing here uses otherwise
    rows = df.select(*own, *_key(id_column, text_column))
    rows = rows.join(lists, (F.col("d") == F.col("sd")) & (F.col("r") == F.col("sr")), "left").select(*[f"c{i}" for i in range(len(columns))], "spans")
    at = columns.index(text_column)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [cut(t, s) if s else (t, 0, 0, []) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist())]
            out = [pa.array([x[0].decode("utf-8", "replace") for x in done], pa.string()) if k == at else batch.column(k) for k in range(len(columns))]
            out += [pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()), pa.array([[None if i == FIRST_ID else i for i in x[3]] for x in done], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, *extra])

    fields = ", ".join(f"`{f.name}` {'string' if f.name == text_column else f.dataType.simpleString()}" for f in df.schema if f.name in columns)
    return rows.mapInArrow(run, f"{fields}, n_removed long, removed_words long, duplicate_of array<long>")
