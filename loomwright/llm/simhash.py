"""SimHash near-duplicates: fingerprints of word shingles, joined by a binary trie.

Equal fingerprints are one node, however many documents have them.  Two fingerprints that differ in at
most 4 of 64 bits agree in 3 of 7 blocks at least, so all links lie within the 35 ways to choose 3
blocks; rows that agree in the chosen blocks are dealt to one task.  There their fingerprints, sorted,
are a binary trie (a node is a range), and node pairs go down together: bit by bit, the pairs of their
children carry the number of differing bits, and a pair over the budget is dropped with all below it.
35 rows a fingerprint is a fixed cost; the 27 bits that agree keep what meets in a task small as the
corpus grows.

Only a spanning forest of each range's links leaves the task: that keeps every connection, and the
rows are at most as many as the fingerprints.

Null or empty texts have fingerprint zero and are linked like any other.  Null ids have no part in
which id is smallest; a component of such rows alone has a null id.  Rows with equal ids are separate.
An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import released, scratch, ship, utf8, written
from loomwright.llm.components import components, forest
from loomwright.llm.encode import blocks

BLOCKS, CHOSEN = 7, 3
#: Shingles whose bits are counted at once; rows of a task that are joined at once, if no bucket holds more.
COUNTED, JOINED = 1 << 15, 1 << 15
#: Candidates that are tested at once.
TESTED = 1 << 14
#: The largest share of bits by which sets of a Jaccard similarity of 0.8 differ: 3 / 16, for four shingles and the same with a fifth.
LOOSE = 0.1875


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The 64 bits of a text (ASCII lower-cased, split at ASCII white space)."""
    from xxhash import xxh64_intdigest as digest

    counts, total, carry = np.zeros(64, np.int64), 0, []
    for block in blocks(text.lower()):
        words = carry + block.split()
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: max(0, len(words) - shingle + 1)]
        for at in range(0, len(starts), COUNTED):
            first, last = starts[at : at + COUNTED].tolist(), ends[shingle - 1 + at : shingle - 1 + at + COUNTED].tolist()
            h = np.array([digest(joined[p:q], seed) for p, q in zip(first, last)], np.uint64)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(h)
        carry = words[len(words) - min(len(words), shingle - 1) :]
    if not total:
        return digest(b" ".join(carry), seed) if carry else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp (the bits as a signed long) of each row."""
    ship(df.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))})

    return df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(n_blocks: int = BLOCKS, chosen: int = CHOSEN) -> list[int]:
    """The bits of every choice of blocks, as signed longs."""
    cuts = [64 * k // n_blocks for k in range(n_blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for c in combinations(block, chosen) for m in [sum(c)]]


def trie_pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """fps: unsigned, ascending in each range starts..ends, which all have a trie of their own.  Yields
    positions of the pairs that differ in at most budget bits."""
    todo = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    before: dict[int, np.ndarray] = {}
    while todo:
        depth, al, ah, bl, bh, diff = todo.pop()
        if len(al) > at_once:  # half at a time: bounded memory
            for part in (slice(0, len(al) // 2), slice(len(al) // 2, None)):
                todo.append((depth, al[part], ah[part], bl[part], bh[part], diff[part]))
            continue
        same = al == bl
        few = (ah - al) * (bh - bl) <= 4
        if few.any():  # few leaves below: compare them
            l1, n1, l2, n2 = al[few], (ah - al)[few], bl[few], (bh - bl)[few]
            each = n1 * n2
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i, j = np.repeat(l1, each) + k // np.repeat(n2, each), np.repeat(l2, each) + k % np.repeat(n2, each)
            ok = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
            yield i[ok], j[ok]
        al, ah, bl, bh, diff, same = (x[~few] for x in (al, ah, bl, bh, diff, same))
        if not len(al) or depth == 64:
            continue
        if depth not in before:
            before[depth] = np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1) == 0)])
        zeros = before[depth]
        am, bm = al + zeros[ah] - zeros[al], bl + zeros[bh] - zeros[bl]
        other = ~same
        parts = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1), tuple(x[other] for x in (am, ah, bl, bm, diff + 1))]
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*parts))
        keep = (ah > al) & (bh > bl) & (diff <= budget) & ~((al == bl) & (ah - al == 1))
        if keep.any():
            todo.append((depth + 1, al[keep], ah[keep], bl[keep], bh[keep], diff[keep]))


def linked(fps: DataFrame, budget: int = 4) -> DataFrame:
    """fps: distinct fingerprints (fp).  Links a, b that connect all that differ in at most budget bits."""
    ship(fps.sparkSession)

    def join(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """rows: choice, chosen bits, fingerprint; sorted by the first two."""
        order = np.lexsort((rows[2].view(np.uint64), rows[1], rows[0]))
        choice, bits, fp = rows[0][order], rows[1][order], rows[2][order].view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])]))
        end = np.append(new[1:], len(fp))
        many = end - new > 1
        label = forest(len(fp), trie_pairs(fp, new[many], end[many], budget))
        moved = np.flatnonzero(label != np.arange(len(fp)))
        yield pa.RecordBatch.from_pydict({"a": fp[moved].view(np.int64), "b": fp[label[moved]].view(np.int64)})

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]))
            size += batch.num_rows
            if size >= JOINED:
                rows = np.concatenate(held, axis=1)
                last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
                if not last.all():  # the last bucket may go on
                    yield from join(rows[:, ~last])
                    rows = rows[:, last]
                held, size = [rows], rows.shape[1] if not last.all() else size // 2
        if size:
            yield from join(np.concatenate(held, axis=1))

    chosen = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks())])).alias("x")
    keyed = fps.select("fp", chosen).select("x.choice", "x.bits", "fp")
    return keyed.repartition("choice", "bits").sortWithinPartitions("choice", "bits").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, shingle: int = 4, budget: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable) of each row."""
    if budget > BLOCKS - CHOSEN:
        raise ValueError(f"at most {BLOCKS - CHOSEN} differing bits")
    with scratch(df.sparkSession, "simhash") as keep:
        rows = keep(fingerprints(df, shingle, id_column, text_column), "fingerprints")
        groups = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
        found = components(linked(groups.select("fp"), budget)).withColumnRenamed("node", "fp")
        classes = written(groups.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "classes")
        # tables of their own: Spark can split the joins where a component or fingerprint is frequent
        smallest = written(classes.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
        of_fp = keep(classes.join(smallest, "component").select("fp", "component_id"), "of_fp")
    return rows.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; of fewer words than that, of the whole sequence."""
    from xxhash import xxh64_intdigest as digest

    own, new, carry = np.zeros(0, np.uint64), [], []
    for block in blocks(text.lower()):
        words = carry + block.split()
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: max(0, len(words) - shingle + 1)]
        for at in range(0, len(starts), COUNTED):
            first, last = starts[at : at + COUNTED].tolist(), ends[shingle - 1 + at : shingle - 1 + at + COUNTED].tolist()
            new.append(np.array([digest(joined[p:q], seed) for p, q in zip(first, last)], np.uint64))
            if sum(map(len, new)) > len(own):
                own, new = np.unique(np.concatenate([own, *new])), []
        carry = words[len(words) - min(len(words), shingle - 1) :]
    if not len(own) and carry:
        return np.array([digest(b" ".join(carry), seed)], np.uint64)
    return np.unique(np.concatenate([own, *new]))


def long_prints(own: np.ndarray, n_prints: int, bits: int) -> np.ndarray:
    """Many short fingerprints of a set of shingles, as signed longs with the bits at their high ends: together
    the SimHash over n_prints * bits hash bits of each shingle."""
    words_per = -(-n_prints * bits // 64)
    salts = mix_hash(np.arange(1, words_per + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    counts = np.zeros(words_per * 64, np.int64)
    for at in range(0, len(own), 255):  # so many bits add up in a byte
        h = mix_hash(own[at : at + 255, None] ^ salts)
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    on = (counts * 2 > len(own))[: n_prints * bits].reshape(n_prints, bits)
    out = np.zeros((n_prints, 64), np.uint8)
    out[:, :bits] = on
    return np.packbits(out, axis=1).view(">i8").ravel().astype(np.int64)


def mix_hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def node_of(own: np.ndarray) -> int:
    """The signed long that names a set of shingles."""
    from xxhash import xxh64_intdigest as digest

    return int(np.uint64(digest(own.tobytes())).astype(np.int64))


def row_key(df: DataFrame, id_column: str, text_column: str) -> list[Column]:
    """What orders rows: no id (1) or one, the id, a hash of the text, and one of all columns."""
    return [F.col(f"`{id_column}`").isNull().cast("int").alias("no_id"), F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.xxhash64(utf8(f"`{text_column}`")).alias("r"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("w")]


def prints(df: DataFrame, shingle: int, n_prints: int, bits: int, id_column: str, text_column: str) -> DataFrame:
    """The row's key, node (of the text's shingles) and prints (array<long>) of each row."""
    ship(df.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, own = [], []
            for t in batch.column(4).to_pylist():
                s = shingle_set(t, shingle)
                node.append(node_of(s))
                own.append(long_prints(s, n_prints, bits))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(node, pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["no_id", "doc_id", "r", "w", "node", "prints"])

    rows = df.select(*row_key(df, id_column, text_column), utf8(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(run, "no_id int, doc_id long, r long, w long, node long, prints array<long>")


def shingle_sets(df: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """node and its shingles of each row."""
    ship(df.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda own: pa.RecordBatch.from_pydict({"node": pa.array(map(node_of, own), pa.int64()), "s": pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))})
        for batch in batches:
            own, size = [], 0
            for t in batch.column(0).to_pylist():
                own.append(shingle_set(t, shingle))
                size += len(own[-1])
                if size >= 1 << 18:
                    yield out(own)
                    own, size = [], 0
            if own:
                yield out(own)

    return df.select(utf8(f"`{text_column}`").alias("text")).mapInArrow(run, "node long, s array<long>")


def forest_pairs(label: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs that pass the test some that connect what all of them connect: those that join two groups
    that are still apart.  label: the group of each position to begin with, named by its smallest position;
    kept up to date in place, so that pairs can leave out what is joined."""
    out = []
    for i, j in pairs:
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        for at in range(0, len(i), TESTED):
            p, q = i[at : at + TESTED], j[at : at + TESTED]
            apart = label[p] != label[q]
            p, q = p[apart], q[apart]
            passed = test(p, q)
            p, q = p[passed], q[passed]
            while len(p):
                a, b = label[p], label[q]
                low, high = np.minimum(a, b), np.maximum(a, b)
                apart = low < high
                if not apart.any():
                    break
                p, q, low, high = p[apart], q[apart], low[apart], high[apart]
                _, pick = np.unique(high, return_index=True)  # each group joins one with a smaller name
                out.append((p[pick], q[pick]))
                label[high[pick]] = low[pick]
                while True:
                    up = label[label]
                    if (up == label).all():
                        break
                    label[:] = up
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def crossed(place: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The members' pairs of pairs of leaves, some at a time.  A leaf's members stand at place..place + size."""
    each = size[i] * size[j]
    base = np.cumsum(each) - each
    for at in range(0, int(each.sum()), TESTED):
        k = np.arange(at, min(at + TESTED, int(each.sum())))
        pair = np.searchsorted(base, k, "right") - 1
        k -= base[pair]
        p, q = place[i[pair]] + k // size[j[pair]], place[j[pair]] + k % size[j[pair]]
        yield p[p < q], q[p < q]


class Buckets:
    """Rows (choice, block, print, node, component) that agree in choice and block, sorted; equal prints are a
    leaf of the bucket's trie."""

    def __init__(self, choice: np.ndarray, block: np.ndarray, fp: np.ndarray, node: np.ndarray, component: np.ndarray, masks: list[int], budget: int):
        self.order = np.lexsort((node, fp.view(np.uint64), block, choice))
        self.choice, self.block, self.fp, self.node, group = (x[self.order] for x in (choice, block, fp, node, component))
        self.fp, self.masks, self.budget = self.fp.view(np.uint64), np.array(masks, np.int64).view(np.uint64), budget
        bucket = np.concatenate([[True], (self.choice[1:] != self.choice[:-1]) | (self.block[1:] != self.block[:-1])])
        fresh = bucket | np.concatenate([[True], self.fp[1:] != self.fp[:-1]])
        self.leaf, self.place = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        self.size = np.diff(np.append(self.place, len(fresh)))
        self.begin = np.flatnonzero(bucket[self.place])
        self.end = np.append(self.begin[1:], len(self.place))
        # groups to begin with: rows of one bucket and component
        of = np.cumsum(bucket)
        by = np.lexsort((group, of))
        new = np.concatenate([[True], (group[by][1:] != group[by][:-1]) | (of[by][1:] != of[by][:-1])])
        self.label = np.empty(len(by), np.int64)
        self.label[by] = np.minimum.reduceat(by, np.flatnonzero(new))[np.cumsum(new) - 1]

    def elsewhere(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether leaves agree in an earlier block of the same print, so that they meet there."""
        x, k = self.fp[self.place[i]] ^ self.fp[self.place[j]], self.choice[self.place[i]] % len(self.masks)
        out = np.zeros(len(i), bool)
        for n, m in enumerate(self.masks):
            out |= (n < k) & (x & m == 0)
        return out

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs of leaves hold rows of different groups."""
        low, high = np.minimum.reduceat(self.label, self.place), np.maximum.reduceat(self.label, self.place)
        return (low[i] != high[j]) | (high[i] != low[j])

    def leaves(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that differ in at most budget bits, a leaf of several rows and itself among them."""
        own = np.flatnonzero(self.size > 1)
        many = self.end - self.begin > 1
        for i, j in chain([(own, own)], trie_pairs(self.fp[self.place], self.begin[many], self.end[many], self.budget)):
            here = ~self.elsewhere(i, j)
            yield i[here], j[here]

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates: pairs of rows, first those that join most."""
        other = np.flatnonzero(self.leaf[1:] == self.leaf[:-1]) + 1
        yield self.place[self.leaf[other]], other
        for i, j in self.leaves():
            yield self.place[i], self.place[j]
            open_ = self.apart(i, j)
            yield from crossed(self.place, self.size, i[open_], j[open_])


def candidate_links(nodes: DataFrame, first: int, last: int, bits: int, budget: int, most: float) -> DataFrame:
    """nodes: node, prints, component.  Links a, b between nodes of different components of which one of the
    prints first..last - 1 differs in at most budget bits and all prints together in at most `most`: each
    print's bits are cut into budget + 1 blocks, of which one agrees, and there the tries are joined.

    First the tries are joined on single prints: that gives the groups of each bucket that candidates hold
    together, untested.  Then each node of a group is tested by all bits against the group's first node, by a
    join, however large the group is: most groups are whole after that.  Only the nodes of groups that aren't
    are dealt out again with all their prints, and every candidate is tested before links are left out that
    connect nothing new."""
    ship(nodes.sparkSession)
    cuts = [bits * k // (budget + 1) for k in range(budget + 2)]
    signed = [m - (1 << 64) if m >> 63 else m for a, b in zip(cuts, cuts[1:]) for m in [((1 << (b - a)) - 1) << (64 - b)]]

    def in_buckets(batches: Iterator[pa.RecordBatch], join: Callable[[list[np.ndarray]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """join over whole buckets; its argument: choice, block, print(s), node, component."""
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            own = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 3, 4)]
            p = batch.column(2)
            own.insert(2, p.flatten().to_numpy().reshape(len(p), -1) if pa.types.is_list(p.type) else p.to_numpy())
            held.append(own)
            size += batch.num_rows
            if size >= JOINED:
                rows = [np.concatenate(x) for x in zip(*held)]
                last_ = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
                if not last_.all():  # the last bucket may go on
                    yield join([x[~last_] for x in rows])
                    rows = [x[last_] for x in rows]
                held, size = [rows], len(rows[0]) if not last_.all() else size // 2
        if held and sum(len(x[0]) for x in held):
            yield join([np.concatenate(x) for x in zip(*held)])

    def meet(rows: list[np.ndarray]) -> pa.RecordBatch:
        b = Buckets(*rows, signed, budget)
        found = np.zeros(len(b.place), bool)

        def candidates() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j in b.leaves():
                open_ = b.apart(i, j)
                found[i[open_]] = found[j[open_]] = True
                yield i[open_], j[open_]

        group = forest(len(b.place), candidates())[b.leaf]
        root = np.full(len(b.place), np.iinfo(np.int64).max)
        np.minimum.at(root, group, b.node)
        own = found[b.leaf]
        return pa.RecordBatch.from_pydict({"choice": b.choice[own].astype(np.int32), "block": b.block[own], "node": b.node[own], "root": root[group][own]})

    def link(rows: list[np.ndarray]) -> pa.RecordBatch:
        own = rows[2]
        b = Buckets(rows[0], rows[1], own[np.arange(len(own)), rows[0] // len(signed)], *rows[3:], signed, budget)
        own = own[b.order].view(np.uint64)
        i, j = forest_pairs(b.label, b.rows(), lambda i, j: np.bitwise_count(own[i] ^ own[j]).sum(1, dtype=np.int64) <= most)
        return pa.RecordBatch.from_pydict({"a": np.maximum(b.node[i], b.node[j]), "b": np.minimum(b.node[i], b.node[j])})

    block = lambda fp, i: F.transform(F.array(*[F.lit(m) for m in signed]), lambda m, k: F.struct(((i + first) * len(signed) + k).alias("choice"), fp.bitwiseAND(m).alias("block"), fp.alias("fp")))
    some = F.slice("prints", first + 1, last - first)
    keyed = nodes.select("node", "component", F.explode(F.flatten(F.transform(some, block))).alias("x")).select("x.choice", "x.block", "x.fp", "node", "component")
    dealt = lambda df: df.repartition("choice", "block").sortWithinPartitions("choice", "block")
    met = written(dealt(keyed).mapInArrow(lambda batches: in_buckets(batches, meet), "choice int, block long, node long, root long"), "met")
    of = nodes.select("node", "prints", "component")
    pairs = met.where("node <> root").select("node", "root").distinct()
    first_ = of.select(F.col("node").alias("root"), F.col("prints").alias("q"), F.col("component").alias("other"))
    apart = F.aggregate(F.zip_with("prints", "q", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = pairs.join(of, "node").join(first_, "root").where((F.col("component") != F.col("other")) & (apart <= most)).select("node", "root", "component", "other")
    near = written(near, "near_first")
    joined = components(near.select(F.col("component").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("old"), F.col("component").alias("new"))
    of = of.select("node", "component").join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    held = written(met.join(of, "node"), "held")
    open_ = held.groupBy("choice", "block", "root").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("choice", "block", "root")
    rest = held.join(written(open_, "open"), ["choice", "block", "root"]).select("choice", "block", "root", "node", "component")
    again = rest.join(nodes.select("node", "prints"), "node").select("choice", "block", "prints", "node", "component", "root")
    again = again.repartition("choice", "block", "root").sortWithinPartitions("choice", "block").drop("root")
    late = again.mapInArrow(lambda batches: in_buckets(batches, link), "a long, b long")
    return near.select(F.greatest("node", "root").alias("a"), F.least("node", "root").alias("b")).unionByName(late).distinct()


def jaccard_links(prints_: np.ndarray, sets: list[np.ndarray], similarity: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that connect all whose sets are that similar.  prints_: a row for each set; pairs that
    differ in more than `most` bits aren't compared.  sets: ascending, distinct."""
    bits, sizes = prints_.view(np.uint64), np.array([len(s) for s in sets])
    label, out = np.arange(len(sets)), []
    for k in range(len(sets) - 1):
        other = k + 1 + np.flatnonzero(label[k + 1 :] != label[k])
        if not len(other) and (label == label[0]).all():
            break
        low, high = np.minimum(sizes[other], sizes[k]), np.maximum(sizes[other], sizes[k])
        other = other[low >= similarity * high - 1e-6]
        other = np.concatenate([p[np.bitwise_count(bits[p] ^ bits[k]).sum(1, dtype=np.int64) <= most] for at in range(0, len(other), TESTED) for p in [other[at : at + TESTED]]] or [other])
        for at in range(0, len(other), 256):
            p = other[at : at + 256]
            flat = np.concatenate([sets[x] for x in p])
            hit = sets[k][np.minimum(np.searchsorted(sets[k], flat), sizes[k] - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[p]) - sizes[p])
            near = p[both >= similarity * (sizes[p] + sizes[k] - both) - 1e-6]
            out += [(k, x) for x in near.tolist()]
            names = np.unique(label[np.append(near, k)])
            label[np.isin(label, names)] = names[0]
    return np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)


def exact_links(members: DataFrame, similarity: float, most: float) -> DataFrame:
    """members: cluster, node, prints, s.  Links a, b that connect all nodes of a cluster that are that similar."""
    ship(members.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            i, j = jaccard_links(np.stack([x[1] for x in held]), [x[2] for x in held], similarity, most)
            node = np.array([x[0] for x in held], np.int64)
            return pa.RecordBatch.from_pydict({"a": node[i], "b": node[j]})

        cluster, held = None, []
        for batch in batches:
            for c, node, p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if c != cluster:
                    if len(held) > 1:
                        yield links()
                    cluster, held = c, []
                held.append((node, p.values.to_numpy().copy(), s.values.to_numpy().view(np.uint64).copy()))
        if len(held) > 1:
            yield links()

    rows = members.select("cluster", "node", "prints", "s").repartition("cluster").sortWithinPartitions("cluster")
    return rows.mapInArrow(run, "a long, b long")


def bits_apart(similarity: float) -> float:
    """The share of SimHash bits that differ between large sets of equal size of that Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def similar_rows(df: DataFrame, similarity: float, shingle: int, n_prints: int, bits: int, budget: int, id_column: str, text_column: str) -> DataFrame:
    """The key (no_id, doc_id, r, w) of each row and its component (a number)."""
    with scratch(df.sparkSession, "similar") as keep:
        return keep(_similar_rows(df, similarity, shingle, n_prints, bits, budget, id_column, text_column), "rows")


def _similar_rows(df: DataFrame, similarity: float, shingle: int, n_prints: int, bits: int, budget: int, id_column: str, text_column: str) -> DataFrame:
    rows = written(prints(df, shingle, n_prints, bits, id_column, text_column), "prints")
    nodes = written(rows.groupBy("node").agg(F.min(F.struct("no_id", "doc_id", "r")).alias("first"), F.first("prints").alias("prints")), "nodes")
    total, p = n_prints * bits, max(LOOSE, bits_apart(similarity))
    most = total * p + 3.5 * (total * p * (1 - p)) ** 0.5
    classes, links = nodes.withColumn("component", F.col("node")), None
    cut = max(1, n_prints // 4)
    for first, last in ((0, cut), (cut, n_prints)):
        with scratch(df.sparkSession, "candidates") as keep:
            near = candidate_links(classes.select("node", "prints", "component"), first, last, bits, budget, most)
            links = keep(near if links is None else links.unionByName(near), "near")
        found = components(links).withColumnRenamed("node", "n")
        classes = written(nodes.join(found, nodes["node"] == F.col("n"), "left").select("node", "first", "prints", F.coalesce("component", "node").alias("component")), "classes")
    members = written(classes.join(found.select(F.col("n").alias("node"), F.col("component").alias("cluster")), "node").select("cluster", "node", "first", "prints"), "members")
    wanted = members.select(F.col("first.doc_id").alias("wd"), F.col("first.r").alias("wr")).distinct()
    some = df.join(wanted, F.col(f"`{id_column}`").cast("long").eqNullSafe(F.col("wd")) & (F.xxhash64(utf8(f"`{text_column}`")) == F.col("wr")), "left_semi")
    sets = shingle_sets(some, shingle, id_column, text_column).groupBy("node").agg(F.first("s").alias("s"))
    exact = components(exact_links(members.join(sets, "node"), similarity, most)).withColumnRenamed("node", "n")
    of_node = written(nodes.join(exact, nodes["node"] == F.col("n"), "left").select("node", F.coalesce("component", "node").alias("component")), "of_node")
    return rows.select("no_id", "doc_id", "r", "w", "node").join(of_node, "node").select("no_id", "doc_id", "r", "w", "component")


def similar_documents(df: DataFrame, similarity: float = 0.8, shingle: int = 5, n_prints: int = 32, bits: int = 40, budget: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and component_id (the smallest id) of near duplicates by similarity.  One fingerprint of 64 bits
    and a few differing bits finds only very close texts; at a similarity of 0.8 some 15 % of the bits differ.
    So there are many short fingerprints, and texts are candidates if any of them lies within the budget (of
    large sets at 0.8, 98.7 % with the parameters given, more above; of sets of a few shingles fewer).
    Candidates that differ in few enough bits form clusters, a bound that is looser than the similarity; in
    these the sets of distinct shingles are compared, and nodes are linked if their Jaccard similarity is that
    high.

    A quarter of the fingerprints goes first.  The others look for links between the components found by then
    alone, so a large family of near copies is gone over once and not for every fingerprint."""
    rows = similar_rows(df, similarity, shingle, n_prints, bits, budget, id_column, text_column)
    smallest = written(rows.groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")  # so that the join can be split
    return rows.join(smallest, "component").select("doc_id", "component_id")


def keep_first(df: DataFrame, similarity: float = 0.8, shingle: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component of similar documents: the one of the smallest id; of rows with equal ids, and
    of rows without one, which come last, the one of the smallest hash of text and columns; of rows that are
    equal in all columns any one.  All columns stay as they are."""
    rows = similar_rows(df, similarity, shingle, 32, 40, 3, id_column, text_column)
    own = ("no_id", "doc_id", "r", "w")
    first = rows.groupBy("component").agg(F.min(F.struct(*own)).alias("k")).select(*[F.col(f"k.{c}").alias(f"f{i}") for i, c in enumerate(own)])
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}  # names that nothing here uses otherwise
    named = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *row_key(df, id_column, text_column))
    kept = named.join(written(first, "first"), F.col("doc_id").eqNullSafe(F.col("f1")) & (F.col("r") == F.col("f2")) & (F.col("w") == F.col("f3")), "left_semi")
    return kept.dropDuplicates(["doc_id", "r", "w"]).select(*[F.col(n).alias(c) for c, n in names.items()])
