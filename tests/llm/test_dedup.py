"""Exact, line, SimHash and substring deduplication against plain loops."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.llm import exact, lines, simhash, substring
from loomwright.llm.components import components

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def roots(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


# ---- exact


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups["".join(c for c in t or "" if c not in BLANK)].append((d, t or ""))
    out = []
    for norm, own in groups.items():
        named = [x for x in own if x[0] is not None]
        keep = min(named, key=lambda x: (-len(x[1]), x[0]))[0] if named else None
        out += [(d, keep, len(own), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in own]
    return sorted(map(str, out))


def test_exact(docs, none, clashing):
    want = brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    for df in (docs, clashing):
        assert sorted(str(tuple(r)) for r in exact.exact_duplicates(df).collect()) == want
    assert exact.exact_duplicates(none).count() == 0


def test_exact_ties_and_hot_group(spark):
    rows = [(k, "a b" if k % 3 else "a  b") for k in range(600)] + [(1000 + k, f"own {k}") for k in range(50)]
    got = sorted(str(tuple(r)) for r in exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_exact(rows)


def test_exact_tells_texts_of_one_digest_apart(spark, docs):
    """With a digest of one byte, many texts have the same one: they are compared whole."""
    rng = random.Random(1)
    rows = [(k, f"{rng.randrange(700)}{' ' * rng.randrange(3)}") for k in range(1500)] + [(None, "1"), (None, "a b"), (None, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in exact.exact_duplicates(df, width=1).collect()) == brute_exact(rows)


# ---- lines


def brute_lines(rows, window=2, alone=None):
    """Rows in order of id; a unit goes if a window of units over it occurs earlier, or it alone if it is long."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        units, lead = [], []
        for line in (t or "").split("\n"):
            if line.strip(BLANK):
                units.append([line])
            elif units:
                units[-1].append(line)
            else:
                lead.append(line)
        gone = set()
        for i in range(len(units) - window + 1):
            key = tuple(u[0].strip(BLANK) for u in units[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        for i, u in enumerate(units):
            if alone and len(u[0].split()) >= alone:
                if u[0].strip(BLANK) in seen:
                    gone.add(i)
                seen.add(u[0].strip(BLANK))
        kept = ["\n".join(u) for i, u in enumerate(units) if i not in gone]
        out[d] = ("\n".join((["\n".join(lead)] if lead else []) + kept), len(units), len(gone))
    return out


def test_lines_on_edge_cases(docs, none, clashing):
    one = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = brute_lines([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(one).collect()} == want
    all_ = lines.dedup_lines(docs).collect()
    assert len(all_) == docs.count()
    assert [(r.text, r.n_removed) for r in all_ if r.doc_id == 2] == [("", 2), ("", 2)]
    assert [r.text for r in all_ if r.doc_id is None] == ["A text without an id."]
    assert lines.dedup_lines(none).count() == 0
    got = lines.dedup_lines(clashing)
    assert got.columns == [c for c in clashing.columns if c != "n_removed"] + ["n_lines", "n_removed"] and got.count() == docs.count()


@pytest.mark.parametrize("window", [1, 2, 3])
def test_lines_random(spark, window):
    rng = random.Random(window)
    rows = [(k, "\n".join(rng.choice(["a", "b ", " c", "", "d d", "\t", "e"]) for _ in range(rng.randrange(12)))) for k in range(120)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), window=window)
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == brute_lines(rows, window)


@pytest.mark.parametrize("window", [2, 3])
def test_long_lines_alone(spark, window):
    rng = random.Random(window)
    rows = [(k, "\n".join(rng.choice(["a", "b ", " c d e", "", "f g h i ", "j k l", f"own {k}"]) for _ in range(rng.randrange(12)))) for k in range(120)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), window=window, alone=3)
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == brute_lines(rows, window, 3)


def test_lines_run_no_python(spark, docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- SimHash


def brute_print(text, k=4):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_simhash(rows, budget=4):
    prints = [brute_print(t) for _, t in rows]
    label = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= budget])
    first = {}
    for (d, _), r in zip(rows, label):
        if d is not None:
            first[r] = min(d, first.get(r, d))
    return sorted(str((d, f"{p:016x}", first.get(r))) for (d, _), p, r in zip(rows, prints, label))


def test_simhash(docs, none, clashing):
    want = brute_simhash([(r.doc_id, r.text) for r in docs.collect()])
    for df in (docs, clashing):
        assert sorted(str(tuple(r)) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_chains(spark):
    """Edited copies of copies: links only between neighbours of a chain."""
    rng = random.Random(3)
    rows, k = [], 100
    for _ in range(12):
        w = [rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(150)]
        for _ in range(8):
            rows.append((k, " ".join(w)))
            k -= 1
            w[rng.randrange(150)] = f"x{k}"
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_simhash(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1)), min_size=1, max_size=40), st.integers(0, 4), st.sampled_from([7, 1 << 20]))
def test_trie_pairs(seeds, budget, at_once):
    fps = set()
    for k, x in seeds:
        fps |= {x, x ^ (1 << k), x ^ (0x1F << (k * 9))}
    f = np.array(sorted(fps), np.uint64)
    cut = len(f) // 2
    got = {(int(i), int(j)) for a, b in simhash.trie_pairs(f, np.array([0, cut]), np.array([cut, len(f)]), budget, at_once) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if (i < cut) == (j < cut) and (int(f[i]) ^ int(f[j])).bit_count() <= budget}
    assert got == want


def test_masks_cover_all_pairs_within_budget():
    rng = random.Random(1)
    masks = [m % (1 << 64) for m in simhash.masks()]
    for _ in range(2000):
        x = sum(1 << rng.randrange(64) for _ in range(4)) % (1 << 64)
        if x.bit_count() <= 4:
            assert any(x & m == 0 for m in masks)


def edited(rng, words, n):
    w = list(words)
    for i in rng.sample(range(len(w)), n):
        w[i] = f"edit{rng.randrange(10**9)}"
    return w


def test_similar_documents(spark, docs, none, clashing):
    """Copies with a similarity of 0.85 and more meet; unrelated ones and those around 0.5 don't."""
    rng = random.Random(5)
    rows, k = [], 0
    near, far = [], []
    for _ in range(30):
        w = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows.append((k, " ".join(w)))
        rows.append((k + 1, " ".join(edited(rng, w, 5))))
        rows.append((k + 2, " ".join(edited(rng, w, 40))))
        near.append((k, k + 1))
        far.append((k, k + 2))
        k += 3
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a] == got[b] for a, b in near)
    assert all(got[a] != got[b] for a, b in far)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in left if x is not None) == [1, 4, 7, 8, 9, 10] and left.count(None) == 1
    assert simhash.keep_first(none).count() == 0 and simhash.keep_first(clashing).count() == len(left)


def test_one_row_of_each_group_stays(spark):
    """Equal ids with different texts, rows without ids, and rows that differ in another column only."""
    rng = random.Random(7)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (2, a, "z"), (3, b, "y"), (None, a, "n"), (None, c, "n"), (None, c, "n"), (None, c, "m"), (None, a + " more", "n")]
    got = sorted((r.doc_id or 0, r.text, r.source) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert [x[:2] for x in got] == sorted([(0, c), (1, a), (1, b)]) and {x[2] for x in got if x[0]} == {"x", "y"} and got[0][2] in "nm"


def family(rng, n, words=300, spans=2, size=14):
    """Texts around one base, each with a few runs of words of its own."""
    base, out = [f"w{rng.randrange(10**6)}" for _ in range(words)], []
    for k in range(n):
        w = list(base)
        for _ in range(spans):
            at = rng.randrange(words - size)
            w[at : at + size] = [f"e{rng.randrange(10**9)}" for _ in range(size)]
        out.append((k, " ".join(w)))
    return out


def test_no_promised_link_is_lost_in_a_dense_family(spark):
    """Against all pairs: two texts that are similar, of which a print lies within the budget and whose bits pass
    the test, end in one component, however many unlike candidates stand beside them."""
    rows = family(random.Random(16), 2400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    label = np.array([got[k] for k, _ in rows])
    sets = [simhash.shingle_set(t.encode(), 5) for _, t in rows]
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((len(rows), len(names)), bool)
    has[np.repeat(np.arange(len(rows)), list(map(len, sets))), flat] = True
    packed, size = np.packbits(has, axis=1), np.array(list(map(len, sets)))
    bits = np.stack([simhash.long_prints(s, 32, 40).view(np.uint64) for s in sets])
    p = max(simhash.LOOSE, simhash.bits_apart(0.8))
    most = 1280 * p + 3.5 * (1280 * p * (1 - p)) ** 0.5
    found, n = [], 0
    for k in range(len(rows) - 1):
        both = np.bitwise_count(packed[k + 1 :] & packed[k]).sum(1, dtype=np.int64)
        like = np.flatnonzero(both >= 0.8 * (size[k + 1 :] + size[k] - both) - 1e-6) + k + 1
        apart = np.bitwise_count(bits[like] ^ bits[k])
        promised = like[(apart.min(1, initial=64) <= 3) & (apart.sum(1, dtype=np.int64) <= most)]
        assert (label[promised] == label[k]).all()
        n += len(promised)
        found += [(k, x) for x in like.tolist() if label[x] == label[k]]
    assert n > 1000
    assert roots(len(rows), found) == label.tolist()  # and nothing unlike comes together


def exact_similarity(a, b):
    a, b = (set(simhash.shingle_set(t.encode(), 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def recall_of_pairs(spark, words, pairs, families, size, seed):
    """Of pairs with a similarity between 0.80 and 0.85: the share that ends in one component, alone in the corpus
    and within families of texts whose others are less alike."""
    rng = random.Random(seed)
    rows, alone, inside = [], [], []

    def pair(base):
        while True:
            a, b = (" ".join(edited(rng, base, n)) for n in (0, rng.randrange(max(1, words // 80), words // 30 + 2)))
            if 0.8 <= exact_similarity(a, b) < 0.85:
                rows.extend([(len(rows), a), (len(rows) + 1, b)])
                return len(rows) - 2, len(rows) - 1

    for _ in range(pairs):
        alone.append(pair([f"w{rng.randrange(10**6)}" for _ in range(words)]))
    for _ in range(families):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            inside.append(pair(edited(rng, base, words // 8)))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return [sum(got[a] == got[b] for a, b in own) / len(own) for own in (alone, inside)]


def test_recall_of_similar_documents(spark):
    alone, inside = recall_of_pairs(spark, 300, 150, 10, 15, 21)
    assert alone >= 0.95 and inside >= 0.95


def test_candidates_are_tested_before_links_are_left_out(spark):
    """One print of all texts is equal.  1 is a candidate of 2 and 3, but only 2 and 3 are alike."""
    rng = random.Random(6)
    a, b, c = ([rng.getrandbits(40) << 24 for _ in range(31)] for _ in range(3))
    as_long = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, [as_long(x) for x in [5 << 24, *own]]) for k, own in [(1, a), (2, b), (3, b[:-1] + [b[-1] ^ 1 << 30]), (4, c)]]
    nodes = spark.createDataFrame([(k, p, k) for k, p in rows], "node long, prints array<long>, component long")
    got = simhash.candidate_links(nodes, 0, 1, 40, 3, 200).collect()
    assert [(r.a, r.b) for r in got] == [(3, 2)]
    joined = nodes.withColumn("component", F.lit(1).cast("long"))
    assert simhash.candidate_links(joined, 0, 1, 40, 3, 200).count() == 0


def test_repeated_phrases_are_no_similarity(spark):
    """The similarity is that of distinct shingles: a phrase that stands often counts once."""
    rng = random.Random(9)
    phrase = sentence(rng, 10)
    own = [sentence(rng, 300) for _ in range(2)]
    rows = [(k, f"{(phrase + ' ') * 70}{t}") for k, t in enumerate(own)]
    short, long = " ".join([phrase] * 3), " ".join([phrase] * 60)
    rows += [(2, f"{own[0]} {own[1]} {short}"), (3, f"{own[0]} {own[1]} {long}")]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 25), min_size=1, max_size=12), min_size=1, max_size=25))
def test_jaccard_links(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    i, j = simhash.jaccard_links(np.zeros((len(sets), 2), np.int64), arrays, 0.8, 0)
    want = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert roots(len(sets), zip(i.tolist(), j.tolist())) == roots(len(sets), want)


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    names = sorted({x for a, b in links if a != b for x in (a, b)})
    place = {x: i for i, x in enumerate(names)}
    label = roots(len(names), [(place[a], place[b]) for a, b in links if a != b])
    for few in (0, 50, 1 << 18):
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), few).collect()}
        assert got == {x: names[label[i]] for i, x in enumerate(names)}
    assert all(components(spark.createDataFrame([], "a long, b long"), few).count() == 0 for few in (0, 9))


# ---- substrings


def sentence(rng, n):
    return " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))


def repeated_windows(rows, n=50):
    seen, found = {}, Counter()
    for d, t in rows:
        w = t.lower().split()
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if seen.setdefault(key, d) != d:
                found[d] += 1
    return found


def test_embedded_passages(spark):
    """Passages of over 50 words inside other text: later copies go, first ones and clean texts stay."""
    rng = random.Random(2)
    passages = [sentence(rng, 56) for _ in range(12)]
    rows = []
    for k in range(150):
        parts = [sentence(rng, rng.randrange(5, 60)) for _ in range(3)]
        if k % 2:
            parts.insert(rng.randrange(4), passages[k % 12])
        rows.append((k, rng.choice([" ", "\n"]).join(parts)))
    got = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not repeated_windows(sorted((d, r.text) for d, r in got.items()))
    for k, t in rows:
        if k % 2 == 0 or k < 13 and passages[k % 12] in t and k == min(i for i, x in rows if passages[k % 12] in x):
            assert got[k].text == t and got[k].n_removed == 0
    assert all(min(i for i, x in rows if passages[k % 12] in x) in got[k].duplicate_of for k in range(13, 150, 2))


def test_phrases_of_different_documents_stay(spark):
    """Two pieces that stand side by side, each of which another document holds, are no passage."""
    rng = random.Random(7)

    def pieces(words):
        h = substring.hashed([w.encode() for w in words])
        starts = [*substring.piece_starts(h, np.zeros(len(h), np.int64)).tolist(), len(h)]
        return [tuple(words[a:b]) for a, b in zip(starts, starts[1:])]

    while True:
        a, b, *more = (sentence(rng, n).split() for n in (6, 6, 15, 15, 15, 15, 15, 15))
        texts = [more[0] + a + more[1], more[2] + b + more[3], more[4] + a + b + more[5]]
        cuts = [pieces(t) for t in texts]
        if all(tuple(x) in cuts[k] for x, k in ((a, 0), (b, 1), (a, 2), (b, 2))):
            break
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].text == t and not got[k].duplicate_of for k, t in rows)


def test_near_paragraphs(spark):
    """Like brute force: clusters of paragraphs with a similarity of 0.8 or more keep their first one."""
    rng = random.Random(4)
    paragraphs = [[f"p{rng.randrange(10**6)}" for _ in range(60)] for _ in range(25)]
    rows = []
    for k in range(80):
        own = [edited(rng, p, n) for p in rng.sample(paragraphs, 2) for n in [rng.choice([0, 0, 1, 1, 12])]]
        rows.append((k, "\n".join([sentence(rng, 25), *(" ".join(w) for w in own)])))
    units = [(d, i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))) for d, t in rows for i, line in enumerate(t.split("\n")) for w in [line.split()]]
    links = [(i, j) for i, a in enumerate(units) for j, b in enumerate(units[:i]) if len(a[2] & b[2]) >= 0.8 * len(a[2] | b[2])]
    label = roots(len(units), links)
    gone = {(d, i) for (d, i, _), r, k in zip(units, label, range(len(units))) if r != k}
    got = substring.removals(spark.createDataFrame(rows, "doc_id long, text string")).where("NOT piece").collect()
    starts = {(d, sum(len(x.split()) for x in t.split("\n")[:i])): (d, i) for d, t in rows for i in range(3)}
    assert {starts[r.d, r.start] for r in got} == gone


def test_substrings_on_edge_cases(docs, none, clashing):
    got = substring.dedup_substrings(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.text for r in got if r.doc_id in (4, 5, 6, 7, 9, 10)} == {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in (4, 5, 6, 7, 9, 10)}
    assert substring.dedup_substrings(none).count() == 0
    out = substring.dedup_substrings(clashing)
    assert out.count() == docs.count() and set(clashing.columns) <= set(out.columns)


def test_bands_are_tuned():
    for s in (0.8, 0.9):
        b = substring.tune(s)
        assert 1 - (1 - s**substring.ROWS) ** b >= substring.RECALL > 1 - (1 - s**substring.ROWS) ** (b - 1)


SETS = st.lists(st.frozensets(st.integers(0, 25), min_size=1, max_size=12), min_size=1, max_size=45)


@settings(max_examples=50, deadline=None)
@given(SETS, SETS)
def test_jaccard_pairs(left, right):
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    arrays = [[np.array(sorted(s), np.int64) for s in x] for x in (left, right)]
    got = [(int(i), int(j)) for a, b in substring.jaccard_pairs(arrays[0], None, 0.8) for i, j in zip(a, b)]
    assert sorted(got) == [(i, j) for i, a in enumerate(left) for j, b in enumerate(left) if i < j and like(a, b)]
    got = [(int(i), int(j)) for a, b in substring.jaccard_pairs(*arrays, 0.8) for i, j in zip(a, b)]
    assert sorted(got) == [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if like(a, b)]


def test_mismatched_spans_stay():
    text = b"one two three four five six seven eight nine ten eleven twelve"
    span = {"start": 0, "n": 12, "piece": False, "h": 12345, "keep": 1}
    assert substring.cut(text, [span])[:3] == (text, 0, 0)


def brute_substrings(rows):
    """Words that stay, and who holds the others, of documents in order of id."""
    rows = sorted(rows)
    words = {d: t.lower().split() for d, t in rows}
    units, windows = [], []
    for d, t in rows:
        at = 0
        for line in t.lower().split("\n"):
            w = line.split()
            if len(w) >= 20:
                units.append((d, at, tuple(w)))
            at += len(w)
        h = substring.hashed([w.encode() for w in words[d]])
        if len(h):
            windows += [(d, int(a), tuple(words[d][a : a + n])) for a, n in zip(*substring.piece_windows(h, np.zeros(len(h), np.int64)))]
    sets = [frozenset(w[i : i + 5] for i in range(len(w) - 4)) for _, _, w in units]
    label = roots(len(units), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)])
    span = lambda u: set(range(u[1], u[1] + len(u[2])))
    gone = defaultdict(set)
    away = []  # what went and its first copy
    for u, r in zip(units, label):
        if u != units[r]:
            gone[u[0]] |= span(u)
            away.append((u, units[r]))
    first, cut = {}, defaultdict(list)
    for u in windows:
        if not span(u) & gone[u[0]]:
            first.setdefault(u[2], u)
    for u in windows:
        k = first.get(u[2], u)
        if k[0] < u[0]:
            away.append((u, k))
            cut[u[0]].append((u, k))
    for u, _ in away:
        gone[u[0]] |= span(u)

    def holders(k):
        lost = [x for x in cut[k[0]] if span(x[0]) & span(k)]
        out = {k[0]} if span(k) - gone[k[0]] else set()
        return out.union(*(holders(x[1]) for x in lost))

    of = defaultdict(set)
    for u, k in away:
        of[u[0]] |= holders(k)
    return {d: ([w for i, w in enumerate(words[d]) if i not in gone[d]], sorted(of[d])) for d, _ in rows}


def substrings(spark, rows):
    return {r.doc_id: (r.text.lower().split(), r.duplicate_of) for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_substrings_against_brute_force(spark):
    """Lines that are near copies, passages that stand as lines and inside others, chains of both."""
    rng = random.Random(12)
    passages = [sentence(rng, rng.choice([12, 25, 40, 60])) for _ in range(20)]
    lines = [f"{sentence(rng, 30)} {rng.choice(passages)} {sentence(rng, 20)}".split() for _ in range(15)]
    rows = []
    for k in range(90):
        own = []
        for _ in range(rng.randrange(4)):
            x = rng.random()
            if x < 0.3:
                own.append(rng.choice(passages))
            elif x < 0.6:
                own.append(" ".join(edited(rng, rng.choice(lines), rng.choice([0, 1, 1, 14]))))
            elif x < 0.8:
                own.append(f"{sentence(rng, 9)} {rng.choice(passages)} {rng.choice(passages)} {sentence(rng, 3)}")
            else:
                own.append(sentence(rng, rng.randrange(30)))
        rows.append((k, rng.choice(["\n", " ", "\n\n"]).join(own)))
    want = brute_substrings(rows)
    assert sum(len(x[1]) > 1 for x in want.values()) > 10
    assert substrings(spark, rows) == want


def test_no_passage_vanishes(spark):
    """A paragraph, a near copy with a passage of its own, and that passage elsewhere: the near copy goes whole,
    so the passage must stay in the third document, and once only in a fourth and fifth."""
    rng = random.Random(13)
    rows, own = [], []
    for g in range(20):
        p, x = sentence(rng, 400).split(), sentence(rng, 25)
        at = rng.randrange(400)
        rows += [(10 * g, " ".join(p)), (10 * g + 1, " ".join([*p[:at], x, *p[at:]]))]
        rows += [(10 * g + k, f"{sentence(rng, 15)} {x} {sentence(rng, 15)}") for k in (2, 3, 4)]
        own.append(x)
    got = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for g, x in enumerate(own):
        assert x in got[10 * g + 2].text and got[10 * g + 1].text == "" and got[10 * g + 1].duplicate_of == [10 * g]
        windows = len(got[10 * g + 3].text.split())
        assert got[10 * g + 3].duplicate_of in ([], [10 * g + 2]) and windows <= 55
    assert {k: (r.text.split(), r.duplicate_of) for k, r in got.items()} == brute_substrings(rows)


def test_copies_go_with_their_short_lines(spark):
    """A copy of a document loses its long lines as paragraphs and the short ones between them as windows."""
    rng = random.Random(17)
    text = "\n".join(sentence(rng, rng.choice([6, 9, 30, 40])) for _ in range(40))
    rows = [(1, text), (2, text), (3, f"{sentence(rng, 40)}\n{text}\n{sentence(rng, 40)}")]
    got = substrings(spark, rows)
    assert got == brute_substrings(rows) and len(got[2][0]) < 25 and len(got[3][0]) < 130


def test_families_of_near_paragraphs(spark, monkeypatch):
    """Families whose members are only partly alike, in blocks of a few paragraphs."""
    monkeypatch.setattr(substring, "BLOCK", 8)
    rng = random.Random(14)
    rows = []
    for _ in range(3):
        base = sentence(rng, 120).split()
        rows += [(len(rows) + k, " ".join(edited(rng, base, rng.choice([1, 2, 3])))) for k in range(50)]
    assert substrings(spark, rows) == brute_substrings(rows)


def test_rows_without_ids_are_documents_of_their_own(spark):
    rng = random.Random(15)
    x = sentence(rng, 60)
    rows = [(None, f"{sentence(rng, 20)} {x} {sentence(rng, 20)}") for _ in range(10)] + [(5, f"{sentence(rng, 9)} {x} {sentence(rng, 9)}")] + [(7, sentence(rng, 40))] * 3
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(x in r.text for r in got) == 1
    assert [r.n_removed for r in got if r.doc_id == 7] == [0, 0, 0]
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [0] + [1] * 9
    assert all(r.duplicate_of == [None] for r in got if r.n_removed)


def test_long_lines_are_whole():
    text = b"\n".join(b" ".join(b"w%d" % (i * 7 + k) for k in range(30)) for i in range(50))
    assert [len(x.split(b"\n")) for x in substring.line_blocks(text, 1000)][:-1] == [len(x.split(b"\n")) for x in substring.line_blocks(text, 1000)][:-1]
    assert b"\n".join(substring.line_blocks(text, 1000)) == text and len(list(substring.line_blocks(text, 1000))) > 3
    assert all(len(line.split()) == 30 for x in substring.line_blocks(text, 1000) for line in x.split(b"\n"))
