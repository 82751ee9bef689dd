"""Tokenizing, packing and token files against the tokenizers library and plain loops."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm import bpe, encode, packing, planes, tokens
from loomwright.llm.common import shared_folder

PATH = encode.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton.loads(bpe.compiled(PATH))


def ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, np.uint32)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_tokenize_like_library(spark, docs, none, clashing, library):
    want = sorted((str(r.doc_id), len(i), sha(i.tobytes()), sha(library.decode(i.tolist(), skip_special_tokens=False).encode())) for r in docs.collect() for i in [ids(library, r.text)])
    for df in (docs, clashing):
        got = tokens.tokenize(df, PATH, with_ids=True, with_decoded=True).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
        assert all(sha(np.array(r.ids, np.uint32).tobytes()) == r.ids_sha256 and sha(r.decoded.encode()) == r.decoded_sha256 for r in got)
    assert tokens.tokenize(none, PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcAB'sSt!.,<|>éÉİ́̌J \n\x85\xa0")), max_size=60))
def test_encoders_on_any_text(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_encoders_on_any_text, "t") else test_encoders_on_any_text.t
    test_encoders_on_any_text.t = library
    a = getattr(test_encoders_on_any_text, "a", None) or bpe.automaton_encoder(bpe.Automaton.loads(bpe.compiled(PATH)))
    test_encoders_on_any_text.a = a
    want = library.encode(text, add_special_tokens=False).ids
    for e in (a, encode.library_encoder(PATH)):
        assert next(e.encode([text.encode()])).tolist() == want


def test_small_cache_and_long_text(library, automaton):
    text = " ".join(f"word{k} Thing{k % 7}," for k in range(200_000))
    for limit in (10, 500_000):
        e = bpe.automaton_encoder(automaton)
        e.limit = limit
        assert sha(next(e.encode([text.encode()])).tobytes()) == sha(ids(library, text).tobytes())


def test_gadgets_by_hand():
    """Symbols a, b (0, 1) and merges aa -> 2, ab -> 3, 2 b -> 4: allowed sequences are the merged ones."""
    merges = [(0, 0, 2), (0, 1, 3), (2, 1, 4)]
    allowed, column, target = bpe.gadgets(5, [0, 1], merges)
    parts = {0: (0,), 1: (1,), 2: (0, 0), 3: (0, 1), 4: (0, 0, 1)}

    def merged(symbols):
        seq = list(symbols)
        for u, v, m in merges:
            out, i = [], 0
            while i < len(seq):
                if seq[i : i + 2] == [u, v]:
                    out.append(m)
                    i += 2
                else:
                    out.append(seq[i])
                    i += 1
            seq = out
        return seq

    def paths(symbols, state):
        if not symbols:
            yield []
        for t, p in parts.items():
            if symbols[: len(p)] == p and allowed[state, column[t]]:
                yield from ([t, *rest] for rest in paths(symbols[len(p) :], target[t]))

    for n in range(1, 9):
        for bits in range(2**n):
            symbols = tuple(bits >> k & 1 for k in range(n))
            assert list(paths(symbols, 0)) == [merged(symbols)]


def check_pieces(rows, want):
    """Every id in exactly one piece, sequences gapless; want: ids by document."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[d])
            assert r.ids_crc32 == zlib.crc32(want[d][r.start : r.start + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(want[d])
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing(spark, docs, none, clashing, library):
    rows = docs.dropDuplicates(["doc_id"])
    want = {r.doc_id: np.append(ids(library, r.text), 1) for r in rows.collect()}
    assert check_pieces(packing.pack_documents(rows, PATH).collect(), want) == 0
    assert check_pieces(packing.pack_documents(clashing.dropDuplicates(["doc_id"]), PATH, with_ids=True).collect(), want) == 0
    assert packing.pack_documents(docs, PATH).where("doc_id = 2").agg({"length": "sum"}).first()[0] == 2 * len(want[2])
    assert packing.pack_documents(none, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_pack_covers_and_balances(lengths):
    pieces = packing.pack(np.array(lengths, np.int64))
    seen, fill = defaultdict(set), defaultdict(int)
    for d, s, n, q, o in pieces:
        assert not seen[d] & set(range(s, s + n))
        seen[d] |= set(range(s, s + n))
        fill[q] += n
    assert all(seen[d] == set(range(n)) for d, n in enumerate(lengths))
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())


def test_pack_takes_cheapest():
    """Equal documents spread evenly over the sequences: costs differ by one document at most."""
    pieces = packing.pack(np.full(64, 512, np.int64))
    cost = defaultdict(float)
    for _, _, n, q, _ in pieces:
        cost[q] += n + n * n / 4096
    assert len(cost) == 16 and len(set(cost.values())) == 1


def test_token_files(spark, docs, none, clashing, library):
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(3)
    got = {r.doc_id: r for r in planes.stored_tokens(rows, PATH).collect()}
    at = 0
    for r in sorted(rows.collect(), key=lambda r: r.doc_id):
        own = np.append(ids(library, r.text), 2)
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(own), zlib.crc32(own.astype("<u4").tobytes()))
        at += len(own)
    assert planes.stored_tokens(docs, PATH).count() == docs.count()
    assert planes.stored_tokens(none, PATH).count() == 0
    ordered = lambda df: sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in planes.stored_tokens(df, PATH).collect())
    named = clashing.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for c in ("ids", "n_tokens", "file", "part", "position", "offset", "d", "payload"):
        named = named.withColumn(c, F.lit("x"))
    assert ordered(named) == sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got.values())


def test_files_with_a_decoder_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["decoder"] = {"type": "ByteLevel"}
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="ByteLevel"):
        bpe.compile_automaton(str(tmp_path / "t.json"))


@pytest.mark.parametrize("bits", [False, True])
def test_plane_ranges(spark, tmp_path, bits):
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (0, 1, 70_000, 3, 200_000, 65_536)]
    with open(tmp_path / "f", "wb") as f:
        w = planes.PlaneWriter(f, block_ids=4096, bits=bits)
        for k, p in enumerate(parts):
            w.add(k, p)
        w.close()
    whole = np.concatenate(parts)
    with open(tmp_path / "f", "rb") as f:
        r = planes.PlaneReader(f)
        assert [(d, n, c) for d, n, c in r.documents()] == [(k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(parts)]
        for a, b in ((0, 0), (0, 5), (4000, 5000), (70_000, 270_000), (len(whole) - 1, len(whole))):
            assert (r.ids(a, b) == whole[a:b]).all()


def test_unlisted_files_do_not_count(spark, docs):
    folder = shared_folder(spark, "files")
    manifest = planes.write_token_files(docs, PATH, folder)
    n = planes.read_token_files(manifest).count()
    store, at = planes.open_store(folder)
    with store.open_output_stream(f"{at}/part-000000-left-by-a-lost-task.planes") as f:
        f.write(b"half a file")
    assert planes.read_token_files(planes.read_manifest(spark, folder)).count() == n == docs.count()
