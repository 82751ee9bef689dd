"""Media, chats and toxicity against plain loops, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.llm import avi, chat, jpeg, toxicity

# ---- media


def test_media_round_trip(docs, none, clashing):
    for df in (docs, clashing):
        got = avi.digests(avi.media(df)).collect()
        assert len(got) == docs.count()
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, (r.text or "").encode())
        for r in got:
            t = texts[r.doc_id]
            payload = t + b" " * (max(1, -(-len(t) // 192)) * 192 - len(t))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(t), len(payload), hashlib.sha256(payload).hexdigest())
            assert r.tail_crc32 == zlib.crc32(payload[-16:])
            media = avi.store(t)
            assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert avi.digests(avi.media(none)).count() == 0
    by_text = {r.doc_id: r.feature for r in got}
    assert by_text[1] == by_text[2] and by_text[4] == by_text[5]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=9000))
def test_any_bytes(data):
    (parsed, frames, h), = avi.decode_clips([avi.store(data)])
    n, payload = avi.read_payload(parsed, frames)
    assert payload[:n] == data and payload[n:].strip(b" ") == b"" and len(payload) % 192 == 0
    assert len(h) == len(frames) and np.allclose(h.sum(1), 1)


def scalar_decode(frame):
    """One frame, bit by bit, as the standard says."""
    f = jpeg.parse(frame)
    codes = {}
    for key, (counts, symbols) in f.huffman.items():
        code, k, table = 0, 0, {}
        for size, n in enumerate(counts, 1):
            for _ in range(n):
                table[size, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        codes[key] = table
    segments, at = [], 0
    raw = f.scan
    start = 0
    while at < len(raw):
        if raw[at] == 0xFF and at + 1 < len(raw) and 0xD0 <= raw[at + 1] <= 0xD7:
            segments.append(raw[start:at])
            at = start = at + 2
        else:
            at += 1
    segments.append(raw[start:])
    across, down = f.grid()
    left = across * down
    out = [[] for _ in f.components]
    for seg in segments:
        bits = "".join(f"{b:08b}" for b in seg.replace(b"\xff\x00", b"\xff"))
        pos, before = 0, [0] * len(f.components)

        def symbol(table):
            nonlocal pos
            code = 0
            for size in range(1, 17):
                code = code << 1 | int(bits[pos])
                pos += 1
                if (size, code) in table:
                    return table[size, code]
            raise ValueError

        def value(size):
            nonlocal pos
            x = int(bits[pos : pos + size] or "0", 2)
            pos += size
            return x if not size or x >> (size - 1) else x - (1 << size) + 1

        for _ in range(min(left, f.interval or left)):
            for c, x in enumerate(f.components):
                for _ in range(x[1] * x[2]):
                    block = [0] * 64
                    before[c] += value(symbol(codes[0, x[4]]))
                    block[0] = before[c]
                    k = 1
                    while k < 64:
                        s = symbol(codes[1, x[5]])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            block[k] = value(s & 15)
                        k += 1
                    out[c].append(block)
            left -= 1
    return [np.array(x) for x in out]


def ordinary_frame(rng, width, height, sampling, interval):
    """A frame with zero runs, end-of-block codes, negative values and several sampling factors."""
    symbols = bytes([0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)])
    ac = (tuple([0] * 8 + [len(symbols)] + [0] * 7), symbols)
    dc = (tuple([0] * 3 + [12] + [0] * 12), bytes(range(12)))
    h, v = max(a for a, _ in sampling), max(b for _, b in sampling)
    units = -(-width // (8 * h)) * -(-height // (8 * v))
    bits, blocks, scan = "", [[] for _ in sampling], b""
    before = [0] * len(sampling)

    def put(table, symbol):
        code, k = 0, 0
        for size, n in enumerate(table[0], 1):
            for _ in range(n):
                if table[1][k] == symbol:
                    return f"{code:0{size}b}"
                code, k = code + 1, k + 1
            code <<= 1

    def amplitude(x):
        size = abs(x).bit_length()
        return size, f"{x if x > 0 else x + (1 << size) - 1:0{size}b}" if size else ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for u in range(units):
        if interval and u and u % interval == 0:
            scan += flush(bits) + bytes([0xFF, 0xD0 + (u // interval - 1) % 8])
            bits, before = "", [0] * len(sampling)
        for c, (a, b) in enumerate(sampling):
            for _ in range(a * b):
                block = [rng.randrange(-200, 200)] + [rng.choice([0, 0, 0, 0, rng.randrange(-90, 90)]) for _ in range(63)]
                if rng.random() < 0.3:
                    block[rng.randrange(1, 30) :] = [0] * (64 - len(block[: rng.randrange(1, 30)]))
                    block = (block + [0] * 64)[:64]
                blocks[c].append(block)
                size, raw = amplitude(block[0] - before[c])
                bits += put(dc, size) + raw
                before[c] = block[0]
                run = 0
                last = max([k for k in range(64) if block[k]] or [0])
                for k in range(1, last + 1):
                    if not block[k]:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + put(ac, 0xF0), run - 16
                    size, raw = amplitude(block[k])
                    bits += put(ac, run << 4 | size) + raw
                    run = 0
                if last < 63:
                    bits += put(ac, 0)
    return blocks, scan + flush(bits), dc, ac


@pytest.mark.parametrize("interval", [0, 1, 3])
@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)]])
def test_ordinary_frames(interval, sampling):
    rng = random.Random(interval)
    frames = []
    for _ in range(3):
        _, scan, dc, ac = ordinary_frame(rng, 40, 24, sampling, interval)
        table = bytes([0]) + bytes([3] * 64)
        sof = struct.pack(">BHHB", 8, 24, 40, len(sampling)) + b"".join(bytes([c + 1, a << 4 | b, 0]) for c, (a, b) in enumerate(sampling))
        sos = bytes([len(sampling)]) + b"".join(bytes([c + 1, 0]) for c in range(len(sampling))) + bytes([0, 63, 0])
        seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
        huff = b"\x00" + bytes(dc[0]) + dc[1] + b"\x10" + bytes(ac[0]) + ac[1]
        frames.append(b"\xff\xd8" + seg(0xDB, table) + seg(0xC0, sof) + seg(0xC4, huff) + (seg(0xDD, struct.pack(">H", interval)) if interval else b"") + seg(0xDA, sos) + scan + b"\xff\xd9")
    for frame, (f, got) in zip(frames, jpeg.decode(frames)):
        want = scalar_decode(frame)
        assert all((g == w).all() for g, w in zip(got, want))
        block = got[0][:1].astype(float) * 3
        flat = np.zeros((8, 8))
        flat.ravel()[jpeg.ZIGZAG] = block[0]
        u, x = np.meshgrid(range(8), range(8))
        basis = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
        pixels = np.clip(np.rint(basis @ flat @ basis.T + 128), 0, 255)
        assert np.abs(jpeg.samples(f, got[0][None])[0, 0].astype(int) - pixels).max() <= 1


def test_features_against_a_plain_decoder(spark):
    """Frames decoded bit by bit and transformed cell by cell: histograms, shots, and the query's feature."""
    rng = random.Random(4)
    texts = [b"", b"plain words " * 40, bytes(rng.randrange(32, 127) for _ in range(9000)) + b"a" * 7000 + "é日本".encode() * 1500, b"x" * 20000]
    flat = np.zeros((64, 64))  # cosine transform: place in the zigzag order to pixel
    for k, place in enumerate(jpeg.ZIGZAG):
        v, u = divmod(int(place), 8)
        for p in range(64):
            y, x = divmod(p, 8)
            c = (math.sqrt(0.5) if u == 0 else 1) * (math.sqrt(0.5) if v == 0 else 1) / 4
            flat[k, p] = c * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
    rows = spark.createDataFrame([(k, avi.store(t)) for k, t in enumerate(texts)], "doc_id long, media binary")
    got = {r.doc_id: r.feature for r in avi.digests(rows).collect()}
    for k, t in enumerate(texts):
        h = []
        for frame in avi.parse_avi(avi.store(t))["frames"]:
            f = jpeg.parse(frame)
            blocks = scalar_decode(frame)[0] * np.array(f.quantisation[f.components[0][3]])
            pixels = np.clip(np.rint(blocks @ flat + 128), 0, 255).astype(int)
            h.append([((pixels >= 16 * b) & (pixels < 16 * b + 16)).mean() for b in range(16)])
        h = np.array(h)
        change = [sum(abs(x - y) for x, y in zip(a, b)) / 2 for a, b in zip(h, h[1:])]
        mean = sum(change) / len(change) if change else 0
        limit = max(0.1, mean + 1.5 * (sum((c - mean) ** 2 for c in change) / len(change)) ** 0.5) if change else 1
        cuts = [0, *(i + 1 for i, c in enumerate(change) if c > limit), len(h)]
        frames, shots, millionths = got[k].split(";")
        assert frames == f"{len(h)} frames" and shots == ",".join(f"{a}-{b}" for a, b in zip(cuts, cuts[1:]))
        assert abs(int(millionths) - mean * 1e6) <= 2000  # a pixel on the edge of a bin may fall to either side
        (_, _, own), = avi.decode_clips([avi.store(t)])
        assert np.abs(own - h).max() < 0.01
    assert got[2].count("-") > 1


def test_shots_and_clips(spark):
    """A change of the picture is a cut; files without an index are walked; others give nothing."""
    dark, light = b"\x00" * 3072, bytes(range(200, 248)) * 64
    frames = jpeg.write_frames(dark * 5 + light * 4 + dark * 3, 4, 4)
    data = avi.write_avi(frames, 32, 32, fps=10)
    plain = data[: data.index(b"idx1")]
    plain = plain[:4] + struct.pack("<I", len(plain) - 8) + plain[8:]
    rows = spark.createDataFrame([(1, data), (2, plain), (3, b"no media"), (4, None), (5, b"")], "doc_id long, media binary")
    got = avi.clips(rows).orderBy("doc_id", "clip").collect()
    want = [(0, 5, 0.0, 0.5), (5, 9, 0.5, 0.9), (9, 12, 0.9, 1.2)]
    assert [(r.doc_id, r.first_frame, r.end_frame, round(r.start_s, 6), round(r.end_s, 6)) for r in got] == [(d, *w) for d in (1, 2) for w in want]


# ---- chats

CONVERSATIONS = [
    (1, 0, "system", "Be kind. ### \\### </turn>"),
    (1, 1, "user", "Hi\n### User: no"),
    (1, 2, "assistant", "x" * 1000 + "é🤖" * 300),
    (2, 0, "user", None),
    (2, 1, None, ""),
    (2, 2, "assistant", "\\"),
    (2, 2, "assistant", "\\"),
    (3, None, "Tool: a\\b", "###"),
    (None, 0, "user", "no id"),
    (4, 5, "assistant", "</turn>\n"),
    (4, 1, "User", "tie"),
    (4, 1, "User", "a tie"),
]


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        out[conv] = own
    return out


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("x"))
    segments = chat.format_log(chat.turns_to_events(rows, delta=7))
    whole = {r.conv_id: r.formatted for r in chat.conversations(segments).collect()}
    got = {r.conv_id: r for r in chat.conversation_digests(segments).collect()}
    for conv, own in brute_chat(CONVERSATIONS).items():
        turns = list(chat.read_turns(whole[conv]))
        assert sorted(turns) == sorted((r or "", t or "") for _, _, r, t in own)
        known = [n if n is not None else -1 for _, n, _, _ in own]
        if len(set(known)) == len(known):
            assert turns == [(r or "", t or "") for _, _, r, t in sorted(own, key=lambda x: x[1] if x[1] is not None else -1)]
        r = got[conv]
        loss = "".join(t for who, t in turns if who == "assistant")
        assert (r.n_turns, r.formatted_chars, r.loss_chars) == (len(own), len(whole[conv]), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.format_log(chat.turns_to_events(none))).count() == 0


EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"


def test_fold_of_events(spark):
    """Deltas, edits, branches, regenerations and deletions in any order of arrival."""
    story = [
        (1, "start", "user", None), (1, "delta", None, "a"), (2, "start", "assistant", None), (2, "delta", None, "wrong"), (1, "delta", None, "b"),
        (3, "start", "user", None), (3, "delta", None, "thanks"), (2, "regenerate", None, None), (2, "delta", None, "ri"), (3, "delta", None, "late"), (2, "delta", None, "ght"),
        (4, "start", "user", None), (4, "delta", None, "old"), (4, "edit", None, "new"), (4, "delta", None, "er"), (5, "start", "user", None), (5, "delete", None, None), (5, "delta", None, "late"),
        (6, "start", "assistant", None), (6, "delta", None, "x"), (4, "edit", None, "newest"), (7, "start", "user", None), (6, "branch", None, "y"), (8, "start", "assistant", None), (8, "delta", None, "z"),
    ]
    events = [(1, k, *x) for k, x in enumerate(story)]
    random.Random(1).shuffle(events)
    log = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string")
    got = sorted((r.place, r.message, r.role, r.text) for r in chat.fold(log).collect())
    assert [x[1:] for x in got] == [(1, "user", "ab"), (2, "assistant", "right"), (4, "user", "newest"), (6, "assistant", "y"), (8, "assistant", "z")]
    with pytest.raises(Exception, match="an event of kind odd"):
        chat.fold(log.withColumn("kind", F.lit("odd"))).collect()
    assert chat.fold(log.limit(0)).count() == 0


def brute_fold(events):
    """One conversation's events, one after another."""
    began, texts, roles, gone = {}, {}, {}, set()
    starts = {}
    for seq, m, kind, *_ in sorted(events, key=lambda e: e[:2]):
        if kind == "start":
            starts.setdefault(m, seq)
    for seq, m, kind, role, text in sorted(events, key=lambda e: e[:2]):
        began.setdefault(m, starts.get(m, seq))
        texts.setdefault(m, "")
        if kind == "start" and seq == starts[m]:
            roles[m] = role or ""
        elif kind == "delta":
            texts[m] += text or ""
        elif kind in ("edit", "branch", "regenerate"):
            texts[m] = "" if kind == "regenerate" else text or ""
        if kind in ("branch", "regenerate"):
            gone |= {x for x, b in {**starts, **began}.items() if began.get(m, seq) < b < seq}
        if kind == "delete":
            gone.add(m)
    return sorted((began[m], m, roles.get(m, ""), t) for m, t in texts.items() if m not in gone)


def test_fold_against_one_event_after_another(spark):
    rng = random.Random(2)
    events = []
    for conv in [None, *range(60)]:
        for seq in range(rng.randrange(1, 40)):
            kind = rng.choice(["start", "start", "delta", "delta", "delta", "edit", "branch", "regenerate", "delete"] if seq % 7 == 0 else ["start", "delta"])
            events.append((conv, seq, rng.randrange(12), kind, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "bc", "###"])))
    got = chat.fold(spark.createDataFrame(events, EVENTS)).collect()
    for conv in {e[0] for e in events}:
        assert sorted((r.place, r.message, r.role, r.text) for r in got if r.conv_id == conv) == brute_fold([e[1:] for e in events if e[0] == conv])


def test_logs_hold_every_kind_of_event(spark):
    rows = spark.createDataFrame([(k % 9, k, "user", f"{'long ' * (k % 40)}{k}") for k in range(400)], "conv_id long, turn long, role string, text string")
    log = chat.turns_to_events(rows, delta=50)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "branch", "regenerate", "delete"}
    got = sorted((r.conv_id, r.place.turn, r.role, r.text) for r in chat.fold(log).collect())
    assert got == sorted((r.conv_id, r.turn, r.role, r.text) for r in rows.collect())


def test_a_very_long_text_comes_back(spark):
    text = "é ### </turn> \\ " * 200_000
    segments = chat.format_log(chat.turns_to_events(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")))
    r = chat.conversation_digests(segments).first()
    assert (r.loss_chars, r.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("\\#</turn>: a\n"), max_size=20), max_size=5))
def test_escaping_is_reversible(texts):
    def esc(x):
        for c in ("\\", "###", "</turn>"):
            x = x.replace(c, "\\" + c)
        return x

    formatted = "".join(f"### User: {esc(t)}</turn>\n" for t in texts)
    assert [t for _, t in chat.read_turns(formatted)] == texts


# ---- toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo") for b in ("ra", "te", "nu") for c in ("s", "n", "ver", "del")]
    bad = ["zgrub", "zgrubby", "vexfool", "vexfoolish"]
    rows, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.2
        sentences = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 12))) for _ in range(rng.randrange(1, 25))]
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = f"{sentences[at]} {rng.choice(bad)}{rng.choice(['', 'en', 'ish'])}"
        rows.append((k, ". ".join(sentences) + "."))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus(900, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    y = dict(labels)
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model, with_sentences=True).collect()}
    held = [k for k in y if k % 3 == 0]
    right = sum((got[k].score >= 0.3) == bool(y[k]) for k in held)
    assert right >= 0.97 * len(held)
    text = dict(rows)
    for k in held:
        if y[k] and got[k].score >= 0.3:
            top = max(got[k].sentences, key=lambda s: s.score)
            assert any(b in text[k][top.start : top.end] for b in ("zgrub", "vexfool"))
    clean = toxicity.keep_clean(docs, model, 0.3)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, r in got.items() if r.score < 0.3}


def test_scores_are_the_noisy_or_of_sentences(spark):
    """Scores and sentences against a plain reading of the model."""
    rows, labels = corpus(300, 4)
    rows = [(k, t.upper() if k % 5 == 0 else t) for k, t in rows] + [(900, None), (901, ""), (902, "!?\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.weights) > 3
    got = {r.doc_id: r for r in toxicity.score(docs, model, with_sentences=True).collect()}
    for k, t in rows:
        clean, sentences = 1 - model.leak, []
        for m in re.finditer(r"[^.!?\n]*[.!?\n]*", t or ""):
            own = {f for w in re.findall(r"\w+", m[0].lower()) for f in [f"w:{w}"] + [f"{n}:{w[:n]}" for n in (4, 5) if len(w) >= n]}
            words = {w for w in re.findall(r"\w+", m[0].lower())}
            total = sum(model.weights[f] for w in words for f in [f"w:{w}"] + [f"{n}:{w[:n]}" for n in (4, 5) if len(w) >= n] if f in model.weights)
            if own & set(model.weights):
                p = 1 / (1 + math.exp(-min(40, max(-40, model.bias + total))))
                clean *= 1 - p
                sentences.append((m.start(), m.end(), p))
        assert abs(got[k].score - (1 - clean)) < 1e-9
        assert [(s.start, s.end) for s in got[k].sentences] == [x[:2] for x in sentences]
        assert all(abs(s.score - x[2]) < 1e-9 for s, x in zip(got[k].sentences, sentences))


def test_features_follow_one_rule(spark):
    """What has a weight, counted by hand; twice the rows with the same shares: the same features and more."""
    rows, labels = corpus(400, 5)
    y, n = dict(labels), Counter(v for _, v in labels)
    for times in (1, 2):
        docs = [(k + 10**6 * i, f"{t} copy{i}x{k}") for k, t in rows for i in range(times)]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        model = toxicity.fit(df, spark.createDataFrame([(k, y[k % 10**6]) for k, _ in docs], "doc_id long, toxic int"))
        counts = Counter((f, y[k % 10**6]) for k, t in docs for f in {f for w in re.findall(r"\w+", t.lower()) for f in toxicity.features(w)})
        want = set()
        for f in {f for f, v in counts if v}:
            a, b = counts[f, 1], counts[f, 0]
            due = (b + 0.5) / (n[0] * times + 1) * n[1] * times
            lift = math.log((a + 0.5) / (n[1] * times + 1)) - math.log((b + 0.5) / (n[0] * times + 1))
            if lift > toxicity.LIFT and 2 * (a * math.log(a / due) - (a - due)) >= toxicity.EVIDENCE:
                want.add(f)
        assert want and set(model.weights) == want


def test_noisy_or_gradient_learns_one_bad_sentence():
    rng = np.random.default_rng(1)
    y, bag, sentence, feature = [], [], [], []
    for k in range(200):
        toxic = k % 4 == 0
        for s in range(6):
            bag.append(k)
            sentence.append(len(bag) - 1)
            feature.append(1 if toxic and s == 2 else 0)
        y.append(toxic)
    bias, leak, w = toxicity.train_bags(np.array(y), np.array(bag), np.array(sentence), np.array(feature), 2)
    p = 1 / (1 + np.exp(-(bias + w)))
    assert p[1] > 0.8 and 1 - (1 - leak) * (1 - p[0]) ** 6 < 0.2 and rng is not None


def test_toxicity_edge_cases(spark, docs, none, clashing):
    labels = spark.createDataFrame([(1, 1), (3, None), (8, 0), (9, 0), (10, 0), (10, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    for df in (docs, clashing):
        scores = toxicity.score(df, model).collect()
        assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, labels).leak == 0 and toxicity.fit(docs, labels.where("toxic = 1")).leak == 1
    long = spark.createDataFrame([(1, "Some clean words. " * 5000)], "doc_id long, text string")
    assert toxicity.score(long, toxicity.Model(0.0, 0.01, {"w:foul": 5.0})).first().score == 0.01
