"""What the driver's tables can't tell apart: rules on small frames, with expected values by plain Python."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import arrays as R
from loomwright.functions import text as T
from loomwright.operators import choices as C
from loomwright.operators import dialogue as D
from loomwright.operators import evaluation as E
from loomwright.operators import matrices as M
from loomwright.operators import quality as Q
from loomwright.operators import splits as S
from loomwright.operators import tokens as K
from loomwright.operators import vectors as V
from loomwright.sources import readers, sinks

WEIRD = ["a b", " x　 y\x85", "\x1ca\x1d\x1eb\x1f", "tab\tline\r\nend ", "", "   ", "Straße", "ﬁ ‍ z", "﻿q"]


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_white_space_is_pythons(spark):
    assert one(spark, WEIRD, T.collapse_ws) == [re.sub(r"\s+", " ", s).strip() for s in WEIRD]
    assert one(spark, WEIRD, T.question_key) == [re.sub(r"\s+", "", s) for s in WEIRD]
    assert one(spark, WEIRD, T.token_count) == [len(s.split()) for s in WEIRD]
    assert one(spark, WEIRD, T.strip) == [s.strip() for s in WEIRD]
    assert one(spark, [None], T.collapse_ws) == [""] and one(spark, [None], T.token_count) == [0]


def test_casefold_and_length(spark):
    assert one(spark, ["Straße", "STRASSE"], T.dedup_key) == ["strasse", "strasse"]
    assert one(spark, ["a😀b"], F.length) == [3]


def test_scripts(spark):
    text = "Aé Łż α я 中 한 සිං ශ්‍රී தமிழ் 😀 € → 1+\x7f ½ ﬀ Ⰰ"
    df = spark.createDataFrame([(1, text), (2, "A"), (3, None)], "doc_id long, text string")
    got = {r.script: (r.n_chars, r.n_records) for r in Q.character_scripts(df).collect()}
    want = {}
    for d, t in ((1, text), (2, "A")):
        for ch in t:
            c = ord(ch)
            if c < 0x41 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7E:
                continue
            name = next((n for a, b, n in T.UNICODE_BLOCKS if a <= c <= b), None)
            if name and name not in T.IGNORED_BLOCKS:
                want.setdefault(name, []).append(d)
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    assert got["English / Basic Latin"] == (3, 2)


def test_keep_script(spark):
    s = "සිංහල ශ්‍රී Абв 中文　x é – — … <>$^_`   ok"
    kept = re.compile("[^඀-෿a-zA-Z0-9\\s.,!?;:'\"()\\[\\]{}\\-–—…%@#&*+=/‍]")
    assert one(spark, [s], T.keep_script) == [kept.sub("", s.replace("　", ""))]


#: Texts and what is left of them.
ARTIFACTS = [
    ('පහයි. සෞඛ්\u200dයය foo', '5. foo'),
    ('x පහයි. y', 'x පහයි. y'),
    ('1. සෞඛ්\u200dයය මෘදු foo', '1. foo'),
    ('go 2. සෞඛ්\u200dයය one 3. මෘදු two', 'go 2. one 3. two'),
    ('a [25වන පිටුවේ පින්තූරය] b [ පිටුව 3 වන පිටුවේ පින්තූරය ] c', 'a b c'),
    ('head [සංස්කරණය] and [සංස්කරණය කරන්න] but සංස්කරණය stays', 'head and but සංස්කරණය stays'),
    ('a\n\n\n\nb  c , d !  \nend \t', 'a\n\nb c, d!\nend'),
    ('දහයයි. සීමාව q\n  විස්සයි. z', '10. q\n 20. z'),
    ('', ''),
]


def test_artifacts_to_fixpoint(spark):
    texts = [t for t, _ in ARTIFACTS]
    got = one(spark, texts, T.clean_artifacts)
    assert got == [w for _, w in ARTIFACTS]
    assert one(spark, got, T.clean_artifacts) == got
    assert one(spark, texts, lambda c: T.clean_artifacts(c, passes=5)) == got
    assert one(spark, ["1. සෞඛ්‍යය මෘදු foo"], lambda c: T.clean_artifacts(c, passes=1)) != ["1. foo"]


def test_bracket_clean_and_context(spark):
    s = ["x [title] y [step] z  w", "[header] a"]
    want = [re.sub(r"\[.*?\]", "", t.strip().replace(" [title]", ". ")).replace("  ", " ") for t in s]
    assert one(spark, s, T.bracket_clean) == want
    assert one(spark, ["hELLO World", ""], T.capitalize) == ["Hello world", ""]


def test_degenerate(spark):
    loops = ["a b c d e " * 10, "w " * 20]
    fine = ["w " * 19, " ".join(f"u{i}" for i in range(40)), " ".join(f"u{i}" for i in range(60)) + " p q r s t" * 3, ""]
    assert one(spark, loops + fine, Q.degenerate) == [True] * 2 + [False] * 4


def test_casefold(spark):
    """Python's full case folding, of every character that the rule knows and of words."""
    words = ["ΟΔΟΣ", "οδος", "Straße", "ﬁn ﬂ ﬃ", "ſee", "ẞ", "İstanbul", "ŉ", "ΐ ΰ", "ꭰ Ꭰ", "plain", "", "ﬓ և", "ᾳ ᾲ ᾷ", "µ ϐ ϑ ẛ"]
    letters = [c for c in map(chr, range(0x20, 0x1E944)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c.lower()]
    assert len(letters) > 150
    values = words + letters
    got = one(spark, values, T.casefold)
    assert got == [v.casefold() for v in values]


def plain_hits(texts, rules, tidy, passes=4):
    hits, n_texts = {n: 0 for n, _, _ in rules + tidy}, {n: 0 for n, _, _ in rules + tidy}
    for t in texts:
        own = {n: 0 for n in hits}
        for _ in range(passes):
            before = dict(own)
            for n, pattern, to in rules:
                t, k = re.subn(pattern, to.replace("$", "\\"), t)
                own[n] += k
            if own == before:
                break
        for n, pattern, to in tidy:
            t, k = re.subn(pattern, to.replace("$", "\\"), t)
            own[n] += k
        for n, k in own.items():
            hits[n] += k
            n_texts[n] += k > 0
    return {n: (hits[n], n_texts[n]) for n in hits}


def test_rule_hits_count_every_pass(spark):
    rules = [("word", r"(\d\. )(?:aa|bb) ", "$1"), ("mark", r"\(x\)", " ")]
    tidy = [("spaces", r"[ \t]{2,}", " "), ("before", r" +([,.])", "$1")]
    texts = ["1. aa bb aa bb aa rest", "1. aa x (x) , y", "nothing", "", "2. bb z  3. aa aa y (x)(x) ."]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = {r.rule: (r.n_hits, r.n_texts) for r in Q.rule_hits(df, rules, tidy=tidy).collect()}
    assert got == plain_hits([*texts, ""], rules, tidy) and got["word"][0] == 9 - 1


def test_hashed_ngrams(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 1, 4, 5, 6, 20, 60)]
    grams = [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for t in texts for w in [t.split()]]
    assert one(spark, texts, lambda c: F.size(F.array_distinct(T.hashed_ngrams(T.tokens(c), 5)))) == grams
    most = [max([w.count(x) for x in w] or [0]) for t in texts for w in [t.split()]]
    for k in (1, 2, 5, 12):
        assert one(spark, texts, lambda c: T.occurs(T.tokens(c), k)) == [m >= k for m in most]


def test_continuation(spark):
    rows = [([1, 2], [1, 2, 3, 4], [9]), ([1, 2], [1, 7, 3], [3]), ([1, 2], [1, 2], [5]), ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [6]), ([1, 2, 3], [1, 2, 3, 4, 5, 6, 7, 8], [0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, c array<int>, w array<int>, a array<int>")
    got = [tuple(r[0]) for r in df.orderBy("i").select(R.continuation(F.col("c"), F.col("w"), F.col("a"), 4)).collect()]
    assert got == [([1, 2, 3, 4], 2), ([1, 2, 3], 2), ([1, 2, 5], 2), ([3, 4, 5, 6], 3), ([5, 6, 7, 8], 1)]


def play(template, messages, **names):
    """A Jinja template of if, elif, else, for and plain expressions, as Python code."""
    code, depth = ["def f(messages, add_generation_prompt=False):", " out = []"], 1
    for part in re.findall(r"\{%.*?%\}|\{\{.*?\}\}", template, re.S):
        body = part[2:-2].strip()
        if part[1] == "{":
            code.append(" " * depth + f"out.append({body})")
        elif body.startswith("end"):
            depth -= 1
        elif body.startswith("for"):
            code.append(" " * depth + "for at, message in enumerate(messages):")
            depth += 1
        else:
            depth -= body.startswith("el")
            code.append(" " * depth + body.replace("loop.first", "(at == 0)") + ":")
            depth += 1
    scope = {}
    exec("\n".join([*code, " return ''.join(out)"]), scope)
    return scope["f"](messages, **names)


@pytest.mark.parametrize("settings_", [{}, {"bos": "<s>", "system_prompt": "Be \"kind\".\n"}, {"user_prefix": "U: ", "eos": "</s>", "turn_separator": "\n"}])
def test_chat_template_is_the_rendering(spark, settings_):
    t = D.Template.of(settings_)
    chats = [[("system", "S"), ("user", "a {b}"), ("assistant", "c")], [("user", "x\ny"), ("assistant", "z"), ("user", "w")], [("user", "u"), ("system", "late")]]
    df = spark.createDataFrame([(i, [(c, r) for r, c in m]) for i, m in enumerate(chats)], "i long, m array<struct<content:string,role:string>>")
    for generation in (False, True):
        got = [r[0] for r in df.orderBy("i").select(D.render(F.col("m"), t, generation)["text"]).collect()]
        assert got == [play(t.chat_template(), [{"role": r, "content": c} for r, c in m], add_generation_prompt=generation) for m in chats]


def test_positions_of_percentiles(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x long")
    r = Q.length_stats(df, {"x": F.col("x")}).first()
    assert (r["median"], r.p10, r.p90) == (3, 1, 4)
    assert {x.p: x.length for x in K.length_distribution(df, F.col("x"), [0, 50, 99.9, 100]).collect()} == {0: 1, 50: 3, 99.9: 4, 100: 4}


@pytest.mark.parametrize("n,sizes", [(1, [1, 0, 0]), (2, [1, 1, 0]), (3, [1, 1, 1]), (5, [3, 1, 1]), (25, [21, 2, 2]), (100, [80, 10, 10])])
def test_split_sizes(spark, n, sizes):
    df = spark.createDataFrame([(i, 0) for i in range(n)], "i long, label int")
    got = {r["split"]: r["count"] for r in S.stratified_split(df, "label", "x", "i").groupBy("split").count().collect()}
    assert [got.get(s, 0) for s in ("train", "val", "test")] == sizes


def test_first_of_ties(spark):
    assert one(spark, [[1.0, 3.0, 3.0]], R.argmax, "array<double>") == [1]
    df = spark.createDataFrame([("m", 5, 1.0), ("m", 2, 1.0), ("m", 9, 0.5)], "k string, step long, v double")
    assert E.best_epoch(df, ["k"], "v", "step").first().best_step == 2
    cells = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 1.0), ("y", "a", 2.0), ("y", "b", 1.0), ("z", "a", None)], "c string, m string, v double")
    assert [tuple(r) for r in E.winners(cells, "c", "m", "v").collect()] == [("y", "a")]


def test_ledger_counts_duplicates_before_later_rules(spark):
    """A copy of an item that a later rule drops counts as duplicate."""
    rows = [(1, "same", 3), (2, "same", 3), (3, "", 4)]
    df = spark.createDataFrame(rows, "i long, q string, n int").withColumn("reason", Q.first_reason([("empty", F.col("q") == "")]))
    first = df.where("reason IS NULL").groupBy("q").agg(F.min("i").alias("first"))
    late = Q.first_reason([("duplicate", F.col("i") > F.col("first")), ("collapsed", F.col("n") < 4)])
    got = {r.reason: r.n for r in Q.ledger(df.join(first, "q", "left").withColumn("reason", F.coalesce("reason", late))).collect()}
    assert got == {"empty": 1, "duplicate": 1, "collapsed": 1}


@pytest.mark.parametrize("b01,b10", [(0, 0), (3, 3), (10, 2)])
def test_mcnemar(spark, b01, b10):
    rows = [(True, False)] * b01 + [(False, True)] * b10 + [(True, True)] * 4
    r = E.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean"), F.col("a"), F.col("b")).first()
    n = b01 + b10
    chi2 = (abs(b01 - b10) - 1) ** 2 / n if n else 0
    assert (r.b01, r.b10) == (b01, b10) and r.chi2 == pytest.approx(chi2, abs=1e-6)
    assert r.p == pytest.approx(math.erfc(math.sqrt(chi2 / 2)) if n else 1, abs=1e-6)


def test_reports_with_unparsed_predictions(spark):
    df = spark.createDataFrame(list(zip("aabbca", ["a", None, "b", "a", "UNK", "b"])), "g string, p string")
    s = E.class_summary(df, "g", "p", ["a", "b", "c", "d"]).first()
    assert (s.n, s.n_unparsed) == (6, 2)
    assert [s.micro_precision, s.micro_recall, s.accuracy] == pytest.approx([1 / 2, 1 / 3, 1 / 3], abs=1e-6)
    assert [s.macro_precision, s.macro_recall, s.macro_f1] == pytest.approx([0.25, 5 / 24, 0.225], abs=1e-6)
    assert s.weighted_f1 == pytest.approx((3 * 0.4 + 2 * 0.5) / 6, abs=1e-6)
    m = {r.gold: r.asDict() for r in E.confusion(df, "g", "p", ["a", "b"]).collect()}
    assert m["a"]["accuracy"] == 0.5 and (m["a"]["a"], m["a"]["b"]) == (1, 1)


def messages(*turns):
    return [{"content": c, "role": r} for r, c in turns]


def test_dialogue_repair(spark):
    u, a, s = "user", "assistant", "system"
    cases = [
        messages((u, "q"), (a, "r")),
        messages((u, "q"), (a, "r"), (u, "late")),
        messages((u, " "), (a, "r")),
        messages((u, "q"), (a, "")),
        messages((u, "q"), (a, "r"), (u, ""), (a, "r")),
        messages((u, "q"), (a, "r"), (u, "q"), (a, None)),
        messages((s, "x"), (u, "q"), (a, "r")),
        messages((s, "x"), (u, "q"), (a, ""), (u, "z"), (a, "r")),
        messages((u, "q"), (u, "q")),
        [],
    ]

    repaired = [(2, None), (0, "not_assistant_last"), (0, "no_content_before_empty_turn"), (0, "no_content_before_empty_turn"), (2, "truncated_at_empty_turn"), (2, "truncated_at_empty_turn"), (3, None), (0, "not_assistant_last"), (0, "not_assistant_last"), (0, "empty")]
    trimmed = [2, 2, 2, 2, 4, 4, 3, 5, 0, 0]
    prepared = [(2, None), (2, None), *repaired[2:8], (0, "no_assistant_turn"), (0, "no_assistant_turn")]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(cases)], "i long, m array<struct<content:string,role:string>>")
    got = df.orderBy("i").select(D.repair(F.col("m")).alias("r"), F.size(D.trim(F.col("m"))).alias("t"), D.prepare(F.col("m"), T.strip).alias("p")).collect()
    assert [(len(x.r.messages), x.r.reason) for x in got] == repaired
    assert [x.t for x in got] == trimmed
    assert [(len(x.p.messages), x.p.reason) for x in got] == prepared


def test_render_spans(spark):
    t = D.Template.of({"bos": "<s>", "system_prompt": "Be kind."})
    m = messages(("user", "hé"), ("assistant", "yes😀"), ("user", ""), ("assistant", "no"))
    df = spark.createDataFrame([(m,)], "m array<struct<content:string,role:string>>")
    r = df.select(D.render(F.col("m"), t, generation=True).alias("r")).first().r
    assert r.text == "<s>### System:\nBe kind.\n\n### User:\nhé\n\n### Assistant:\nyes😀<|end_of_text|>\n\n### User:\n\n\n### Assistant:\nno<|end_of_text|>\n\n### Assistant:\n"
    assert [r.text[x.s : x.e] for x in r.spans] == ["yes😀<|end_of_text|>", "no<|end_of_text|>"]
    with pytest.raises(ValueError, match="unknown"):
        D.Template.of({"color": "red"})
    assert len(t.fingerprint()) == 10 and t.fingerprint() != D.Template().fingerprint()


def test_wraps(spark):
    prompt = "Task one.\nBody 1\nAnswer: 2\n\nTask two. Answer: hidden\nBody 2\nAnswer: "
    got = one(spark, [prompt], lambda c: C.wrap_blocks(c, C.CHAT, "Answer:", end=C.CHAT_END))[0]

    assert got == (
        "### User:\nTask one.\n\nBody 1\n\n### Assistant:\nAnswer: 2<|end_of_text|>\n\n"
        "### User:\nTask two. Answer: hidden\n\nBody 2\n\n### Assistant:\nAnswer: "
    )
    assert C.template_of("\nx 1, 2,3 , 4 y 1,2,3,4\n") == "x [NUMS] y 1,2,3,4"


def test_masks_and_chunks(spark):
    ids = list(range(10, 20))
    assert one(spark, [ids], lambda c: R.mask_prefix(c, F.lit(3)), "array<int>") == [[-100] * 3 + ids[3:]]
    assert one(spark, [[]], lambda c: R.chunks(c, 4, 2, 3), "array<int>") == [[[]]]

    for n in range(1, 12):
        got = one(spark, [list(range(n))], lambda c: R.chunks(c, 4, 3, 3), "array<int>")[0]
        assert got == [list(range(n))[3 * k : 3 * k + 4] for k in range(min(3, 1 + max(0, math.ceil((n - 4) / 3))))]
    df = spark.createDataFrame([([1, 2, 3], [(0, 2), (2, 5), (5, 7)], [(2, 7)], [2, 5])], "ids array<int>, o array<struct<s:int,e:int>>, sp array<struct<s:int,e:int>>, ends array<int>")
    r = df.select(R.mask_spans(F.col("ids"), F.col("o"), F.col("sp")).alias("m"), R.cut_at_turn(F.lit(9), F.col("ends"), 4).alias("a"), R.cut_at_turn(F.lit(9), F.col("ends"), 1).alias("b"), R.cut_at_turn(F.lit(3), F.col("ends"), 4).alias("c")).first()
    assert (r.m, r.a, r.b, r.c) == ([-100, 2, 3], 2, 1, 3)


def test_packing_by_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i // 4, [int(x) for x in rng.integers(0, 9, rng.integers(0, 9))]) for i in range(20)]
    df = spark.createDataFrame(rows, "i long, b long, ids array<int>")
    want, short = [], []
    for b in range(5):
        flat = [x for i, g, ids in rows if g == b for x in ids]
        want += [flat[k : k + 6] for k in range(0, len(flat) // 6 * 6, 6)]
        short += [flat[k : k + 40] for k in range(0, max(len(flat) // 40 * 40, 1 if flat else 0), 40)]
    assert [r.ids for r in K.pack_blocks(df, "ids", "i", F.col("b"), 6).orderBy("batch", "block").collect()] == want
    assert [r.ids for r in K.pack_blocks(df, "ids", "i", F.col("b"), 40, keep_short=True).orderBy("batch", "block").collect()] == short
    assert all(r.ids[0] == 7 and len(r.ids) == 5 for r in K.pack_blocks(df, "ids", "i", F.col("b"), 5, head=7).collect())


def test_budget_batches(spark):
    """Longest first; every batch is within the limits, and would not be with the next row."""
    sizes = [5, 9, 3, 3, 3, 20, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i long, n long")
    rows = sorted(K.budget_batches(df, ["i"], "n", 90, 4).collect(), key=lambda r: (-r.n, r.i))
    assert [r.batch for r in rows] == sorted(r.batch for r in rows)
    batches = [[r.n for r in rows if r.batch == b] for b in range(rows[-1].batch + 1)]
    fits = lambda b: len(b) <= 4 and len(b) * max(b) ** 2 <= 90
    assert all(fits(b) or len(b) == 1 for b in batches)
    assert not any(fits(b + c[:1]) for b, c in zip(batches, batches[1:]))


def test_divergence(spark):
    a = spark.createDataFrame([("x", 3), ("y", 1)], "token string, n long")
    b = spark.createDataFrame([("x", 1), ("z", 1)], "token string, n long")
    assert K.kl_divergence(a, a).first().kl == 0
    assert K.kl_divergence(a, b).first().kl == pytest.approx(0.75 * math.log(1.5) + 0.25 * math.log(0.25 / 1e-12), abs=1e-5)
    m = E.total_variation(spark.createDataFrame([(0, 3), (1, 1)], "option long, n long"), spark.createDataFrame([(0, 1), (1, 3)], "option long, n long"))
    assert m.first().tvd == 50
    none = spark.createDataFrame([(0, 0), (1, 0)], "option long, n long")
    assert math.isnan(E.total_variation(none, none).first().tvd)


def test_perplexity_caps(spark):
    df = spark.createDataFrame([("a", 2.0, 1), ("a", 4.0, 3), ("b", 800.0, 1)], "k string, loss double, w long")
    got = {r.k: r.perplexity for r in E.perplexity(df, ["k"], "loss", "w").collect()}
    assert got["a"] == pytest.approx(math.exp(3.5), abs=1e-5) and got["b"] == math.inf


def test_rotation_average_ignores_rotation(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(20):
        base = rng.normal(size=4)
        want[i] = int(base.argmax())
        rows += [(i, r, s, float(base[(s + r) % 4])) for r in range(4) for s in range(4)]
    got = {r.item_idx: r.pred for r in E.rotation_average(spark.createDataFrame(rows, "item_idx long, rot int, slot int, score double")).collect()}
    assert got == want


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    x[0] = 0
    x[1] = x[2]
    x[3] = -x[4]
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "k long, v array<float>, g int")
    y = x.astype(np.float64)
    n = np.linalg.norm(y, axis=1, keepdims=True)
    unit = np.divide(y, n, out=np.zeros_like(y), where=n > 0)
    got = {r.g: r for r in V.intra_cosine(df, "v", "g").collect()}
    for g in range(3):
        u = unit[g::3]
        pairs = [u[i] @ u[j] for i in range(len(u)) for j in range(len(u)) if i != j and (u[i].any() and u[j].any())]
        assert got[g].mean_cosine == pytest.approx(sum(pairs) / (len(u) * (len(u) - 1)), abs=1e-5)
    mean, cov = V.mean_covariance(df, "v")
    assert np.allclose(mean, y.mean(0)) and np.allclose(cov, np.cov(y.T, ddof=0))
    assert V.gaussian_kl(mean, cov, mean, cov) == pytest.approx(0, abs=1e-9) and V.gaussian_js(mean, cov, mean + 1, cov) > 0
    e = np.linalg.eigvalsh(np.cov(y.T))[::-1]
    assert [r.eigenvalue for r in V.spectrum(df, "v").collect()] == pytest.approx(list(e))
    near = V.neighbours(df, df.where("k < 20"), "k", "v", 3, block=7).collect()
    sim = np.round(unit @ unit.T, 6)
    for q in range(20):
        order = sorted((j for j in range(60) if j != q), key=lambda j: (-sim[q, j], j))[:3]
        assert [r.key for r in sorted((r for r in near if r["query"] == q), key=lambda r: r["rank"])] == order
    z = {r.k for r in V.outliers(df, R.norm(F.col("v")), 2.0).collect()}
    assert z == set(np.flatnonzero(np.abs((n[:, 0] - n.mean()) / n.std()) > 2).tolist())


def test_matrices(spark):
    rng = np.random.default_rng(5)
    a = {"one": np.outer(rng.normal(size=6), rng.normal(size=4)), "eye": np.eye(4), "any": rng.normal(size=(9, 4))}
    df = spark.createDataFrame([(m, i, [float(v) for v in r]) for m, x in a.items() for i, r in enumerate(x)], "m string, row long, vals array<double>").repartition(3)
    sv = M.singular_values(df, ["m"])
    got = {}
    for r in sv.orderBy("m", "k").collect():
        got.setdefault(r.m, []).append(r.value)
    for m, x in a.items():
        assert got[m] == pytest.approx(list(np.linalg.svd(x, compute_uv=False)), abs=1e-6)
    ranks = {r.m: r for r in M.ranks(sv, ["m"]).collect()}
    assert ranks["one"].numerical_rank == 1 and ranks["eye"].effective_rank == pytest.approx(4, abs=1e-4)
    w, fa, fb = rng.normal(size=(5, 4)), rng.normal(size=(2, 4)), rng.normal(size=(5, 2))
    table = lambda name, x: spark.createDataFrame([(name, i, [float(v) for v in r]) for i, r in enumerate(x)], "name string, row long, vals array<double>")
    for stable, scale in ((False, 8 / 2), (True, 8 / 2**0.5)):
        merged = M.low_rank_merge(table("w", w).unionByName(table("other", w)), table("w", fa), table("w", fb), 8.0, stable)
        got = {r.name: [] for r in merged.collect()}
        for r in merged.orderBy("name", "row").collect():
            got[r.name].append(r.vals)
        assert np.allclose(got["w"], w + scale * fb @ fa) and np.allclose(got["other"], w)
    att = spark.createDataFrame([(0, q, k, p) for q, row in enumerate([[1.0, 0.0, 0.0], [0.5, 0.5, 0.0], [1 / 3] * 3]) for k, p in enumerate(row)], "head int, q int, k int, p double")
    r = M.attention_metrics(att, ["head"]).first()
    assert r.entropy == pytest.approx((math.log(2) + math.log(3)) / 2, abs=1e-5) and r.sink == pytest.approx((0.5 + 1 / 3) / 2, abs=1e-5)
    assert np.allclose(M.rollout(att.withColumn("layer", F.lit(0)), 3).sum(1), 1)
    x = spark.createDataFrame([(v,) for v in (0.0, -1.0, float("nan"), float("inf"), 1.0, 9.99, 10.0, 100.0)], "x double")
    h = {r.bin: r.n for r in M.log_histogram(x, "x", [F.lit("all")], 0.0, 2.0, 2).collect()}
    assert h == {0: 2, 1: 2}


def test_smaller_side_and_factors(spark):
    """Wide matrices through their rows; signatures, statistics with the spectral norm, weights trained whole."""
    rng = np.random.default_rng(7)
    a = {"wide": rng.normal(size=(5, 40)), "tall": rng.normal(size=(40, 5)), "square": rng.normal(size=(9, 9))}
    df = spark.createDataFrame([(m, i, [float(v) for v in r]) for m, x in a.items() for i, r in enumerate(x)], "m string, row long, vals array<double>").repartition(4)
    sv = M.singular_values(df, ["m"], block=7)
    for m, x in a.items():
        assert [r.value for r in sv.where(F.col("m") == m).orderBy("k").collect()] == pytest.approx(list(np.linalg.svd(x, compute_uv=False)), abs=1e-6)
    raw = {m: np.concatenate([np.pad(np.linalg.svd(x, compute_uv=False)[:6], (0, max(0, 6 - min(x.shape)))), [np.linalg.norm(x)]]) for m, x in a.items()}
    z = np.stack([raw[m] for m in a])
    d = z.std(0)
    got = {r.m: r.signature for r in M.standardise(M.head_signatures(sv, ["m"], 6), "signature", ["m"]).collect()}
    for k, m in enumerate(a):
        assert got[m] == pytest.approx(list((z[k] - z.mean(0)) / np.where(d > 0, d, 1)), abs=1e-5)
    for r in M.statistics(df, ["m"], row="row").collect():
        x = a[r.m]
        assert (r.n, r.spectral, r.median, r.p1, r.p99) == pytest.approx((x.size, np.linalg.norm(x, 2), np.median(x), np.percentile(x, 1), np.percentile(x, 99)), abs=1e-5)
    table = lambda name, x: spark.createDataFrame([(name, i, [float(v) for v in r]) for i, r in enumerate(x)], "name string, row long, vals array<double>")
    w, o, fa, fb = (rng.normal(size=s) for s in ((5, 4), (5, 4), (2, 4), (5, 2)))
    both = M.low_rank_merge(table("w", w).unionByName(table("v", w)), table("w", fa), table("w", fb), 8.0, overrides=table("w", o).unionByName(table("v", o)))
    got = {n: np.array([r.vals for r in both.where(F.col("name") == n).orderBy("row").collect()]) for n in "wv"}
    assert np.allclose(got["w"], o + 4 * fb @ fa) and np.allclose(got["v"], o)
    assert [r.name for r in M.unused(table("x", o).select("name"), table("w", w).select("name")).collect()] == ["x"]


def test_quantiles_and_shares(spark):
    """Order statistics, running and top shares against numpy, with null keys, ties and far-off values."""
    rng = np.random.default_rng(8)
    rows = [(int(k), i, float(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 400), np.round(rng.lognormal(2, 2, 400), 1)))]
    rows = [(k or None, i, v) for k, i, v in rows] + [(9, 1000, 5.0), (8, 1001, 2.0), (8, 1002, 2.0)]
    df = spark.createDataFrame(rows, "k int, i long, v double").repartition(3)
    by = {k: np.array([v for kk, _, v in rows if kk == k]) for k in {r[0] for r in rows}}
    for r in M.quantiles(df, ["k"], F.col("v"), {"a": 0.0, "b": 0.33, "c": 0.5, "d": 0.99, "e": 1.0}).collect():
        assert [r.a, r.b, r.c, r.d, r.e] == pytest.approx(list(np.quantile(by[r.k], [0, 0.33, 0.5, 0.99, 1.0])), abs=1e-6)
    for r in M.top_share(df, ["k"], "v", "i").collect():
        x = np.sort(by[r.k])[::-1]
        assert r.top_share == pytest.approx(x[: math.ceil(len(x) * 0.1)].sum() / x.sum(), abs=1e-6)
    got = M.cumulative_share(df, ["k"], "v", "i").collect()
    for k, x in by.items():
        own = sorted((r for r in got if r.k == k), key=lambda r: (-r.v, r.i))
        assert [r.share_upto for r in own] == pytest.approx(list(np.cumsum(np.sort(x)[::-1]) / x.sum()), abs=1e-9)
    masked = M.quantile_mask(df, ["k"], "v", 0.25).collect()
    assert all(r.masked == (r.v <= np.quantile(by[r.k], 0.25) + 1e-12) for r in masked) and len(masked) == len(rows)


def test_divergence_of_singular_covariances():
    """A determinant that isn't positive: the logarithms of the singular values and the ridge."""
    c0, c1, m = np.diag([1.0, 2.0]), np.diag([1.0, -0.5]), np.zeros(2)
    s0, s1 = c0 + 1e-3 * np.eye(2), c1 + 1e-3 * np.eye(2)
    logs = [np.log(np.abs(np.diag(s)) + 1e-3).sum() for s in (s0, s1)]
    assert V.gaussian_kl(m, c0, m, c1) == pytest.approx(0.5 * (logs[1] - logs[0] - 2 + np.trace(np.linalg.inv(s1) @ s0)))
    assert V.gaussian_kl(m, c0, m, c0 * 2) == pytest.approx(0.5 * (np.linalg.slogdet(c0 * 2 + 1e-3 * np.eye(2))[1] - np.linalg.slogdet(s0)[1] - 2 + np.trace(np.linalg.inv(c0 * 2 + 1e-3 * np.eye(2)) @ s0)))


def test_samples_and_projections(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 3)) * [3, 1, 0.1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<double>").repartition(3)
    assert [r.place for r in V.numbered(df, "k", bounds=5).orderBy("k").collect()] == list(range(80))
    far = x - x.mean(0)
    u = np.linalg.svd(far, full_matrices=False)[2][:2]
    u = u * np.sign(u[np.arange(2), np.abs(u).argmax(1)])[:, None]
    got = np.array([r.coordinates for r in V.projected(df, "v").orderBy("k").collect()])
    assert np.allclose(got, far @ u[:2].T, atol=1e-6)
    a, b = df.where("k < 30"), df.where("k >= 30")
    r = V.rbf_mmd(a, b, "v", block=16).first()
    d = lambda p, q: ((p[:, None] - q[None]) ** 2).sum(-1)
    s = np.median(d(x[:30], x[30:]))
    mean = lambda p: np.exp(-d(p, p) / s)[~np.eye(len(p), dtype=bool)].mean()
    assert r.sigma == pytest.approx((s / 2) ** 0.5, abs=1e-5) and r.mmd == pytest.approx(max(mean(x[:30]) + mean(x[30:]) - 2 * np.exp(-d(x[:30], x[30:]) / s).mean(), 0) ** 0.5, abs=1e-5)
    with pytest.raises(ValueError):
        V.rbf_mmd(a, b, "v", most=20)
    assert [r.k for r in V.most_moved(spark.createDataFrame([(1, 0.5), (2, -0.5), (3, 0.5)], "k long, cosine double"), "k", 2).collect()] == [2, 1]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.sampled_from([0.1, 0.5, 0.99]))
def test_kth_threshold(spark, xs, ratio):
    r = M.kth_threshold(spark.createDataFrame([(float(x),) for x in xs], "x double"), F.col("x"), ratio).first()
    k = max(1, math.floor(len(xs) * ratio))
    want = sorted(xs)[k - 1]
    assert r.threshold == want and r.achieved == pytest.approx(sum(x <= want for x in xs) / len(xs), abs=1e-6)


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"x","label":"1"}\n\n  \nnot json\n{"text":"y"}\n', encoding="utf-8")
    rows = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert tuple(readers.jsonl_errors(rows).first())[1:] == (2, 1)
    with pytest.raises(Exception):
        readers.read_jsonl_strict(spark, str(tmp_path / "a.jsonl")).collect()
    (tmp_path / "b.csv").write_text(' comment ; label\n"two\nlines;x";NA\n;""\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "b.csv"), ";").collect()] == [("two\nlines;x", "NA"), ("", "")]
    (tmp_path / "c.txt").write_text("short&&&&&" + "a long article with & inside &&&& ok" + "&&&&&&&" + "x" * 21, encoding="utf-8")
    assert [r.text for r in readers.read_articles(spark, str(tmp_path / "c.txt")).orderBy("place").collect()] == ["a long article with & inside &&&& ok", "x" * 21]
    (tmp_path / "bad.csv").write_text("h\n1 , t , with, comma , A0 , x , A1 , y , True , False\n2 , t , u , v , w , y , True , maybe\n", encoding="utf-8")
    (tmp_path / "good.csv").write_text("h\n1 , t , with, comma , A0 , x , A1 , y , True , False\n", encoding="utf-8")
    got = readers.recover_labels(spark, [str(tmp_path / "bad.csv"), str(tmp_path / "good.csv")], ["A0", "A1"]).collect()
    assert [(r.file.rsplit("/", 1)[1], r.pred, r.gold) for r in got] == [("good.csv", "A1", "A0")]
    assert readers.expand(spark, [f"{tmp_path}/none*", f"{tmp_path}/*.jsonl"])[0].endswith("a.jsonl")
    with pytest.raises(FileNotFoundError):
        readers.expand(spark, f"{tmp_path}/none*")
    rows = spark.createDataFrame([("w1", "s1"), ("w2", "s2"), ("w3", "s1")], "name string, shard string")
    got = readers.read_tensors(spark, rows, lambda shard, names: ((n, 0, [1.0, 2.0]) for n in names)).collect()
    assert sorted(r.name for r in got) == ["w1", "w2", "w3"]


def test_tensor_index(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "model.safetensors.index.json").write_text('{"metadata": {"total_size": 1},\n "weight_map": {"x.weight": "model-1.safetensors", "y.weight": "model-2.safetensors", "z.bias": "model-2.safetensors"}}', encoding="utf-8")
    got = readers.tensor_shards(spark, str(tmp_path / "a"), r"\.weight$").collect()
    assert sorted(map(tuple, got)) == [("x.weight", f"{tmp_path}/a/model-1.safetensors"), ("y.weight", f"{tmp_path}/a/model-2.safetensors")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "model.safetensors").write_bytes(b"x")
    row = readers.tensor_shards(spark, str(tmp_path / "b")).first()
    assert row.name is None and row.shard.endswith("/b/model.safetensors")
    with pytest.raises(FileNotFoundError):
        readers.tensor_shards(spark, str(tmp_path))


def test_reports_are_whole_or_an_error(spark):
    for write in (sinks.markdown, sinks.latex, sinks.plain):
        assert write(spark.range(10_000)).count("\n") >= 10_000
        with pytest.raises(ValueError):
            write(spark.range(10_001))


def test_a_cluster_needs_a_shared_folder():
    from loomwright.session import local_folder

    assert local_folder("local[4]") != local_folder("local")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            local_folder(master)


def test_sinks(spark):
    df = spark.createDataFrame([("a_b", 1.234), ("c", None)], "name string, x double")
    assert sinks.markdown(df) == "| name | x |\n|---|---|\n| a_b | 1.23 |\n| c |  |\n"
    assert r"a\_b & 1.23 \\" in sinks.latex(df) and sinks.plain(df).splitlines()[1].startswith("a_b")


def test_stream_is_the_batch(spark, tmp_path):
    from loomwright.streaming import events as EV

    rows = spark.createDataFrame([(i, f"text {i}  x ,", 1) for i in range(20)], "doc_id long, text string, n int")
    rows.write.parquet(f"{tmp_path}/landing")
    EV.clean_landing(spark, f"{tmp_path}/landing", "doc_id long, text string, n int", f"{tmp_path}/out", f"{tmp_path}/state")
    EV.clean_landing(spark, f"{tmp_path}/landing", "doc_id long, text string, n int", f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 20 and all(r.text == f"text {r.doc_id} x," and r.n_tokens == 3 for r in got)


def test_plans_prune_and_push(spark):
    """A filter and a projection reach the scan."""
    from loomwright import plans

    plan = plans.QUERIES["token_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "struct<text:string,lang:string>" in plan
