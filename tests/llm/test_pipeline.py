"""The pipeline, stage by stage, against plain versions on a small corpus."""

import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm import toxicity
from loomwright.llm.encode import default_vocabulary
from loomwright.llm.queries import QUERIES, TOXIC_FROM

from .conftest import SCHEMA
from .test_dedup import brute_lines, edited, repeated_windows, roots, sentence
from .test_media_chat_toxicity import corpus
from .test_tokens import check_pieces, ids

TOP = Path(__file__).resolve().parents[2]
XXHASH = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)  # Spark's own hash of a string


#: Extra columns with names that the operators give to columns of their own.
CLASHING = ["n_lines", "n_removed", "removed_words", "duplicate_of", "d", "r", "w", "h", "node", "component", "component_id", "prints", "score", "units", "gone", "spans"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean and toxic documents, near copies, embedded passages, repeated runs of lines, odd rows."""
    at = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(8)
    rows, labels = corpus(400, 2)
    rows = [(k, t) for k, t in rows]
    passage = sentence(rng, 60)
    run = "\n".join(sentence(rng, 8) for _ in range(4))
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    for k in range(1000, 1020):
        rows.append((k, " ".join(edited(rng, base, 2 + k % 5 * 2))))
        rows.append((k + 100, f"{sentence(rng, 30)} {passage} {sentence(rng, 20)}"))
        rows.append((k + 200, f"{sentence(rng, 12)}\n{run}\n{sentence(rng, 12)}"))
        rows.append((k + 300, sentence(rng, 80)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "word " * 4000)]
    twice = [(2010, sentence(rng, 40)), (2011, sentence(rng, 40)), (None, sentence(rng, 40))]
    docs = [(k, t, rng.choice(["en", None]), "s", None if t is None else len(t)) for k, t in rows] + [(k, t, "en", "s", len(t)) for k, t in twice for _ in range(2)]
    df = spark.createDataFrame(docs, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.concat(F.lit("own "), F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))))
    df.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in labels] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "substring_dedup", "packing"]
    before, out = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.dtypes == docs.dtypes
        out[name], before = now, now
    for now in [out[n] for n in names[:-1]]:
        for c in CLASHING:
            assert now.where(F.col(c) != F.concat(F.lit("own "), F.coalesce(F.col("doc_id").cast("string"), F.lit("x")))).count() == 0
    texts = lambda df: sorted((r.doc_id is None, r.doc_id, r.text or "") for r in df.collect())
    # toxicity: the same decisions as the query, all other rows whole
    model_rows = QUERIES["op9_toxicity"](spark, sf_dir)
    toxic = {r.doc_id for r in model_rows.where("predicted = 1").collect()}
    assert toxic and texts(out["toxicity"]) == [x for x in texts(docs) if x[1] not in toxic]
    # lines: of rows that repeat id and text each gets the same result
    rows = sorted({x for x in texts(out["toxicity"])})
    order = {x: i for i, x in enumerate(sorted(rows, key=lambda x: (not x[0], x[1] or 0, XXHASH(x[2]))))}
    want = brute_lines([(i, x[2]) for x, i in order.items()])
    lines = texts(out["line_dedup"])
    assert lines == sorted((x[0], x[1], want[order[x]][0]) for x in texts(out["toxicity"]))
    assert all(r.n_chars == len(r.text) for r in out["line_dedup"].collect())
    # near copies: one row of each component by exact similarity, texts unchanged
    distinct = sorted(set(lines))
    sets = [frozenset(zip(*(w[i:] for i in range(5)))) or frozenset([tuple(w)]) for x in distinct for w in [x[2].lower().split()]]
    label = roots(len(sets), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)])
    kept = texts(out["simhash_near_dedup"])
    assert len(kept) == len(set(label)) and set(kept) <= set(distinct)
    assert sorted(x[:2] for x in kept) == sorted(min(distinct[i][:2] for i in range(len(distinct)) if label[i] == r) for r in set(label))
    assert 1 < sum(not x[0] and 1000 <= x[1] < 1020 for x in kept) < 20
    # substrings: nothing of 50 words stands twice, clean documents are whole
    left = texts(out["substring_dedup"])
    assert [x[:2] for x in left] == [x[:2] for x in kept] and not repeated_windows([(i, x[2]) for i, x in enumerate(left)])
    assert [x for x in left if not x[0] and 1300 <= x[1] < 1320] == [x for x in kept if not x[0] and 1300 <= x[1] < 1320]
    # packing
    library = Tokenizer.from_file(default_vocabulary())
    assert check_pieces(out["packing"].collect(), {x[1]: np.append(ids(library, x[2]), 1) for x in left}) == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == out["packing"].count()


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_labels_of_held_out_rows_are_never_read(spark, sf_dir):
    """Turning the labels of held-out rows around changes nothing."""
    from loomwright.llm.queries import fitted_toxicity

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = fitted_toxicity(docs, labels), fitted_toxicity(docs, turned)
    assert a == b and isinstance(a, toxicity.Model) and TOXIC_FROM == 0.3


def test_library_stands_without_this_part(tmp_path):
    shutil.copytree(TOP, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    tests = ["tests/test_semantics.py", "tests/test_plans.py::test_entry", *(f"tests/test_plans.py::test_query[{q}]" for q in ("token_counts", "kept_table", "matrix_stats"))]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *tests], cwd=tmp_path / "repo", env=env, timeout=900, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-3000:]


def test_no_import_of_this_part_elsewhere():
    for p in (TOP / "loomwright").rglob("*.py"):
        if "llm" not in p.parts:
            assert "loomwright.llm" not in p.read_text()
