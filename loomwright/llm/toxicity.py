"""Toxicity by multiple-instance learning.

A document is a bag of sentences and its label says whether any of them is toxic.  A sentence's
probability is a logistic function of its features (words and their prefixes); the document's is a
noisy-or: 1 - (1 - leak) * product over sentences of (1 - p).  All weights are learned together from
document labels, and the trained model locates the sentences.

Fitting reads a bounded sample of the labelled rows: at most SAMPLE rows, those with the smallest hashes
of their ids; copies of a text count once.  Everything else covers all rows and whole texts.  One rule at
every size says which features have a weight: those whose smoothed share of the toxic documents is e^LIFT
times that of the others, where a likelihood-ratio test of the two shares gives EVIDENCE or more.  They
are kept as strings, so no two words share a weight; what the driver holds is bounded by the sample.  A sentence without any of them has probability 0, so a clean text's score doesn't grow with
its length.

Null or empty texts have no sentence and score the leak.  Labels that are null don't count; a document
with contradicting labels counts as toxic.  Without labels of both kinds every score is the share of
toxic ones (0 without any).  Rows with equal or null ids are scored each on their own; an empty table
gives no rows.  Only id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import released, scratch, ship, utf8, written

#: Labelled rows that are fitted on at most.
SAMPLE = 20_000
#: A feature is kept if its smoothed share among toxic documents is e to the power LIFT times that of others,
#: and twice the log-likelihood ratio of its count of toxic documents against that share is EVIDENCE or more
#: (chi-square with one degree of freedom: one in a thousand by chance).
LIFT, EVIDENCE = 1.2, 10.83
#: Words remembered by one scorer.
KNOWN_WORDS = 200_000

_WORD, _END = re.compile(r"\w+"), re.compile(r"[.!?\n]+")


def features(word: str) -> list[str]:
    """A word and its prefixes of 4 and 5 characters."""
    return [f"w:{word}", *(f"{n}:{word[:n]}" for n in (4, 5) if len(word) >= n)]


@dataclass
class Model:
    bias: float
    leak: float
    weights: dict[str, float] = field(default_factory=dict)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float | None] = {}

    def weight(self, word: str) -> float | None:
        """The sum of a word's weights; None if it has no feature."""
        if word in self.known:
            return self.known[word]
        own = [w for f in features(word) if (w := self.model.weights.get(f)) is not None]
        out = sum(own) if own else None
        if len(self.known) < KNOWN_WORDS:
            self.known[word] = out
        return out

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that have a feature."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        at = 0
        while at < len(low):
            m = _END.search(low, at)
            end = m.end() if m else len(low)
            own = [w for x in dict.fromkeys(_WORD.findall(low, at, end)) if (w := self.weight(x)) is not None]
            if own:
                yield at, end, 1 / (1 + np.exp(-np.clip(self.model.bias + sum(own), -40, 40)))
            at = end

    def score(self, text: str) -> float:
        words = dict.fromkeys(_WORD.findall(text.lower()))
        if not any(self.weight(w) is not None for w in words):
            return self.model.leak
        clean = 1 - self.model.leak
        for _, _, p in self.sentences(text):
            clean *= 1 - p
        return float(1 - clean)


def _sample(df: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, sample: int) -> DataFrame:
    """doc_id, text (bytes), y of at most `sample` labelled rows, a text once."""
    y = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.max(F.col(label_column).cast("int")).alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows of two numbers: bounded
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).join(F.broadcast(y), "doc_id")
    rows = written(rows.withColumn("copy", F.xxhash64("text")), "sample")
    return rows.join(rows.groupBy("copy", "y").agg(F.min("doc_id").alias("doc_id")), ["copy", "y", "doc_id"]).dropDuplicates(["doc_id"])


def _counts(rows: DataFrame) -> DataFrame:
    """feature, toxic, other: documents that have it."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORD.findall(text.decode("utf-8", "replace").lower()))
                counts[y > 0].update({f for w in words for f in features(w)})
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield out(*counts)
                counts = Counter(), Counter()
        yield out(*counts)

    def out(other: Counter, toxic: Counter) -> pa.RecordBatch:
        names = list(toxic.keys() | other.keys())
        return pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "toxic": pa.array([toxic[f] for f in names], pa.int64()), "other": pa.array([other[f] for f in names], pa.int64())})

    return rows.select("text", "y").mapInArrow(run, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _bags(rows: DataFrame, number: dict[str, int]) -> DataFrame:
    """doc_id, y, sentence (within the document) and feature of each use."""
    shared = rows.sparkSession.sparkContext.broadcast(number)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out: list[tuple] = []
            for doc, text, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for s, part in enumerate(_END.split(text.decode("utf-8", "replace").lower())):
                    out += [(doc, y, s, known[f]) for w in dict.fromkeys(_WORD.findall(part)) for f in features(w) if f in known]
            yield pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate([("doc_id", pa.int64()), ("y", pa.int32()), ("sentence", pa.int32()), ("feature", pa.int32())])})

    return rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, sentence int, feature int")


def train_bags(y: np.ndarray, bag: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n_features: int, rounds: int = 300, rate: float = 0.1, decay: float = 1e-3) -> tuple[float, float, np.ndarray]:
    """bias, leak and weights by gradient descent on the log-loss of the noisy-or.  bag: of each
    sentence, ascending; sentence and feature: of each use."""
    weights, bias, leak = np.full(n_features, 1.0), -2.0, np.log(0.02)
    theta = np.concatenate([weights, [bias, leak]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n, n_sentences = len(y), len(bag)
    for t in range(1, rounds + 1):
        z = np.clip(theta[-2] + np.bincount(sentence, theta[:-2][feature], n_sentences), -30, 30)
        log_clean = -np.logaddexp(0, z)  # log(1 - p) of each sentence
        base = -np.exp(np.minimum(theta[-1], -0.7))  # log(1 - leak), about
        total = np.minimum(np.bincount(bag, log_clean, n) + base, -1e-9)
        # d loss / d total, for p = 1 - exp(total)
        slope = np.where(y > 0, np.exp(total) / (1 - np.exp(total)), -1.0)
        back = slope[bag] * -(1 / (1 + np.exp(-z)))
        grad = np.concatenate([np.bincount(feature, back[sentence], n_features), [back.sum(), (slope * base).sum()]]) / n
        grad[:-2] += decay * theta[:-2]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[-2]), float(1 - np.exp(-np.exp(min(theta[-1], -0.7)))), theta[:-2]


def fit(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE) -> Model:
    """labels: id_column and label_column (1: toxic)."""
    ship(df.sparkSession)
    with scratch(df.sparkSession, "toxicity"):
        return _fit(df, labels, id_column, text_column, label_column, sample)


def _fit(df: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, sample: int) -> Model:
    rows = _sample(df, labels, id_column, text_column, label_column, sample)
    n = dict(rows.groupBy("y").count().collect())
    toxic, other = sum(c for y, c in n.items() if y > 0), sum(c for y, c in n.items() if y <= 0)
    if not toxic or not other:
        return Model(0.0, float(bool(toxic)))
    lift = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    due = (F.col("other") + 0.5) / (other + 1) * toxic  # if the feature were as frequent in toxic documents
    evidence = 2 * (F.col("toxic") * F.log(F.col("toxic") / due) - (F.col("toxic") - due))
    best = _counts(rows).where(F.col("toxic") > 0).where((lift > LIFT) & (evidence >= EVIDENCE))
    names = sorted(r[0] for r in best.select("feature").collect())  # bounded by the sample
    bags = _bags(rows, {f: k for k, f in enumerate(names)}).toPandas().sort_values(["doc_id", "sentence", "feature"])
    docs = rows.select("doc_id", "y").toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)
    place = docs.reset_index().drop_duplicates("doc_id").set_index("doc_id")["index"]
    sentence = bags.groupby(["doc_id", "sentence"], sort=True).ngroup().to_numpy()
    bag = place.loc[bags["doc_id"]].to_numpy() if len(bags) else np.zeros(0, np.int64)
    first = np.unique(sentence, return_index=True)[1]
    bias, leak, weights = train_bags(docs["y"].to_numpy() > 0, bag[first].astype(np.int64), sentence.astype(np.int64), bags["feature"].to_numpy().astype(np.int64), len(names))
    return Model(bias, leak, dict(zip(names, weights.tolist())))


def score(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", with_sentences: bool = False) -> DataFrame:
    """doc_id and score of each row; with with_sentences also the offending sentences, as structs of
    start, end (code points) and score."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            columns = {"doc_id": batch.column(0), "score": pa.array([scorer.score(t) for t in texts], pa.float64())}
            if with_sentences:
                columns["sentences"] = pa.array([[{"start": a, "end": b, "score": float(p)} for a, b, p in scorer.sentences(t)] for t in texts], kind)
            yield pa.RecordBatch.from_pydict(columns)

    fields = "doc_id long, score double" + ", sentences array<struct<start:long,end:long,score:double>>" * with_sentences
    return df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).mapInArrow(run, fields)


def keep_clean(df: DataFrame, model: Model, below: float, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows whose score is smaller, whole and unchanged: a filter without a shuffle."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_column)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t or "") < below for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
