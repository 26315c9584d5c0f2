"""Toxicity: a logistic classifier with a counterfactual penalty.

Features are the words of a text (lower case) and their prefixes, each as log(1 + count). In every
sentence of the labelled rows that names a group (GROUPS), that term is swapped for another of its
list; the squared difference of the two scores is added to the loss with weight PENALTY, so that
naming a group by itself doesn't move a score.

Fitted on a bounded sample of labelled rows (MAX_ROWS, drawn by hash) with at most MAX_FEATURES
features, the highest by the z score of their document frequencies in the two classes; the bound
keeps the normal equations small. Scoring reads
every row whole, and uses text only. Null and empty texts get the score of a text without features.
Without labelled rows, or with one class only, all scores are the smoothed share of that class.
Rows that repeat get rows that repeat; a document labelled twice counts as its highest label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import mod_of_crc, read, slices
from claimweave.session import small_batches

MAX_ROWS, MAX_FEATURES, LEAST_DOCS, LEAST_Z = 12_000, 700, 5, 3.5
PENALTY, RIDGE, PREFIXES = 1.0, 0.002, range(3, 9)
#: Terms that name groups; a term is swapped for the next of its list.
GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)
SWAPS = {term: group[(i + 1) % len(group)] for group in GROUPS for i, term in enumerate(group)}
WORD, SENTENCE = re.compile(r"\w+"), re.compile(r"[^.!?\n]+")
NAMES = re.compile(r"\b(" + "|".join(sorted(SWAPS, key=len, reverse=True)) + r")\b")


def word_features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) > k)]


def features(text: str) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for f in word_features(word):
            out[f] += n
    return out


def swapped(text: str) -> Iterator[tuple[str, str]]:
    """Each sentence that names a group, and the same with another group's name."""
    for sentence in SENTENCE.findall(text.lower()):
        if NAMES.search(sentence):
            yield sentence, NAMES.sub(lambda m: SWAPS[m[0]], sentence)


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of rows that may be learned from: at most about MAX_ROWS, by a hash of the id."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(mod_of_crc("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where("toxic IN (0, 1)")
    total = marks.count()
    if total > MAX_ROWS:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * MAX_ROWS / total))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    return texts.join(F.broadcast(marks), "doc_id")  # at most about MAX_ROWS rows


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def flush() -> Iterator[pd.DataFrame]:
        keys = list(counts[0].keys() | counts[1].keys())
        yield from slices([(k, counts[0][k], counts[1][k]) for k in keys], ["feature", "n0", "n1"])
        counts[0].clear(), counts[1].clear()

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            counts[toxic].update(features(text).keys())
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield from flush()
    yield from flush()


def fit(sample: DataFrame) -> Model:
    """``sample``: (text, toxic), of bounded size. Frequencies are counted by executors; the driver gets the chosen features only."""
    small_batches(sample.sparkSession)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    prior = math.log((n1 + 0.5) / (n0 + 0.5))
    if not n0 or not n1:
        return Model(min(prior, -0.01) if not n1 else prior, {})
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-9)
    table = sample.select("text", "toxic").mapInPandas(_frequencies, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = table.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z)
    chosen = [r["feature"] for r in best.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()]
    if not chosen:
        return Model(prior, {})
    index = {f: i for i, f in enumerate(chosen)}

    def sparse(text: str) -> dict[int, float]:
        return {index[f]: math.log1p(c) for f, c in features(text).items() if f in index}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                x = sparse(text)
                out.append((toxic, list(x), list(x.values())))
            yield from slices(out, ["toxic", "at", "value"])

    def differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Products of score changes by pairs of features, summed over the swapped sentences; feature -1 with itself counts them."""
        sums: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                for a, b in swapped(text):
                    p, q = sparse(a), sparse(b)
                    d = {k: x for k in p.keys() | q.keys() if (x := q.get(k, 0.0) - p.get(k, 0.0))}
                    sums.update({(i, j): x * y for i, x in d.items() for j, y in d.items()} | ({(-1, -1): 1.0} if d else {}))
        yield from slices([(i, j, x) for (i, j), x in sums.items()], ["i", "j", "value"])

    data = sample.select("text", "toxic").mapInPandas(rows, "toxic int, at array<int>, value array<double>").collect()
    y = np.array([r["toxic"] for r in data])
    x = np.zeros((len(data), len(chosen) + 1), np.float32)
    for i, r in enumerate(data):
        x[i, r["at"]] = r["value"]
    x[:, -1] = 1
    changes = sample.select("text").mapInPandas(differences, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    changes = changes.toPandas()  # a row for two features at most, however many sentences there are
    ridge = np.full(len(chosen) + 1, RIDGE)
    ridge[-1] = 1e-9
    extra = np.diag(ridge)
    if len(changes):
        counted = changes["i"] < 0
        n, own = changes.loc[counted, "value"].sum(), changes[~counted]
        extra[own["i"], own["j"]] += PENALTY * own["value"] / n
    w = np.zeros(len(chosen) + 1)
    w[-1] = prior
    for _ in range(10):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + extra @ w
        hessian = (x * (p * (1 - p)).astype(np.float32)[:, None]).T @ x / len(y) + extra
        w -= np.linalg.solve(hessian.astype(np.float64), gradient)
    return Model(float(w[-1]), {f: float(v) for f, v in zip(chosen, w) if abs(v) > 1e-6})


def scorer(model: Model):
    """Scores of texts. Words are looked up once; the memory of words is emptied when it is full."""
    weights, known = model.weights, {}

    def score(text: str) -> float:
        found: Counter = Counter()
        for word in WORD.findall(text.lower()):
            hit = known.get(word)
            if hit is None:
                if len(known) > 100_000:
                    known.clear()
                hit = known[word] = tuple(f for f in word_features(word) if f in weights)
            if hit:
                found.update(hit)
        logit = model.bias + sum(weights[f] * math.log1p(c) for f, c in sorted(found.items()))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))

    return score


def score_documents(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, with its score and the prediction at 0.5."""
    rows = docs.select(*keep, _score(model)(F.coalesce("text", F.lit(""))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def train(spark: SparkSession, sf_dir: str) -> Model:
    return fit(labelled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(read(spark, sf_dir, "documents"), train(spark, sf_dir), ["doc_id"])
    return scored.select("doc_id", (mod_of_crc("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns as they were."""
    return docs.where(_score(model)(F.coalesce("text", F.lit(""))) < 0.5)


def _score(model: Model):
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer(model)
        for texts in batches:
            yield texts.map(score).astype("float64")

    return run
