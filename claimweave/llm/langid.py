"""Language ID: interpolated Kneser-Ney character models, one per language.

N-grams of code points up to order ORDER of the lower-cased letters (all else is one blank) are
kept in sorted arrays of 64-bit hashes; a row has the log probability under every language, and
another array has the weight of backing off from a context. A text gets the language of the lowest
cross-entropy by character. The score is the calibrated chance that this is right; ``accepted`` is
false where that is under 0.5 or the cross-entropy is above what all but 1 in 200 calibration texts
of the language have.

Fitted on a bounded sample of labelled rows: about TRAIN_DOCS a language for counts and HOLD_DOCS
for calibration, by a hash of the id; n-grams of the highest order seen less than LEAST times are
left out, after discounts, contexts and continuations were counted over all of them. Every row is scored whole. Null texts and texts without letters are ``und`` with score 0,
as is everything when no row has a language to learn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import mod_of_crc, read, slices
from claimweave.session import materialize, small_batches

ORDER, LEAST, TRAIN_DOCS, HOLD_DOCS = 4, 2, 800, 200
BLOCK = 250_000
LETTERS = re.compile(r"[^\W\d_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def clean(text: str) -> str:
    """Lower-cased words of letters, a blank before and behind each; empty without letters."""
    words = LETTERS.findall(text.lower())
    if not all(map(str.isalpha, words)):  # fractions, superscripts and numbers in circles are no letters
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return f" {' '.join(words)} " if words else ""


def hashes(text: str) -> list[np.ndarray]:
    """By order, from 1: hashes of the n-grams at each position."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    out = [code * _P]
    for n in range(1, ORDER):
        h = out[-1][:-1]
        h = (h ^ (h >> np.uint64(31))) * _P + code[n:]
        out.append(h)
    return out


@dataclass
class Level:
    """One order: hashes of its n-grams with log probabilities, hashes of contexts with log weights."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    backoff: np.ndarray | None = None


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]
    unseen: float | np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    most: float = 1.0
    ceiling: np.ndarray | None = None

    def logp(self, h: list[np.ndarray], order: int, at: np.ndarray) -> np.ndarray:
        """Log probabilities [len(at), languages] of the characters that end the n-grams at ``at``."""
        level = self.levels[order - 1]
        want = h[order - 1][at]
        row = np.minimum(np.searchsorted(level.grams, want), len(level.grams) - 1)
        out = level.logp[row]
        miss = np.flatnonzero(level.grams[row] != want)
        if len(miss):
            if order == 1:
                out[miss] = self.unseen
            else:
                out[miss] = self.logp(h, order - 1, at[miss] + 1)
                context = h[order - 2][at[miss]]
                row = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
                seen = level.contexts[row] == context
                out[miss[seen]] += level.backoff[row[seen]]
        return out

    def means(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters scored, and mean log probabilities [texts, languages], of texts from clean()."""
        n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= BLOCK):
                size += len(texts[stop])
                stop += 1
            part = [t if len(t) >= ORDER else "" for t in texts[start:stop]]
            part = [(" " * (ORDER - 2) + t) if t else " " * (ORDER - len(x)) + x if x else "" for t, x in zip(part, texts[start:stop])]
            lengths = np.array([len(t) for t in part])
            if lengths.sum() >= ORDER:
                h = hashes("".join(part))
                ends = np.cumsum(lengths)
                doc = np.repeat(np.arange(len(part)), lengths)[: len(h[-1])]
                at = np.flatnonzero(np.arange(len(h[-1])) + ORDER <= ends[doc])
                p = self.logp(h, ORDER, at).astype(np.float64)
                which, first = np.unique(doc[at], return_index=True)
                total[start + which] = np.add.reduceat(p, first, axis=0)
                n[start + which] = np.diff(np.append(first, len(at)))
            start = stop
        return n, total / np.maximum(n, 1)[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, accepted."""
        cleaned = [clean(t or "") for t in texts]
        n, mean = self.means(cleaned)
        best = mean.argmax(1)
        score = self.chance(n, mean)
        entropy = -mean[np.arange(len(best)), best]
        accepted = (score >= 0.5) & (entropy <= self.ceiling[best]) & (n > 0)
        return [self.languages[b] if c else "und" for b, c in zip(best, cleaned)], np.where(n > 0, score, 0.0), accepted

    def margin(self, n: np.ndarray, mean: np.ndarray) -> np.ndarray:
        if mean.shape[1] < 2:
            return np.sqrt(n)
        top = np.sort(mean, axis=1)
        return (top[:, -1] - top[:, -2]) * np.sqrt(n)

    def chance(self, n: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """At most the smoothed share of calibration texts that were right."""
        return self.most / (1 + np.exp(-np.clip(self.offset + self.slope * self.margin(n, mean), -30, 30)))


def _discount(once: float, twice: float) -> float:
    """Of the numbers of n-grams seen once and twice, among all of the order."""
    return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9)) if once else 0.5


def estimate(kept: pd.DataFrame, seen: pd.DataFrame, languages: list[str]) -> Model:
    """From (lang, gram, n, total), the n-grams that are kept, with their counts (continuation counts below the
    highest order) and their contexts' totals; and (lang, size, once, twice), of all n-grams, kept or not.

    What the n-grams left out and the discounts take from a context goes to the lower order, so each context sums to 1."""
    k = len(languages)
    letters = set(kept.loc[kept["gram"].str.len() == 1, "gram"])
    uniform = 1 / (len(letters) + 1000)
    model = Model(languages, [], float(np.log(uniform)))
    numbers = {(r.lang, r.size): _discount(r.once, r.twice) for r in seen.itertuples(index=False)}
    for order in range(1, ORDER + 1):
        own = kept[kept["gram"].str.len() == order]
        grams = sorted(set(own["gram"]))
        table = np.concatenate([hashes(g)[order - 1] for g in grams]) if grams else np.zeros(0, np.uint64)
        contexts = sorted({g[:-1] for g in grams})
        gamma = np.zeros((len(contexts), k))
        place = {c: i for i, c in enumerate(contexts)}
        logp = np.empty((len(grams), k))
        where = {g: i for i, g in enumerate(grams)}
        context_of = np.array([place[g[:-1]] for g in grams], np.int64)
        if order > 1:
            lower = model.logp(hashes("".join(grams)), order - 1, np.arange(len(grams)) * order + 1)
        else:
            lower = np.full((len(grams), k), model.unseen)
        for j, language in enumerate(languages):
            mine = own[own["lang"] == language]
            if not len(mine):
                logp[:, j] = lower[:, j]
                continue
            n, total = mine["n"].to_numpy(np.float64), mine["total"].to_numpy(np.float64)
            rows = np.array([where[g] for g in mine["gram"]])
            of = context_of[rows]
            share = np.maximum(n - numbers.get((language, order), 0.5), 0) / total
            weight = np.clip(1 - np.bincount(of, share, len(contexts)), 1e-9, 1)  # a context without kept n-grams leaves all to the lower order
            gamma[:, j] = np.log(weight)
            p = np.exp(lower[:, j]) * weight[context_of]
            p[rows] += share
            logp[:, j] = np.log(np.maximum(p, 1e-12))
        order_by = np.argsort(table)
        level = Level(table[order_by], logp[order_by].astype(np.float32))
        if order == 1 and contexts:
            model.unseen = np.log(uniform) + gamma[0]  # what the one context of order 1 leaves to characters never seen
        if order > 1:
            ch = np.concatenate([hashes(c)[order - 2] for c in contexts]) if contexts else np.zeros(0, np.uint64)
            by = np.argsort(ch)
            level.contexts, level.backoff = ch[by], gamma[by].astype(np.float32)
        model.levels.append(level)
    return model


def statistics(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (lang, gram, n) of the highest order: the kept n-grams of all orders with their contexts' totals, and the
    numbers seen once and twice, see estimate(). Both are counted over all n-grams, before any is left out."""
    kept, seen, level = None, None, counts
    for order in range(ORDER, 0, -1):
        context = F.left("gram", F.lit(order - 1))
        totals = level.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"))
        own = level.where(F.col("n") >= LEAST) if order == ORDER else level
        own = own.withColumn("context", context).join(totals, ["lang", "context"]).select("lang", "gram", "n", "total")
        numbers = level.groupBy("lang").agg(F.lit(order).alias("size"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
        kept, seen = (own, numbers) if kept is None else (kept.unionByName(own), seen.unionByName(numbers))
        level = level.groupBy("lang", F.right("gram", F.lit(order - 1)).alias("gram")).agg(F.count("*").alias("n"))  # continuations: distinct longer n-grams
    return kept, seen


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from collections import Counter

    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pd.DataFrame]:
        yield from slices([(x, g, n) for x, c in counts.items() for g, n in c.items()], ["lang", "gram", "n"])
        counts.clear()

    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"]):
            t = clean(text)
            if t:
                t = " " * (ORDER - 2) + t
                counts.setdefault(lang, Counter()).update(t[i : i + ORDER] for i in range(len(t) - ORDER + 1))
        if sum(map(len, counts.values())) > 300_000:
            yield from flush()
    yield from flush()


def fit(rows: DataFrame) -> Model | None:
    """``rows``: (doc_id, text, lang) that may be learned from. None if there is nothing to learn."""
    small_batches(rows.sparkSession)
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not have:
        return None
    want = TRAIN_DOCS + HOLD_DOCS
    share = F.create_map(*[x for lang, n in have.items() for x in (F.lit(lang), F.lit(int(1e6 * min(1.0, want / n))))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = rows.where(draw < share[F.col("lang")]).withColumn("hold", F.pmod(F.xxhash64("doc_id", F.lit("hold")), F.lit(want)) < HOLD_DOCS)
    counts = sample.where("NOT hold").select("text", "lang").mapInPandas(_count, "lang string, gram string, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    kept, seen = (x.toPandas() for x in statistics(counts))  # of the sample: at most the n-grams that its letters allow, for each of its languages
    if not len(kept):
        return None
    languages = sorted(kept["lang"].unique())
    model = estimate(kept, seen, languages)
    model.ceiling = np.full(len(languages), np.inf)

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, mean = model.means([clean(t) for t in batch["text"]])
            yield pd.DataFrame({"lang": batch["lang"], "n": n, "mean": list(mean)})

    held = sample.where("hold").select("text", "lang").mapInPandas(means, "lang string, n long, mean array<double>").where("n > 0").toPandas()
    if len(held):
        mean, n = np.stack(held["mean"]), held["n"].to_numpy()
        best = mean.argmax(1)
        right = np.array([languages[b] == x for b, x in zip(best, held["lang"])], np.float64)
        x = np.c_[np.ones(len(n)), model.margin(n, mean)]
        w, prior = np.array([0.0, 1.0]), np.array([0.1, 0.01])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - right) + prior * (w - np.array([0.0, 1.0]))
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(prior), g)
        if w[1] > 0:
            model.offset, model.slope = float(w[0]), float(w[1])
        model.most = float((right.sum() + 1) / (len(right) + 2))
        for j, language in enumerate(languages):
            own = -mean[(held["lang"] == language).to_numpy() & (n >= 50), j]
            if len(own) >= 20:
                model.ceiling[j] = np.quantile(own, 0.995) * 1.1
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))  # pandas turns longs beside nulls into floats
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score, accepted = model.predict(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": lang, "score": score, "accepted": accepted})

    out = rows.mapInPandas(run, "doc_id string, lang_pred string, score double, accepted boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from rows whose crc32 of the id is not 2 modulo 4; the others are held out."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").where(mod_of_crc("doc_id", 4) != 2))
    found = identify(docs, model)
    return found.select("doc_id", (mod_of_crc("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
