"""Near-duplicate documents: MinHash banding, sequential Bayesian verification, exact check.

1. Word shingles of whole texts are hashed; the least hashes under PERMUTATIONS orders, as two bytes
   each, make a signature, and each band of it a key. Texts of the same words in the same order (by
   a cryptographic digest) are one class and go on as one row; other texts, also those of equal
   sets, are linked by step 3 only.
2. Classes that share a band key are candidates if their sizes can reach the threshold. Their
   signatures are compared batch by batch: a pair is dropped as soon as the posterior chance that
   its similarity reaches the threshold is under MISS, given the matches seen so far (uniform prior).
3. Of the pairs that remain in a bucket, a maximum spanning forest by estimated similarity is
   verified on full shingle sets; links join components. So few more links are tested than are needed.
4. Rows of buckets that still hold several components are compared in one more forest, across
   blocks. Then their shingles are sorted, those that the fewest of these rows have first. Two rows
   of n and m shingles that reach the threshold share at least a = t * (n + m) / (1 + t) of them, so
   the first shingle they share stands within the first n - a + 1 of the one and m - a + 1 of the
   other (prefix and positional filter, which lose no link). Pairs of different components that meet
   so are verified, until none is left. The components are those of testing all pairs, and rows
   whose own changes set them apart from a large group of copies meet none of its rows.

Buckets are cut into blocks of BLOCK rows, differently in each band. In the forest of step 4 the rows
outside a bucket's largest component are cut into blocks as well, and each meets every block of the
bucket: a task holds two blocks at a time, and only a forest of pairs leaves it.

Two texts whose sets reach the threshold share no band key with chance (1 - t**ROWS)**BANDS: 3e-7 at
t of 0.85, 6e-5 at 0.8, less above; the misses of step 2 come on top.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.llm.components import components
from claimweave.session import materialize, shuffle_partitions, small_batches

BATCH, MISS, BLOCK, PART_BYTES = 16, 1e-6, 1024, 500_000
_M = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Settings:
    """Link where ``scale`` * intersection >= ``least`` * union."""

    words: int = 5
    least: int = 80
    scale: int = 100
    rows: int = 6
    bands: int = 32

    @property
    def permutations(self) -> int:
        return self.rows * self.bands

    @property
    def threshold(self) -> float:
        return self.least / self.scale


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


#: A random value for each byte.
BYTES = np.random.default_rng(20240301).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts (lower-cased A-Z), sorted by text; and how many each has.

    A text with fewer words than ``words`` has its whole sequence as one shingle."""
    n = len(texts)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[raw]
    before = np.concatenate(([True], space[:-1]))
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    at = np.arange(len(raw)) - start[np.maximum(np.cumsum(~space & before) - 1, 0)]  # places within words
    value = _mix(_mix(BYTES[raw] + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    prefix = np.concatenate(([np.uint64(0)], np.cumsum(value)))
    h = _mix(prefix[end] - prefix[start] + (end - start).astype(np.uint64))  # sums of values that depend on byte and place
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, start, side="right")
    out, count = [], np.bincount(doc, minlength=n)
    owner = []
    for k in range(1, words + 1):  # texts of exactly k words, or of at least ``words``
        fits = (count >= words) if k == words else (count == k)
        if not fits.any():
            continue
        m = len(h) - k + 1
        value = np.full(m, np.uint64(k))
        for j in range(k):
            value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m])
        ok = (doc[:m] == doc[k - 1 :]) & fits[doc[:m]]
        out.append(value[ok])
        owner.append(doc[:m][ok])
    value, of = np.concatenate(out), np.concatenate(owner)
    by = np.lexsort((value, of))
    value, of = value[by], of[by]
    first = np.concatenate(([True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])))
    return value[first], np.bincount(of[first], minlength=n)


@lru_cache(maxsize=2)
def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(texts: list[bytes], s: Settings) -> pd.DataFrame:
    """n_shingles, text_key (a digest of the words in order), bands (longs), sig (two bytes for each permutation)."""
    value, count = shingle_hashes(texts, s.words)
    full = np.flatnonzero(count)
    start = (np.cumsum(count) - count)[full]
    sig = np.zeros((len(texts), s.permutations), np.uint16)
    for j, seed in enumerate(_seeds(s.permutations)):
        if len(full):
            low = np.minimum.reduceat(((value ^ (value >> np.uint64(31))) * seed >> np.uint64(32)).astype(np.uint32), start)
            sig[full, j] = (_mix(low.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    key = np.zeros((len(texts), s.bands), np.uint64)
    for b in range(s.bands):
        h = np.full(len(texts), np.uint64(b + 1))
        for j in range(s.rows):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * s.rows + j])
        key[:, b] = h
    keys = [blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts]  # bytes.split() parts at the blanks of SPACE
    return pd.DataFrame({"n_shingles": count, "text_key": keys, "bands": list(key.view(np.int64)), "sig": [x.tobytes() for x in sig]})


def sketch(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n_shingles, text_key, bands, sig) of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass").translate(LOWER) for t in batch["text"]]
            ids, i = batch["doc_id"].to_numpy(), 0
            while i < len(raw):
                size, j = 0, i
                while j < len(raw) and (j == i or size + len(raw[j]) < PART_BYTES):
                    size += len(raw[j])
                    j += 1
                out = signatures(raw[i:j], s)
                out.insert(0, "doc_id", ids[i:j])
                yield out
                i = j

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_shingles long, text_key binary, bands array<long>, sig binary")


@lru_cache(maxsize=8)
def least_matches(permutations: int, threshold: float) -> tuple[int, ...]:
    """After each batch of BATCH hashes: with fewer matches than this, a pair is dropped.

    With k of n matches and a uniform prior, similarity s has posterior Beta(k + 1, n - k + 1);
    the pair stays while the chance of s >= threshold is at least MISS. Two bytes match by chance
    1 in 65536, which only adds matches."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    logs, rest, above = np.log(grid), np.log1p(-grid), grid >= threshold
    out, k = [], 0
    for n in range(BATCH, permutations + 1, BATCH):
        while k < n:
            density = k * logs + (n - k) * rest
            density = np.exp(density - density.max())
            if density[above].sum() / density.sum() >= MISS:
                break
            k += 1
        out.append(k)
    return tuple(out)


@dataclass
class Rows:
    """Rows of some groups as arrays; a group's rows stand together."""

    ids: np.ndarray
    group: np.ndarray
    comp: np.ndarray
    n: np.ndarray
    sig: np.ndarray

    def compare(self, i: np.ndarray, j: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs (i, j) that sizes and signatures leave, and their matches."""
        fits = (self.comp[i] != self.comp[j]) & (s.scale * np.minimum(self.n[i], self.n[j]) >= s.least * np.maximum(self.n[i], self.n[j]))
        i, j = i[fits], j[fits]
        hits = np.zeros(len(i), np.int32)
        for step, limit in enumerate(least_matches(s.permutations, s.threshold)):
            if not len(i):
                break
            part = slice(step * BATCH, (step + 1) * BATCH)
            hits = hits + (self.sig[i, part] == self.sig[j, part]).sum(1)
            stay = hits >= limit
            i, j, hits = i[stay], j[stay], hits[stay]
        return i, j, hits

    def forest(self, i: np.ndarray, j: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Which of the pairs make a maximum spanning forest of the components of each group."""
        label = np.unique(np.stack((self.group, self.comp)), axis=1, return_inverse=True)[1].reshape(-1)
        root = list(range(int(label.max(initial=0)) + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        taken = []
        for k in np.argsort(-hits, kind="stable").tolist():
            p, q = find(int(label[i[k]])), find(int(label[j[k]]))
            if p != q:
                root[q] = p
                taken.append(k)
        return np.array(taken, np.int64)


def _within(r: Rows, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one group that compare() leaves: each row with the d-th row behind it, for rising d."""
    parts, at, d = [], np.arange(len(r.ids)), 1
    while True:
        at = at[at + d < len(r.ids)]
        at = at[r.group[at] == r.group[at + d]]
        if not len(at):
            break
        parts.append(r.compare(at, at + d, s))
        d += 1
    none = np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*parts))) if parts else (none, none, none)


def _across(r: Rows, side: np.ndarray, minor: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a row of side 0 and one of side 1 of the same group, behind it; two rows outside the main component meet once."""
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    first, last = np.searchsorted(r.group[y], r.group[x], "left"), np.searchsorted(r.group[y], r.group[x], "right")
    many = last - first
    none = np.zeros(0, np.int64)
    parts, start, sums = [(none, none, none)], 0, np.cumsum(many)
    while start < len(x):
        stop = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + 500_000, "right")))
        n = many[start:stop]
        i = np.repeat(x[start:stop], n)
        j = y[np.repeat(first[start:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(i) else none
        once = ~minor[j] | (r.ids[i] < r.ids[j])
        parts.append(r.compare(i[once], j[once], s))
        start = stop
    return tuple(map(np.concatenate, zip(*parts)))


def _forests(where: list[str], s: Settings):
    """Over rows sorted by ``where``: a spanning forest (a, b) of each group. Rows of a group that a batch ends in wait for the next."""
    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows[where].to_numpy()
        group = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))))
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), -1)
        r = Rows(rows["doc_id"].to_numpy(), group, rows["comp"].to_numpy(), rows["n"].to_numpy(), sig)
        if "side" in rows:
            i, j, hits = _across(r, rows["side"].to_numpy(), (rows["comp"] != rows["main"]).to_numpy(), s)
        else:
            i, j, hits = _within(r, s)
        keep = r.forest(i, j, hits)
        i, j = r.ids[i[keep]], r.ids[j[keep]]
        return pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[where].to_numpy()
            if held and (held[-1][where].to_numpy()[-1] != keys[0]).any():
                yield pairs(pd.concat(held, ignore_index=True))
                held = []
            cut = int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1  # where the last group starts
            if cut:
                yield pairs(pd.concat([*held, batch[:cut]], ignore_index=True))
                held = []
            held.append(batch[cut:])
        if held:
            yield pairs(pd.concat(held, ignore_index=True))

    return run


def rare_first(texts: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, gram, place, n): the first shingles of each text, by how many of the texts have them, then by hash.

    ``place`` counts from 0; a text has so many that two that reach the threshold share one of them.
    Shingles of one text only stand before all others and are counted, not returned. ``sizes``: (doc_id, n)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"]):
                value = shingle_hashes([text.encode("utf-8", "surrogatepass").translate(LOWER)], s.words)[0].view(np.int64)
                yield pd.DataFrame({"doc_id": [i], "gram": [value]})

    each = materialize(texts.mapInPandas(run, "doc_id long, gram array<long>"), "sets").select("doc_id", F.explode("gram").alias("gram"))
    common = each.groupBy("gram").agg(F.count("*").alias("texts")).where("texts > 1")
    w = W.partitionBy("doc_id")
    shared = each.join(common, "gram").join(sizes, "doc_id")
    placed = shared.select("doc_id", "gram", "n", (F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("texts", "gram")) - 1).alias("place"))
    return placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * s.least / s.scale))


def prefix_pairs(prefixes: DataFrame, comp: DataFrame, s: Settings) -> DataFrame:
    """(a, b): texts of different components whose first shared shingle leaves enough of both to reach the threshold.

    Where a shingle's texts are of several components, those outside the largest meet all."""
    named = prefixes.join(comp, "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    sizes = named.groupBy("gram", "comp").agg(F.count("*").alias("rows"))
    main = sizes.groupBy("gram").agg(F.max(F.struct("rows", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("gram", F.col("top.comp").alias("main"))
    rows = materialize(named.join(main, "gram"), "prefix")
    x, y = rows.where("comp != main"), rows.select(*[F.col(c).alias(f"y_{c}") for c in rows.columns])
    left = F.least(F.col("n") - F.col("place"), F.col("y_n") - F.col("y_place"))
    enough = left * (s.scale + s.least) >= (F.col("n") + F.col("y_n")) * s.least
    once = (F.col("y_comp") == F.col("y_main")) | (F.col("doc_id") < F.col("y_doc_id"))
    met = x.join(y, (F.col("gram") == F.col("y_gram")) & (F.col("comp") != F.col("y_comp")) & enough & once)
    return met.select(F.least("doc_id", "y_doc_id").alias("a"), F.greatest("doc_id", "y_doc_id").alias("b")).distinct()


def exact_links(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """(a, b, linked): the pairs checked on their full shingle sets. Each id has one row in ``docs``."""
    def sets(text: str) -> set[tuple[str, ...]]:
        words = WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"))
        if not words:
            return set()
        return set(zip(*(words[i:] for i in range(s.words)))) if len(words) >= s.words else {tuple(words)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[object, set] = (None, set())
        for batch in batches:
            linked = []
            for a, x, y in zip(batch["a"], batch["ta"], batch["tb"]):
                if last[0] != a:
                    last = (a, sets(x))
                p, q = last[1], sets(y)
                both = len(p & q)
                linked.append(bool(both) and s.scale * both >= s.least * (len(p) + len(q) - both))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": linked})

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    left, right = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")  # last by a: its rows come together
    return joined.mapInPandas(run, "a long, b long, linked boolean")


def one_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row for each id; of several texts, the one that sorts first."""
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    again = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return rows
    least = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows.join(again, "doc_id", "left_anti").unionByName(least)


def _dealt(rows: DataFrame, where: list[str], more: list[str]) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), *where).sortWithinPartitions(*where, *more)


def _block(blocks: Column) -> Column:
    """The block of a row among so many, by a hash that differs by band."""
    return F.pmod(F.xxhash64("doc_id", "band"), F.greatest(blocks, F.lit(1))).cast("int")


def _first_pairs(members: DataFrame, signs: DataFrame, s: Settings) -> DataFrame:
    """(a, b): a spanning forest of each block of each bucket."""
    where = ["band", "key", "block"]
    placed = members.select("band", "key", "doc_id", _block(F.ceil(F.col("size") / BLOCK)).alias("block"), F.col("doc_id").alias("comp"))
    dealt = _dealt(placed.join(signs, "doc_id"), where, ["doc_id"])
    return dealt.mapInPandas(_forests(where, s), "a long, b long").distinct()


def _unresolved(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(band, key, doc_id, comp, main, size, minors): rows of buckets of several components, with the bucket's largest
    component, its number of rows, and that of rows outside the largest."""
    named = members.join(comp, "doc_id", "left").select("band", "key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    sizes = named.groupBy("band", "key", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("n").alias("size"))
    main = main.where("comps > 1").select("band", "key", F.col("top.comp").alias("main"), "size", (F.col("size") - F.col("top.n")).alias("minors"))
    return named.join(main, ["band", "key"])


def _more_pairs(still: DataFrame, signs: DataFrame, s: Settings) -> DataFrame:
    """(a, b): a spanning forest of rows outside a bucket's main component (side 0) with all of its rows (side 1)."""
    where = ["band", "key", "bx", "by"]
    nx, ny = F.ceil(F.col("minors") / BLOCK).cast("int"), F.ceil(F.col("size") / BLOCK).cast("int")
    kept = ["band", "key", "doc_id", "comp", "main"]
    x = still.where("comp != main").select(*kept, F.lit(0).alias("side"), _block(nx).alias("bx"), F.explode(F.sequence(F.lit(0), ny - 1)).alias("by"))
    y = still.select(*kept, F.lit(1).alias("side"), _block(ny).alias("by"), F.explode(F.sequence(F.lit(0), nx - 1)).alias("bx"))
    dealt = _dealt(x.unionByName(y).join(signs, "doc_id"), where, ["side", "doc_id"])
    return dealt.mapInPandas(_forests(where, s), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; kept is true for the least id of a component.

    Null and empty texts have no shingles and link with nothing. Rows that repeat an id are one
    document, with the text that sorts first; rows without an id have no shingles counted and are
    kept, with a null component. An empty table gives an empty result."""
    small_batches(docs.sparkSession)
    rows = one_text(docs)
    sketched = materialize(sketch(rows, s), "sketch")
    full = sketched.where("n_shingles > 0")
    classes = materialize(full.groupBy("text_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    bands = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(bands.join(shared, ["band", "key"]), "members")
    ids = members.select("doc_id").distinct()
    signs = materialize(reps.select("doc_id", F.col("n_shingles").alias("n"), "sig").join(ids, "doc_id", "left_semi"), "signs")
    texts = materialize(rows.join(ids, "doc_id", "left_semi").select("doc_id", "text"), "texts")

    found = materialize(_first_pairs(members, signs, s), "pairs")
    tested, links, comp, prefixes = found, None, None, None
    while not found.isEmpty():
        checked = materialize(exact_links(found, texts, s), "checked")
        new = checked.where("linked").select("a", "b")
        if prefixes is not None and new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        first = comp is None
        comp = materialize(components(links).withColumnRenamed("node", "doc_id"), "components")
        links = comp.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))  # a star for each component
        if first:
            still = materialize(_unresolved(members, comp), "still")
            found = materialize(_more_pairs(still, signs, s).join(tested, ["a", "b"], "left_anti"), "pairs")
        if not first or found.isEmpty():
            if prefixes is None:
                own = texts.join(still.select("doc_id").distinct(), "doc_id", "left_semi")
                prefixes = materialize(rare_first(own, signs.select("doc_id", "n"), s), "prefixes")
            found = materialize(prefix_pairs(prefixes, comp, s).join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(found)

    label = classes if comp is None else classes.join(comp.withColumnRenamed("doc_id", "rep"), "rep", "left")
    label = label.select("text_key", (F.col("rep") if comp is None else F.coalesce("component", "rep")).alias("component_id"))
    known = sketched.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("text_key")).alias("text_key"))
    found = known.join(label, "text_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")).select("doc_id", "n_shingles", "component_id")
    out = docs.select("doc_id").join(found, "doc_id", "left").fillna({"n_shingles": 0})
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP8 = Settings(words=3, least=85)


def near_duplicates_op8(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, OP8)
