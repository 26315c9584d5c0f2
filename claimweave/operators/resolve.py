"""Entity resolution: exact cascade, fuzzy match within type groups, creation, and keyed merges."""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.session import materialize

LEAST_RATIO = 0.92


def group(entity_type: Column) -> Column:
    """Genes and proteins are one group."""
    return F.when(entity_type.isin("gene", "protein"), "gene_protein").otherwise(entity_type)


#: What narrows candidates, in turn; the shorter list is that of lookups by the store.
RUNGS = ("unique", "type_organism", "organism", "type", "group", "canonical")
STORE_RUNGS = ("unique", "type", "type_organism", "untyped_organism")


def exact(mentions: DataFrame, entities: DataFrame, synonyms: DataFrame, order: tuple[str, ...] = RUNGS) -> DataFrame:
    """(mention, entity_id, rung): mentions (mention, name, entity_type, organism) whose candidates narrow to one.

    Candidates have the name as a synonym. Rungs in turn: the only candidate; the only one of the
    type and organism; of the organism; of the type; of the type's group; whose canonical name is the name. A lookup by the store narrows by
    type, then among these by organism, and by organism alone where the mention has no type.
    Candidates are summed up by name, and by name with what a rung narrows by, before mentions meet
    them: one is the only one where the least and the greatest id agree."""
    rows = mentions.select("mention", F.lower(F.trim("name")).alias("key"), "entity_type", F.nullif(F.lower(F.coalesce("organism", F.lit(""))), F.lit("")).alias("organism"), group(F.col("entity_type")).alias("grp"))
    known = entities.select(F.col("id").alias("entity_id"), F.col("entity_type"), F.nullif(F.lower(F.coalesce("organism", F.lit(""))), F.lit("")).alias("organism"), group(F.col("entity_type")).alias("grp"), F.lower(F.trim("canonical_name")).alias("c"))
    asked = rows.select("key").distinct()
    found = synonyms.select("entity_id", F.col("synonym").alias("key")).join(asked, "key", "left_semi").join(known, "entity_id")
    rungs = {"unique": [], "type_organism": ["entity_type", "organism"], "organism": ["organism"], "untyped_organism": ["organism"], "type": ["entity_type"], "group": ["grp"], "canonical": []}
    rungs = {name: rungs[name] for name in order}
    for i, (name, by) in enumerate(rungs.items()):
        own = found.where("c = key") if name == "canonical" else found.dropna(subset=by) if by else found
        only = own.groupBy("key", *by).agg(F.min("entity_id").alias(f"_{i}"), F.max("entity_id").alias("last")).where(F.col(f"_{i}") == F.col("last")).drop("last")
        rows = rows.join(only, ["key", *by], "left")
        if name == "untyped_organism":
            rows = rows.withColumn(f"_{i}", F.when(F.col("entity_type").isNull(), F.col(f"_{i}")))
    chosen = F.coalesce(*[f"_{i}" for i in range(len(rungs))])
    rung = F.coalesce(*[F.when(F.col(f"_{i}").isNotNull(), name) for i, name in enumerate(rungs)])
    return rows.select("mention", chosen.alias("entity_id"), rung.alias("rung")).where("entity_id IS NOT NULL")


def _without(text: Column, gone: Column) -> Column:
    """The distinct strings that are left when ``gone`` letters (0 or 1) are taken out."""
    one = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.left(text, i - 1), F.substr(text, i + 1)))
    return F.array_distinct(F.when(gone == 0, F.array(text)).otherwise(one))


def _reach(n: Column, least: float) -> Column:
    """The lengths that a string can have whose ratio with one of n letters reaches ``least``, or a few more."""
    more = F.floor(n * 2 * (1 - least) / least).cast("int") + 1
    return F.sequence(F.greatest(n - more, F.lit(1)), n + more)


def _common(n: Column, m: Column, least: float) -> Column:
    """How many letters, in order, strings of n and m letters have in common at least, if their ratio reaches ``least``."""
    return F.ceil((n + m) * least / 2 - 1e-9).cast("int")


def _near(n: Column, m: Column, least: float) -> Column:
    """Whether at most one letter of either is over."""
    return F.greatest(n, m) - _common(n, m, least) <= 1


def _variants(rows: DataFrame, text: str, own: str, other: str, least: float) -> DataFrame:
    """The rows once for each length of a near string and each string that is left without the letters that may be over."""
    n = F.length(text)
    sized = rows.withColumn(own, n).withColumn(other, F.explode(_reach(n, least))).withColumn("common", _common(F.col(own), F.col(other), least))
    sized = sized.where((F.col("common") <= F.least(own, other)) & _near(F.col(own), F.col(other), least))
    return sized.withColumn("block", F.explode(F.transform(_without(F.col(text), F.col(own) - F.col("common")), lambda v: F.xxhash64(v)))).drop("common")


def gram_width(least: float, widest: int = 4) -> int:
    """The greatest width of grams of which strings at ``least`` that aren't near share at least one, whatever their lengths.

    A letter taken out spoils ``width`` grams, one put in a gram less. Lengths up to 64 are gone through; beyond, both counts
    are linear in the other string's length, so they are greatest for the shortest or the longest that can reach ``least``."""
    for width in range(widest, 1, -1):
        def left(n: int, m: float, common: float, width: int = width) -> float:
            return n - width + 1 - width * (n - common) - (width - 1) * (m - common)

        pairs = [(n, m, math.ceil((n + m) * least / 2 - 1e-9)) for n in range(1, 65) for m in range(1, int(n * (2 - least) / least) + 2)]
        apart = [(n, m, c) for n, m, c in pairs if c <= min(n, m) and max(n, m) - c > 1]
        longer = [(64, m, (64 + m) * least / 2) for m in (64 * least / (2 - least), 64 * (2 - least) / least)]
        if all(left(*x) >= 1 for x in apart + longer):
            return width
    return 1


def _spoilt(n: Column, m: Column, width: int, least: float) -> Column:
    """How many grams of a string of n letters one of m may lack, if their ratio reaches ``least``; null if it can't or they are near."""
    common = _common(n, m, least)
    return F.when((common <= F.least(n, m)) & ~_near(n, m, least), (n - common) * width + (m - common) * (width - 1))


def _grams(rows: DataFrame, text: str, width: int) -> DataFrame:
    """The rows once for each gram. A gram's second occurrence in a string is a gram of its own, and so on."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - width + 1, F.lit(1))), lambda i: F.substr(F.col(text), i, F.lit(width)))
    each = F.transform("grams", lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice("grams", F.lit(1), i), lambda y: y == x))))
    return rows.withColumn("grams", grams).withColumn("block", F.explode(each)).drop("grams")


def _rarest(grams: DataFrame, counts: DataFrame, text: str, carried: list[str]) -> DataFrame:
    """Of each string so many of its rarest grams that one of them is shared with any string to be found: one more than it may lack."""
    ranked = grams.join(counts, ["g", "lb", "block"], "left").groupBy(text, "g", "lb", "most", *carried)
    blocks = ranked.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "block"))).alias("blocks"))
    return blocks.select(text, "g", "lb", *carried, F.explode(F.slice("blocks", F.lit(1), F.col("most") + 1)).alias("x")).withColumn("block", F.col("x.block")).drop("x")


def candidates(rows: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(key, g, name, entity_id): all pairs of a group whose ratio can reach ``least``, and others. ``rows``: key, g; ``names``: name, g, entity_id.

    Strings of ratio r have m letters in common, in order, of which r sets the least number. Where at most one
    letter of either is over, a pair shares a string that is left without it: n strings of n letters. Of others, m sets how
    many grams may differ; of that many and one, the rarest among names of the length first, one is shared. So a name has rows by its
    length times the share of letters that may differ, and pieces that all names have, like a common beginning, bring no pairs
    together. A mention looks for names of each length that occurs."""
    near = _variants(rows, "key", "la", "lb", least).join(_variants(names, "name", "lb", "la", least), ["g", "la", "lb", "block"])
    width = gram_width(least)
    n = F.length("name")
    known = names.withColumn("lb", n).withColumn("most", F.array_max(F.transform(_reach(n, least), lambda m: _spoilt(n, m, width, least)))).where("most IS NOT NULL")
    asked = rows.withColumn("lb", F.explode(_reach(F.length("key"), least))).withColumn("most", _spoilt(F.length("key"), F.col("lb"), width, least))
    asked = asked.where("most IS NOT NULL").join(known.select("g", "lb").distinct(), ["g", "lb"], "left_semi")
    known = _grams(known, "name", width)
    counts = known.groupBy("g", "lb", "block").agg(F.count("*").alias("often"))
    far = _rarest(_grams(asked, "key", width), counts, "key", []).join(_rarest(known, counts, "name", ["entity_id"]), ["g", "lb", "block"])
    columns = ["key", "g", "name", "entity_id"]
    return near.select(*columns).unionByName(far.select(*columns)).distinct()


def fuzzy(mentions: DataFrame, entities: DataFrame, synonyms: DataFrame | None = None, least: float = LEAST_RATIO) -> DataFrame:
    """(mention, entity_id, ratio): the most similar name or synonym of the type group, at ``least`` or more.

    Pairs meet by an index that loses none (see candidates); bounds on the ratio come before the ratio.
    Equal names meet once. Ties go to the least id."""
    rows = mentions.select(F.lower(F.trim("name")).alias("key"), group(F.col("entity_type")).alias("g")).distinct()
    every = entities.select("id", F.lower(F.trim("canonical_name")).alias("name"), group(F.col("entity_type")).alias("g"))
    if synonyms is not None:
        every = every.unionByName(synonyms.select(F.col("entity_id").alias("id"), F.col("synonym").alias("name")).join(every.select("id", "g"), "id"))
    names = every.groupBy("name", "g").agg(F.min("id").alias("entity_id"))
    pairs = candidates(rows, names, least)

    @F.pandas_udf("double")
    def ratio(keys: pd.Series, others: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> float:
            m = SequenceMatcher(None, a, b)
            return m.ratio() if m.quick_ratio() >= least else 0.0

        return pd.Series([one(a, b) for a, b in zip(keys, others)], dtype="float64")

    scored = pairs.withColumn("ratio", ratio("key", "name")).where(F.col("ratio") >= least)
    best = scored.groupBy("key", "g").agg(F.min(F.struct((-F.col("ratio")).alias("low"), "entity_id")).alias("x"))
    asked = mentions.select("mention", F.lower(F.trim("name")).alias("key"), group(F.col("entity_type")).alias("g"))
    return asked.join(best, ["key", "g"]).select("mention", "x.entity_id", F.round(-F.col("x.low"), 6).alias("ratio"))


def every_name(mentions: DataFrame) -> DataFrame:
    """A row for each name of a mention: its own, then its ``synonyms`` (array, may be missing), with the place of each."""
    more = F.coalesce("synonyms", F.array().cast("array<string>")) if "synonyms" in mentions.columns else F.array().cast("array<string>")
    each = mentions.select("mention", "entity_type", "organism", F.posexplode(F.concat(F.array("name"), more)).alias("place", "name"))
    return each.where(F.trim("name") != "")


def first_exact(names: DataFrame, entities: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(mention, entity_id, rung): of a mention's names the first that resolves."""
    key = F.concat_ws("#", "place", "mention")
    hits = exact(names.withColumn("mention", key), entities, synonyms)
    at = F.split_part("mention", F.lit("#"), F.lit(1)).cast("int")
    own = F.expr("substring(mention, locate('#', mention) + 1)")
    return hits.select(own.alias("mention"), at.alias("place"), "entity_id", "rung").groupBy("mention").agg(F.min(F.struct("place", "entity_id", "rung")).alias("x")).select("mention", "x.entity_id", "x.rung")


def cascade(mentions: DataFrame, entities: DataFrame, synonyms: DataFrame, resolved: DataFrame | None = None, least: float = LEAST_RATIO) -> DataFrame:
    """(mention, entity_id, how): the first name that is exact; with the names that an outside source adds, again; else fuzzy by
    name; else a new entity, one for each name and type group.

    ``resolved``: (mention, canonical_name, accession, names), what that source found; its canonical name goes to a new entity.
    New entities of a batch don't see each other but for equal names: order within it has no effect. What each step found is written, so that the
    plans don't hold each other, and names are only compared if a mention is left."""
    names = every_name(mentions)
    first = materialize(first_exact(names, entities, synonyms).select("mention", "entity_id", F.concat(F.lit("exact:"), "rung").alias("how")), "exact")
    rest, out = mentions.join(first, "mention", "left_anti"), first
    if resolved is not None:
        wider = rest.join(resolved.select("mention", "names"), "mention").select("mention", "entity_type", "organism", F.posexplode("names").alias("place", "name"))
        again = materialize(first_exact(wider, entities, synonyms).select("mention", "entity_id", F.concat(F.lit("resolved:"), "rung").alias("how")), "again")
        rest, out = rest.join(again, "mention", "left_anti"), out.unionByName(again)
    rest = materialize(rest, "rest")
    if rest.isEmpty():
        return out
    second = materialize(fuzzy(rest, entities, synonyms, least).select("mention", "entity_id", F.lit("fuzzy").alias("how")), "fuzzy")
    left = rest.join(second, "mention", "left_anti")
    if resolved is not None:
        left = left.join(resolved.select("mention", F.col("canonical_name").alias("better")), "mention", "left").withColumn("name", F.coalesce("better", "name"))
    new = left.select("mention", F.concat(F.lit("new:"), group(F.col("entity_type")), F.lit(":"), F.lower(F.trim("name"))).alias("entity_id"), F.lit("created").alias("how"))
    return out.unionByName(second).unionByName(new)


def created(mentions: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New entities (id, canonical_name, entity_type, organism) of cascade(), and their synonyms (entity_id, synonym): their names and all that were given."""
    new = mentions.join(resolved.where("how = 'created'").select("mention", "entity_id"), "mention")
    first = F.min(F.struct("mention", F.trim("name").alias("canonical_name"), "entity_type", "organism")).alias("x")
    rows = new.groupBy(F.col("entity_id").alias("id")).agg(first).select("id", "x.canonical_name", "x.entity_type", "x.organism")
    own = every_name(mentions).join(new.select("mention", "entity_id"), "mention")
    return rows, own.select("entity_id", F.lower(F.trim("name")).alias("synonym")).distinct()


def learn_synonyms(resolved: DataFrame, mentions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(entity_id, synonym) pairs that the mentions add; empty names and known pairs are left out."""
    new = every_name(mentions).join(resolved.select("mention", "entity_id"), "mention").select("entity_id", F.lower(F.trim("name")).alias("synonym")).where("synonym != ''").distinct()
    return new.join(synonyms, ["entity_id", "synonym"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column, null_conflicts: bool = False) -> DataFrame:
    """One row a key: of old and new together, the one that sorts first by ``order``.

    Rows with a null in a key never conflict, so all of them stay; with ``null_conflicts`` nulls equal each other."""
    rows = old.unionByName(new)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    keyed = rows if null_conflicts else rows.where(whole)
    best = keyed.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("x"))
    best = best.select(*keys, "x.*").select(*rows.columns)
    return best if null_conflicts else best.unionByName(rows.where(~whole))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new``, one a key, that ``old`` lacks."""
    return new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys)


def merge_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Results by (entity, mode): the deeper one stays, of equals the new; expiry is the new one's, hits start at 0."""
    both = cache.withColumn("new", F.lit(0)).unionByName(fresh.withColumn("new", F.lit(1)))
    merged = both.groupBy("entity", "mode").agg(
        F.max_by(F.struct("max_depth", "result"), F.struct("max_depth", "new")).alias("r"), F.max_by("expires", "new").alias("expires"), F.max("new").alias("touched"), F.max_by("hits", "new").alias("hits")
    )
    return merged.select("entity", "mode", "r.max_depth", "r.result", "expires", F.when(F.col("touched") == 1, 0).otherwise(F.col("hits")).alias("hits"))


def cache_hits(cache: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """The requests (entity, mode, depth) that the cache answers: unexpired, and as deep at least."""
    return asked.join(cache, ["entity", "mode"]).where((F.col("expires") > now) & (F.col("depth") <= F.col("max_depth"))).select("entity", "mode", "depth", "result")


def similar_window(want: str, body: str, least: float) -> bool:
    """Whether ``want`` is as similar as ``least`` to a window of the text: its length and 50 more, every half length (50 at least).

    Windows that share too few letters are left out by counts of letters, before any is compared; first all at once, by the letters of the whole text."""
    step, most = max(len(want) // 2, 50), max(1, len(body) - len(want) + 1)
    have, there = Counter(want), Counter(body)
    shortest = min(len(want) + 50, len(body) - (most - 1) // step * step)  # the last window
    if 2 * sum(min(n, there[letter]) for letter, n in have.items()) < least * (len(want) + shortest) - 1e-9:
        return False
    starts = np.arange(0, most, step)
    stops = np.minimum(starts + len(want) + 50, len(body))
    shared, letters = np.zeros(len(starts)), np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4")
    for letter, n in have.items():
        sums = np.concatenate(([0], np.cumsum(letters == ord(letter))))
        shared += np.minimum(n, sums[stops] - sums[starts])
    hopeful = np.flatnonzero(2 * shared >= least * (len(want) + stops - starts) - 1e-9)
    return any(SequenceMatcher(None, want, body[starts[i] : stops[i]]).ratio() >= least for i in hopeful)
