"""Merkle manifest of a table, proved by an octopus multiproof.

Each row is a leaf: the digest of its fields. The leaves of a language, in order of doc_id, make a
tree, whose nodes are digests of two consecutive nodes (the last of an odd number: of one); the roots
of the languages, in order of language, make one more tree in the same way, and its root is that of
the manifest.

* ``leaves`` gives rows their places by ranges, so a language of any size is spread.
* ``grow`` hashes blocks of 2 ** height consecutive nodes, each in one task, to their common
  ancestor, then blocks of these, and so on: the rounds grow with the logarithm of the number of rows.
* ``prove`` deals the chosen leaves by block. A block computes which nodes it lacks: the least set
  of coordinates (tree, level, index) with which all of its leaves reach the root. These are fetched by
  one join, interiors that several leaves share are derived once, and each leaf's own proof
  is read off. Blocks of chosen leaves may have gaps.

Rows that agree in doc_id and all fields are leaves of their own, side by side; rows of one doc_id that
differ are ordered by leaf. A null doc_id comes first. A null is written ``-``, so it differs from
an empty text. A table without rows has no leaves, no root and no proofs. Other columns than the five aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import CRC_TABLE, crc_sql
from claimweave.operators.order import placed
from claimweave.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: FEW: with so many trees at most, their roots are broadcast.
HEIGHT, FEW = 10, 10_000
#: The tree over the languages' roots; languages are written with a mark before them, null as the mark of its own that sorts first.
TOP, NONE, SOME = "", "-", "="


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(**values: Column) -> Column:
    """The digest of a row's fields, some of them replaced by ``values``."""
    def field(name: str) -> Column:
        value = values.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def leaves(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """(tree, doc_id, leaf, claimed, idx, n): each row's leaf, what is claimed to be its leaf (null: the same), its place in the tree, and the tree's size."""
    tree = F.coalesce(F.concat(F.lit(SOME), F.col("lang").cast("string")), F.lit(NONE))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf().alias("leaf"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    alike = rows.groupBy("tree", "doc_id", "leaf", "claimed").agg(F.count("*").alias("copies"))
    single = alike.select("tree", "doc_id", "leaf", "claimed", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return materialize(placed(single, ["tree"], ["doc_id", "leaf", "copy"], "idx", "n"), "leaves").drop("copy")


def _above(key: tuple, block: pd.DataFrame, height: int) -> pd.DataFrame:
    """All nodes above a block of one level's nodes, up to its ancestor ``height`` levels on, or to the root."""
    block = block.sort_values("idx")
    n, level, first = int(block["n"].iat[0]), int(block["level"].iat[0]), int(block["idx"].iat[0])
    here, rows = block["hash"].tolist(), []
    for _ in range(height):
        if n == 1:
            break
        here = [digest(*here[i : i + 2]) for i in range(0, len(here), 2)]
        n, level, first = (n + 1) // 2, level + 1, first // 2
        rows += [(key[0], level, first + i, n, h) for i, h in enumerate(here)]
    return pd.DataFrame(rows, columns=["tree", "level", "idx", "n", "hash"])


NODE = "tree string, level int, idx long, n long, hash string"


def grow(level0: DataFrame, height: int = HEIGHT) -> DataFrame:
    """All nodes (tree, level, idx, n, hash) of the trees over (tree, idx, n, hash); n is the number of nodes of their level."""
    here = level0.select("tree", F.lit(0).alias("level"), "idx", "n", "hash")
    every = here
    while not here.where("n > 1").isEmpty():
        above = here.where("n > 1").withColumn("block", F.shiftright("idx", height)).groupBy("tree", "block").applyInPandas(lambda key, block: _above(key, block, height), NODE)
        above = materialize(above, "nodes")
        every = every.unionByName(above)
        last = above.groupBy("tree").agg(F.max("level").alias("level"))
        here = above.join(last, ["tree", "level"])
    return every


def manifest(docs: DataFrame, claimed: Column | None = None, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(leaves, nodes): the leaves with their language's place ``r`` among ``m``, its ``subroot`` and the ``root``; the nodes of all trees."""
    low = leaves(docs, claimed)
    nodes = grow(low.select("tree", "idx", "n", F.col("leaf").alias("hash")), height)
    subroots = placed(nodes.where("n = 1").select("tree", F.col("hash").alias("subroot")), [], ["tree"], "r")
    trees = nodes.where("n = 1").count()
    subroots = materialize(subroots.withColumn("m", F.lit(trees).cast("long")), "subroots")
    top = grow(subroots.select(F.lit(TOP).alias("tree"), F.col("r").alias("idx"), F.col("m").alias("n"), F.col("subroot").alias("hash")), height)
    root = top.where("n = 1").first()
    subroots = subroots.withColumn("root", F.lit(root["hash"] if root else None).cast("string"))
    few = trees <= FEW  # a row for each language
    return low.join(F.broadcast(subroots) if few else subroots, "tree"), nodes.unionByName(top)


def missing(chosen: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """The fewest (level, index) that give the root of ``n`` leaves from the chosen ones, sorted and each once."""
    level, have = 0, chosen
    while n > 1:
        beside = have ^ 1
        for i in beside[(beside < n) & ~np.isin(beside, have, assume_unique=True)].tolist():
            yield level, i
        have, n, level = np.unique(have >> 1), (n + 1) // 2, level + 1


def _lacks(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    one = block.iloc[0]
    rows = [(*key, key[0], *x) for x in missing(np.unique(block["idx"].to_numpy()), int(one["n"]))]
    rows += [(*key, TOP, *x) for x in missing(np.array([int(one["r"])]), int(one["m"]))]
    return pd.DataFrame(rows, columns=["tree", "block", "of", "level", "idx"])


def _levels(known: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> list[dict[int, str]]:
    """The known and fetched nodes of each level, with those that are derived from them, up to the root."""
    by_level: dict[int, dict[int, str]] = {}
    for (level, i), h in fetched.items():
        by_level.setdefault(level, {})[i] = h
    out = [known | by_level.get(0, {})]
    while n > 1:
        below = out[-1]
        n = (n + 1) // 2
        derived = {p: digest(below[2 * p], below.get(2 * p + 1, "")) for p in {i >> 1 for i in below}}
        out.append(derived | by_level.get(len(out), {}))
    return out


def _path(levels: list[dict[int, str]], i: int) -> list[tuple[str, bool]]:
    """The sibling at each level below the root, and whether it stands on the left; no text where there is none."""
    return [(here.get((i >> at) ^ 1, ""), bool((i >> at) & 1)) for at, here in enumerate(levels[:-1])]


def fold(h: str, path: list[tuple[str, bool]]) -> str:
    for beside, left in path:
        h = digest(beside, h) if left else digest(h, beside)
    return h


PROOF = "doc string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _expand(key: tuple, block: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
    """The proof of each of a block's leaves, from the leaves and the nodes that were fetched for them."""
    if block.empty:
        return pd.DataFrame(columns=["doc", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    one = block.iloc[0]
    mine, above = {}, {}
    for of, level, i, h in zip(got["of"], got["level"], got["idx"], got["hash"]):
        (above if of == TOP else mine)[level, i] = h
    levels = _levels(dict(zip(block["idx"].tolist(), block["leaf"])), mine, int(one["n"]))
    top = _path(_levels({int(one["r"]): levels[-1][0]}, above, int(one["m"])), int(one["r"]))
    rows = []
    for doc, h, claimed, i in zip(block["doc"], block["leaf"], block["claimed"], block["idx"].tolist()):
        path = _path(levels, i) + top
        folded = fold(claimed or h, path)
        rows.append((doc, h, levels[-1][0], one["root"], digest(*[s for s, _ in path]), folded, folded == one["root"]))
    return pd.DataFrame(rows, columns=["doc", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def prove(chosen: DataFrame, nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of the chosen leaves of a manifest."""
    kind = dict(chosen.dtypes)["doc_id"]
    rows = chosen.withColumn("block", F.shiftright("idx", height))
    lacks = rows.select("tree", "block", "idx", "n", "r", "m").groupBy("tree", "block").applyInPandas(_lacks, "tree string, block long, of string, level int, idx long")
    stored = nodes.select(F.col("tree").alias("of"), "level", "idx", "hash")
    got = lacks.join(stored, ["of", "level", "idx"])
    dealt = rows.select("tree", "block", F.col("doc_id").cast("string").alias("doc"), "leaf", "claimed", "idx", "n", "r", "m", "root").groupBy("tree", "block")
    out = dealt.cogroup(got.groupBy("tree", "block")).applyInPandas(_expand, PROOF)
    return out.select(F.col("doc").cast(kind).alias("doc_id"), *[c for c in out.columns if c != "doc"])


def tampered() -> Column:
    """The leaf of a row whose n_chars was raised by one, where 7 divides the crc32 of the decimal doc_id; else null."""
    raised = F.col("n_chars").cast("decimal(20,0)") + 1
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(n_chars=raised))


def merkle_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The proof of every row, checked against what is claimed after tampering."""
    return prove(*manifest(docs, tampered(), height), height)


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


#: Nodes level by level, then each leaf's way up through its language's tree and the tree above.
ORACLE_SQL = f"""
WITH RECURSIVE hashed AS (SELECT doc_id, coalesce('{SOME}' || lang, '{NONE}') AS tree, {_leaf("n_chars")} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS claimed FROM documents, {CRC_TABLE} c),
low AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS r FROM hashed),
nodes AS (SELECT tree, 0 AS level, idx, count(*) OVER (PARTITION BY tree) AS n, leaf AS hash FROM low
  UNION ALL SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level + 1, idx // 2, (n + 1) // 2),
tops AS (SELECT '{TOP}' AS tree, 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, hash FROM nodes WHERE n = 1
  UNION ALL SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY tree, level + 1, idx // 2, (n + 1) // 2),
places AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS place, hash AS subroot FROM nodes WHERE n = 1),
every AS (SELECT * FROM nodes UNION ALL SELECT * FROM tops),
up AS (SELECT r, tree, 0 AS level, idx, CAST('' AS VARCHAR) AS beside, coalesce(claimed, leaf) AS hash, (SELECT max(n) FROM nodes x WHERE x.tree = low.tree AND x.level = 0) AS n FROM low
  UNION ALL SELECT up.r, CASE WHEN up.n > 1 THEN up.tree ELSE '{TOP}' END, CASE WHEN up.n > 1 THEN up.level + 1 ELSE 0 END, CASE WHEN up.n > 1 THEN up.idx // 2 ELSE p.place END, up.beside || coalesce(s.hash, ''),
    CASE WHEN up.n = 1 THEN up.hash WHEN up.idx % 2 = 1 THEN sha256(s.hash || up.hash) ELSE sha256(up.hash || coalesce(s.hash, '')) END,
    CASE WHEN up.n > 1 THEN (up.n + 1) // 2 ELSE (SELECT count(*) FROM places) END
    FROM up LEFT JOIN every s ON up.n > 1 AND s.tree = up.tree AND s.level = up.level AND s.idx = xor(up.idx, 1) LEFT JOIN places p ON p.tree = up.tree WHERE up.n > 1 OR up.tree <> '{TOP}')
SELECT doc_id, leaf, p.subroot, root, sha256(beside) AS proof_sha256, up.hash AS folded_root, up.hash = root AS verified
FROM up JOIN low USING (r) JOIN places p ON p.tree = low.tree, (SELECT hash AS root FROM tops WHERE n = 1) t WHERE up.tree = '{TOP}' AND up.n = 1"""
