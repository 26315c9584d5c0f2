"""The Merkle manifest against a plain one, of all rows and of chosen leaves."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    doc, source, lang, n, text = row
    return H(*map(field, (doc, source, lang, n if n is None else n + more, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    """The contract, row by row."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    order = sorted(by_lang, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in order:
        mine = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = (mine, levels_of([leaf_of(r) for r in mine]))
    top = levels_of([trees[lang][1][-1][0] for lang in order])
    out = []
    for place, lang in enumerate(order):
        mine, levels = trees[lang]
        for i, row in enumerate(mine):
            h = leaf_of(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            beside = []
            for tree, j in ((levels, i), (top, place)):
                for level in tree[:-1]:
                    s = level[j ^ 1] if (j ^ 1) < len(level) else ""
                    beside.append(s)
                    h, j = (H(s, h) if j & 1 else H(h, s)), j >> 1
            out.append((row[0], levels[0][i], levels[-1][0], top[-1][0], H(*beside), h, h == top[-1][0]))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


ROWS = [(i, f"src{i % 3}", ["en", "de", None, "ñ"][i % 4], i * 3, f"text {i} ü") for i in range(150)]
ODD = [
    (None, None, None, None, None),
    (None, "a", "en", 1, ""),
    (7, "a", "en", None, "x"),
    (7, "a", "en", None, "x"),  # a repeated row
    (7, "a", "en", 2, "x"),  # another row of the id
    (900, "a", "", 5, None),  # an empty language isn't null
    (901, "a", "alone", 2**40, "long " * 50_000),
]


@pytest.mark.parametrize("height", [1, 3, 10])
def test_manifest(spark, height):
    rows = ROWS + ODD
    got = result(merkle.merkle_manifest(spark.createDataFrame(rows, COLUMNS), height))
    assert got == plain(rows)
    assert {r[6] for r in got} == {True, False}


def test_roots_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FEW", 0)
    assert result(merkle.merkle_manifest(spark.createDataFrame(ROWS, COLUMNS))) == plain(ROWS)


def test_one_row_no_rows_and_other_columns(spark):
    one = ROWS[3:4]
    assert result(merkle.merkle_manifest(spark.createDataFrame(one, COLUMNS))) == plain(one)
    assert merkle.merkle_manifest(spark.createDataFrame([], COLUMNS)).count() == 0
    clash = spark.createDataFrame(ROWS, COLUMNS).withColumns({c: F.lit("?") for c in ("tree", "idx", "leaf", "n", "root", "hash", "block", "copy", "_at")})
    assert result(merkle.merkle_manifest(clash)) == plain(ROWS)


def test_proofs_of_chosen_leaves(spark):
    """A sparse choice: the same proofs, from few fetched nodes."""
    want = {r[0]: r for r in plain(ROWS)}
    leaves, nodes = merkle.manifest(spark.createDataFrame(ROWS, COLUMNS), merkle.tampered(), 4)
    got = result(merkle.prove(leaves.where("doc_id % 11 = 5 OR doc_id = 8"), nodes, 4))
    chosen = [i for i in range(150) if i % 11 == 5 or i == 8]
    assert got == sorted((want[i] for i in chosen), key=str)


def test_missing_is_the_least_union():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 13):
        for _ in range(20):
            chosen = np.flatnonzero(rng.random(n) < 0.4)
            if not len(chosen):
                continue
            known, level, size, want = {int(i) for i in chosen}, 0, n, set()
            while size > 1:
                want |= {(level, i ^ 1) for i in known if (i ^ 1) < size and (i ^ 1) not in known}
                known, size, level = {i >> 1 for i in known}, (size + 1) // 2, level + 1
            got = list(merkle.missing(chosen, n))
            assert sorted(got) == sorted(want) and len(set(got)) == len(got)
