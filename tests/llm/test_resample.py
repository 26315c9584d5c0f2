"""Importance resampling against counts of whole texts."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from claimweave.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def buckets(text, n):
    ws = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(ws[i : i + g]).encode()) % 10_000 for g in range(1, n + 1) for i in range(len(ws) - g + 1)], len(ws)


def plain(docs, target, n=1, percent=10, least=20):
    found, wanted = [buckets(t, n) for _, t in docs], [buckets(t, n)[0] for t in target]
    s, t = Counter(b for f, _ in found for b in f), Counter(b for f in wanted for b in f)
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    rows = []
    for (doc, text), (f, n_words) in zip(docs, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append(([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))], n_words))
    drawn = sorted((r for r, w in rows if w >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(drawn[: len(drawn) * percent // 100])}
    return sorted([(*r, rank.get(id(r))) for r, _ in rows], key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


LINE = "The quick Brown fox jumps over the lazy dog again and again."
DOCS = [(i, "\n".join([LINE] * (i % 4) + [f"Wort{i % 7} ÄPFEL-äpfel {i}x y" for _ in range(i % 5)])) for i in range(120)] + [
    (500, None), (501, ""), (502, "\n\n \t\n"), (503, "!?. --"), (504, "\r\n".join(["a b", "c", "", "d e f"] * 10)), (None, "no id " * 12), (505, "İ𝔘x ASCII\x00nul " * 20_000),
]
TARGET = ["the lazy dog", "wort3 äpfel", None, ""]


def frames(spark, docs, target=TARGET):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")


@pytest.mark.parametrize("n", [1, 3])
def test_equals_whole_texts(spark, n):
    docs = DOCS if n == 1 else DOCS[:-1]
    got = result(resample.resample(*frames(spark, docs), n, percent=30))
    assert got == plain(docs, TARGET, n, 30)
    assert sum(r[4] is not None for r in got) > 10


def test_repeated_rows_and_ids(spark):
    """Repeated rows are drawn each; texts of one id stay apart."""
    docs = DOCS[:40] * 3 + [(7, "another text of seven " * 9), (7, None)]
    got = result(resample.resample(*frames(spark, docs), percent=50))
    want = plain(docs, TARGET, percent=50)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])


def test_empty_tables_and_other_columns(spark):
    none, target = frames(spark, [])
    assert resample.resample(none, target).count() == 0
    docs, none = frames(spark, DOCS[:30], [])
    assert result(resample.resample(docs, none)) == plain(DOCS[:30], [])
    docs, target = frames(spark, DOCS[:30])
    clash = docs.withColumns({c: F.lit("?") for c in ("line", "key", "tie", "gain", "bucket", "buckets", "copies", "score", "place", "rank", "weight")})
    assert result(resample.resample(clash, target)) == plain(DOCS[:30], TARGET)


def test_lines_are_counted_once(spark):
    docs, _ = frames(spark, DOCS[:60])
    rows = resample.segments(docs).collect()
    lines = Counter(line for _, t in DOCS[:60] for line in t.split("\n") if WORD.search(line.translate(LOWER)))
    assert sorted(r["occurrences"] for r in rows) == sorted(lines.values())
