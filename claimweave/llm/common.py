"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def mod_of_crc(column: str, modulus: int) -> Column:
    """crc32 of a column written as text, modulo ``modulus``; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def by_size(batch: pd.DataFrame, column: str, most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """The batch in parts of at most about ``most`` characters of the column, so that what is made of a part stays small."""
    sums = batch[column].str.len().cumsum().to_numpy()
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(sums.searchsorted((sums[start - 1] if start else 0) + most, "right")))
        yield batch[start:stop]
        start = stop


def slices(rows: list[tuple], columns: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    """The rows as frames of at most ``size`` rows; none for no rows."""
    for i in range(0, len(rows), size):
        yield pd.DataFrame(rows[i : i + size], columns=columns)


#: DuckDB SQL of a table with one row: the remainders t of the 256 bytes, made by shifts.
CRC_TABLE = """(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)) q)"""


def crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8 bytes, beside CRC_TABLE's column t."""
    units = f"list_transform(range(0, strlen({text})), lambda k: CAST(('0x' || substr(hex({text}), CAST(2 * k + 1 AS BIGINT), 2)) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {units}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
