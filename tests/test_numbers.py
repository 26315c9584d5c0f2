"""Exact rounding against Python's."""

import math
import random

from pyspark.sql import functions as F

from claimweave.functions.numbers import exact_round


def test_equals_python(spark):
    rng = random.Random(4)
    values = [rng.uniform(-2, 2) for _ in range(8_000)] + [rng.randrange(-40_000, 40_000) / 2 / 10**rng.randrange(1, 6) for _ in range(8_000)]
    values += [k / 8 for k in range(-40, 40)] + [k / 1000 + 0.0005 for k in range(2_000)] + [(2 * k + 1) / 2**j for k in range(200) for j in (5, 6, 9)] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-20, 20) for _ in range(2_000)]
    values += [0.0, -0.0, 2.675, 0.5, 1.5, 2.5, 1e300, -1e300, 5e-324, 0.49999999999999994, 1e15 + 0.5, math.inf, -math.inf]
    rows = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "x double")
    for digits in (0, 1, 3, 4, 6):
        for r in rows.select("x", exact_round(F.col("x"), digits).alias("y")).collect():
            if r.x is None or math.isnan(r.x) or math.isinf(r.x):
                assert r.y is None if r.x is None else (math.isnan(r.y) if math.isnan(r.x) else r.y == r.x)
            elif abs(r.x) * 10**digits < 2**51:
                assert r.y == round(r.x, digits), (r.x, digits)
