import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millwatch.functions.rounding import round_exact, round_scaled


def test_rounding_agrees_with_python_and_numpy(spark):
    rng = np.random.default_rng(3)
    numbers = np.concatenate(
        [
            np.round(rng.random(4000), 6), np.arange(2001) / 2000, np.arange(401) / 400,
            rng.normal(0, 50, 2000), [0.0, 0.5, 1.5, 2.675, 1.005, 0.1235, 87.6545, -0.0005, 1e12 + 0.125],
        ]
    )
    df = spark.createDataFrame(pd.DataFrame({"x": numbers}))
    got = df.select(
        "x", *[round_exact(F.col("x"), d).alias(f"e{d}") for d in (1, 2, 3)],
        *[round_scaled(F.col("x"), d).alias(f"s{d}") for d in (3, 6)],
    ).toPandas()
    for digits in (1, 2, 3):
        assert got[f"e{digits}"].tolist() == [round(x, digits) for x in got["x"]]
    for digits in (3, 6):
        assert np.array_equal(got[f"s{digits}"], np.round(got["x"].to_numpy(), digits))
