import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def frame(spark, pdf, ts=("timestamp",)):
    """pandas -> Spark with NTZ times and nulls in place of NaN."""
    df = spark.createDataFrame(pdf)
    for c in ts:
        if c in pdf.columns:
            df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    doubles = [c for c in pdf.columns if pdf[c].dtype == np.float64]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def series(n, freq="1min", start="2024-01-01", **cols):
    return pd.DataFrame({"timestamp": pd.date_range(start, periods=n, freq=freq), **cols})


def same(a, b, tol=1e-9):
    np.testing.assert_allclose(np.asarray(a, dtype=float), np.asarray(b, dtype=float), rtol=tol, atol=tol, equal_nan=True)
