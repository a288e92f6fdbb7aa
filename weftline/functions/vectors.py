"""Vector expressions over array<float>."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 for a zero vector, empty vectors or unlike lengths, null for a null vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the normalised mean of each key's vectors, which have one length.

    Sums by position with partial aggregation, so no key's vectors meet in one task.
    """
    sums = rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return mean.select(key, normalise(F.transform("v", lambda e: e["x"])).alias(vector))


@F.pandas_udf(T.BinaryType())
def to_blob(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else struct.pack(f"<{len(x)}f", *x))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(b: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; bytes left over at the end are dropped."""
    return b.map(lambda x: None if x is None else list(struct.unpack(f"<{len(x) // 4}f", bytes(x[: len(x) // 4 * 4]))))


def register(spark: SparkSession) -> None:
    """Make cosine, fold_key, xxh3 fingerprints and markdown sniffing callable from SQL."""
    from weftline.functions import hashing

    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        "CASE WHEN size(a) <> size(b) OR size(a) = 0 THEN 0D ELSE coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / "
        "nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D), 0D) END"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION fold_key(name STRING) RETURNS STRING RETURN translate(regexp_replace(name, '^[\\\\s\\\\p{{Z}}]+|[\\\\s\\\\p{{Z}}]+$', ''), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    )
    spark.udf.register("fingerprint", hashing.fingerprint)
    spark.udf.register("fingerprint_wide", hashing.fingerprint_wide)
