"""Fingerprints of texts."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fingerprint_text(text: str) -> str:
    """xxh3: and 16 hexadecimal digits over the UTF-8 bytes, seed 0."""
    return f"xxh3:{xxhash.xxh3_64_intdigest(text.encode()):016x}"


def fingerprint_text_wide(text: str) -> str:
    """xxh3-128: and 32 hexadecimal digits."""
    return f"xxh3-128:{xxhash.xxh3_128_intdigest(text.encode()):032x}"


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fingerprint_text(t))


@F.pandas_udf(T.StringType())
def fingerprint_wide(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fingerprint_text_wide(t))


def sha256_fingerprint(text: Column) -> Column:
    """sha256: and 64 hexadecimal digits; stays in the JVM."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))
