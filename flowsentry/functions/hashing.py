"""Deterministic per-row randomness.

Everything random in the library (splits, quota cuts, fit samples, minibatch
order) hangs off md5 of a row key and a seed, so results do not depend on
partitioning, task retries or executor loss.  The same numbers are
reproducible in DuckDB: ``('0x' || substr(md5(s), 1, k))::bigint``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keyed(key: Column | str, seed: int | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(k.cast("string"), F.lit(f":{seed}"))


def hash_bits(key: Column | str, seed: int | str, hex_digits: int = 15) -> Column:
    """Non-negative integer made of the first ``hex_digits`` hex digits of
    md5(key:seed); 15 digits = 60 uniform bits, fits a signed bigint."""
    return F.conv(F.md5(_keyed(key, seed)).substr(1, hex_digits), 16, 10).cast("bigint")


def hash_bucket(key: Column | str, seed: int | str, buckets: int = 10_000) -> Column:
    """Uniform bucket in [0, buckets) from the first 8 hex digits."""
    return (hash_bits(key, seed, 8) % F.lit(buckets)).cast("int")


def hash_unit(key: Column | str, seed: int | str) -> Column:
    """Uniform double in [0, 1) from 60 hash bits."""
    return hash_bits(key, seed, 15).cast("double") / F.lit(float(1 << 60))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``value`` as a column that is computed once a row: a one-element
    array is exploded, and a filter on what hangs on the column reads it there
    instead of being rewritten into its expression, hash for hash."""
    return df.select("*", F.explode(F.array(value)).alias(name))
