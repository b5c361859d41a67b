"""Appends, upserts and their merge rules as joins and aggregates over keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key (nulls equal) ``existing`` lacks, one a key."""
    e = existing.select(*keys).distinct()
    cond = [new[k].eqNullSafe(e[k]) for k in keys]
    return new.join(e, cond, "left_anti").dropDuplicates(keys)


def upsert_last(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All keys, each with its row of the highest version; ``new`` wins ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys and c != version]
    return both.groupBy(*keys).agg(F.max(F.struct(version, "_new", *rest)).alias("_r")).select(*keys, f"_r.{version}", *[f"_r.{c}" for c in rest])


def open_and_close(quotes: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Write-once opening and last-value closing: the first non-null value stays, the last reading wins even if null."""
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(at, value)))[value]
    return quotes.groupBy(*keys).agg(first.alias(f"{value}_open"), F.max_by(value, at).alias(f"{value}_close"), F.count("*").alias("n"))


def fill_from(new: DataFrame, old: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Non-destructive update: a null in ``new`` leaves the value of ``old``."""
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    return old.join(n, keys, "left").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, else null; a rule that can't be decided is broken."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(F.lit(name))
    return out


def record_hash(*cols: str) -> Column:
    """SHA-256 of a record as JSON with its fields by name; the field that holds it isn't one of them."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def append_lines(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines; what is there stays as it is."""
    df.write.mode("append").json(path)


def persist(df: DataFrame, path: str) -> None:
    """Puts a ledger in the place of what was there, as a table and as CSV with a header."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
