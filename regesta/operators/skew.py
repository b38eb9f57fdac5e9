"""Per-key results where a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regesta.session import materialise_with

#: name -> (partial aggregate, merge of partials); what can be made from these is exact in two stages.
Agg = tuple[Callable[[], Column], Callable[[str], Column]]


def rows() -> Agg:
    return (lambda: F.count("*"), lambda c: F.sum(c))


def total(column: str) -> Agg:
    return (lambda: F.sum(column), lambda c: F.sum(c))


def least(column: str) -> Agg:
    return (lambda: F.min(column), lambda c: F.min(c))


def most(column: str) -> Agg:
    return (lambda: F.max(column), lambda c: F.max(c))


def known(column: str) -> Agg:
    return (lambda: F.count(column), lambda c: F.sum(c))


def heavy_keys(counts: DataFrame, keys: list[str], n: str, share: float, whole: int | None) -> DataFrame:
    """Keys with at least share of all rows (whole) in counts (one row for a key); there are at most 1/share of them."""
    whole = whole or 0
    return counts.where(F.col(n) >= F.lit(share) * F.lit(float(whole))).where(" and ".join(f"{k} is not null" for k in keys))


def salted_aggregate(df: DataFrame, keys: list[str], identity: list[str], aggs: dict[str, Agg], *, distinct: dict[str, str] | None = None, heavy_share: float = 0.01, salts: int = 64) -> DataFrame:
    """Group df by keys in two stages, so that no task has a heavy key to itself.

    First the rows of each key are counted (combined before the shuffle). Keys holding at least heavy_share of the
    rows, at most 1/heavy_share of them and so fit for a broadcast, get a salt of 0 to salts-1 appended; all others
    get 0. The salt is a hash of the identity columns, random across rows and the same when a task runs again.
    Partials are made per key and salt and then merged per key. distinct: result name -> column whose different
    values are counted; here the salt is the hash of that value, so that the counts of the salts can be added up.

    Rows whose keys are null form a group of their own, as in SQL. An empty table gives no group. Columns of df
    named like the salt are not read. Result: keys and one column for each name of aggs and distinct.
    """
    distinct = distinct or {}
    counts, seen = materialise_with(df.groupBy(*keys).agg(F.count("*").alias("_rows")), "key-counts", whole=F.sum("_rows"))
    heavy = heavy_keys(counts, keys, "_rows", heavy_share, seen["whole"]).select(*(F.col(k).alias(f"_h_{k}") for k in keys), F.lit(True).alias("_heavy"))
    match = F.lit(True)
    for k in keys:
        match = match & (df[k] == F.col(f"_h_{k}"))
    marked = df.join(F.broadcast(heavy), match, "left")

    def salt(*columns: str) -> Column:
        return F.when(F.col("_heavy"), F.pmod(F.xxhash64(*(df[c] for c in columns)), F.lit(salts))).otherwise(F.lit(0)).alias("_salt")

    by = [df[k] for k in keys]
    partial = marked.groupBy(*by, salt(*identity)).agg(*(p().alias(name) for name, (p, _) in aggs.items()))
    merged = partial.groupBy(*keys).agg(*(m(name).alias(name) for name, (_, m) in aggs.items()))
    for name, column in distinct.items():
        values = marked.groupBy(*by, salt(column), df[column].alias("_value")).agg(F.lit(1).alias("_one"))
        per_salt = values.groupBy(*keys, "_salt").agg(F.count("_value").alias(name))
        per_key = per_salt.groupBy(*keys).agg(F.sum(name).alias(name))
        same = F.lit(True)
        for k in keys:
            same = same & merged[k].eqNullSafe(per_key[k])
        merged = merged.join(per_key, same, "left").select(*(merged[c] for c in merged.columns), per_key[name])
    return merged
