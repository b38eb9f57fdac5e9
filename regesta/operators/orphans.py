"""References to records that do not exist, or not yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regesta.session import materialise, materialise_with

KEY = ["champ", "cle"]


def first_seen(targets: DataFrame) -> DataFrame:
    """champ, cle, depuis -> the earliest depuis of each key; combined before the shuffle, so a hot key is no matter."""
    return targets.where("cle is not null").groupBy(*KEY).agg(F.min("depuis").alias("depuis"))


def _verdicts(refs: DataFrame, targets: DataFrame, heavy_keys: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references with a key, written once; heavy keys; the verdicts on keys and periods: nom_table, champ, cle, periode, absente, depuis, lourde).

    A verdict is on what is missing, or later than the first record that refers to it.
    """
    refs = materialise(refs.where("cle is not null").select("nom_table", *KEY, "periode", "enregistrement", "instant"), "references")
    groups, seen_refs = materialise_with(refs.groupBy("nom_table", *KEY, "periode").agg(F.count("*").alias("n"), F.min("instant").alias("premier")), "key-periods", total=F.sum("n"))
    heavy = groups.groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") * heavy_keys >= (seen_refs["total"] or 0)).select(*KEY)
    heavy = materialise(heavy, "heavy")
    seen = first_seen(targets).withColumn("trouvee", F.lit(True))
    late = F.coalesce(F.col("depuis") > F.col("premier"), F.lit(False))
    found = F.coalesce(F.col("trouvee"), F.lit(False))
    by_broadcast = groups.join(F.broadcast(heavy), KEY, "left_semi").join(F.broadcast(seen.join(F.broadcast(heavy), KEY, "left_semi")), KEY, "left")
    by_shuffle = groups.join(F.broadcast(heavy), KEY, "left_anti").join(seen, KEY, "left")
    verdicts = (
        by_broadcast.withColumn("lourde", F.lit(True))
        .unionByName(by_shuffle.withColumn("lourde", F.lit(False)))
        .where(~found | late)
        .select(*KEY, "nom_table", "periode", (~found).alias("absente"), "depuis", "lourde")
    )
    return refs, heavy, materialise(verdicts, "verdicts")


#: Records without a table name or period have verdicts as well, so these two compare as values.
def _as_values(df: DataFrame) -> DataFrame:
    return df.withColumns({"_table": F.coalesce("nom_table", F.lit("\u0000")), "_periode": F.coalesce("periode", F.lit("\u0000"))})


_ON = ["_table", *KEY, "_periode"]


def _judged(refs: DataFrame, heavy: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of refs (records, or counts of them, by key and period) with the verdict on their key: heavy keys by broadcast, all others by a join that the planner chooses; both united."""
    rows = _as_values(refs)
    light = _as_values(verdicts.where("not lourde")).select(*_ON, "absente", "depuis")
    hot = _as_values(verdicts.where("lourde")).groupBy("_table", *KEY).agg(F.max("absente").alias("absente"), F.max("depuis").alias("depuis"))
    cold = rows if hot.isEmpty() else rows.join(F.broadcast(heavy), KEY, "left_anti")
    return cold.join(light, _ON).unionByName(rows.join(F.broadcast(hot), ["_table", *KEY]))


def orphan_references(refs: DataFrame, targets: DataFrame, *, heavy_keys: int = 1000) -> DataFrame:
    """Every reference whose target is missing or came later than the record itself.

    refs: nom_table, champ, cle, periode, enregistrement, instant. targets: champ, cle, depuis.
    Result: nom_table, champ, cle, periode, enregistrement, absente (true: no such row; false: it came later), distinct.

    The split by skew: references are counted per key and period first, so what is joined is one row for a key and
    period. Keys with at least 1/heavy_keys of all references (there can be no more than heavy_keys of them: the
    bound of that broadcast) meet their targets by broadcast, all other keys by a shuffle join. Both give the
    verdicts, whose union then selects the records: again by broadcast for heavy keys, and for the rest by a join on key and period, where no heavy key is left.

    Null keys are no reference. A null instant of a record or target only hides lateness, never a missing row.
    Empty tables give an empty result; with no targets every reference is an orphan. Repeated rows come out once.
    """
    refs, heavy, verdicts = _verdicts(refs, targets, heavy_keys)
    rows = _judged(refs, heavy, verdicts)
    return rows.where(F.col("absente") | (F.col("depuis") > F.col("instant"))).select("nom_table", *KEY, "periode", "enregistrement", "absente").distinct()


def orphan_report(refs: DataFrame, targets: DataFrame, *, heavy_keys: int = 1000) -> DataFrame:
    """Per table, field and period: distinct records that refer to something, and how many of them refer to nothing, or to what came later.

    The counts come from partial ones: different records per key and period, counted once. Where a key is missing, all its records are orphans, so its count is added as
    it is, for heavy keys and for the others; only keys that came late are looked up record by record.
    Result: nom_table, champ, periode, references, absentes, tardives.
    """
    refs, heavy, verdicts = _verdicts(refs, targets, heavy_keys)
    by = ["nom_table", "champ", "periode"]
    records = refs.groupBy(*by, "cle", "enregistrement").agg(F.max("instant").alias("instant"))
    partial = materialise(records.groupBy(*by, "cle").agg(F.count("*").alias("n")), "partial-counts")
    missing = _judged(partial, heavy, verdicts.where("absente")).groupBy(*by).agg(F.sum("n").alias("absentes"))
    late = _judged(refs, heavy, verdicts.where("not absente")).where(F.col("depuis") > F.col("instant")).select(*by, "cle", "enregistrement").distinct().groupBy(*by).agg(F.count("*").alias("tardives"))
    base = partial.groupBy(*by).agg(F.sum("n").alias("references"))
    # a row each for a table, field and period: null periods are one period
    none = F.lit(0).cast("long")
    parts = [base.select(*by, "references", none.alias("absentes"), none.alias("tardives")), missing.select(*by, none.alias("references"), "absentes", none.alias("tardives")), late.select(*by, none.alias("references"), none.alias("absentes"), "tardives")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("references", "absentes", "tardives")))
