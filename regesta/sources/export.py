"""The public file and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public file's columns, in order.
EXPORT_COLUMNS = (
    "code_insee", "commune", "rna_id", "association", "type", "kind", "valeur", "valeur_corrigee", "valeur_publiable", "regime", "score", "confiance", "methode_extraction", "source_url",
    "collected_at", "review_statut",
)
BOM, SEPARATOR, LINE_END = "﻿", ";", "\r\n"


def cell(value: Column) -> Column:
    """A value as a CSV field: no formula for a spreadsheet, quoted where it must be; null is empty."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    safe = F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)
    return F.when(safe.rlike(r"[\";\r\n]"), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def csv_lines(rows: DataFrame, columns: tuple[str, ...] = EXPORT_COLUMNS) -> DataFrame:
    """rang, ligne: the file's lines (without their ends), the header as number 0."""
    body = rows.select("rang", F.concat_ws(SEPARATOR, *(cell(F.col(c)) for c in columns)).alias("ligne"))
    head = rows.sparkSession.createDataFrame([(0, SEPARATOR.join(columns))], "rang int, ligne string")
    return head.unionByName(body)


def write_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = EXPORT_COLUMNS) -> None:
    """Files that in the order of their names make one CSV: sorted by range, each written by its own task; the first begins with the mark and header."""
    lines = csv_lines(rows, columns).withColumn("ligne", F.when(F.col("rang") == 0, F.concat(F.lit(BOM), "ligne")).otherwise(F.col("ligne")))
    ordered = lines.repartitionByRange("rang").sortWithinPartitions("rang").select(F.col("ligne").alias("value"))
    ordered.write.option("lineSep", LINE_END).mode("overwrite").text(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, columns in their order, nulls written."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_once(df: DataFrame, path: str) -> None:
    """A snapshot that is there whole or not at all: Spark's commit protocol moves it into place."""
    df.write.mode("overwrite").parquet(path)
