"""The national registry: CSV in a folder or an archive, read by column name."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regesta.functions.places import clean_text, departement_of, site_address
from regesta.functions.text import normalise_name
from regesta.sources.ranges import RANGE_BYTES, read_ranges

# The registry's columns that are read.
COLUMNS = ("id", "titre", "objet", "objet_social1", "adrs_codeinsee", "adrs_libcommune", "siteweb", "date_disso", "date_creat", "date_decla", "position", "maj_time")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", columns: tuple[str, ...] = COLUMNS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns of CSV files by name, with fichier and octet (the byte after each record); see read_ranges. A dump of any size is many tasks."""
    return read_ranges(spark, path, columns, delimiter, range_bytes)


def entry_end(departement: str) -> str:
    """How the name of a district's file in the registry's archive ends, in lower case."""
    return f"_dpt_{departement.lower()}.csv"


def archive_entry_fits(name: F.Column, departement: str) -> F.Column:
    """Is it the file of one district in the registry's archive?"""
    return F.lower(name).endswith(entry_end(departement))


def read_archive(spark: SparkSession, path: str, departement: str) -> DataFrame:
    """The rows of a district from ZIP archives: one task for an archive, entries streamed; methods other than stored and deflated, and wrong sizes, are errors."""
    return archive_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content"), departement)


def archive_rows(files: DataFrame, departement: str) -> DataFrame:
    """The rows of a district from archives given as bytes (content); see archive_entry_fits for the entries that count."""
    wanted = entry_end(departement)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.filename.lower().endswith(wanted):
                            continue
                        if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                            raise ValueError(f"{info.filename}: compression method {info.compress_type}")
                        with z.open(info) as f:
                            for part in pd.read_csv(f, dtype=str, keep_default_na=False, chunksize=10_000):
                                yield part.reindex(columns=list(COLUMNS), fill_value="")

    return files.mapInPandas(rows, ", ".join(f"{c} string" for c in COLUMNS))


def to_associations(rows: DataFrame, departement: str | None = None) -> DataFrame:
    """Registry rows as associations. Rows without id or title, or of another district, are no associations; dissolved ones stay, with their date."""
    named = rows.where((F.trim("id") != "") & (F.trim("titre") != ""))
    code = clean_text(F.col("adrs_codeinsee"))
    kept = named if departement is None else named.where(departement_of(code) == departement)
    return kept.select(
        F.trim("id").alias("rna_id"), code.alias("code_insee"), F.trim("titre").alias("nom"), normalise_name(F.col("titre")).alias("nom_normalise"), clean_text(F.col("objet")).alias("objet"),
        clean_text(F.col("objet_social1")).alias("code_objet_social"), clean_text(F.col("adrs_libcommune")).alias("libelle"), site_address(F.col("siteweb")).alias("site_web"),
        *(clean_text(F.col(c)).alias(n) for c, n in (("date_creat", "date_creation"), ("date_decla", "date_declaration"), ("date_disso", "date_dissolution"), ("position", "position_rna"), ("maj_time", "maj_rna"))),
    )
