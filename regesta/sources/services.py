"""The directory of public services: JSON with one array of services, and the listing of its dumps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from regesta.functions.places import departement_of, name_from_label

_S = StringType()


def _rows(*names: str) -> ArrayType:
    return ArrayType(StructType([StructField(n, _S) for n in names]))


SERVICE = StructType(
    [
        StructField("nom", _S), StructField("site_internet", _rows("libelle", "valeur")), StructField("adresse", _rows("type_adresse", "nom_commune")),
        StructField("pivot", ArrayType(StructType([StructField("type_service_local", _S), StructField("code_insee_commune", ArrayType(_S))]))),
    ]
)


def read_services(spark: SparkSession, path: str) -> DataFrame:
    """One row for each object of the array 'service'. The reader takes a whole file per task: give a large dump as lines (read_service_lines)."""
    whole = spark.read.schema(StructType([StructField("service", ArrayType(SERVICE))])).option("multiLine", True).json(path)
    return whole.selectExpr("inline(service)")


def read_service_lines(spark: SparkSession, path: str) -> DataFrame:
    """One service in JSON per line: splittable."""
    return spark.read.schema(SERVICE).option("mode", "DROPMALFORMED").json(path)


def split_array(text: str, key: str, head: int = 65_536) -> list[str]:
    """The objects of the array under a key, as text; what is no object is left out. A key not in the head and an object without an end are errors."""
    at = text.find(f'"{key}"', 0, head)
    if at < 0:
        raise ValueError(f"no {key!r} in the first {head} characters")
    at = text.index("[", at)
    out: list[str] = []
    depth = start = 0
    quoted = escaped = False
    for i in range(at + 1, len(text)):
        c = text[i]
        if quoted:
            escaped, quoted = (not escaped and c == "\\"), quoted and not (c == '"' and not escaped)
            continue
        if c == '"':
            quoted = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
        elif c == "]" and depth == 0:
            return out
    raise ValueError("the array has no end")


def split_services(texts: DataFrame) -> DataFrame:
    """One row for each object of the array 'service' of texts (texte); what is no object is left out, an object that cannot be read has nulls."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["texte"]:
                yield pd.DataFrame({"j": split_array(text, "service")}, dtype=object)

    return texts.where("texte is not null").select("texte").mapInPandas(split, "j string").select(F.from_json("j", SERVICE).alias("s")).select("s.*")


def town_halls(services: DataFrame, departement: str | None = None) -> DataFrame:
    """code_insee, nom, url_mairie of every town hall: a code once per service, the first http address of its sites."""
    halls = services.withColumn("p", F.explode(F.filter("pivot", lambda p: p["type_service_local"] == "mairie")))
    codes = F.array_distinct(F.filter(F.transform("p.code_insee_commune", lambda c: F.trim(c)), lambda c: c != ""))
    site = F.try_element_at(F.filter(F.transform("site_internet", lambda s: F.trim(s["valeur"])), lambda v: v.rlike("^(?i)https?://[^\\s/]+")), F.lit(1))
    town = F.coalesce(F.try_element_at(F.filter(F.transform("adresse", lambda a: a["nom_commune"]), lambda n: n.isNotNull() & (F.trim(n) != "")), F.lit(1)), name_from_label(F.col("nom")))
    rows = halls.select(F.explode(codes).alias("code_insee"), F.trim(F.coalesce(town, F.lit(""))).alias("nom"), site.alias("url_mairie")).distinct()
    rows = rows.withColumn("departement", departement_of(F.col("code_insee"))).where("departement is not null")
    return rows if departement is None else rows.where(F.col("departement") == departement)


# How a dated dump is named.
DUMP_LINK = r"""href="([^"]*\d{4}-\d{2}-\d{2}_\d{6}-data\.gouv_local\.json)\""""


def newest_dump(listing: Column) -> Column:
    """Of a listing's links to dated dumps the newest, by name."""
    return F.array_max(F.regexp_extract_all(listing, F.lit(DUMP_LINK), F.lit(1)))
