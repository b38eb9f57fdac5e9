"""Upserts as folds over versions: the same rows in any order and number give the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regesta.functions.keys import instant


def latest(df: DataFrame, keys: list[str], version: list[str], instants: bool = False) -> DataFrame:
    """One row for each key: that of the greatest version (ISO texts compared as instants, if so told), ties by the greatest row. Map-side combined, so copies of a hot key do not pile up.

    Null keys are left out. An empty table stays empty.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [(instant(F.col(c)) if instants else F.col(c)).alias(f"_v{i}") for i, c in enumerate(version)]
    pick = F.max(F.struct(*first, *version, *(c for c in rest if c not in version)))
    return df.dropna(subset=keys).groupBy(*keys).agg(pick.alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def fold_communes(versions: DataFrame, order: str) -> DataFrame:
    """code_insee, nom, url_mairie, source_resolution, statut_resolution of each municipality over all its deliveries.

    The last name that is not empty and the last address that is not null stay; status and source move with the address only,
    so it does not matter in which order deliveries without an address come.
    """
    named = F.col("nom").isNotNull() & (F.col("nom") != "")
    located = F.col("url_mairie").isNotNull()
    site = F.max(F.when(located, F.struct(order, "url_mairie", "source_resolution", "statut_resolution")))
    folded = versions.dropna(subset=["code_insee"]).groupBy("code_insee").agg(F.max(F.when(named, F.struct(order, "nom")))["nom"].alias("nom"), site.alias("_s"), F.max("departement").alias("departement"))
    return folded.select("code_insee", "nom", "departement", F.col("_s.url_mairie").alias("url_mairie"), F.col("_s.source_resolution").alias("source_resolution"), F.coalesce("_s.statut_resolution", F.lit("sans_site")).alias("statut_resolution"))


def minimal_communes(codes: DataFrame, communes: DataFrame) -> DataFrame:
    """communes plus a bare row (statut 'inconnu', named by its label or code) for every code that has none. codes: code_insee, libelle."""
    bare = codes.where("code_insee is not null").groupBy("code_insee").agg(F.max("libelle").alias("libelle")).join(communes.select("code_insee"), "code_insee", "left_anti")
    added = bare.select("code_insee", F.coalesce("libelle", "code_insee").alias("nom"), F.lit("inconnu").alias("statut_resolution"))
    return communes.unionByName(added, allowMissingColumns=True)


def upsert_contacts(readings: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each contact of a holder: the reading of greatest confidence, the earliest among equals; id and review stay those of the first.

    The holder is the association, or the municipality where there is none: two keys that never meet.
    """
    key = [F.col("association_id"), F.when(F.col("association_id").isNull(), F.col("code_insee")).alias("commune_seule"), F.col("kind"), F.col("valeur_normalisee")]
    first = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), "id", "review_statut")
    best = F.min(F.struct((-F.col("confiance")).alias("rang"), *(c.alias(f"_o{i}") for i, c in enumerate(order)), "id", "valeur", "source_url", "methode_extraction", "confiance", "collected_at"))
    held = readings.where("association_id is not null or code_insee is not null")
    folded = held.groupBy(*key).agg(F.min(first).alias("_f"), best.alias("_b"), F.max("code_insee").alias("code_insee"))
    return folded.select("_f.id", "association_id", "commune_seule", "kind", "valeur_normalisee", "_b.valeur", "_b.source_url", "_b.methode_extraction", "_b.confiance", "_b.collected_at", "_f.review_statut")


def insert_new(rows: DataFrame, table: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """The rows whose key the table lacks, the first of each key by order; null keys compare as values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    if table is None:
        return first
    on = F.lit(True)
    for k in keys:
        on = on & first[k].eqNullSafe(table[k])
    return first.join(table, on, "left_anti")
