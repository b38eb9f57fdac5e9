"""Queries of the problems tagged llm, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regesta.functions.keys import canonical_url, code_insee, instant, trimmed
from regesta.functions.text import normalise_name
from regesta.functions.times import iso_text
from regesta.llm import oracles
from regesta.llm.keys import contact_key, email_key, phone_key
from regesta.llm.leakage import leaks
from regesta.llm.mainbody import main_body
from regesta.llm.matching import match_entities
from regesta.llm.mixing import count_tokens, mix, source_key
from regesta.llm.survivor import survivors
from regesta.llm.variants import link_variants, linked_and_loose, variant_pairs
from regesta.llm.truncation import truncated, truncation_by_source
from regesta.session import table

#: Where the vocabulary files of public tokenizers lie; a parameter of the installation.
TOKENIZERS = os.environ.get("REGESTA_TOKENIZERS", "/opt/tokenizers")

# How this vocabulary's tokenizer cuts a text into pieces before it merges bytes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def association_names(spark: SparkSession, folder: str) -> DataFrame:
    """id, code, name, alt_name, sigle and the municipality's name, which is given by its code."""
    communes = table(spark, folder, "commune").groupBy(code_insee(F.col("code_insee")).alias("code")).agg(F.max("nom").alias("place"))
    own = table(spark, folder, "association").select("id", code_insee(F.col("code_insee")).alias("code"), F.col("nom").alias("name"), F.col("nom_normalise").alias("alt_name"), "sigle").distinct()
    return own.join(communes, "code", "left")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return variant_pairs(*linked_and_loose(association_names(spark, folder)))


def p2_organisations(spark: SparkSession, folder: str) -> DataFrame:
    """Every id with the number of its organisation and of the ids registered for it."""
    linked = link_variants(association_names(spark, folder))
    sizes = linked.groupBy("organisation").agg(F.count("*").alias("identifiants"))
    return linked.join(sizes, "organisation").select("id", "organisation", "identifiants")


def _site(url: Column) -> Column:
    """The host of a site, with or without scheme and www."""
    return F.nullif(F.regexp_extract(F.lower(trimmed(url)), r"^(?:[a-z]+://)?(?:www\.)?([a-z0-9.\-]+)", 1), F.lit(""))


def matched_entries(spark: SparkSession, folder: str) -> DataFrame:
    """fiche_id, organisation, association_id, confiance of every match that is likelier than not."""
    region = F.when(F.col("code").rlike("^97|^98"), F.substring("code", 1, 3)).otherwise(F.substring("code", 1, 2))
    register = association_names(spark, folder).withColumn("region", region)
    fiche = table(spark, folder, "fiche_mairie")
    codes = table(spark, folder, "commune").select(normalise_name(F.col("nom")).alias("place_key"), code_insee(F.col("code_insee")).alias("code")).distinct()
    placed = fiche.withColumn("place_key", normalise_name(F.col("commune_libelle"))).join(codes, "place_key", "left")
    entries = placed.select(F.col("fiche_id").alias("id"), F.col("nom_affiche").alias("name"), F.lit(None).cast("string").alias("sigle"), F.col("commune_libelle").alias("place"), "code", F.col("departement").alias("region"), F.col("activite").alias("activity"))
    entry_contacts = fiche.select(F.col("fiche_id").alias("id"), F.explode(F.array(phone_key(F.col("telephone")), email_key(F.col("courriel")), F.concat(F.lit("//"), _site(F.col("site"))))).alias("contact"))
    contact = table(spark, folder, "contact").where("association_id is not null")
    values = F.array(contact_key(F.col("kind"), F.col("valeur_normalisee")), contact_key(F.col("kind"), F.col("valeur")), contact_key(F.col("kind"), F.col("valeur_corrigee")))
    reached = contact.select(F.col("association_id").alias("id"), F.explode(values).alias("contact"))
    sites = table(spark, folder, "association").select("id", F.concat(F.lit("//"), _site(F.col("site_web"))).alias("contact"))
    matches, linked = match_entities(entries, register, entry_contacts, reached.unionByName(sites))
    likely = matches.where("p >= 0.5")
    return likely.join(linked.select(F.col("organisation").alias("r"), F.col("id").alias("association_id")).distinct(), "r").select(F.col("l").alias("fiche_id"), F.col("r").alias("organisation"), "association_id", F.col("p").alias("confiance"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return matched_entries(spark, folder).select("fiche_id", "association_id").distinct()


def p4_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry with its organisation and the confidence of the match, or without."""
    found = matched_entries(spark, folder).groupBy("fiche_id").agg(F.max("confiance").alias("confiance"), F.max_by("organisation", "confiance").alias("organisation"), F.count("*").alias("identifiants"))
    return table(spark, folder, "fiche_mairie").select("fiche_id").distinct().join(found, "fiche_id", "left")


def cached_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_cache").select("cache_path", "domaine", "texte")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return main_body(cached_pages(spark, folder))


def p5_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Visits of pages with the share of lines of their text that is main body, reached by page.cache_path."""
    lines = F.filter(F.split("texte", "\n"), lambda x: F.trim(x) != "")
    texts = table(spark, folder, "page_cache").select("cache_path", F.size(lines).alias("lignes"))
    kept = main_body(cached_pages(spark, folder)).groupBy("cache_path").agg(F.count("*").alias("lignes_corps"))
    visits = table(spark, folder, "page").select("cache_path", "campagne", "url_hash").where("cache_path is not null").distinct()
    return visits.join(texts, "cache_path").join(kept, "cache_path", "left").select("campagne", "url_hash", "cache_path", "lignes", F.coalesce("lignes_corps", F.lit(0)).cast("long").alias("lignes_corps"))


_GROUP = ["association_id", "code_insee_h", "kind", "cle"]


def contact_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each contact id in a group of two or more, with its group's key and what it is judged by; of an id delivered twice the later row."""
    contact = table(spark, folder, "contact").where("id is not null")
    filled = sum((F.col(c).isNotNull().cast("int") for c in contact.columns), F.lit(0))
    rank = F.when(F.col("review_statut") == "corrige", 3).when(F.col("review_statut") == "valide", 2).when(F.col("review_statut") == "a_revoir", 1).when(F.col("review_statut") == "rejete", 0)
    code = code_insee(F.col("code_insee"))
    columns = [
        instant(F.col("collected_at")).alias("recueilli"), "confiance", filled.alias("remplis"), "association_id", F.when(F.col("association_id").isNull(), code).alias("code_insee_h"), "kind",
        contact_key(F.col("kind"), F.coalesce("valeur_normalisee", "valeur")).alias("cle"), rank.alias("rang_revue"), canonical_url(F.col("source_url")).alias("source_url"),
        "valeur", "is_generique", "methode_extraction", "review_statut", "review_note", "valeur_corrigee", "score", "score_version",
    ]
    once = contact.groupBy("id").agg(F.max(F.struct(*columns)).alias("r")).select("id", "r.*")
    keyed = once.where("cle is not null and kind is not null and (association_id is not null or code_insee_h is not null)")
    several = keyed.groupBy(*_GROUP).agg(F.count("*").alias("_n")).where("_n > 1")
    same = F.lit(True)
    for g in _GROUP:
        same = same & keyed[g].eqNullSafe(several[g])
    mine = keyed.join(several, same, "left_semi")
    pages = table(spark, folder, "page").select(canonical_url(F.col("url")).alias("source_url")).where("source_url is not null").distinct().withColumn("en_page", F.lit(1))
    return mine.join(pages, "source_url", "left").withColumn("en_page", F.coalesce("en_page", F.lit(0))).withColumn("recueilli_us", F.unix_micros("recueilli"))


_CRITERIA = ["rang_revue", "confiance", "recueilli_us", "remplis", "en_page"]
_TRUST = ["rang_revue", "confiance", "remplis", "en_page"]
_FIELDS = ["valeur", "source_url", "methode_extraction", "confiance", "review_statut", "review_note", "valeur_corrigee", "is_generique", "score", "score_version", "collected_at"]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    elected = survivors(contact_records(spark, folder), _GROUP, "id", [], _TRUST, "recueilli", criteria=_CRITERIA)
    id_type = table(spark, folder, "contact").schema["id"].dataType
    return elected.where("sans_conteste").select(F.col("elu").cast(id_type).alias("contact_id"))


def p6_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of every group: each field's winning value, and the id that represents it."""
    records = contact_records(spark, folder).withColumn("collected_at", iso_text(F.col("recueilli")))
    same = {"valeur": contact_key(F.col("kind"), F.col("valeur")), "valeur_corrigee": contact_key(F.col("kind"), F.col("valeur_corrigee")), "review_note": F.lower(trimmed(F.col("review_note")))}
    elected = survivors(records, _GROUP, "id", _FIELDS, _TRUST, "recueilli", criteria=_CRITERIA, same=same)
    return elected.select(*_GROUP, "n", "elu", *(F.col(f).alias(f"{f}_retenu") for f in _FIELDS), "sans_conteste")


def _eval_parts(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(p).alias("partie"), F.col(p).alias("texte")) for p in ("passage", "question")))
    return table(spark, folder, "eval_item").select("item_id", F.explode(parts).alias("p")).select("item_id", "p.partie", "p.texte")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents").select("doc_id", "text"), _eval_parts(spark, folder)).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which items leaked, by what part, and into how many texts."""
    found = leaks(table(spark, folder, "documents").select("doc_id", "text"), _eval_parts(spark, folder))
    return found.groupBy("item_id", "partie").agg(F.count("*").alias("textes"))


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = count_tokens(table(spark, folder, "documents"), "text", str(Path(TOKENIZERS) / "byte_bpe_50k.tiktoken"), PIECES)
    return mix(docs, table(spark, folder, "mix_target"), doc_id="doc_id", text="text", source="source")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(table(spark, folder, "documents").select("doc_id", "text")).where("tronque").select("doc_id")


def p10_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return truncation_by_source(truncated(docs.select("doc_id", "text")), docs.select("doc_id", source_key(F.col("source")).alias("source")))


QUERIES = {
    "p2_found": p2_found, "p2_organisations": p2_organisations,
    "p4_found": p4_found, "p4_entries": p4_entries, "p5_found": p5_found, "p5_pages": p5_pages, "p6_found": p6_found, "p6_survivors": p6_survivors, "p8_found": p8_found, "p8_items": p8_items, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_sources": p10_sources,
}

SQL: dict[str, str] = dict(oracles.SQL)
