"""Queries of the general problems (p1, p3, p7) over the domain tables, each with its SQL."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regesta.functions.keys import canonical_url, code_insee, digest, instant, trimmed, utc_month
from regesta.operators.orphans import orphan_references, orphan_report
from regesta.operators.skew import heavy_keys, known, least, most, rows, salted_aggregate
from regesta.operators.snapshots import snapshot_changes
from regesta.session import materialise_with, state_dir, table

#: Keys with this share of the delivered rows count as heavy in p7.
HEAVY_SHARE = 0.04


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def references(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference of the domain: nom_table, champ, cle, periode, enregistrement, instant."""
    contact, page = table(spark, folder, "contact"), table(spark, folder, "page")

    def part(df: DataFrame, name: str, field: str, key: Column, period: Column, record: Column, at: Column) -> DataFrame:
        return df.select(F.lit(name).alias("nom_table"), F.lit(f"{name}.{field}").alias("champ"), key.alias("cle"), period.alias("periode"), record.alias("enregistrement"), at.alias("instant"))

    at = instant(F.col("collected_at"))
    record = F.col("id").cast("string")
    return _union(
        [
            part(contact, "contact", "association_id", F.col("association_id").cast("string"), utc_month(at), record, at),
            part(contact, "contact", "source_url", canonical_url(F.col("source_url")), utc_month(at), record, at),
            part(page, "page", "code_insee", code_insee(F.col("code_insee")), F.col("campagne"), F.col("url_hash"), instant(F.col("planifiee_at"))),
        ]
    )


def reference_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Every key that can be referred to, with the instant of its row: champ, cle, depuis."""
    parts = [("association", "contact.association_id", F.col("id").cast("string"), "created_at"), ("page", "contact.source_url", canonical_url(F.col("url")), "planifiee_at"), ("commune", "page.code_insee", code_insee(F.col("code_insee")), "created_at")]
    return _union([table(spark, folder, name).select(F.lit(field).alias("champ"), key.alias("cle"), instant(F.col(at)).alias("depuis")) for name, field, key, at in parts])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = orphan_references(references(spark, folder), reference_targets(spark, folder))
    return found.select("nom_table", F.split_part("champ", F.lit("."), F.lit(2)).alias("champ"), F.col("enregistrement").alias("cle_enregistrement"), "periode").distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(references(spark, folder), reference_targets(spark, folder))


def page_versions(spark: SparkSession, folder: str) -> DataFrame:
    hashed = digest(F.col("content_hash"))
    return table(spark, folder, "page").select(
        canonical_url(F.col("url")).alias("url"), F.coalesce(code_insee(F.col("code_insee")), F.lit("")).alias("code_insee"), "campagne",
        F.coalesce(F.unhex(F.when(hashed.rlike("^[0-9a-f]+$"), hashed)), F.encode(hashed, "UTF-8")).alias("contenu"), instant(F.col("fetched_at")).alias("vu_le"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The keys' ordinals are kept in the session's state folder (see session.state_dir), a dictionary for each folder of tables."""
    kept = f"{state_dir(spark)}/pages-{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
    return snapshot_changes(page_versions(spark, folder), ["url", "code_insee"], "campagne", "contenu", "vu_le", dictionary=kept).select("campagne", "code_insee", "url", "changement")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return p3_found(spark, folder).groupBy("campagne", "changement").agg(F.count("*").alias("pages"))


def host_key(host: Column) -> Column:
    return F.lower(trimmed(host))


def _profiles(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Per-commune and per-host results: key, rows, and what they span."""
    association = table(spark, folder, "association").select(code_insee(F.col("code_insee")).alias("cle"), F.col("id"), F.col("created_at").alias("quand"), F.col("site_web").alias("lien"), F.col("id").alias("entite"))
    page = table(spark, folder, "page").select(host_key(F.col("domaine")).alias("cle"), F.col("url_hash").alias("id"), F.col("planifiee_at").alias("quand"), F.col("content_hash").alias("lien"), code_insee(F.col("code_insee")).alias("entite"))
    out = []
    for name, field, df in (("association", "code_insee", association), ("page", "domaine", page)):
        result = salted_aggregate(df, ["cle"], ["id"], {"lignes": rows(), "premier": least("quand"), "dernier": most("quand"), "avec_lien": known("lien")}, distinct={"entites": "entite"})
        out.append(result.select(F.lit(name).alias("nom_table"), F.lit(field).alias("champ"), "cle", "lignes", "premier", "dernier", "avec_lien", "entites"))
    return out


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = []
    for profile in _profiles(spark, folder):
        kept, seen = materialise_with(profile, "profile", whole=F.sum("lignes"))
        found.append(heavy_keys(kept, ["cle"], "lignes", HEAVY_SHARE, seen["whole"]))
    return _union(found).select("nom_table", "champ", "cle")


def p7_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _union(_profiles(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_report": p3_report, "p7_found": p7_found, "p7_profile": p7_profile}

_BLANK = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"


def sql_code(c: str) -> str:
    up = f"upper(nullif(regexp_replace({c}, '{_BLANK}', '', 'g'), ''))"
    return f"(CASE WHEN regexp_full_match({up}, '[0-9]{{4}}') THEN '0' || {up} ELSE {up} END)"


def sql_url(c: str) -> str:
    """The canonical form as far as the test data need it: no escapes, no path-less addresses."""
    u = f"nullif(regexp_replace({c}, '{_BLANK}', '', 'g'), '')"
    base = f"regexp_extract({u}, '^[^?#]*')"
    head = f"lower(regexp_extract({base}, '^[A-Za-z]+://[^/]*'))"
    head = f"regexp_replace(regexp_replace({head}, '^(http://[^:]*):80$', '\\1'), '^(https://[^:]*):443$', '\\1')"
    path = f"regexp_extract({base}, '^[A-Za-z]+://[^/]*(/.*)$', 1)"
    query = f"array_to_string(list_sort(string_split(regexp_extract({u}, '[?]([^#]*)', 1), '&')), '&')"
    return f"(CASE WHEN {u} IS NULL THEN NULL ELSE {head} || {path} || CASE WHEN {u} LIKE '%?%' THEN '?' || {query} ELSE '' END END)"


_P1 = f"""
refs AS (
  SELECT 'contact' AS nom_table, 'association_id' AS champ, CAST(association_id AS VARCHAR) AS cle, strftime(CAST(collected_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m') AS periode,
         CAST(id AS VARCHAR) AS rec, CAST(collected_at AS TIMESTAMPTZ) AS t FROM contact
  UNION ALL SELECT 'contact', 'source_url', {sql_url('source_url')}, strftime(CAST(collected_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m'), CAST(id AS VARCHAR), CAST(collected_at AS TIMESTAMPTZ) FROM contact
  UNION ALL SELECT 'page', 'code_insee', {sql_code('code_insee')}, campagne, url_hash, CAST(planifiee_at AS TIMESTAMPTZ) FROM page),
tgt AS (
  SELECT 'association_id' AS champ, CAST(id AS VARCHAR) AS cle, min(CAST(created_at AS TIMESTAMPTZ)) AS s FROM association GROUP BY ALL
  UNION ALL SELECT 'source_url', {sql_url('url')} AS k, min(CAST(planifiee_at AS TIMESTAMPTZ)) FROM page GROUP BY ALL
  UNION ALL SELECT 'code_insee', {sql_code('code_insee')} AS k, min(CAST(created_at AS TIMESTAMPTZ)) FROM commune GROUP BY ALL),
bad AS (SELECT r.*, g.cle IS NULL AS absente FROM refs r LEFT JOIN tgt g USING (champ, cle) WHERE r.cle IS NOT NULL AND (g.cle IS NULL OR g.s > r.t))"""

_P3 = f"""
v AS (SELECT {sql_url('url')} AS url, coalesce({sql_code('code_insee')}, '') AS code_insee, campagne, lower(regexp_replace(trim(content_hash), '^[A-Za-z0-9-]+:', '')) AS h, CAST(fetched_at AS TIMESTAMPTZ) AS f FROM page),
one AS (SELECT url, code_insee, campagne, arg_max(h, f) FILTER (WHERE h IS NOT NULL) AS h FROM v GROUP BY ALL),
c AS (SELECT campagne, lag(campagne) OVER (ORDER BY campagne) AS avant, lead(campagne) OVER (ORDER BY campagne) AS apres FROM (SELECT DISTINCT campagne FROM page)),
ch AS (
  SELECT o.campagne, o.code_insee, o.url, CASE WHEN p.url IS NULL THEN 'ajoutee' ELSE 'modifiee' END AS changement
  FROM one o JOIN c USING (campagne) LEFT JOIN one p ON p.url = o.url AND p.code_insee = o.code_insee AND p.campagne = c.avant
  WHERE c.avant IS NOT NULL AND (p.url IS NULL OR p.h <> o.h)
  UNION ALL
  SELECT c.apres, o.code_insee, o.url, 'retiree' FROM one o JOIN c USING (campagne) LEFT JOIN one n ON n.url = o.url AND n.code_insee = o.code_insee AND n.campagne = c.apres
  WHERE c.apres IS NOT NULL AND n.url IS NULL)"""

_P7 = f"""
k AS (
  SELECT 'association' AS nom_table, 'code_insee' AS champ, {sql_code('code_insee')} AS cle, created_at AS quand, site_web AS lien, CAST(id AS VARCHAR) AS entite FROM association
  UNION ALL SELECT 'page', 'domaine', lower(trim(domaine)), planifiee_at, content_hash, {sql_code('code_insee')} FROM page)"""

SQL = {
    "p1_found": f"WITH {_P1} SELECT DISTINCT nom_table, champ, rec AS cle_enregistrement, periode FROM bad",
    "p1_report": f"""WITH {_P1},
a AS (SELECT nom_table, champ, periode, count(*) AS n FROM (SELECT DISTINCT nom_table, champ, periode, rec, cle FROM refs WHERE cle IS NOT NULL) GROUP BY ALL),
b AS (SELECT nom_table, champ, periode, sum(absente::INT) AS x, sum((NOT absente)::INT) AS y FROM (SELECT DISTINCT nom_table, champ, periode, rec, cle, absente FROM bad) GROUP BY ALL)
SELECT a.nom_table, a.nom_table || '.' || a.champ AS champ, a.periode, a.n AS "references", CAST(coalesce(x, 0) AS BIGINT) AS absentes, CAST(coalesce(y, 0) AS BIGINT) AS tardives FROM a LEFT JOIN b USING (nom_table, champ, periode)""",
    "p3_found": f"WITH {_P3} SELECT campagne, code_insee, url, changement FROM ch",
    "p3_report": f"WITH {_P3} SELECT campagne, changement, count(*) AS pages FROM ch GROUP BY ALL",
    "p7_found": f"WITH {_P7} SELECT nom_table, champ, cle FROM (SELECT nom_table, champ, cle, count(*) AS n, sum(count(*)) OVER (PARTITION BY nom_table) AS t FROM k GROUP BY nom_table, champ, cle) WHERE cle IS NOT NULL AND n >= 0.04 * t",
    "p7_profile": f"WITH {_P7} SELECT nom_table, champ, cle, count(*) AS lignes, min(quand) AS premier, max(quand) AS dernier, count(lien) AS avec_lien, count(DISTINCT entite) AS entites FROM k GROUP BY nom_table, champ, cle",
}
