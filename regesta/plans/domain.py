"""Queries of the directory over its own tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regesta.functions import contacts as fc
from regesta.functions import links as fl
from regesta.functions import net, places, times
from regesta.functions.classify import association_type
from regesta.functions.keys import canonical_url, code_insee, instant
from regesta.functions.scoring import CONTACT_VERSION
from regesta.functions.text import normalise_name
from regesta.operators import attach as oa
from regesta.operators import contacts as oc
from regesta.operators import jobs as oj
from regesta.operators import metrics as om
from regesta.operators import pages as op
from regesta.operators.expectations import RULES, broken
from regesta.operators.upserts import fold_communes, insert_new, latest, minimal_communes, upsert_contacts
from regesta.plans.general import sql_code, sql_url
from regesta.session import table

#: The instant that stands for now, so that results do not change from day to day.
NOW = "2026-03-20T00:00:00.000Z"
SINCE = "2021-03-20"


def communes(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "commune")
    return latest(df.withColumn("code_insee", code_insee(F.col("code_insee"))), ["code_insee"], ["updated_at"], instants=True)


def associations(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "association")
    return latest(df.withColumn("code_insee", code_insee(F.col("code_insee"))), ["id"], ["updated_at"], instants=True)


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "contact"), ["id"], ["collected_at"], instants=True)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "page")
    return latest(df.withColumn("code_insee", code_insee(F.col("code_insee"))), ["url_hash"], ["fetched_at"], instants=True)


def domains(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "domaine_mail"), ["domaine"], ["verifie_at"], instants=True)


_CLEAN = f"""
c AS (SELECT * FROM commune QUALIFY row_number() OVER (PARTITION BY code_insee ORDER BY CAST(updated_at AS TIMESTAMPTZ) DESC) = 1),
a AS (SELECT * EXCLUDE (code_insee), {sql_code('code_insee')} AS code_insee FROM association QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(updated_at AS TIMESTAMPTZ) DESC) = 1),
ct AS (SELECT * FROM contact QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(collected_at AS TIMESTAMPTZ) DESC) = 1),
p AS (SELECT * EXCLUDE (code_insee), {sql_code('code_insee')} AS code_insee FROM page QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY CAST(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, content_hash DESC NULLS LAST) = 1),
d AS (SELECT * FROM domaine_mail QUALIFY row_number() OVER (PARTITION BY domaine ORDER BY CAST(verifie_at AS TIMESTAMPTZ) DESC) = 1)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {_CLEAN}\n{sql}" if not sql.lstrip().startswith("--raw") else sql.replace("--raw", "", 1)
        return f

    return keep


def _valid_sql(v: str) -> str:
    local, dom = f"regexp_extract({v}, '^(.*)@[^@]*$', 1)", f"regexp_extract({v}, '@([^@]*)$', 1)"
    return (
        f"CASE WHEN length({v}) = 0 OR length({v}) > 254 THEN 'longueur' WHEN instr({v}, '@') = 0 OR {local} = '' OR {dom} = '' OR instr({local}, '@') > 0 THEN 'arobase' "
        f"WHEN length({local}) > 64 THEN 'longueur' WHEN NOT regexp_full_match({local}, '[A-Za-z0-9!#$%&''*+/=?^_`{{|}}~-]+([.][A-Za-z0-9!#$%&''*+/=?^_`{{|}}~-]+)*') THEN 'partie_locale' "
        f"WHEN length({dom}) > 253 THEN 'longueur' WHEN NOT regexp_full_match({dom}, '([A-Za-z0-9]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?[.])+[A-Za-z0-9]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?') THEN 'domaine' "
        f"WHEN NOT regexp_full_match(regexp_extract({dom}, '([^.]*)$', 1), '[A-Za-z]{{2,}}') THEN 'domaine_de_tete' END"
    )


_COVER = """
SELECT c.departement, count(*) AS actives, count(*) FILTER (WHERE e = 1) AS avec_email, count(*) FILTER (WHERE u = 1) AS avec_email_exploitable, count(*) FILTER (WHERE j = 1) AS avec_email_joignable
FROM a JOIN c USING (code_insee) LEFT JOIN (
  SELECT association_id AS id, 1 AS e, max((coalesce(score, 1) > 0)::INT) AS u, max((coalesce(score, 1) > 0 AND coalesce(d.mx = 1, false))::INT) AS j
  FROM ct LEFT JOIN d ON d.domaine = substr(valeur_normalisee, instr(valeur_normalisee, '@') + 1) WHERE kind = 'email' AND association_id IS NOT NULL {rule} GROUP BY 1) f USING (id)
WHERE a.date_dissolution IS NULL {live} GROUP BY 1"""


@query("a1_couverture", _COVER.format(rule="AND review_statut <> 'rejete'", live=""))
def a1(spark, folder):
    return om.coverage(associations(spark, folder), communes(spark, folder), contacts(spark, folder), domains(spark, folder))


@query("a3_couverture_bilan", _COVER.format(rule="", live=""))
def a3(spark, folder):
    return om.coverage(associations(spark, folder), communes(spark, folder), contacts(spark, folder), domains(spark, folder), rejected=True)


@query("a4_couverture_non_dormante", _COVER.format(rule="AND review_statut <> 'rejete'", live=f"AND date_declaration >= '{SINCE}'"))
def a4(spark, folder):
    return om.coverage(associations(spark, folder).where(F.col("date_declaration") >= SINCE), communes(spark, folder), contacts(spark, folder), domains(spark, folder))


@query("a5_joignables", "SELECT departement, count(*) AS joignables FROM a SEMI JOIN (SELECT association_id AS id FROM ct WHERE kind = 'email' AND split_part(valeur_normalisee, '@', 2) IN (SELECT domaine FROM d WHERE mx = 1)) m USING (id) JOIN c USING (code_insee) WHERE date_dissolution IS NULL GROUP BY departement")
def a5(spark, folder):
    mail = contacts(spark, folder).where("kind = 'email' and association_id is not null").select(F.col("association_id").alias("id"), F.regexp_replace("valeur_normalisee", "^[^@]*@", "").alias("domaine"))
    reached = mail.join(domains(spark, folder).where("mx = 1").select("domaine"), "domaine", "left_semi").select("id").distinct()
    live = associations(spark, folder).where("date_dissolution is null").join(reached, "id", "left_semi").join(communes(spark, folder).select("code_insee", "departement"), "code_insee")
    return live.groupBy("departement").agg(F.count("*").alias("joignables"))


@query("a6_dormance", f"SELECT departement, actives, non_dormantes, sans_date, actives - non_dormantes - sans_date AS dormantes FROM (SELECT c.departement, count(*) AS actives, count(*) FILTER (WHERE date_declaration >= '{SINCE}') AS non_dormantes, count(*) FILTER (WHERE date_declaration IS NULL) AS sans_date FROM a JOIN c USING (code_insee) WHERE date_dissolution IS NULL GROUP BY 1)")
def a6(spark, folder):
    return om.dormancy(associations(spark, folder), communes(spark, folder), SINCE)


@query("a7_declarations_par_annee", "SELECT departement, split_part(date_declaration, '-', 1) AS annee, sum(1)::BIGINT AS associations FROM (SELECT * FROM a WHERE date_declaration > '' AND date_dissolution IS NULL) SEMI JOIN (SELECT code_insee FROM c) k USING (code_insee) LEFT JOIN (SELECT code_insee, departement FROM c) x USING (code_insee) GROUP BY ALL")
def a7(spark, folder):
    return om.declarations_by_year(associations(spark, folder), communes(spark, folder))


@query("a8_prefiltre", "SELECT c.departement, campagne, count(*) AS total, count(prefiltre_verdict) AS jugees, count(*) FILTER (WHERE prefiltre_verdict = 'retenue') AS retenues, count(*) FILTER (WHERE prefiltre_verdict = 'ecartee') AS ecartees, count(*) FILTER (WHERE prefiltre_verdict = 'retenue' AND coalesce(contacts_extraits, 0) < 2) AS candidates FROM p JOIN c USING (code_insee) WHERE statut = 'visitee' GROUP BY 1, 2")
def a8(spark, folder):
    return om.page_verdicts(pages(spark, folder), communes(spark, folder))


@query("a9_motifs", "SELECT campagne, prefiltre_motif AS motif, count(*) AS pages FROM p JOIN c USING (code_insee) WHERE statut = 'visitee' AND prefiltre_motif IS NOT NULL GROUP BY 1, 2")
def a9(spark, folder):
    seen = pages(spark, folder).where("statut = 'visitee' and prefiltre_motif is not null").join(communes(spark, folder).select("code_insee"), "code_insee", "left_semi")
    return seen.groupBy("campagne", F.col("prefiltre_motif").alias("motif")).agg(F.count("*").alias("pages"))


@query("a10_histogramme_pages", "SELECT campagne, 4 * CAST(sign(prefiltre_score) * floor(abs(prefiltre_score) / 4) AS INTEGER) AS borne, count(*) AS pages FROM p WHERE statut = 'visitee' AND prefiltre_score IS NOT NULL GROUP BY 1, 2")
def a10(spark, folder):
    return om.histogram(pages(spark, folder).where("statut = 'visitee'"), ["campagne"], F.col("prefiltre_score"), "pages", width=4)


_FAMILY = "substr(CASE WHEN length(trim(code_objet_social)) < 6 THEN lpad(trim(code_objet_social), 6, '0') ELSE trim(code_objet_social) END, 1, 3)"
_NAME = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
_NN = "' ' || " + _NAME.format("nom") + " || ' '"
_TYPE = f"""CASE WHEN contains({_NN}, ' comite des fetes ') OR contains({_NN}, ' comite de fetes ') OR contains({_NN}, ' comite danimation ') OR contains({_NN}, ' comite d animation ') THEN 'comite_des_fetes'
WHEN contains({_NN}, ' centre de loisirs ') OR contains({_NN}, ' accueil de loisirs ') OR contains({_NN}, ' centre aere ') OR contains({_NN}, ' alsh ') THEN 'centre_de_loisirs'
WHEN NOT regexp_full_match(coalesce(trim(code_objet_social), ''), '[0-9]+') THEN 'diverses' WHEN {_FAMILY} = '011' THEN 'sportive' WHEN {_FAMILY} IN ('005', '006', '010') THEN 'culturelle'
WHEN {_FAMILY} IN ('003', '009', '017', '018', '019', '020', '021', '030', '036', '038') THEN 'sociale' ELSE 'diverses' END"""


@query("a12_types", f"SELECT c.departement, {_TYPE.replace('nom', 'a.nom')} AS type, count(*) AS associations FROM a JOIN c USING (code_insee) WHERE date_dissolution IS NULL GROUP BY 1, 2")
def a12(spark, folder):
    live = associations(spark, folder).where("date_dissolution is null").withColumn("type", association_type(F.col("code_objet_social"), F.col("nom"))["type"])
    return live.join(communes(spark, folder).select("code_insee", "departement"), "code_insee").groupBy("departement", "type").agg(F.count("*").alias("associations"))


@query("f12_classification", f"SELECT id, {_TYPE} AS type FROM a")
def f12(spark, folder):
    return associations(spark, folder).select("id", association_type(F.col("code_objet_social"), F.col("nom"))["type"].alias("type"))



@query("a11_normalisation", "SELECT departement, coalesce(n, 0) AS associations, coalesce(contacts, 0) AS contacts, coalesce(notes, 0) AS notes, coalesce(invalides, 0) AS invalides FROM (SELECT DISTINCT departement FROM c) LEFT JOIN (SELECT departement, count(*) AS n FROM a JOIN c USING (code_insee) WHERE date_dissolution IS NULL GROUP BY 1) USING (departement) LEFT JOIN (SELECT departement, count(*) AS contacts, count(score) AS notes, count(*) FILTER (WHERE score = 0) AS invalides FROM ct JOIN c USING (code_insee) GROUP BY 1) USING (departement)")
def a11(spark, folder):
    return om.normalisation_counts(associations(spark, folder), contacts(spark, folder), communes(spark, folder))


@query("a13_mx", "SELECT departement, sum((v = 1)::INT)::BIGINT AS avec_mx, sum((v = 0)::INT)::BIGINT AS sans_mx, sum((v = -1)::INT)::BIGINT AS mx_inconnu FROM (SELECT code_insee, coalesce((SELECT max(mx) FROM d WHERE domaine = split_part(valeur_normalisee, '@', 2)), -1) AS v FROM ct WHERE kind = 'email' AND NOT coalesce(score <= 0, false)) m JOIN c USING (code_insee) GROUP BY departement")
def a13(spark, folder):
    return om.mail_verdicts(contacts(spark, folder), communes(spark, folder), domains(spark, folder))


@query("a14_histogramme_contacts", "SELECT CAST(trunc(score * 10) AS INTEGER) AS borne, count(*) AS contacts FROM ct JOIN c USING (code_insee) WHERE score IS NOT NULL GROUP BY 1")
def a14(spark, folder):
    rows = contacts(spark, folder).join(communes(spark, folder).select("code_insee"), "code_insee", "left_semi")
    return om.histogram(rows, [], F.col("score") * 10, "contacts")


@query("a15_revue", "SELECT *, valide + rejete + corrige AS arbitres, corrige / nullif(CAST(valide + rejete + corrige AS DOUBLE), 0) AS taux_correction FROM (SELECT c.departement, count(*) FILTER (WHERE review_statut = 'a_revoir') AS a_revoir, count(*) FILTER (WHERE review_statut = 'valide') AS valide, count(*) FILTER (WHERE review_statut = 'rejete') AS rejete, count(*) FILTER (WHERE review_statut = 'corrige') AS corrige, count(*) FILTER (WHERE score IS NULL) AS non_notes, count(*) FILTER (WHERE review_statut = 'corrige' AND score_version IS DISTINCT FROM 2) AS corrections_a_noter FROM ct JOIN c USING (code_insee) GROUP BY 1)")
def a15(spark, folder):
    return om.review_counts(contacts(spark, folder), communes(spark, folder), CONTACT_VERSION)


@query("a17_communes", "SELECT departement, count(*) AS communes, count(*) FILTER (WHERE statut_resolution = 'resolue') AS resolues, count(url_mairie) AS avec_url, count(last_crawled_at) AS visitees FROM c GROUP BY 1")
def a17(spark, folder):
    return communes(spark, folder).groupBy("departement").agg(F.count("*").alias("communes"), F.count_if(F.col("statut_resolution") == "resolue").alias("resolues"), F.count("url_mairie").alias("avec_url"), F.count("last_crawled_at").alias("visitees"))


@query("a18_derniere_campagne", "SELECT max(campagne) AS campagne FROM p")
def a18(spark, folder):
    return pages(spark, folder).agg(F.max("campagne").alias("campagne"))


@query("a19_budget", "SELECT campagne, code_insee, count(*) AS pages FROM p WHERE code_insee IS NOT NULL GROUP BY 1, 2")
def a19(spark, folder):
    return pages(spark, folder).where("code_insee is not null").groupBy("campagne", "code_insee").agg(F.count("*").alias("pages"))


_DELTAS = "SELECT 'decouverte' AS etape, 'pages_' || statut AS nom, count(*) AS valeur FROM p GROUP BY 2 UNION ALL SELECT 'extraction', 'contacts_' || kind, count(*) FROM ct GROUP BY 2 UNION ALL SELECT 'http', 'status_' || CAST(http_status // 100 AS VARCHAR) || 'xx', count(*) FROM p WHERE http_status IS NOT NULL GROUP BY 2"


def _deltas(spark: SparkSession, folder: str) -> DataFrame:
    p, ct = pages(spark, folder), contacts(spark, folder)
    one = F.lit(1).cast("long").alias("valeur")
    read = p.select(F.lit("decouverte").alias("etape"), F.concat(F.lit("pages_"), "statut").alias("nom"), one)
    kinds = ct.select(F.lit("extraction").alias("etape"), F.concat(F.lit("contacts_"), "kind").alias("nom"), one)
    codes = p.where("http_status is not null").select(F.lit("http").alias("etape"), F.concat(F.lit("status_"), F.floor(F.col("http_status") / 100).cast("string"), F.lit("xx")).alias("nom"), one)
    return read.unionByName(kinds).unionByName(codes)


@query("a20_compteurs", _DELTAS)
def a20(spark, folder):
    return om.counters(_deltas(spark, folder))



@query("a21_domaines", f"SELECT DISTINCT lower(regexp_extract(valeur_normalisee, '@([^@]*)$', 1)) AS domaine FROM ct WHERE kind = 'email' AND ({_valid_sql('valeur_normalisee')}) IS NULL")
def a21(spark, folder):
    mail = contacts(spark, folder).where((F.col("kind") == "email") & fc.email_fault(F.col("valeur_normalisee")).isNull())
    return mail.select(fc.mail_domain(F.col("valeur_normalisee")).alias("domaine")).where("domaine is not null").distinct()


@query("p20_domaines_a_verifier", f"SELECT DISTINCT lower(regexp_extract(valeur_normalisee, '@([^@]*)$', 1)) AS domaine FROM ct WHERE kind = 'email' AND ({_valid_sql('valeur_normalisee')}) IS NULL AND domaine NOT IN (SELECT domaine FROM d WHERE mx IS NOT NULL AND CAST(verifie_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '2026-02-18 00:00:00+00')".replace("AND domaine NOT IN", "AND lower(regexp_extract(valeur_normalisee, '@([^@]*)$', 1)) NOT IN"))
def verify(spark, folder):
    return om.domains_to_verify(contacts(spark, folder), domains(spark, folder), F.lit(NOW))


QUERIES["domaines_a_verifier"], SQL["domaines_a_verifier"] = QUERIES.pop("p20_domaines_a_verifier"), SQL.pop("p20_domaines_a_verifier")


@query("a24_departements", "SELECT DISTINCT departement FROM c")
def a24(spark, folder):
    return communes(spark, folder).select("departement").distinct()


@query("a25_associations_avec_site", "SELECT c.departement, count(*) AS associations FROM a JOIN c USING (code_insee) WHERE site_web IS NOT NULL GROUP BY 1")
def a25(spark, folder):
    return associations(spark, folder).where("site_web is not null").join(communes(spark, folder).select("code_insee", "departement"), "code_insee").groupBy("departement").agg(F.count("*").alias("associations"))


@query("f1_noms_normalises", f"SELECT id, {_NAME.format('nom')} AS nom_cle FROM a")
def f1(spark, folder):
    return associations(spark, folder).select("id", normalise_name(F.col("nom")).alias("nom_cle"))


@query("f3_regime_adresses", "SELECT id, CASE WHEN regexp_matches(regexp_replace(split_part(lower(valeur), '@', 1), '[^a-z0-9]', '', 'g'), 'abuse|accueil|administration|associ|bureau|cantine|club|commun|contact|courrier|culture|direction|ecole|hoteldeville|info|inscription|jeunesse|mairie|nepasrepondre|noreply|postmaster|president|reservation|secreta|service|sport|tresorier|ville|webmaster') THEN 1 WHEN regexp_full_match(split_part(lower(valeur), '@', 1), '[a-z]+[._-][a-z]{2,}') THEN 0 END AS regime FROM ct WHERE kind = 'email'")
def f3(spark, folder):
    return contacts(spark, folder).where("kind = 'email'").select("id", fc.office_or_person(F.col("valeur")).alias("regime"))


_PHONE = "regexp_replace(valeur, '[^0-9+]', '', 'g')"
_NATIONAL = f"CASE WHEN starts_with({_PHONE}, '+33') THEN '0' || substr({_PHONE}, 4) WHEN starts_with({_PHONE}, '0033') THEN '0' || substr({_PHONE}, 5) WHEN starts_with({_PHONE}, '0') THEN {_PHONE} END"


@query("f4_telephones", f"SELECT id, CASE WHEN regexp_full_match(n, '0[1-9][0-9]{{8}}') THEN '+33' || substr(n, 2) END AS international, CASE WHEN regexp_full_match(n, '0[1-9][0-9]{{8}}') THEN substr(n, 1, 2) IN ('06', '07') END AS mobile FROM (SELECT id, {_NATIONAL} AS n FROM ct WHERE kind = 'phone')")
def f4(spark, folder):
    number = fc.international_phone(F.col("valeur"))
    return contacts(spark, folder).where("kind = 'phone'").select("id", number.alias("international"), fc.is_mobile(number).alias("mobile"))


@query("f8_fautes", f"SELECT id, kind, CASE WHEN kind = 'email' THEN {_valid_sql('valeur_normalisee')} WHEN NOT regexp_full_match(valeur_normalisee, '[+]33[1-9][0-9]{{8}}') THEN 'forme' END AS faute FROM ct")
def f8(spark, folder):
    return contacts(spark, folder).select("id", "kind", fc.contact_fault(F.col("kind"), F.col("valeur_normalisee")).alias("faute"))



@query("f7_contacts_des_pages")
def f7(spark, folder):
    """Every address and number in the cached pages, the surest reading of each."""
    read = op.read_texts(table(spark, folder, "page_cache").select("cache_path", "texte"))
    best = read.groupBy("cache_path", "kind", "valeur_normalisee").agg(F.min(F.struct((-F.col("confiance")).alias("c"), "pos", "valeur", "is_generique", "methode", "confiance")).alias("b"))
    return best.select("cache_path", "kind", "valeur_normalisee", "b.valeur", "b.is_generique", "b.methode", "b.confiance")



@query("f17_adresses", f"SELECT DISTINCT url, {sql_url('url')} AS canonique FROM page")
def f17(spark, folder):
    return table(spark, folder, "page").select("url", canonical_url(F.col("url")).alias("canonique")).distinct()


@query("f18_empreintes", f"SELECT DISTINCT url, sha256({sql_url('url')}) AS empreinte FROM page")
def f18(spark, folder):
    return table(spark, folder, "page").select("url", F.sha2(canonical_url(F.col("url")), 256).alias("empreinte")).distinct()


@query("f19_bornes", "--raw SELECT o_orderkey, CAST(year(o_orderdate) - 3 AS VARCHAR) || CASE WHEN strftime(o_orderdate, '%m-%d') = '02-29' THEN '-03-01' ELSE strftime(o_orderdate, '-%m-%d') END || 'T00:00:00.000Z' AS borne FROM orders")
def f19(spark, folder):
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
    return table(spark, folder, "orders").select("o_orderkey", times.years_before(day, 3).alias("borne"))


@query("f21_reprises", "--raw SELECT o_orderkey, o_orderkey % 24 + 1 AS essais, CAST(least(1000 * pow(2, o_orderkey % 24), 300000) AS BIGINT) AS attente_ms FROM orders")
def f21(spark, folder):
    tries = F.col("o_orderkey") % 24 + 1
    return table(spark, folder, "orders").select("o_orderkey", tries.alias("essais"), times.backoff_ms(tries).alias("attente_ms"))


@query("f22_reseaux", "--raw SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '10.' || o_orderkey // 256 % 256 || '.' || o_orderkey % 256 || '.0/24' ELSE '2001:db8:' || lower(to_hex(o_orderkey)) || '::/48' END AS reseau FROM orders")
def f22(spark, folder):
    """Networks of addresses made of orders' numbers: of version 4 and, in two spellings, of version 6."""
    n = F.col("o_orderkey")
    v4 = F.concat_ws(".", F.lit("10"), F.floor(n / 256) % 256, n % 256, n % 254)
    v6 = F.concat(F.when(n % 3 == 0, "2001:0DB8:").otherwise("2001:db8:"), F.when(n % 5 == 0, F.lpad(F.hex(n), 4, "0")).otherwise(F.lower(F.hex(n))), F.lit("::"), F.lower(F.hex(n % 999)))
    return table(spark, folder, "orders").select("o_orderkey", net.subnet_key(F.when(n % 2 == 0, v4).otherwise(v6)).alias("reseau"))


@query("p6_departements_raw")
def p6dep(spark, folder):
    return pages(spark, folder).select("url_hash", "code_insee", places.departement_of(F.col("code_insee")).alias("departement"))


QUERIES["departement_des_pages"] = QUERIES.pop("p6_departements_raw")
SQL["departement_des_pages"] = f"WITH {_CLEAN} SELECT url_hash, code_insee, CASE WHEN regexp_full_match(code_insee, '(2[AB]|[0-9]{{2}})[0-9]{{3}}') THEN CASE WHEN substr(code_insee, 1, 2) IN ('97', '98') THEN substr(code_insee, 1, 3) ELSE substr(code_insee, 1, 2) END END AS departement FROM p"


@query("d1_dedoublonnage", "SELECT id FROM ct WHERE association_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM ct r WHERE r.association_id IS NOT NULL AND r.code_insee = ct.code_insee AND r.kind = ct.kind AND r.valeur_normalisee = ct.valeur_normalisee)")
def d1(spark, folder):
    return oc.drop_shadowed(contacts(spark, folder)).select("id")


@query("j8_derniers_verdicts", f"SELECT {sql_url('url')} AS url, code_insee, prefiltre_verdict AS verdict FROM p WHERE code_insee IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {sql_url('url')}, code_insee ORDER BY campagne DESC, CAST(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, prefiltre_verdict DESC NULLS LAST) = 1")
def j8(spark, folder):
    return oc.latest_verdicts(pages(spark, folder))


_V = "coalesce(valeur_corrigee, valeur_normalisee)"
_SCORE = f"""
, v AS (SELECT {sql_url('url')} AS url, code_insee, prefiltre_verdict AS verdict FROM p WHERE code_insee IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {sql_url('url')}, code_insee ORDER BY campagne DESC, CAST(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, prefiltre_verdict DESC NULLS LAST) = 1),
r AS (SELECT ct.*, v.verdict, d.mx, CASE WHEN kind = 'email' THEN {_valid_sql(_V)} WHEN NOT regexp_full_match({_V}, '[+]33[1-9][0-9]{{8}}') THEN 'forme' END AS faute,
        CASE WHEN valeur_corrigee IS NOT NULL THEN 0.95::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, coalesce(confiance, 0))) END AS base
      FROM ct LEFT JOIN v ON v.url = {sql_url('ct.source_url')} AND v.code_insee = ct.code_insee LEFT JOIN d ON kind = 'email' AND d.domaine = CASE WHEN contains(regexp_extract({_V}, '@([^@]*)$', 1), '.') THEN lower(regexp_extract({_V}, '@([^@]*)$', 1)) END)
SELECT id, faute, CASE WHEN faute IS NOT NULL THEN 0 ELSE floor(greatest(0::DOUBLE, least(1::DOUBLE,
   base * CASE WHEN kind <> 'email' THEN 1 WHEN mx = 0 THEN 0.3 WHEN mx IS NULL THEN 0.9 ELSE 1 END::DOUBLE * CASE WHEN kind <> 'email' THEN 1 WHEN is_generique = 0 THEN 0.8 WHEN is_generique IS NULL THEN 0.95 ELSE 1 END::DOUBLE
   * CASE WHEN association_id IS NULL THEN 0.85 ELSE 1 END::DOUBLE * CASE WHEN verdict = 'ecartee' THEN 0.9 WHEN verdict IS NULL THEN 0.95 ELSE 1 END::DOUBLE)) * 100 + 0.5) / 100.0::DOUBLE END AS score FROM r"""


@query("f16_scores", _SCORE.lstrip("\n"))
def f16(spark, folder):
    return oc.score_contacts(contacts(spark, folder), pages(spark, folder), domains(spark, folder)).select("id", "faute", "score")



@query("p21_a_renoter", "SELECT id FROM ct WHERE score_version IS DISTINCT FROM 2")
def p21(spark, folder):
    return oc.to_rescore(contacts(spark, folder)).select("id")


QUERIES["contacts_a_renoter"], SQL["contacts_a_renoter"] = QUERIES.pop("p21_a_renoter"), SQL.pop("p21_a_renoter")


@query("w7_file_de_revue", "SELECT id, score FROM ct WHERE review_statut = 'a_revoir' AND score IS NOT NULL ORDER BY score, id LIMIT 50")
def w7(spark, folder):
    return oc.top_rows(contacts(spark, folder).where("review_statut = 'a_revoir' and score is not null"), [F.col("score"), F.col("id")], 50).select("id", "score")


@query("w8_meilleurs_contacts", "SELECT ct.id, coalesce(score, confiance) AS rang FROM ct JOIN c USING (code_insee) ORDER BY 2 DESC, c.nom, valeur, ct.id LIMIT 50")
def w8(spark, folder):
    rows = contacts(spark, folder).join(communes(spark, folder).select("code_insee", "nom"), "code_insee").withColumn("rang", F.coalesce("score", "confiance"))
    return oc.top_rows(rows, [F.desc("rang"), F.col("nom"), F.col("valeur"), F.col("id")], 50).select("id", "rang")


@query("w9_meilleures_pages", "SELECT url_hash, prefiltre_score FROM p WHERE statut = 'visitee' AND prefiltre_score IS NOT NULL ORDER BY prefiltre_score DESC, url, url_hash LIMIT 50")
def w9(spark, folder):
    return oc.top_rows(pages(spark, folder).where("statut = 'visitee' and prefiltre_score is not null"), [F.desc("prefiltre_score"), F.col("url"), F.col("url_hash")], 50).select("url_hash", "prefiltre_score")


@query("w10_communes", "SELECT code_insee, nom FROM c ORDER BY code_insee LIMIT 50")
def w10(spark, folder):
    return oc.top_rows(communes(spark, folder), [F.col("code_insee")], 50).select("code_insee", "nom")


@query("w11_associations", "SELECT a.id, a.nom FROM a JOIN c USING (code_insee) ORDER BY c.nom, a.nom, a.id LIMIT 50")
def w11(spark, folder):
    rows = associations(spark, folder).join(communes(spark, folder).select("code_insee", F.col("nom").alias("commune")), "code_insee")
    return oc.top_rows(rows, [F.col("commune"), F.col("nom"), F.col("id")], 50).select("id", "nom")



_PRIORITY = "CASE WHEN profondeur <= 0 THEN 10 WHEN profondeur = 1 THEN 80 ELSE 150 END + 39 - greatest(0, least(39, CAST(floor(coalesce(prefiltre_score, 0) * 4 + 0.5) AS INTEGER)))"


@query("w2_pages_du_budget", f"SELECT url_hash, {_PRIORITY} AS priorite, rang FROM (SELECT *, row_number() OVER (PARTITION BY campagne, code_insee ORDER BY profondeur, {_PRIORITY}, url, url_hash) AS rang FROM p WHERE code_insee IS NOT NULL) WHERE rang <= 10")
def w2(spark, folder):
    return op.within_budget(pages(spark, folder).where("code_insee is not null"), 10).select("url_hash", "priorite", "rang")



@query("p23_racines", "SELECT code_insee, url_mairie, regexp_matches(lower(url_mairie), '^https?://[^/?#]+') AND NOT regexp_matches(split_part(regexp_extract(lower(url_mairie), '^https?://([^/:?#]+)', 1), '.', -2), '^(facebook|fb|messenger|instagram|linkedin|twitter|tiktok|snapchat|pinterest|threads|youtube|youtu|whatsapp|telegram)$') AS utilisable FROM c WHERE url_mairie IS NOT NULL")
def p23(spark, folder):
    rows = communes(spark, folder).where("url_mairie is not null")
    return rows.select("code_insee", "url_mairie", (fl.town_hall_url(F.col("url_mairie")).isNotNull() & ~fl.is_social(fl.host(F.col("url_mairie")))).alias("utilisable"))


QUERIES["racines_a_explorer"], SQL["racines_a_explorer"] = QUERIES.pop("p23_racines"), SQL.pop("p23_racines")


@query("j14_contenus_doubles", "SELECT campagne, code_insee, url_hash, premiere FROM (SELECT *, first(url_hash) OVER (PARTITION BY campagne, code_insee, content_hash ORDER BY fetched_at NULLS FIRST, url_hash) AS premiere FROM p WHERE content_hash IS NOT NULL AND code_insee IS NOT NULL) WHERE premiere <> url_hash")
def j14(spark, folder):
    return op.duplicate_content(pages(spark, folder))


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of cached pages in which a contact stands: item, code_insee, ctx_id, texte."""
    where = pages(spark, folder).where("cache_path is not null and code_insee is not null").select("cache_path", "code_insee").distinct()
    read = op.read_texts(table(spark, folder, "page_cache").select("cache_path", "texte")).join(where, "cache_path")
    return read.select(F.concat_ws("|", "cache_path", "kind", "valeur_normalisee").alias("item"), "code_insee", F.concat_ws("|", "cache_path", "code_insee", F.col("pos").cast("string")).alias("ctx_id"), F.col("ligne").alias("texte")).distinct()


@query("j11_rattachement")
def j11(spark, folder):
    return oa.attach(_contexts(spark, folder), oa.known_names(associations(spark, folder)))


@query("j12_noms_uniques", f"SELECT code_insee, nom_cle, CASE WHEN min(id) = max(id) THEN min(id) END AS association_id FROM (SELECT code_insee, {_NAME.format('nom')} AS nom_cle, id FROM a WHERE date_dissolution IS NULL AND code_insee IS NOT NULL) WHERE length(nom_cle) >= 8 GROUP BY 1, 2")
def j12(spark, folder):
    return oa.known_names(associations(spark, folder))


_PLACES = "SELECT DISTINCT cache_path, code_insee FROM p WHERE cache_path IS NOT NULL AND code_insee IS NOT NULL"


@query("f15_noms_connus", f""", n AS (SELECT DISTINCT code_insee, {_NAME.format('nom')} AS nom_cle FROM a WHERE date_dissolution IS NULL AND code_insee IS NOT NULL AND length({_NAME.format('nom')}) >= 8), w AS ({_PLACES}),
t AS (SELECT cache_path, code_insee, ' ' || {_NAME.format('texte')} || ' ' AS t FROM page_cache JOIN w USING (cache_path))
SELECT cache_path, count(*) AS noms FROM t JOIN n USING (code_insee) WHERE contains(t, ' ' || nom_cle || ' ') GROUP BY 1""")
def f15(spark, folder):
    where = pages(spark, folder).where("cache_path is not null and code_insee is not null").select("cache_path", "code_insee").distinct()
    texts = table(spark, folder, "page_cache").join(where, "cache_path").select("code_insee", F.col("cache_path").alias("ctx_id"), "texte")
    return oa.named_in(texts, oa.known_names(associations(spark, folder))).groupBy(F.col("ctx_id").alias("cache_path")).agg(F.count("*").alias("noms"))


@query("f14_verdicts")
def f14(spark, folder):
    """The verdict on every cached page, from its text, contacts and names."""
    cached = table(spark, folder, "page_cache").select("cache_path", "url", F.length("texte").alias("longueur"))
    read = f7(spark, folder).groupBy("cache_path").agg(F.count("*").cast("double").alias("contacts"))
    beside = j11(spark, folder).groupBy(F.split_part("item", F.lit("|"), F.lit(1)).alias("cache_path")).agg(F.count("*").cast("double").alias("rattaches"))
    zero = F.lit(0.0)
    facts = cached.join(read, "cache_path", "left").join(f15(spark, folder), "cache_path", "left").join(beside, "cache_path", "left")
    return op.judge_pages(facts.select("cache_path", "url", "longueur", F.coalesce("contacts", zero).alias("contacts"), F.coalesce(F.col("noms").cast("double"), zero).alias("noms"), F.coalesce("rattaches", zero).alias("rattaches")))


_EXPORT = f"""
, e AS (SELECT ct.*, c.departement, c.nom AS commune, a.rna_id, a.nom AS association, CASE WHEN a.id IS NOT NULL THEN {_TYPE.replace('nom', 'a.nom')} END AS type FROM ct JOIN c USING (code_insee) LEFT JOIN a ON a.id = ct.association_id WHERE ct.review_statut <> 'rejete' AND ct.score >= 0.5)
SELECT departement, row_number() OVER (PARTITION BY departement ORDER BY commune NULLS FIRST, association NULLS FIRST, kind, valeur, id) AS rang, id, code_insee, commune, rna_id, association, type, kind, valeur, valeur_corrigee, coalesce(valeur_corrigee, valeur) AS valeur_publiable,
CASE WHEN kind <> 'email' THEN '' WHEN is_generique = 1 THEN 'generique' WHEN is_generique = 0 THEN 'nominatif' ELSE 'indetermine' END AS regime, printf('%.2f', score) AS score, printf('%.2f', confiance) AS confiance, methode_extraction, source_url, collected_at, review_statut FROM e"""


@query("k1_export", _EXPORT)
def k1(spark, folder):
    typed = associations(spark, folder).withColumn("type", association_type(F.col("code_objet_social"), F.col("nom"))["type"])
    return oc.export_lines(contacts(spark, folder), typed, communes(spark, folder), least_score=0.5)


@query("k2_export_lignes", "SELECT departement, count(*) AS lignes FROM ct JOIN c USING (code_insee) WHERE review_statut <> 'rejete' AND score >= 0.5 GROUP BY 1")
def k2(spark, folder):
    return k1(spark, folder).groupBy("departement").agg(F.count("*").alias("lignes"))


@query("u1_communes", "--raw SELECT code_insee, max(CASE WHEN nom <> '' THEN nom END) AS nom, max(departement) AS departement, arg_max(url_mairie, updated_at) FILTER (WHERE url_mairie IS NOT NULL) AS url_mairie FROM commune GROUP BY 1")
def u1(spark, folder):
    return fold_communes(table(spark, folder, "commune"), "updated_at").select("code_insee", "nom", "departement", "url_mairie")


@query("u2_associations", "--raw SELECT rna_id, arg_max(id, updated_at) AS id, max(updated_at) AS updated_at FROM (SELECT DISTINCT rna_id, id, updated_at FROM association WHERE rna_id IS NOT NULL) GROUP BY 1")
def u2(spark, folder):
    return latest(table(spark, folder, "association").select("rna_id", "id", "updated_at"), ["rna_id"], ["updated_at"])


@query("u3_communes_minimales", f"SELECT code_insee, nom, statut_resolution FROM c UNION ALL SELECT k, k, 'inconnu' FROM (SELECT DISTINCT code_insee AS k FROM a WHERE code_insee IS NOT NULL AND code_insee NOT IN (SELECT code_insee FROM c))")
def u3(spark, folder):
    codes = associations(spark, folder).select("code_insee", F.lit(None).cast("string").alias("libelle"))
    return minimal_communes(codes, communes(spark, folder)).select("code_insee", "nom", "statut_resolution")


@query("u4_contacts", """
, r AS (SELECT *, CASE WHEN association_id IS NULL THEN code_insee END AS seule FROM ct WHERE association_id IS NOT NULL OR code_insee IS NOT NULL),
f AS (SELECT *, first(id) OVER w1 AS id1, first(review_statut) OVER w1 AS statut1, row_number() OVER w2 AS rn FROM r WINDOW w1 AS (PARTITION BY association_id, seule, kind, valeur_normalisee ORDER BY CAST(collected_at AS TIMESTAMPTZ), id), w2 AS (PARTITION BY association_id, seule, kind, valeur_normalisee ORDER BY confiance DESC, CAST(collected_at AS TIMESTAMPTZ), id))
SELECT id1 AS id, valeur_normalisee, confiance, statut1 AS review_statut FROM f WHERE rn = 1""")
def u4(spark, folder):
    return upsert_contacts(contacts(spark, folder), [instant(F.col("collected_at"))]).select("id", "valeur_normalisee", "confiance", "review_statut")


@query("u5_pages", f"SELECT url_hash FROM p QUALIFY row_number() OVER (PARTITION BY campagne, code_insee, {sql_url('url')} ORDER BY planifiee_at, url_hash) = 1")
def u5(spark, folder):
    return insert_new(pages(spark, folder).withColumn("canonique", canonical_url(F.col("url"))), None, ["campagne", "code_insee", "canonique"], ["planifiee_at", "url_hash"]).select("url_hash")


@query("u6_domaines", "SELECT domaine, mx, verifie_at FROM d")
def u6(spark, folder):
    return domains(spark, folder).select("domaine", "mx", "verifie_at")


_CUT = "2025-09-01T00:00:00.000Z"


@query("d2_conservation", f"SELECT 'contact' AS nom_table, count(*) AS lignes FROM ct WHERE CAST(collected_at AS TIMESTAMPTZ) >= '{_CUT}' UNION ALL SELECT 'page', count(*) FROM p WHERE CAST(coalesce(fetched_at, planifiee_at) AS TIMESTAMPTZ) >= '{_CUT}' UNION ALL SELECT 'domaine_mail', count(*) FROM d WHERE CAST(verifie_at AS TIMESTAMPTZ) >= '{_CUT}'")
def d2(spark, folder):
    kept = (("contact", oc.retained(contacts(spark, folder), F.col("collected_at"), _CUT)), ("page", oc.retained(pages(spark, folder), F.coalesce("fetched_at", "planifiee_at"), _CUT)), ("domaine_mail", oc.retained(domains(spark, folder), F.col("verifie_at"), _CUT)))
    parts = [df.agg(F.count("*").alias("lignes")).select(F.lit(n).alias("nom_table"), "lignes") for n, df in kept]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("d3_revue", "SELECT id, CASE WHEN id % 7 = 0 THEN 'valide' WHEN id % 11 = 0 THEN 'rejete' ELSE review_statut END AS review_statut FROM ct")
def d3(spark, folder):
    ct = contacts(spark, folder)
    wanted = F.when(F.col("id") % 7 == 0, "valide").when(F.col("id") % 11 == 0, "rejete")
    actions = ct.select("id", F.lit(1).alias("seq"), wanted.alias("action"), F.lit(None).cast("string").alias("saisie")).where("action is not null")
    return oc.apply_reviews(ct, actions).select("id", "review_statut")


@query("a16_etats", "SELECT campagne, count(*) FILTER (WHERE statut = 'a_visiter') AS pending, CAST(0 AS BIGINT) AS leased, count(*) FILTER (WHERE statut = 'visitee') AS done, count(*) FILTER (WHERE statut IN ('bloquee', 'hors_type')) AS skipped, count(*) FILTER (WHERE statut = 'erreur') AS dead FROM p GROUP BY 1")
def a16(spark, folder):
    state = F.when(F.col("statut") == "a_visiter", "pending").when(F.col("statut") == "visitee", "done").when(F.col("statut") == "erreur", "dead").otherwise("skipped")
    return oj.state_counts(pages(spark, folder).withColumn("state", state), ["campagne"])


@query("t4_ecarts", "--raw SELECT user_id, ts, ecart_ms FROM (SELECT user_id, ts, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS DOUBLE) / 1000 AS ecart_ms FROM events) WHERE ecart_ms < 60000")
def t4(spark, folder):
    return oj.gaps(table(spark, folder, "events"), ["user_id"], "ts", 60_000)


_BROKEN = """
SELECT 'contact.' || unnest(['provenance', 'confiance', 'score', 'rattachement', 'kind', 'generique', 'statut', 'correction']) AS regle, (SELECT count(*) FROM ct) AS lignes, unnest([
  (SELECT count(*) FROM ct WHERE source_url IS NULL OR methode_extraction IS NULL OR collected_at IS NULL OR confiance IS NULL), (SELECT count(*) FROM ct WHERE confiance IS NULL OR confiance < 0 OR confiance > 1),
  (SELECT count(*) FROM ct WHERE score < 0 OR score > 1), (SELECT count(*) FROM ct WHERE coalesce(CAST(association_id AS VARCHAR), code_insee) IS NULL), (SELECT count(*) FROM ct WHERE NOT coalesce(regexp_full_match(kind, 'email|phone'), false)),
  (SELECT count(*) FROM ct WHERE is_generique <> 0 AND is_generique <> 1), (SELECT count(*) FROM ct WHERE NOT coalesce(regexp_full_match(review_statut, 'a_revoir|valide|rejete|corrige'), false)), (SELECT count(*) FROM ct WHERE review_statut IS NULL OR (review_statut = 'corrige' AND valeur_corrigee IS NULL))]) AS fautes
UNION ALL SELECT 'commune.resolution', (SELECT count(*) FROM c), (SELECT count(*) FROM c WHERE statut_resolution IS NULL OR (statut_resolution = 'resolue' AND coalesce(url_mairie, source_resolution) IS NULL) OR (statut_resolution = 'resolue' AND url_mairie IS NULL) OR (statut_resolution = 'resolue' AND source_resolution IS NULL))
UNION ALL SELECT 'domaine_mail.mx', (SELECT count(*) FROM d), (SELECT count(*) FROM d WHERE mx < 0 OR mx > 1)
UNION ALL SELECT 'page.' || unnest(['statut', 'profondeur']), (SELECT count(*) FROM p), unnest([(SELECT count(*) FROM p WHERE NOT coalesce(regexp_full_match(statut, 'a_visiter|visitee|bloquee|erreur|hors_type|dupliquee'), false)), (SELECT count(*) FROM p WHERE profondeur IS NULL OR profondeur < 0 OR profondeur > 2)])"""


@query("contraintes", _BROKEN)
def contraintes(spark, folder):
    out = None
    for name, df in (("contact", contacts), ("commune", communes), ("domaine_mail", domains), ("page", pages)):
        part = broken(df(spark, folder), RULES[name]).select(F.concat(F.lit(name + "."), "regle").alias("regle"), "lignes", "fautes")
        out = part if out is None else out.unionByName(part)
    return out



@query("w12_derniers_passages", "SELECT campagne, count(*) AS pages, min(planifiee_at) AS debut, max(fetched_at) AS fin FROM p GROUP BY 1 ORDER BY campagne DESC LIMIT 5")
def w12(spark, folder):
    runs = pages(spark, folder).groupBy("campagne").agg(F.count("*").alias("pages"), F.min("planifiee_at").alias("debut"), F.max("fetched_at").alias("fin"))
    return oc.top_rows(runs, [F.desc("campagne")], 5)


@query("d5_issues", "SELECT url_hash, CASE WHEN profondeur = 0 AND statut <> 'visitee' THEN CASE statut WHEN 'bloquee' THEN 'interdit_robots' WHEN 'hors_type' THEN 'refuse' ELSE 'injoignable' END END AS issue FROM p WHERE statut <> 'a_visiter'")
def d5(spark, folder):
    return pages(spark, folder).where("statut <> 'a_visiter'").select("url_hash", times.commune_outcome(F.col("statut"), F.col("profondeur")).alias("issue"))
