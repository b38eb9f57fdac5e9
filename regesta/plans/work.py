"""Queries of work: jobs and their states, review, streams, and the measures whose SQL is longer than a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regesta.functions import links as fl
from regesta.functions import net
from regesta.functions.keys import canonical_url, instant
from regesta.functions.links import crawl_priority
from regesta.operators import contacts as oc
from regesta.operators import jobs as oj
from regesta.operators import metrics as om
from regesta.operators.upserts import insert_new
from regesta.plans.domain import _CLEAN, _DELTAS, _NAME, _SCORE, _deltas, associations, communes, contacts, domains, pages
from regesta.plans.general import sql_url
from regesta.plans.intake import scratch
from regesta.session import table
from regesta.streaming import flows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, clean: bool = True):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {_CLEAN}\n{sql}" if clean else sql
        return f

    return keep


# --- jobs ----------------------------------------------------------------------------------------------------------

AT = "2026-01-15T00:00:00.000Z"


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as the jobs that fetch them: a page to visit waits, one of another type is being worked on, and so on."""
    state = F.when(F.col("statut") == "a_visiter", "pending").when(F.col("statut") == "hors_type", "leased").when(F.col("statut") == "visitee", "done").when(F.col("statut") == "bloquee", "skipped").otherwise("dead")
    return pages(spark, folder).select(
        F.concat_ws("|", "url_hash", "campagne").alias("id"), state.alias("state"), crawl_priority(F.col("profondeur"), F.col("prefiltre_score")).alias("priority"), (F.col("profondeur") + 1).alias("attempts"),
        F.lit(3).alias("max_attempts"), F.col("planifiee_at").alias("available_at"), F.when(F.col("statut") == "hors_type", F.col("planifiee_at")).alias("lease_expires_at"), F.coalesce("fetched_at", "planifiee_at").alias("updated_at"), "prefiltre_motif",
    )


_PRIORITY = "CASE WHEN profondeur <= 0 THEN 10 WHEN profondeur = 1 THEN 80 ELSE 150 END + 39 - greatest(0, least(39, CAST(floor(coalesce(prefiltre_score, 0) * 4 + 0.5) AS INTEGER)))"
_JOBS = f"""
, j AS (SELECT url_hash || '|' || campagne AS id, CASE statut WHEN 'a_visiter' THEN 'pending' WHEN 'hors_type' THEN 'leased' WHEN 'visitee' THEN 'done' WHEN 'bloquee' THEN 'skipped' ELSE 'dead' END AS state, {_PRIORITY} AS priority, profondeur + 1 AS attempts,
        planifiee_at AS available_at, CASE WHEN statut = 'hors_type' THEN planifiee_at END AS lease_expires_at, coalesce(fetched_at, planifiee_at) AS updated_at, prefiltre_motif FROM p)"""
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')"


@query("w14_travaux_par_etat", _JOBS + "SELECT state, rang, id FROM (SELECT state, id, row_number() OVER (PARTITION BY state ORDER BY CAST(updated_at AS TIMESTAMPTZ) DESC, id) AS rang FROM j) WHERE rang <= 50")
def w14(spark, folder):
    return oj.latest_jobs(jobs(spark, folder), 50).select("state", "rang", "id")


@query("w16_prochains_travaux", _JOBS + f"SELECT id, priority FROM j WHERE (state = 'pending' AND available_at <= '{AT}') OR (state = 'leased' AND lease_expires_at <= '{AT}')")
def w16(spark, folder):
    """All jobs that may be taken now: waiting ones whose time has come, and those whose lease has run out."""
    return oj.eligible(jobs(spark, folder), AT).select("id", "priority")


@query("t1_prises", _JOBS + f"""SELECT id, CASE WHEN n IS NULL THEN state ELSE 'leased' END AS state, attempts + (n IS NOT NULL)::INT AS attempts, CASE WHEN n IS NULL THEN lease_expires_at ELSE '2026-01-15T00:01:00.000Z' END AS lease_expires_at
FROM j LEFT JOIN (SELECT id, 1 AS n FROM j WHERE (state = 'pending' AND available_at <= '{AT}') OR (state = 'leased' AND lease_expires_at <= '{AT}') ORDER BY priority, id LIMIT 20) k USING (id)""")
def t1(spark, folder):
    """The table of jobs after twenty were taken for a minute."""
    return oj.lease(jobs(spark, folder), AT, 20, 60_000).select("id", "state", "attempts", "lease_expires_at")


_EVENTS = ("complete", "skip", "fail", "release", "renew", "requeue")


@query("d6_transitions", _JOBS + f"""
, e AS (SELECT *, ['complete', 'skip', 'fail', 'release', 'renew', 'requeue', NULL][ascii(id) % 7 + 1] AS ev, state = 'leased' AS held, attempts >= 3 AS over, state IN ('done', 'skipped', 'dead') AS ended FROM j)
SELECT id, CASE WHEN held AND ev = 'complete' THEN 'done' WHEN held AND ev = 'skip' THEN 'skipped' WHEN held AND ev = 'fail' THEN CASE WHEN over THEN 'dead' ELSE 'pending' END WHEN held AND ev = 'release' THEN 'pending' WHEN ended AND ev = 'requeue' THEN 'pending' ELSE state END AS state,
CASE WHEN held AND ev = 'release' THEN greatest(attempts - 1, 0) WHEN ended AND ev = 'requeue' THEN 0 ELSE attempts END AS attempts,
CASE WHEN held AND ev = 'fail' AND NOT over THEN {_ISO.format(f"TIMESTAMP '2026-01-15 00:00:00' + to_milliseconds(least(1000 * pow(2, attempts - 1), 300000)::BIGINT)")} WHEN (held AND ev = 'release') OR (ended AND ev = 'requeue') THEN '{AT}' ELSE available_at END AS available_at,
CASE WHEN held AND ev = 'renew' THEN '2026-01-15T00:02:00.000Z' WHEN ev IS NULL THEN lease_expires_at END AS lease_expires_at FROM e""")
def d6(spark, folder):
    """What jobs become after an event each, some after several of which the last counts."""
    own = jobs(spark, folder)
    turn = F.ascii("id") % 7
    last = own.where(turn < 6).select("id", F.lit(2).alias("seq"), F.element_at(F.array(*map(F.lit, _EVENTS)), turn + 1).alias("event"), F.lit(120_000).alias("lease_ms"))
    earlier = last.withColumns({"seq": F.lit(1), "event": F.lit("complete")})
    return oj.settle(own, last.unionByName(earlier).unionByName(last), AT).select("id", "state", "attempts", "available_at", "lease_expires_at")


@query("u7_mises_en_file", f"SELECT cle, arg_min(url_hash, (planifiee_at, url_hash)) AS url_hash FROM (SELECT code_insee || '|' || {sql_url('url')} AS cle, url_hash, planifiee_at FROM p WHERE code_insee IS NOT NULL) WHERE cle NOT IN (SELECT code_insee || '|' || {sql_url('url')} FROM p WHERE code_insee IS NOT NULL AND campagne = (SELECT min(campagne) FROM p)) GROUP BY 1")
def u7(spark, folder):
    """Jobs by their key: what the first campaign has queued is not queued again, and of several with one key the first is."""
    own = pages(spark, folder).where("code_insee is not null").select(F.concat_ws("|", "code_insee", canonical_url(F.col("url"))).alias("cle"), "url_hash", "planifiee_at", "campagne")
    first = own.join(own.agg(F.min("campagne").alias("campagne")), "campagne", "left_semi").select("cle").distinct()
    return insert_new(own, first, ["cle"], ["planifiee_at", "url_hash"]).select("cle", "url_hash")


@query("charges_de_travail", """SELECT id, faute, CASE WHEN faute IS NULL THEN CASE WHEN v = 3 THEN 0 ELSE profondeur END END::BIGINT AS profondeur
FROM (SELECT *, CASE WHEN code_insee IS NULL THEN 'codeInsee' WHEN v = 2 THEN 'url' WHEN v = 1 THEN 'campagne' END AS faute FROM (SELECT url_hash || '|' || campagne AS id, code_insee, profondeur, length(url) % 5 AS v FROM p))""")
def charges(spark, folder):
    """Payloads of page jobs, some without a campaign or address or with a depth that is no number, read or refused with a reason."""
    v = F.length("url") % 5
    depth = F.when(v == 3, F.lit('"deux"')).otherwise(F.col("profondeur").cast("string"))
    fields = [F.when(F.col("code_insee").isNotNull(), F.concat(F.lit('"codeInsee": "'), "code_insee", F.lit('"'))), F.when(v == 2, F.lit('"url": ""')).otherwise(F.concat(F.lit('"url": "'), "url", F.lit('"'))), F.when(v != 1, F.concat(F.lit('"campagne": "'), "campagne", F.lit('"'))), F.concat(F.lit('"profondeur": '), depth)]
    rows = pages(spark, folder).select(F.concat_ws("|", "url_hash", "campagne").alias("id"), F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")).alias("j"))
    return rows.select("id", oj.page_payload(F.col("j")).alias("r")).select("id", "r.faute", "r.profondeur")


@query("w12_lectures", f"SELECT source, statut, lus, total, debut FROM (SELECT campagne AS source, CASE WHEN count(*) FILTER (WHERE statut = 'a_visiter') = 0 THEN 'termine' ELSE 'ouvert' END AS statut, count(fetched_at) AS lus, count(*) AS total, min(planifiee_at) AS debut FROM p GROUP BY 1) ORDER BY debut DESC, source DESC LIMIT 20")
def w12(spark, folder):
    """Readings of sources, the last begun first: each campaign reads its pages."""
    own = pages(spark, folder).groupBy(F.col("campagne").alias("source")).agg(F.when(F.count_if(F.col("statut") == "a_visiter") == 0, "termine").otherwise("ouvert").alias("statut"), F.count("fetched_at").alias("lus"), F.count("*").alias("total"), F.min("planifiee_at").alias("debut"))
    return oc.top_rows(own, [F.desc("debut"), F.desc("source")], 20)


@query("w15_departement_par_defaut", "SELECT departement, coalesce(demande, dernier, premier, '35') AS affiche FROM (SELECT departement, CASE WHEN departement < '50' THEN departement END AS demande FROM (SELECT DISTINCT departement FROM c)), (SELECT max(departement) FILTER (WHERE campagne = (SELECT max(campagne) FROM p)) AS dernier FROM p JOIN c USING (code_insee)), (SELECT min(departement) AS premier FROM c)")
def w15(spark, folder):
    """The district that is shown where none is asked for: that of the last run, else the first."""
    asked = communes(spark, folder).select("departement", F.when(F.col("departement") < "50", F.col("departement")).alias("demande")).distinct()
    runs = pages(spark, folder).join(communes(spark, folder).select("code_insee", "departement"), "code_insee").select("campagne", "departement")
    return om.default_district(asked, runs, communes(spark, folder), "35").select("departement", "affiche")


@query("a16_travaux_par_etat", _JOBS + "SELECT s AS state, count(id) AS travaux FROM (SELECT unnest(['pending', 'leased', 'done', 'skipped', 'dead', 'failed']) AS s) LEFT JOIN j ON state = s WHERE s <> 'failed' GROUP BY 1")
def a16(spark, folder):
    counted = oj.state_counts(jobs(spark, folder), [])
    return counted.select(F.explode(F.array(*(F.struct(F.lit(s).alias("state"), F.col(s).alias("travaux")) for s in oj.STATES))).alias("x")).select("x.*")


@query("racines_par_etat", "SELECT etat, count(*) AS communes FROM (SELECT CASE WHEN NOT regexp_matches(trim(url_mairie), '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]+') THEN 'invalide' WHEN regexp_matches(lower(url_mairie), '^https?://([^/]*[.])?(facebook|instagram)[.]com') THEN 'refuse' ELSE 'a_explorer' END AS etat FROM (SELECT CASE WHEN substr(code_insee, 5, 1) = '0' THEN 'https://www.facebook.com/' || code_insee WHEN substr(code_insee, 5, 1) = '1' THEN 'ftp:' || code_insee ELSE url_mairie END AS url_mairie FROM c WHERE url_mairie IS NOT NULL)) GROUP BY 1")
def racines(spark, folder):
    """Roots to explore, refused ones and invalid ones; some addresses are turned into those of networks or into none."""
    last = F.substring("code_insee", 5, 1)
    url = F.when(last == "0", F.concat(F.lit("https://www.facebook.com/"), "code_insee")).when(last == "1", F.concat(F.lit("ftp:"), "code_insee")).otherwise(F.col("url_mairie"))
    rows = communes(spark, folder).where("url_mairie is not null").select(fl.root_state(url).alias("etat"))
    return rows.groupBy("etat").agg(F.count("*").alias("communes"))


# --- review --------------------------------------------------------------------------------------------------------


@query("f28_saisies", r"""
, s AS (SELECT id, kind, CASE WHEN kind = 'email' THEN CASE id % 3 WHEN 0 THEN '<' || upper(valeur_normalisee) || '>,' WHEN 1 THEN replace(valeur_normalisee, '@', ' ') ELSE 'x' || valeur_normalisee END
        ELSE CASE id % 3 WHEN 0 THEN '06 11 22 33 44' WHEN 1 THEN '12 34' ELSE '0' || substr(valeur_normalisee, 4) END END AS t FROM ct WHERE length(valeur_normalisee) < 200 AND regexp_full_match(valeur_normalisee, '[a-z0-9.-]+@[a-z0-9-]+([.][a-z0-9-]+)*[.][a-z]{2,}|[+]33[1-5][0-9]{8}'))
SELECT id, CASE WHEN kind = 'email' THEN CASE WHEN id % 3 <> 1 THEN lower(trim(t, '<>,')) END WHEN id % 3 = 0 THEN '+33611223344' WHEN id % 3 = 2 THEN '+33' || substr(t, 2) END AS normalisee, CASE WHEN id % 3 = 1 THEN 'illisible' WHEN kind = 'phone' AND id % 3 = 0 THEN 'mobile' END AS refus FROM s
WHERE NOT (kind = 'email' AND regexp_matches(t, '[.]{2}|^[.]|[.]@|@-|-[.]|[.]-|^<?[.]'))""")
def f28(spark, folder):
    """What reviewers type, read like any other contact; what cannot be read and mobiles are refused."""
    turn, mail = F.col("id") % 3, F.col("kind") == "email"
    v = F.col("valeur_normalisee")
    typed = F.when(mail, F.when(turn == 0, F.concat(F.lit("<"), F.upper(v), F.lit(">,"))).when(turn == 1, F.replace(v, F.lit("@"), F.lit(" "))).otherwise(F.concat(F.lit("x"), v)))
    typed = typed.otherwise(F.when(turn == 0, "06 11 22 33 44").when(turn == 1, "12 34").otherwise(F.concat(F.lit("0"), F.substr(v, F.lit(4)))))
    rows = contacts(spark, folder).where(v.rlike(r"^([a-z0-9.-]+@[a-z0-9-]+([.][a-z0-9-]+)*[.][a-z]{2,}|[+]33[1-5][0-9]{8})$") & (F.length(v) < 200)).withColumn("t", typed)
    rows = rows.where(~(mail & F.col("t").rlike(r"[.]{2}|^[.]|[.]@|@-|-[.]|[.]-|^<?[.]")))
    return rows.select("id", oc.read_correction(F.col("kind"), F.col("t")).alias("c")).select("id", "c.normalisee", "c.refus")


@query("d3_corrections", r"""
, k AS (SELECT *, coalesce('a' || association_id, 'c' || code_insee) AS h, CASE WHEN kind = 'email' AND id % 2 = 0 THEN 'revu' || id || '@corrige.example' WHEN kind = 'email' AND id % 3 = 0 THEN 'sans arobase' WHEN kind = 'email' THEN valeur_normalisee END AS t FROM ct),
r AS (SELECT *, CASE WHEN t IS NULL THEN NULL WHEN NOT regexp_full_match(t, '[^\s@]+@[^\s@]+[.][A-Za-z]{2,}') THEN 'illisible' WHEN lower(t) = valeur_normalisee THEN 'identique' END AS refus FROM k WHERE t IS NULL OR id % 2 = 0 OR id % 3 = 0 OR regexp_full_match(valeur_normalisee, '[a-z0-9][a-z0-9_%+-]*([.][a-z0-9_%+-]+)*@[a-z0-9]+([.-][a-z0-9]+)*[.][a-z]{2,}'))
SELECT id, CASE WHEN t IS NOT NULL AND refus IS NULL THEN 'corrige' ELSE review_statut END AS review_statut, CASE WHEN t IS NOT NULL AND refus IS NULL THEN t ELSE valeur_corrigee END AS valeur_corrigee, CASE WHEN t IS NOT NULL AND refus IS NULL THEN lower(t) ELSE valeur_normalisee END AS valeur_normalisee, refus FROM r""")
def d3(spark, folder):
    """Corrections of e-mail addresses: new ones are taken, unreadable and unchanged ones refused."""
    ct = contacts(spark, folder)
    mail, v = F.col("kind") == "email", F.col("valeur_normalisee")
    typed = F.when(mail & (F.col("id") % 2 == 0), F.concat(F.lit("revu"), F.col("id").cast("string"), F.lit("@corrige.example"))).when(mail & (F.col("id") % 3 == 0), "sans arobase").when(mail, v)
    rows = ct.withColumn("t", typed)
    rows = rows.where(F.col("t").isNull() | (F.col("id") % 2 == 0) | (F.col("id") % 3 == 0) | v.rlike(r"^[a-z0-9][a-z0-9_%+-]*([.][a-z0-9_%+-]+)*@[a-z0-9]+([.-][a-z0-9]+)*[.][a-z]{2,}$"))
    actions = rows.where("t is not null").select("id", F.lit(1).alias("seq"), F.lit("corrige").alias("action"), F.col("t").alias("saisie"))
    return oc.apply_reviews(rows.drop("t"), actions).select("id", "review_statut", "valeur_corrigee", "valeur_normalisee", "refus")


_CUT = "2025-09-01 00:00:00+00"


@query("d2_purge", f"""SELECT 'contact' AS nom_table, count(*) FILTER (WHERE CAST(collected_at AS TIMESTAMPTZ) < '{_CUT}') AS supprimees FROM ct UNION ALL SELECT 'page', count(*) FILTER (WHERE CAST(coalesce(fetched_at, planifiee_at) AS TIMESTAMPTZ) < '{_CUT}') FROM p
UNION ALL SELECT 'domaine_mail', count(*) FILTER (WHERE CAST(verifie_at AS TIMESTAMPTZ) < '{_CUT}') FROM d UNION ALL SELECT 'run', count(*) FILTER (WHERE t < '{_CUT}') FROM (SELECT campagne, min(CAST(planifiee_at AS TIMESTAMPTZ)) AS t FROM p GROUP BY 1)
UNION ALL SELECT 'page_cache', count(*) FILTER (WHERE CAST(fetched_at AS TIMESTAMPTZ) < '{_CUT}') FROM page_cache""")
def d2(spark, folder):
    """What a purge takes away, per table: contacts, pages, mail verdicts, runs and cached bodies; never municipalities or associations."""
    own = pages(spark, folder)
    runs = own.groupBy("campagne").agg(F.min_by("planifiee_at", instant(F.col("planifiee_at"))).alias("started_at"))
    tables = {"contact": (contacts(spark, folder), F.col("collected_at")), "page": (own, F.coalesce("fetched_at", "planifiee_at")), "domaine_mail": (domains(spark, folder), F.col("verifie_at")), "run": (runs, F.col("started_at")), "page_cache": (table(spark, folder, "page_cache"), F.col("fetched_at"))}
    return oc.purged(tables, "2025-09-01T00:00:00.000Z")


# --- measures ------------------------------------------------------------------------------------------------------


_FAMILY = "substr(CASE WHEN length(trim(code_objet_social)) < 6 THEN lpad(trim(code_objet_social), 6, '0') ELSE trim(code_objet_social) END, 1, 3)"


@query("f12_sources", f"""SELECT source, count(*) AS associations FROM (SELECT CASE WHEN contains(n, ' comite des fetes ') THEN 'nom:comite_des_fetes' WHEN contains(n, ' comite de fetes ') THEN 'nom:comite_des_fetes' WHEN contains(n, ' comite danimation ') THEN 'nom:comite_danimation' WHEN contains(n, ' comite d animation ') THEN 'nom:comite_danimation'
WHEN contains(n, ' centre de loisirs ') THEN 'nom:centre_de_loisirs' WHEN contains(n, ' accueil de loisirs ') THEN 'nom:accueil_de_loisirs' WHEN contains(n, ' centre aere ') THEN 'nom:centre_aere' WHEN contains(n, ' alsh ') THEN 'nom:alsh' WHEN regexp_full_match(trim(code_objet_social), '[0-9]+') THEN 'rna:' || {_FAMILY} ELSE 'defaut' END AS source
FROM (SELECT *, ' ' || {_NAME.format('nom')} || ' ' AS n FROM a)) GROUP BY 1""")
def f12s(spark, folder):
    from regesta.functions.classify import association_type

    typed = associations(spark, folder).select(association_type(F.col("code_objet_social"), F.col("nom"))["source"].alias("source"))
    return typed.groupBy("source").agg(F.count("*").alias("associations"))


def sql_link_score(path: str, anchor: str) -> str:
    good = {"vie associative": 6, "associ": 4, "annuaire": 3, "vie locale": 2, "benevol": 2, "club": 2, "sport": 2, "loisir": 2, "culture": 2, "forum": 1, "jeunesse": 1, "contact": 1}
    bad = "actualite|agenda|urbanisme|etat civil|mentions legales|marche public|marches publics|compte rendu|comptes rendus|plan du site|politique de confidentialite|cookie|connexion|mon compte|newsletter|recherche|deces|naissance|cimetiere|cadastre|permis de construire|conseil municipal|arrete|dechet|assainissement"
    plus = " + ".join(f"{k} * contains({t}, '{w}')::INT" for w, k in good.items() for t in (path, anchor))
    return f"({plus} - 4 * len(list_filter(string_split('{bad}', '|'), lambda w: contains({path}, w) OR contains({anchor}, w))))"


_PATH = "trim(regexp_replace(lower(strip_accents(regexp_extract({0}, '^[A-Za-z]+://[^/?#]*([^#]*)', 1))), '[^a-z0-9]+', ' ', 'g'))"


@query("f13_scores_liens", f"SELECT url_hash, {sql_link_score('u', 'm')}::INT AS score FROM (SELECT url_hash, {_PATH.format('url')} AS u, {_PATH.format('url_source')} || ' ' || coalesce(prefiltre_motif, '') AS m FROM (SELECT * REPLACE (coalesce(url_source, 'http://h/') AS url_source) FROM p))")
def f13(spark, folder):
    """Scores of links; the path of the page that names a page, and its reason, stand for the anchor."""
    anchor = F.concat(fl.path_and_query(F.coalesce("url_source", F.lit("http://h/"))), F.lit(" "), F.coalesce("prefiltre_motif", F.lit("")))
    return pages(spark, folder).select("url_hash", fl.link_score(F.col("url"), anchor).cast("int").alias("score"))


_HOST_OF = "regexp_extract({0}, '^[a-z]+://([^/:?#]*)', 1)"


@query("w1_meilleurs_liens", f"""
, l AS (SELECT DISTINCT {sql_url('url_source')} AS base, {sql_url('url')} AS c, url AS href FROM page WHERE url_source IS NOT NULL),
u AS (SELECT base, href, regexp_extract(c, '^([a-z]+://)', 1) || {_HOST_OF.format('base')} || regexp_replace(c, '^[a-z]+://[^/:]*', '') AS url FROM l WHERE regexp_replace({_HOST_OF.format('c')}, '^www[.]', '') = regexp_replace({_HOST_OF.format('base')}, '^www[.]', '')
      AND NOT regexp_matches(split_part(regexp_replace(c, '[?#].*$', ''), '/', -1), '^.+[.](?i:pdf|docx?|xlsx?|pptx?|od[ts]|rtf|csv|jpe?g|png|gif|webp|svg|ico|bmp|tiff?|zip|rar|7z|gz|tar|mp[34]|avi|mov|wmv|wav|ogg|css|js|json|xml|rss|atom|exe|dmg|apk)$')),
s AS (SELECT base AS page, url, max({sql_link_score('pp', "''")})::INT AS score FROM (SELECT *, {_PATH.format('href')} AS pp FROM u) WHERE url <> base GROUP BY 1, 2)
SELECT page, url, score, rang FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, length(url), url) AS rang FROM s WHERE score > 0) WHERE rang <= 8""")
def w1(spark, folder):
    """The eight best links of every page that others name as the page they were found on."""
    from regesta.operators import pages as op

    found = table(spark, folder, "page").where("url_source is not null").select(canonical_url(F.col("url_source")).alias("page"), F.col("url").alias("href"), F.lit("").alias("ancre"), F.lit(0).alias("pos")).distinct()
    return op.best_links(found).select("page", "url", "score", "rang")


_ROBOTS = (
    "User-agent: autre\nDisallow: /\n\nUser-agent: *\nDisallow: /agenda\nAllow: /agenda/*5$\nDisallow: /*art=\nCrawl-delay: 5\n",
    "User-agent: annuaire\nUser-agent: autre\nDisallow: /vie-\nAllow: /vie-locale\nCrawl-delay: 1,5\n\nUser-agent: annuaire\nDisallow: /\n",
    "# rien\n",
)


@query("w18_permissions", f"""SELECT url, CASE length(h) % 3 WHEN 0 THEN NOT ((starts_with(q, '/agenda') AND NOT regexp_matches(q, '^/agenda/.*5$')) OR (regexp_matches(q, '^/.*art=') AND NOT regexp_matches(q, '^/agenda/.*5$'))) WHEN 1 THEN NOT (starts_with(q, '/vie-') AND NOT starts_with(q, '/vie-locale')) ELSE true END AS permis, CASE length(h) % 3 WHEN 0 THEN 5000 ELSE 2000 END AS delai_ms
FROM (SELECT DISTINCT url, {_HOST_OF.format('lower(url)')} AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS q FROM p)""")
def w18(spark, folder):
    """Which addresses an agent may read by the rules of their hosts (three texts by turns), and how long it waits; each text is parsed once."""
    hosts = spark.createDataFrame(list(enumerate(_ROBOTS)), "k int, robots string").select("k", net.robots_policy("annuaire")(F.col("robots")).alias("r"))
    own = pages(spark, folder).select("url").distinct().withColumn("k", F.length(fl.host(F.col("url"))) % 3)
    rows = own.join(F.broadcast(hosts), "k")
    return rows.select("url", net.allowed(F.col("r.rules"), fl.path_and_query(F.col("url"))).alias("permis"), net.effective_delay_ms(F.col("r.delay_ms"), 2000).alias("delai_ms"))


@query("k5_compteurs_json", f", s AS ({_DELTAS}), o AS (SELECT etape, nom, sum(valeur)::BIGINT AS v FROM s GROUP BY 1, 2) SELECT etape, '{{' || string_agg('\"' || nom || '\":' || v, ',' ORDER BY nom) || '}}' AS compteurs FROM o GROUP BY 1")
def k5(spark, folder):
    return om.counters_json(om.counters(_deltas(spark, folder)))


_SIGNALS = _SCORE.split("SELECT id, faute, CASE")[0] + """SELECT kind, signaux, count(*) AS contacts, min(score) AS moindre, max(score) AS meilleur FROM (SELECT kind, concat_ws(',', CASE WHEN valeur_corrigee IS NOT NULL THEN 'revue' END, CASE WHEN faute IS NOT NULL THEN 'syntaxe' END, CASE WHEN faute IS NULL AND kind = 'email' AND coalesce(mx, 0) = 0 THEN 'mx' END,
CASE WHEN faute IS NULL AND kind = 'email' AND coalesce(is_generique, 0) = 0 THEN 'regime' END, CASE WHEN faute IS NULL AND association_id IS NULL THEN 'rattachement' END, CASE WHEN faute IS NULL AND coalesce(verdict, 'ecartee') = 'ecartee' THEN 'page' END) AS signaux, """ + "CASE WHEN faute IS NOT NULL THEN 0 ELSE floor(greatest(0::DOUBLE, least(1::DOUBLE," + _SCORE.split("ELSE floor(greatest(0::DOUBLE, least(1::DOUBLE,")[1].replace(" FROM r", " FROM r) GROUP BY 1, 2")


@query("f16_signaux", _SIGNALS)
def f16s(spark, folder):
    scored = oc.score_contacts(contacts(spark, folder), pages(spark, folder), domains(spark, folder))
    return scored.groupBy("kind", "signaux").agg(F.count("*").alias("contacts"), F.min("score").alias("moindre"), F.max("score").alias("meilleur"))


# --- streams -------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    batch = table(spark, folder, name)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(batch.schema)
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@query("t3_reprise_sans_doublon", "SELECT id, collected_at, confiance FROM contact WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY collected_at DESC) = 1", clean=False)
def t3(spark, folder):
    """Contacts from a stream of files that is read twice: the second run has nothing left to do."""
    target, checkpoint = scratch(spark, "upserts"), scratch(spark, "stream")
    for _ in range(2):
        flows.upsert_stream(_stream(spark, folder, "contact"), target, checkpoint, ["id"], ["collected_at"]).awaitTermination()
    return flows.read_snapshot(spark, target).select("id", "collected_at", "confiance")


def _written(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    target, checkpoint = scratch(spark, "rows"), scratch(spark, "stream")
    schema = stream.schema
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema(schema).parquet(target)


@query("t2_une_fois_par_jour", "SELECT DISTINCT user_id, date_trunc('day', ts) AS jour FROM events WHERE ts IS NOT NULL", clean=False)
def t2(spark, folder):
    """Events once per user and day, from a stream."""
    rows = _stream(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _written(flows.once_per_period(rows, "user_id", "ts", "day"), spark).select("user_id", F.col("periode").cast("timestamp_ntz").alias("jour"))


@query("t1_etats_en_flux", "SELECT user_id AS id, CASE user_id % 5 WHEN 0 THEN 'leased' WHEN 1 THEN 'done' WHEN 2 THEN 'skipped' WHEN 3 THEN 'pending' ELSE 'dead' END AS state, CASE user_id % 5 WHEN 4 THEN 2 ELSE 1 END AS attempts FROM (SELECT DISTINCT user_id FROM events)", clean=False)
def t1s(spark, folder):
    """States of jobs from a stream of their events, one job for each user; each event comes as often as the user has events."""
    at = [("take", 1.0), ("complete", 2.0), ("skip", 2.0), ("fail", 2.0), ("take", 3.0), ("fail", 4.0)]
    turn = F.col("user_id") % 5
    wanted = F.when(turn == 0, F.array(F.lit(0))).when(turn == 1, F.array(F.lit(0), F.lit(1))).when(turn == 2, F.array(F.lit(0), F.lit(2))).when(turn == 3, F.array(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0), F.lit(3), F.lit(4), F.lit(5)))
    table_of = F.array(*(F.struct(F.lit(e).alias("event"), F.lit(t).alias("at")) for e, t in at))
    rows = _stream(spark, folder, "events").select(F.col("user_id").cast("long").alias("id"), F.explode(wanted).alias("k")).select("id", F.get(table_of, F.col("k")).alias("e")).select("id", "e.at", "e.event", F.lit(2).alias("max_attempts"))
    target, checkpoint = scratch(spark, "rows"), scratch(spark, "stream")
    flows.lease_states(rows, 60.0).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{target}/{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", True).schema("id long, state string, attempts int, lease_until double").parquet(target).select("id", "state", "attempts").distinct()


# --- pages ---------------------------------------------------------------------------------------------------------


@query("f14_scores_des_pages", f""", f AS (SELECT url_hash, length(url) * 25 AS longueur, (coalesce(contacts_extraits, 0) + length(url) % 3)::DOUBLE AS contacts, (length(domaine) % 4)::DOUBLE AS noms, (length(url) % 2)::DOUBLE AS rattaches, {sql_link_score('u', "''")}::DOUBLE AS v FROM (SELECT *, {_PATH.format('url')} AS u FROM p)),
g AS (SELECT *, least(12::DOUBLE, rattaches * 4) AS liste, least(12::DOUBLE, noms * 3) AS nm, least(6::DOUBLE, contacts * 2) + least(4::DOUBLE, floor(contacts * 1000.0::DOUBLE / greatest(longueur, 1000) * 2 + 0.5)) AS ct, greatest(-4::DOUBLE, least(4::DOUBLE, v)) AS vo FROM f),
h AS (SELECT *, longueur < 200 AND contacts = 0 AS vide, liste + nm + ct + vo AS total, greatest(liste, nm, ct, vo) AS haut FROM g)
SELECT url_hash, CASE WHEN vide THEN 0 ELSE floor(total * 100 + 0.5) / 100.0::DOUBLE END AS score, CASE WHEN NOT vide AND total >= 8 THEN 'retenue' ELSE 'ecartee' END AS verdict,
CASE WHEN vide THEN 'vide' WHEN total >= 8 THEN CASE haut WHEN liste THEN 'liste' WHEN nm THEN 'noms' WHEN ct THEN 'contacts' ELSE 'vocabulaire' END WHEN vo < 0 THEN 'negatif' ELSE 'insuffisant' END AS motif, NOT vide AND total >= 8 AND contacts < 2 AS candidate FROM h""")
def f14(spark, folder):
    """Verdicts of pages with their dominant reason, from facts made of the pages' columns."""
    from regesta.operators import pages as op

    real = lambda c: c.cast("double")
    facts = pages(spark, folder).select("url_hash", "url", (F.length("url") * 25).alias("longueur"), real(F.coalesce("contacts_extraits", F.lit(0)) + F.length("url") % 3).alias("contacts"), real(F.length("domaine") % 4).alias("noms"), real(F.length("url") % 2).alias("rattaches"))
    return op.judge_pages(facts).select("url_hash", "score", "verdict", "motif", "candidate")


_ROOT = "(SELECT DISTINCT u AS root FROM (SELECT {0} AS u FROM c WHERE regexp_matches(trim(url_mairie), '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]+')))".format(sql_url("regexp_replace(trim(url_mairie), '#.*$', '')"))


@query("t7_exploration", f"""
, l AS (SELECT {sql_url('url_source')} AS source, {sql_url('url')} AS url, max(trunc(coalesce(prefiltre_score, 0))::INT) AS score FROM page WHERE url_source IS NOT NULL GROUP BY 1, 2),
z AS (SELECT root, root AS url, 0 AS profondeur, 0 AS score FROM {_ROOT}),
o AS (SELECT root, l.url, 1 AS profondeur, max(l.score) AS score FROM z JOIN l ON l.source = z.url WHERE l.url <> root GROUP BY 1, 2),
t AS (SELECT root, l.url, 2 AS profondeur, max(l.score) AS score FROM o JOIN l ON l.source = o.url WHERE l.url <> root AND NOT EXISTS (SELECT 1 FROM o x WHERE x.root = o.root AND x.url = l.url) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY profondeur, score DESC, url) AS rang FROM (FROM z UNION ALL FROM o UNION ALL FROM t)) WHERE rang <= 10""")
def t7(spark, folder):
    """What is reached from the town halls' roots in two steps over the links of all visits, ten pages each."""
    from regesta.operators import pages as op

    roots = communes(spark, folder).select(fl.town_hall_url(F.col("url_mairie")).alias("u")).where("u is not null").select(canonical_url(F.col("u")).alias("root"), canonical_url(F.col("u")).alias("url")).distinct()
    links = table(spark, folder, "page").where("url_source is not null").select(canonical_url(F.col("url_source")).alias("source"), canonical_url(F.col("url")).alias("url"), F.coalesce("prefiltre_score", F.lit(0.0)).cast("int").alias("score")).groupBy("source", "url").agg(F.max("score").alias("score"))
    return op.frontier(roots, links, 10)


_FICHES = "SELECT fiche_id, min(trim(regexp_replace(regexp_replace(nom_affiche, '[<>&;]', '', 'g'), '[ \\x{00A0}\\t]+', ' ', 'g'))) AS nom, min(lower(trim(courriel))) AS c, min(telephone) AS t FROM fiche_mairie WHERE regexp_full_match(lower(trim(courriel)), '[a-z][a-z0-9.]*[a-z0-9]@[a-z0-9-]+[.]example') AND regexp_full_match(telephone, '0[1-5]([ .-]?[0-9]{2}){4}') GROUP BY 1"


@query("f7_contacts_des_fiches", f"""SELECT fiche_id AS page, 'email' AS kind, c AS valeur_normalisee, 'dom:mailto' AS methode, 0.9::DOUBLE AS confiance, nom || ' : écrire' AS contexte FROM ({_FICHES})
UNION ALL SELECT fiche_id, 'phone', '+33' || substr(regexp_replace(t, '[^0-9]', '', 'g'), 2), 'texte:motif', 0.6::DOUBLE, nom || ', ' || c || ' ou ' || t FROM ({_FICHES})""", clean=False)
def f7(spark, folder):
    """Contacts of pages made of directory entries, each once by its surest reading, with the shortest block that holds it."""
    from regesta.functions.pages import parse_page
    from regesta.operators import pages as op

    mail, name = F.lower(F.trim("courriel")), F.trim(F.regexp_replace(F.regexp_replace("nom_affiche", "[<>&;]", ""), "[ \\x{00A0}\t]+", " "))
    rows = table(spark, folder, "fiche_mairie").where(mail.rlike(r"^[a-z][a-z0-9.]*[a-z0-9]@[a-z0-9-]+[.]example$") & F.col("telephone").rlike(r"^0[1-5]([ .-]?[0-9]{2}){4}$"))
    own = rows.groupBy("fiche_id").agg(F.min(name).alias("n"), F.min(mail).alias("c"), F.min("telephone").alias("t"))
    html = F.concat(F.lit("<p>"), "n", F.lit(' : <a href="mailto:'), "c", F.lit('?subject=x">écrire</a></p><ul><li>'), "n", F.lit(", "), "c", F.lit(" ou "), "t", F.lit("<li>"), "n", F.lit(", la page entière de la fiche : "), "c", F.lit(" et "), "t", F.lit("</ul>"))
    docs = own.select(F.col("fiche_id").alias("page"), F.lit("x").alias("code_insee"), parse_page(html, F.lit("https://h.example/")).alias("doc"))
    return op.page_contacts(docs).select("page", "kind", "valeur_normalisee", "methode", "confiance", F.element_at("contextes", 1).alias("contexte"))
