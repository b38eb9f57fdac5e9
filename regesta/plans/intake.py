"""Queries of reading: sources, bodies, HTML, and what decides whether something is read at all. Rows come from the tables; files are written to the shared folder and read again."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regesta.functions import contacts as fc
from regesta.functions import links as fl
from regesta.functions import pages as fp
from regesta.functions import places, times
from regesta.operators import pages as op
from regesta.operators.jobs import resume_points
from regesta.plans.domain import _CLEAN, _NAME, NOW, associations, communes, contacts, pages
from regesta.plans.general import sql_url
from regesta.session import shared_dir, table
from regesta.sources import export, registry, services, store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, clean: bool = True):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {_CLEAN}\n{sql}" if clean else sql
        return f

    return keep


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes with the session."""
    path = f"{shared_dir(spark).rstrip('/')}/regesta/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


# --- registry ------------------------------------------------------------------------------------------------------


def _registry_rows(spark: SparkSession, folder: str) -> DataFrame:
    """associations as the registry delivers them: text only, no value is '', no date is 0001-01-01; names with quotes and line ends."""
    day = F.coalesce(F.col("date_creation"), F.lit("0001-01-01"))
    return associations(spark, folder).where("rna_id is not null").select(
        F.col("rna_id").alias("id"), F.concat(F.lit('L\'"asso" '), F.col("nom"), F.when(F.col("id") % 3 == 0, "\n; suite").otherwise("")).alias("titre"), F.coalesce("objet", F.lit("")).alias("objet"),
        F.coalesce("code_objet_social", F.lit("")).alias("objet_social1"), F.coalesce("code_insee", F.lit(" ")).alias("adrs_codeinsee"), F.lit("").alias("adrs_libcommune"), F.coalesce("site_web", F.lit("")).alias("siteweb"),
        F.coalesce("date_dissolution", F.lit("0001-01-01")).alias("date_disso"), day.alias("date_creat"), F.coalesce("date_declaration", F.lit("")).alias("date_decla"),
    )


# registry ids are of one association each in what is compared
_REGISTRY = """
, r AS (SELECT rna_id, code_insee, 'L''"asso" ' || nom || CASE WHEN id % 3 = 0 THEN chr(10) || '; suite' ELSE '' END AS nom, objet, code_objet_social, date_creation, date_declaration, date_dissolution FROM a WHERE rna_id IS NOT NULL)
SELECT trim(rna_id) AS rna_id, code_insee, nom, nullif(nullif(trim(objet), ''), '0001-01-01') AS objet, nullif(nullif(trim(code_objet_social), ''), '0001-01-01') AS code_objet_social, nullif(nullif(trim(date_creation), ''), '0001-01-01') AS date_creation,
       nullif(nullif(trim(date_declaration), ''), '0001-01-01') AS date_declaration, nullif(nullif(trim(date_dissolution), ''), '0001-01-01') AS date_dissolution FROM r WHERE trim(rna_id) <> ''"""
_REGISTRY_OUT = ["rna_id", "code_insee", "nom", "objet", "code_objet_social", "date_creation", "date_declaration", "date_dissolution"]


@query("s1_csv", _REGISTRY)
def s1(spark, folder):
    """CSV with quotes, doubled quotes and line ends in fields, written in many files and read by column name; columns that lack are ''."""
    path = scratch(spark, "rna-csv")
    _registry_rows(spark, folder).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return registry.to_associations(registry.read_csv(spark, path)).select(*_REGISTRY_OUT)


@query("s4_archives", _REGISTRY)
def s4(spark, folder):
    """The same from ZIP archives, one for each bucket of rows, with an entry per district."""
    lines = _registry_rows(spark, folder).withColumn("bucket", F.pmod(F.hash("id"), F.lit(64)))

    def pack(keyed: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for k, part in keyed.drop(columns="bucket").groupby(keyed.index % 2):
                z.writestr(f"rna/rna_{k}_DPT_{'all' if k else 'ALL'}.csv", part.to_csv(index=False))
        return pd.DataFrame({"content": [buffer.getvalue()]})

    return registry.to_associations(registry.archive_rows(lines.groupBy("bucket").applyInPandas(pack, "content binary"), "all")).select(*_REGISTRY_OUT)


@query("sites_des_associations", """SELECT id, CASE WHEN regexp_matches(s, '^[Hh][Tt][Tt][Pp][Ss]?://[^\\s/]+') THEN s WHEN regexp_full_match(s, '[^\\s/:@]+[.][A-Za-z]{2,}(/\\S*)?') THEN 'https://' || s END AS site FROM (SELECT id, trim(site_web, ' ') AS s FROM a)""")
def sites(spark, folder):
    return associations(spark, folder).select("id", places.site_address(F.trim("site_web")).alias("site"))


@query("vides_du_registre", "SELECT id, nullif(nullif(trim(date_dissolution, ' '), ''), '0001-01-01') AS dissolution, nullif(nullif(trim(sigle, ' '), ''), '0001-01-01') AS sigle FROM (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN '0001-01-01' WHEN id % 5 = 1 THEN ' ' ELSE date_dissolution END AS date_dissolution) FROM a)")
def p2(spark, folder):
    marked = F.when(F.col("id") % 5 == 0, "0001-01-01").when(F.col("id") % 5 == 1, " ").otherwise(F.col("date_dissolution"))
    return associations(spark, folder).select("id", places.clean_text(marked).alias("dissolution"), places.clean_text(F.col("sigle")).alias("sigle"))


@query("noms_de_libelles", "SELECT code_insee, nom FROM c")
def p5(spark, folder):
    """Municipalities' names from labels of town halls, written in several ways."""
    label = F.concat(F.when(F.length("nom") % 3 == 0, "Mairie - ").when(F.length("nom") % 3 == 1, "MAIRIE déléguée – ").otherwise(""), F.col("nom"))
    return communes(spark, folder).select("code_insee", places.name_from_label(label).alias("nom"))


@query("departements_couverts", """SELECT code_insee, departement, regexp_full_match(departement, '[0-9]{2}|[0-9][AB]|[0-9]{3}') AND departement NOT IN ('57', '67', '68') AS couvert,
coalesce(CASE WHEN regexp_full_match(code_insee, '(2[AB]|[0-9]{2})[0-9]{3}') THEN CASE WHEN code_insee[1:2] IN ('97', '98') THEN code_insee[1:3] ELSE code_insee[1:2] END END = upper(trim(departement)), false) AS dedans FROM c""")
def p8(spark, folder):
    return communes(spark, folder).select("code_insee", "departement", places.valid_departement(F.col("departement")).alias("couvert"), places.in_departement(F.col("code_insee"), F.col("departement")).alias("dedans"))


# --- services ------------------------------------------------------------------------------------------------------


def _service_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of JSON with an array 'service' each, the town halls of a bucket of municipalities, and things that are no object or no town hall."""
    hall = F.struct(
        F.concat(F.lit('Mairie - {"'), "nom").alias("nom"), F.array(F.struct(F.lit("").alias("libelle"), F.lit("néant").alias("valeur")), F.struct(F.lit("").alias("libelle"), F.col("url_mairie").alias("valeur"))).alias("site_internet"),
        F.array(F.struct(F.lit("Adresse").alias("type_adresse"), F.col("nom").alias("nom_commune"))).alias("adresse"), F.array(F.struct(F.lit("mairie").alias("type_service_local"), F.array(F.col("code_insee"), F.concat(F.col("code_insee"), F.lit(" "))).alias("code_insee_commune"))).alias("pivot"),
    )
    rows = communes(spark, folder).where("nom <> ''").select(F.pmod(F.hash("code_insee"), F.lit(32)).alias("bucket"), F.to_json(hall).alias("j"))
    other = '3, "x", {"nom": "Caf", "site_internet": [], "adresse": [], "pivot": [{"type_service_local": "caf", "code_insee_commune": ["00000"]}]}'
    return rows.groupBy("bucket").agg(F.concat(F.lit('{"avant": ["]"], "service": ['), F.array_join(F.collect_list("j"), ", "), F.lit(f", {other}]}}")).alias("texte"))


_HALLS = "SELECT code_insee, nom, CASE WHEN regexp_matches(trim(url_mairie), '^[Hh][Tt][Tt][Pp][Ss]?://[^\\s/]+') THEN trim(url_mairie) END AS url_mairie, CASE WHEN code_insee[1:2] IN ('97', '98') THEN code_insee[1:3] ELSE code_insee[1:2] END AS departement FROM c WHERE nom <> '' AND regexp_full_match(code_insee, '(2[AB]|[0-9]{2})[0-9]{3}')"


@query("s3_services", _HALLS)
def s3(spark, folder):
    """Town halls from texts of JSON, whose arrays are split into objects first."""
    return services.town_halls(services.split_services(_service_texts(spark, folder)))


@query("mairies_du_fichier", _HALLS)
def p4(spark, folder):
    """Town halls from files of JSON."""
    path = scratch(spark, "services")
    _service_texts(spark, folder).select("bucket", F.regexp_replace("texte", r"3, \"x\", ", "").alias("value")).write.partitionBy("bucket").text(path)
    return services.town_halls(services.read_services(spark, path))


@query("s5_dernier_export", "SELECT code_insee, max(strftime(CAST(updated_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d_%H%M%S') || '-data.gouv_local.json') AS fichier FROM association GROUP BY 1", clean=False)
def s5(spark, folder):
    """The newest dump of listings, one listing for each municipality."""
    at = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.to_timestamp("updated_at").cast("timestamp_ntz")), "yyyy-MM-dd_HHmmss")
    links = table(spark, folder, "association").select("code_insee", F.concat(F.lit('<li><a href="'), at, F.lit('-data.gouv_local.json">d</a> <a href="x.json">')).alias("l")).distinct()
    return links.groupBy("code_insee").agg(F.array_join(F.collect_list("l"), "\n").alias("t")).select("code_insee", services.newest_dump(F.col("t")).alias("fichier"))


@query("s10_reprises_de_lecture", """
, v AS (SELECT DISTINCT url_hash, campagne, content_hash AS e, fetched_at AS m, contacts_extraits AS t FROM p),
o AS (SELECT url_hash, length(url) AS lus, CASE WHEN length(url) % 4 = 0 THEN NULL ELSE 'x' END AS entete, content_hash AS e, fetched_at AS m, http_status AS t FROM p)
SELECT url_hash AS source, CASE WHEN entete IS NULL OR lus = 0 THEN 0 WHEN length(url_hash || campagne) % 3 = 0 THEN 0 WHEN e IS NULL OR m IS NULL OR t IS NULL THEN lus WHEN ascii(url_hash) % 2 = 0 THEN 0 ELSE lus END AS depart,
       CASE WHEN entete IS NULL OR lus = 0 THEN 'debut' WHEN length(url_hash || campagne) % 3 = 0 THEN 'redemarrage' WHEN e IS NULL OR m IS NULL OR t IS NULL THEN 'reprise' WHEN ascii(url_hash) % 2 = 0 THEN 'redemarrage' ELSE 'reprise' END AS suite
FROM o JOIN (SELECT url_hash, campagne FROM p) q USING (url_hash)""")
def s10(spark, folder):
    """Where a reading that was broken off goes on: fingerprints of pages stand for those of dumps; half of them have changed since."""
    own = pages(spark, folder)
    progress = own.select(F.col("url_hash").alias("source"), F.length("url").cast("long").alias("lus"), F.when(F.length("url") % 4 == 0, None).otherwise("x").alias("entete"), F.col("content_hash").alias("etag"), F.col("fetched_at").alias("modifie"), F.col("http_status").cast("long").alias("taille"))
    same = F.ascii("url_hash") % 2 != 0
    known = F.col("content_hash").isNotNull() & F.col("fetched_at").isNotNull() & F.col("http_status").isNotNull()
    changed = F.when(known & ~same, F.concat("content_hash", F.lit("'"))).otherwise(F.col("content_hash"))
    remote = own.select(F.col("url_hash").alias("source"), changed.alias("etag"), F.col("fetched_at").alias("modifie"), F.col("http_status").cast("long").alias("taille"), (F.length(F.concat("url_hash", "campagne")) % 3 != 0).alias("partiel"))
    return resume_points(progress, remote)


# --- bodies and HTML -----------------------------------------------------------------------------------------------


def cached(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_cache").where("texte is not null")


def _body(text: Column) -> Column:
    """A text as bytes, in one of three encodings."""
    turn = F.length(text) % 3
    utf16 = F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))
    return F.when(turn == 0, F.encode(text, "UTF-8")).when(turn == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).otherwise(utf16)


@query("s13_decodage", "SELECT cache_path, sha256(texte) AS empreinte FROM page_cache WHERE texte IS NOT NULL", clean=False)
def s13(spark, folder):
    """Texts that were encoded in several ways, read again as text; some headers name an encoding that the mark or the bytes belie."""
    header = F.when(F.length("texte") % 2 == 0, "text/html; charset=utf-8").otherwise("text/html")
    return cached(spark, folder).select("cache_path", F.sha2(fp.decode_page(_body(F.col("texte")), header), 256).alias("empreinte"))


@query("s14_html", "SELECT cache_path, content_type, content_type IS NULL OR lower(trim(string_split(content_type, ';')[1])) IN ('', 'text/html', 'application/xhtml+xml') AS lisible FROM page_cache", clean=False)
def s14(spark, folder):
    return table(spark, folder, "page_cache").select("cache_path", "content_type", fp.is_html(F.col("content_type")).alias("lisible"))


_ENTITIES = "texte"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("eacute", "é"), ("egrave", "è"), ("ecirc", "ê"), ("agrave", "à"), ("ccedil", "ç"), ("ocirc", "ô"), ("ugrave", "ù"), ("icirc", "î"), ("euml", "ë"), ("iuml", "ï"), ("acirc", "â"), ("amp", "&")):
    _ENTITIES = f"replace({_ENTITIES}, '&{_name};', '{_char}')"


@query("s16_entites", f"SELECT cache_path, sha256({_ENTITIES}) AS empreinte, length({_ENTITIES}) AS taille FROM page_cache WHERE texte IS NOT NULL", clean=False)
def s16(spark, folder):
    text = fp.decode_text(F.col("texte"))
    return cached(spark, folder).select("cache_path", text.alias("t")).select("cache_path", F.sha2("t", 256).alias("empreinte"), F.length("t").cast("long").alias("taille"))


# white space of any kind
_WS = "[\\s\\x{000B}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_BLANK = _WS.replace("\\s", "\\t\\r\\f ")


def sql_tidy(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '{_BLANK}+', ' ', 'g'), ' *\\n{_WS}*', chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


@query("f30_espaces", f"SELECT cache_path, sha256({sql_tidy('texte')}) AS empreinte FROM page_cache WHERE texte IS NOT NULL", clean=False)
def f30(spark, folder):
    return cached(spark, folder).select("cache_path", F.sha2(fp.tidy_text(F.col("texte")), 256).alias("empreinte"))


def _html(text: Column, url: Column) -> Column:
    """A page whose lines are paragraphs, with a link to itself, one to nowhere and one to another page of the site."""
    quoted = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.array_join(F.transform(F.split(quoted, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    return F.concat(F.lit("<head><title>non</title></head><script>non</script><body><a href='#x'></a><a href=''></a><div>"), lines, F.lit("</div><a href='/suite?b=2'></a><a href='"), url, F.lit("'></a>"))


@query("s15_pages", f"""SELECT cache_path, sha256(array_to_string(list_filter(list_transform(string_split(texte, chr(10)), lambda x: {sql_tidy('x')}), lambda x: x <> ''), chr(10))) AS empreinte,
len(list_filter(list_transform(string_split(texte, chr(10)), lambda x: {sql_tidy('x')}), lambda x: x <> '')) AS blocs, regexp_extract(url, '^[a-zA-Z]+://[^/]*') || '/suite?b=2' AS premier, 2 AS liens FROM page_cache WHERE texte IS NOT NULL""", clean=False)
def s15_pages(spark, folder):
    """Text, blocks and links of the cached texts as HTML."""
    docs = cached(spark, folder).select("cache_path", fp.parse_page(_html(F.col("texte"), F.col("url")), F.col("url")).alias("d"))
    return docs.select("cache_path", F.sha2("d.texte", 256).alias("empreinte"), F.size("d.blocs").alias("blocs"), F.element_at("d.liens", 1)["href"].alias("premier"), F.size("d.liens").alias("liens"))


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies with the size that was stated for them, which is wrong for some."""
    size = F.octet_length("texte") + F.when(F.length("texte") % 5 == 0, 1).otherwise(0)
    return cached(spark, folder).select("url", F.col("texte").alias("body"), size.alias("taille"), "fetched_at")


_BODIES = f"SELECT sha256({sql_url('url')}) AS cle, arg_max(sha256(texte), (CAST(fetched_at AS TIMESTAMPTZ), url)) AS corps, max(CAST(fetched_at AS TIMESTAMPTZ)) AS t FROM page_cache WHERE texte IS NOT NULL AND length(texte) % 5 <> 0 GROUP BY 1"


@query("s9_corps", f"SELECT cle, corps FROM ({_BODIES})", clean=False)
def s9(spark, folder):
    return store.keyed_bodies(_bodies(spark, folder)).select("cle", F.sha2("body", 256).alias("corps"))


@query("corps_frais", f"SELECT cle FROM ({_BODIES}) WHERE t + INTERVAL 90 DAY > TIMESTAMPTZ '{NOW}'", clean=False)
def p22(spark, folder):
    return store.fresh(store.keyed_bodies(_bodies(spark, folder)), NOW, 90 * 86_400_000).select("cle")


@query("d8_corps_gardes", f"SELECT cle FROM ({_BODIES}) WHERE t >= TIMESTAMPTZ '2025-09-01 00:00:00+00'", clean=False)
def d8(spark, folder):
    return store.prune(store.keyed_bodies(_bodies(spark, folder)), "2025-09-01T00:00:00.000Z").select("cle")


def _answer(domain: str) -> tuple[list[tuple[int, str]] | None, str | None]:
    """What a resolver that is given in place of a network says of a domain."""
    kind = len(domain) % 6
    if kind in (0, 1):
        return None, ("ENOTFOUND", "TIMEOUT")[kind]
    return {2: [(0, ".")], 3: []}.get(kind, [(20, "mx2." + domain), (10, "mx1." + domain)]), None


@query("s12_resolution", "SELECT DISTINCT domaine, CASE WHEN length(domaine) % 6 = 1 THEN NULL WHEN length(domaine) % 6 IN (0, 2, 3) THEN 0 ELSE 1 END::INT AS mx, CASE WHEN length(domaine) % 6 > 3 THEN 'mx1.' || domaine || ' mx2.' || domaine ELSE '' END AS hotes FROM domaine_mail WHERE domaine IS NOT NULL", clean=False)
def s12(spark, folder):
    """Verdicts of an outside resolver, each domain asked once; W17: hosts by priority."""
    return store.resolve_domains(table(spark, folder, "domaine_mail"), _answer).select("domaine", "mx", F.array_join("mx_hotes", " ").alias("hotes"))


# --- links and answers ---------------------------------------------------------------------------------------------


_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1))"
_NO_PAGE = "'(?i)[.](pdf|docx?|xlsx?|pptx?|od[ts]|rtf|csv|jpe?g|png|gif|webp|svg|ico|bmp|tiff?|zip|rar|7z|gz|tar|mp[34]|avi|mov|wmv|wav|ogg|css|js|json|xml|rss|atom|exe|dmg|apk)$'"


@query("liens_ecartes", f"""SELECT url_hash, v, regexp_matches(split_part(h, '.', -2), '^(facebook|fb|messenger|instagram|linkedin|twitter|tiktok|snapchat|pinterest|threads|youtube|youtu|whatsapp|telegram)$') OR h = 'x.com' OR suffix(h, '.x.com') AS social,
coalesce(regexp_replace(h, '^www[.]', '') = regexp_replace({_HOST.replace('url', 'url_source')}, '^www[.]', ''), false) AS meme_site, regexp_matches(split_part(regexp_replace(u, '[?#].*$', ''), '/', -1), '^.+' || {_NO_PAGE}) AS fichier
FROM (SELECT url_hash, v, url_source, CASE v WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^([a-z]+://)[^/]*', '\\1www.facebook.com') WHEN 2 THEN rtrim(split_part(url, '?', 1), '/') || '/plan.PDF' ELSE regexp_replace(url, '^([a-z]+://)', '\\1m.x.com/') END AS u,
      lower(regexp_extract(CASE v WHEN 1 THEN 'https://www.facebook.com/' WHEN 3 THEN 'https://m.x.com/' ELSE url END, '^[A-Za-z]+://([^/:?#]*)', 1)) AS h FROM p, (SELECT unnest([0, 1, 2, 3]) AS v))""")
def p16(spark, folder):
    """P14, P15, P16 over pages' addresses as they are and turned into addresses of networks and files."""
    u = F.col("url")
    variants = [u, F.regexp_replace(u, "(?i)^([a-z]+://)[^/]*", "$1www.facebook.com"), F.concat(F.regexp_replace(F.split_part(u, F.lit("?"), F.lit(1)), "/+$", ""), F.lit("/plan.PDF")), F.regexp_replace(u, "(?i)^([a-z]+://)", "$1m.x.com/")]
    rows = pages(spark, folder).select("url_hash", "url_source", F.posexplode(F.array(*variants)).alias("v", "u")).withColumn("h", fl.host(F.col("u")))
    return rows.select("url_hash", "v", fl.is_social(F.col("h")).alias("social"), F.coalesce(fl.same_site(F.col("h"), fl.host(F.col("url_source"))), F.lit(False)).alias("meme_site"), fl.is_no_page(F.col("u")).alias("fichier"))


@query("statuts_passagers", "SELECT url_hash, http_status IN (408, 429) OR http_status // 100 = 5 AS passager FROM p WHERE http_status IS NOT NULL")
def p18(spark, folder):
    return pages(spark, folder).where("http_status is not null").select("url_hash", times.is_transient(F.col("http_status")).alias("passager"))


@query("f20_jours_de_campagne", "SELECT url_hash, strftime(CAST(planifiee_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d') AS jour, strftime(CAST(planifiee_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM p")
def f20(spark, folder):
    """instants as a day and as ISO text, both in UTC."""
    at = F.to_timestamp("planifiee_at")
    return pages(spark, folder).select("url_hash", times.campaign_day(at).alias("jour"), times.iso_text(at).alias("iso"))


@query("f26_attentes", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN least(o_orderkey % 5000 * 1000, 3600000) WHEN o_orderkey % 4 = 1 THEN least(greatest(epoch_ms(CAST(o_orderdate AS TIMESTAMP)) - epoch_ms(TIMESTAMP '1995-01-01 00:00:00'), 0), 3600000) ELSE 60000 END AS attente_ms FROM orders""", clean=False)
def f26(spark, folder):
    """Waits that servers ask for, in seconds, as a date, or not at all."""
    day = F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT"))
    header = F.when(F.col("o_orderkey") % 4 == 0, (F.col("o_orderkey") % 5000).cast("string")).when(F.col("o_orderkey") % 4 == 1, day).when(F.col("o_orderkey") % 4 == 2, "bientôt")
    return table(spark, folder, "orders").select("o_orderkey", times.retry_after_ms(header, F.lit("1995-01-01T00:00:00.000Z")).alias("attente_ms"))


# --- contacts in texts ---------------------------------------------------------------------------------------------


_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}"


@query("f6_contacts_des_fiches", f"""SELECT fiche_id, m AS valeur, lower(m) AS valeur_normalisee FROM (SELECT DISTINCT fiche_id, unnest(regexp_extract_all('Voir ' || nom_affiche || ' <' || courriel || '>, ' || lower(courriel) || '.png', '{_MAIL}')) AS m FROM fiche_mairie WHERE courriel IS NOT NULL) WHERE NOT regexp_matches(m, '(?i)[.](png|jpe?g|gif|webp|svg|css|js)$')""", clean=False)
def f6(spark, folder):
    """addresses in running text; what names a file is none."""
    text = F.concat(F.lit("Voir "), "nom_affiche", F.lit(" <"), "courriel", F.lit(">, "), F.lower("courriel"), F.lit(".png"))
    read = F.filter(fc.contacts_in_text(text), lambda x: (x["kind"] == "email") & (x["methode"] == "texte:motif"))
    return table(spark, folder, "fiche_mairie").where("courriel is not null").select("fiche_id", F.explode(read).alias("x")).select("fiche_id", "x.valeur", "x.valeur_normalisee").distinct()


_BESIDE = f"""
, k AS (SELECT ct.id AS item, a.code_insee, 'Contact : ' || upper(a.nom) || ' - ' || ct.valeur AS texte FROM ct JOIN a ON a.id = ct.association_id WHERE a.code_insee IS NOT NULL),
n AS (SELECT code_insee, nom_cle, CASE WHEN min(id) = max(id) THEN min(id) END AS association_id FROM (SELECT code_insee, {_NAME.format('nom')} AS nom_cle, id FROM a WHERE date_dissolution IS NULL AND code_insee IS NOT NULL) WHERE length(nom_cle) >= 8 GROUP BY 1, 2)"""


def _named_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts beside the names of their associations, as a page would show them."""
    own = associations(spark, folder).where("code_insee is not null").select(F.col("id").alias("association_id"), "code_insee", "nom")
    rows = contacts(spark, folder).where("association_id is not null").select("id", "association_id", "valeur").join(own, "association_id")
    return rows.select(F.col("id").alias("item"), "code_insee", F.col("id").alias("ctx_id"), F.concat(F.lit("Contact : "), F.upper("nom"), F.lit(" - "), "valeur").alias("texte"))


@query("j11_contacts_nommes", _BESIDE + f"SELECT item, nom_cle, association_id FROM k JOIN n USING (code_insee) WHERE contains(' ' || {_NAME.format('texte')} || ' ', ' ' || nom_cle || ' ') QUALIFY row_number() OVER (PARTITION BY item ORDER BY length(nom_cle) DESC, nom_cle) = 1")
def j11(spark, folder):
    from regesta.operators import attach as oa

    return oa.attach(_named_contexts(spark, folder), oa.known_names(associations(spark, folder)))


@query("f15_noms_des_contacts", _BESIDE + f"SELECT item AS ctx_id, count(*) AS noms FROM k JOIN n USING (code_insee) WHERE contains(' ' || {_NAME.format('texte')} || ' ', ' ' || nom_cle || ' ') GROUP BY 1")
def f15(spark, folder):
    from regesta.operators import attach as oa

    return oa.named_in(_named_contexts(spark, folder), oa.known_names(associations(spark, folder))).groupBy("ctx_id").agg(F.count("*").alias("noms"))


@query("j14_contenus_communs", """, h AS (SELECT url_hash, domaine, lower(regexp_replace(trim(content_hash), '^[A-Za-z0-9-]+:', '')) AS e, CAST(fetched_at AS TIMESTAMPTZ) AS t FROM p WHERE content_hash IS NOT NULL)
SELECT domaine, url_hash, premiere FROM (SELECT *, first(url_hash) OVER (PARTITION BY domaine, e ORDER BY t NULLS FIRST, url_hash) AS premiere FROM h) WHERE premiere <> url_hash""")
def j14(spark, folder):
    """Pages of a host that show what another page of it showed before, in any campaign."""
    from regesta.functions.keys import digest, instant

    rows = pages(spark, folder).withColumns({"campagne": F.lit("toutes"), "code_insee": F.col("domaine"), "content_hash": digest(F.col("content_hash")), "fetched_at": instant(F.col("fetched_at"))})
    return op.duplicate_content(rows).select(F.col("code_insee").alias("domaine"), "url_hash", "premiere")


# --- sinks ---------------------------------------------------------------------------------------------------------


@query("k3_cellules", """SELECT id, CASE WHEN regexp_matches(s, '[";\\r\\n]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS cellule FROM (SELECT id, CASE WHEN regexp_matches(v, '^[=+@\\t\\r-]') THEN '''' || v ELSE v END AS s FROM (SELECT id, CASE id % 4 WHEN 0 THEN '=' || nom WHEN 1 THEN 'a;"' || nom WHEN 2 THEN chr(9) || nom ELSE nom END AS v FROM a))""")
def k3(spark, folder):
    turn = F.col("id") % 4
    value = F.when(turn == 0, F.concat(F.lit("="), "nom")).when(turn == 1, F.concat(F.lit('a;"'), "nom")).when(turn == 2, F.concat(F.lit("\t"), "nom")).otherwise(F.col("nom"))
    return associations(spark, folder).select("id", export.cell(value).alias("cellule"))


@query("k6_json", "SELECT code_insee, nom, url_mairie, departement FROM c")
def k6(spark, folder):
    """Municipalities as lines of JSON, written and read again."""
    path = scratch(spark, "json")
    export.as_json(communes(spark, folder).select("code_insee", "nom", "url_mairie", "departement")).write.text(path)
    return spark.read.schema("code_insee string, nom string, url_mairie string, departement string").json(path)


@query("k7_instantane", "SELECT domaine, mx, verifie_at FROM d")
def k7(spark, folder):
    """A snapshot that is written twice and is there once."""
    from regesta.plans.domain import domains

    path = scratch(spark, "snapshot")
    for _ in range(2):
        export.write_once(domains(spark, folder).select("domaine", "mx", "verifie_at"), path)
    return spark.read.parquet(path)
