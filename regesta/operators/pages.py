"""Pages: links, budget, frontier, duplicate content, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regesta.functions.contacts import (
    DECLARED, EMAIL_IN_TEXT, PHONE_IN_TEXT, REBUILT, SEEN, WRITTEN_OUT_EMAIL, clean_email, contacts_in_text, international_phone, is_mobile, office_or_person,
)
from regesta.functions.keys import canonical_url
from regesta.functions.links import BEST_LINKS, MAX_DEPTH, crawl_priority, host, is_no_page, is_social, link_score, same_site
from regesta.functions.scoring import PAGE_VERSION, page_score


def best_links(links: DataFrame, n: int = BEST_LINKS) -> DataFrame:
    """Per page the n best links: page, url (canonical), ancre, score, rang.

    links: page, href, ancre, pos. Links elsewhere, to social networks, to files and to the page itself fall out, and so do those that promise
    nothing. An address counts once, with its best score, the first of equals. Order: score, the shorter address, the address.
    """
    # addresses are read once per link; what follows works on their parts
    read = links.select("page", "ancre", "pos", "href", canonical_url(F.col("href")).alias("c"), canonical_url(F.col("page")).alias("base"))
    parts = read.select("*", host(F.col("c")).alias("h"), host(F.col("base")).alias("here"))
    usable = parts.where(F.col("c").rlike("^https?://") & ~is_social(F.col("h")) & same_site(F.col("h"), F.col("here")) & ~is_no_page(F.col("c")))
    # the host of the page stands for its twin with or without www.
    aligned = F.concat(F.regexp_extract("c", r"^([a-z]+://)", 1), F.col("here"), F.regexp_replace("c", r"^[a-z]+://[^/:]*", ""))
    scored = usable.select("page", "ancre", "pos", aligned.alias("url"), "base", "href").where("url <> base").select("page", "ancre", "pos", "url", link_score(F.col("href"), F.col("ancre")).alias("score")).where("score > 0")
    once = scored.groupBy("page", "url").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "ancre")).alias("b"))
    w = Window.partitionBy("page").orderBy("s", F.length("url"), "url")
    return once.select("page", "url", F.col("b.ancre").alias("ancre"), F.col("b.s").alias("s")).withColumn("rang", F.row_number().over(w)).where(F.col("rang") <= n).select("page", "url", "ancre", (-F.col("s")).cast("int").alias("score"), "rang")


def within_budget(pages: DataFrame, per_commune: int) -> DataFrame:
    """The pages of a municipality and campaign that its budget reaches, by depth, priority and address: rang is their place."""
    w = Window.partitionBy("campagne", "code_insee").orderBy("profondeur", "priorite", "url", "url_hash")
    ranked = pages.withColumn("priorite", crawl_priority(F.col("profondeur"), F.col("prefiltre_score"))).withColumn("rang", F.row_number().over(w))
    return ranked.where(F.col("rang") <= per_commune)


def frontier(roots: DataFrame, links: DataFrame, per_root: int, depth: int = MAX_DEPTH) -> DataFrame:
    """root, url, profondeur: what is reached from roots (root, url) over links (source, url, score) in `depth` steps.

    One join per step; an address keeps its least depth, and each root has per_root pages, shallow and promising ones first.
    """
    seen = roots.select("root", "url").withColumn("profondeur", F.lit(0)).withColumn("score", F.lit(0))
    level = seen
    for d in range(1, depth + 1):
        step = level.select("root", F.col("url").alias("source")).join(links, "source").groupBy("root", "url").agg(F.max("score").alias("score"))
        level = step.join(seen.select("root", "url"), ["root", "url"], "left_anti").withColumn("profondeur", F.lit(d)).select("root", "url", "profondeur", "score")
        seen = seen.unionByName(level)
    w = Window.partitionBy("root").orderBy("profondeur", F.desc("score"), "url")
    return seen.withColumn("rang", F.row_number().over(w)).where(F.col("rang") <= per_root)


def duplicate_content(pages: DataFrame) -> DataFrame:
    """Pages whose content another page of the municipality and campaign showed before: url_hash and the first page's."""
    w = Window.partitionBy("campagne", "code_insee", "content_hash").orderBy("fetched_at", "url_hash")
    known = pages.where("content_hash is not null and code_insee is not null")
    return known.withColumn("premiere", F.first("url_hash").over(w)).where("premiere <> url_hash").select("campagne", "code_insee", "url_hash", "premiere")


def read_texts(texts: DataFrame) -> DataFrame:
    """cache_path, lignes (of a text) and the contacts of each line, with their place; one row for a line with a contact."""
    lines = texts.select("cache_path", F.posexplode(F.split("texte", "\n")).alias("pos", "ligne"))
    return lines.withColumn("contact", F.explode(contacts_in_text(F.col("ligne")))).select("cache_path", "pos", "ligne", "contact.*")


def judge_pages(facts: DataFrame) -> DataFrame:
    """Verdicts of pages. facts: url, longueur, contacts, noms, rattaches. Nothing is dropped: a verdict only advises."""
    vocabulary = link_score(F.col("url"), F.lit(""))
    score = page_score(F.col("longueur"), F.col("contacts"), F.col("noms"), F.col("rattaches"), vocabulary)
    return facts.withColumn("j", score).select(*facts.columns, "j.score", "j.verdict", "j.motif", "j.candidate", F.lit(PAGE_VERSION).alias("prefiltre_version"))


def page_contacts(docs: DataFrame, *, mobiles: bool = False) -> DataFrame:
    """The contacts of parsed pages: page, code_insee, kind, valeur, valeur_normalisee, is_generique, methode, confiance, contextes.

    docs: page, code_insee, doc (see functions.pages). What the page declares (mailto, tel) is surest, then what stands in its text, then
    what is put together from words. A contact comes once per page, by its surest reading, of equals the one with more contexts, then the
    first. Contexts are the blocks that hold it, from the shortest. Mobile numbers are left out unless wanted (see excluded_mobiles).
    """
    read = _readings(docs)
    read = read if mobiles else read.where(~((F.col("kind") == "phone") & is_mobile(F.col("valeur_normalisee"))))
    blocks = F.col("doc.blocs")
    holding = F.filter(blocks, lambda b: F.contains(b["texte"], F.col("trace")) | F.exists(b["liens"], lambda x: x["href"] == F.col("trace")))
    sized = F.transform(F.array_sort(F.transform(holding, lambda b, i: F.struct(F.length(b["texte"]).alias("n"), i.alias("i"), b["texte"].alias("texte")))), lambda s: s["texte"])
    framed = read.withColumn("contextes", sized)
    best = F.min(F.struct((-F.col("confiance")).alias("c"), (-F.size("contextes")).alias("k"), "pos", "valeur", "is_generique", "methode", "confiance", "contextes"))
    once = framed.groupBy("page", "code_insee", "kind", "valeur_normalisee").agg(best.alias("b"))
    return once.select("page", "code_insee", "kind", "b.valeur", "valeur_normalisee", "b.is_generique", "b.methode", "b.confiance", "b.contextes")


def excluded_mobiles(docs: DataFrame) -> DataFrame:
    """page, mobiles: readings of mobile numbers, which the contacts leave out."""
    return _readings(docs).where((F.col("kind") == "phone") & is_mobile(F.col("valeur_normalisee"))).groupBy("page").agg(F.count("*").alias("mobiles"))


def _readings(docs: DataFrame) -> DataFrame:
    def scheme(name: str) -> Column:
        return F.filter("doc.liens", lambda x: F.lower(x["href"]).startswith(name))

    def target(x: Column, name: str) -> Column:
        rest = F.substr(x["href"], F.lit(len(name) + 1))
        return F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest)

    def reading(kind: str, raw: Column, trace: Column, method: str, sure: float) -> Column:
        return F.struct(F.lit(kind).alias("kind"), raw.alias("raw"), trace.alias("trace"), F.lit(method).alias("methode"), F.lit(sure).alias("confiance"))

    mails = F.flatten(F.transform(scheme("mailto:"), lambda x: F.transform(F.split(F.split_part(target(x, "mailto:"), F.lit("?"), F.lit(1)), ","), lambda part: reading("email", part, x["href"], "dom:mailto", DECLARED))))
    tels = F.transform(scheme("tel:"), lambda x: reading("phone", target(x, "tel:"), x["href"], "dom:tel", DECLARED))
    text = F.col("doc.texte")

    def in_text(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: reading(kind, m, m, "texte:motif", SEEN))

    seen = [in_text("email", EMAIL_IN_TEXT), in_text("phone", PHONE_IN_TEXT)]
    rebuilt = F.transform(F.regexp_extract_all(text, F.lit(WRITTEN_OUT_EMAIL), F.lit(0)), lambda m: reading("email", F.regexp_replace(m, "^" + WRITTEN_OUT_EMAIL + "$", "$1@$2.$3"), m, "texte:obfusque", REBUILT))
    rows = docs.select("page", "code_insee", "doc", F.posexplode(F.concat(mails, tels, *seen, rebuilt)).alias("pos", "x")).select("page", "code_insee", "doc", "pos", "x.*")
    mail = F.col("kind") == "email"
    norm = F.when(mail, F.lower(clean_email(F.col("raw")))).otherwise(international_phone(F.col("raw")))
    cleaned = rows.select("*", F.when(mail, clean_email(F.col("raw"))).otherwise(F.trim("raw")).alias("valeur"), norm.alias("valeur_normalisee")).where("valeur_normalisee is not null")
    return cleaned.withColumn("is_generique", F.when(mail, office_or_person(F.col("valeur"))))
