"""Contacts: duplicates, scores, review, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regesta.functions.contacts import clean_email, contact_fault, international_phone, is_mobile, mail_domain, office_or_person
from regesta.functions.keys import canonical_url, instant
from regesta.functions.scoring import CONTACT_VERSION, contact_score, regime
from regesta.session import materialise
from regesta.sources.export import EXPORT_COLUMNS


def drop_shadowed(contacts: DataFrame) -> DataFrame:
    """Without the contacts of a municipality that an association of it has as well. Run again, it changes nothing."""
    key = ["code_insee", "kind", "valeur_normalisee"]
    attached = contacts.where("association_id is not null").select(*key).distinct()
    loose = contacts.where("association_id is null").join(attached, key, "left_anti")
    return contacts.where("association_id is not null").unionByName(loose.select(contacts.columns))


def latest_verdicts(pages: DataFrame) -> DataFrame:
    """url (canonical), code_insee, verdict of the page's row of the last campaign, even where that row has none."""
    row = F.max(F.struct("campagne", instant(F.col("fetched_at")).alias("f"), "prefiltre_verdict"))
    return pages.where("code_insee is not null").groupBy(canonical_url(F.col("url")).alias("url"), "code_insee").agg(row["prefiltre_verdict"].alias("verdict"))


def score_contacts(contacts: DataFrame, pages: DataFrame, domains: DataFrame) -> DataFrame:
    """id and the score of every contact, with the factors that made it.

    The page's last verdict comes by a shuffle join on canonical address and municipality, the mail verdict by domain (the part after the last @).
    """
    verdicts = latest_verdicts(pages).select(F.col("url").alias("_page"), "code_insee", "verdict")
    mx = domains.groupBy(F.lower("domaine").alias("d")).agg(F.max(F.struct("verifie_at", "mx"))["mx"].alias("mx"))
    value = F.coalesce("valeur_corrigee", "valeur_normalisee")
    rows = contacts.withColumn("v", value).withColumn("_page", canonical_url(F.col("source_url"))).withColumn("d", F.when(F.col("kind") == "email", mail_domain(F.col("v")))).join(verdicts, ["_page", "code_insee"], "left").join(mx, "d", "left")
    fault = contact_fault(F.col("kind"), F.col("v"))
    score = contact_score(F.col("kind"), F.col("confiance"), F.col("valeur_corrigee").isNotNull(), fault.isNull(), F.col("mx"), F.col("is_generique"), F.col("association_id").isNotNull(), F.col("verdict"))
    return rows.select("id", "kind", fault.alias("faute"), score.alias("s")).select("id", "kind", "faute", "s.score", "s.base", F.array_join(F.transform("s.signaux", lambda x: x["signal"]), ",").alias("signaux"), F.lit(CONTACT_VERSION).alias("score_version"))


def to_rescore(contacts: DataFrame, everything: bool = False) -> DataFrame:
    """The contacts whose score is missing or of another version."""
    return contacts if everything else contacts.where(F.col("score_version").isNull() | (F.col("score_version") != CONTACT_VERSION))


def read_correction(kind: Column, text: Column) -> Column:
    """Struct (valeur, normalisee, refus) of what a reviewer typed, read like any other contact; mobiles are refused."""
    mail, phone = clean_email(text), international_phone(text)
    norm = F.when(kind == "email", F.lower(mail)).otherwise(phone)
    refused = F.when(norm.isNull(), "illisible").when((kind == "phone") & is_mobile(phone), "mobile").when(contact_fault(kind, norm).isNotNull(), "invalide")
    return F.struct(F.when(kind == "email", mail).otherwise(F.trim(text)).alias("valeur"), norm.alias("normalisee"), refused.alias("refus"))


def apply_reviews(contacts: DataFrame, actions: DataFrame) -> DataFrame:
    """Contacts after review: id, review_statut, valeur, valeur_corrigee, valeur_normalisee, is_generique, score_version, refus.

    actions: id, seq, action ('valide', 'rejete', 'corrige'), saisie; the last of an id counts. A correction that cannot be read, changes nothing
    or meets another contact of the same holder is refused and says why; 'valeur' is never rewritten, and a correction opens the score again.
    """
    last = actions.groupBy("id").agg(F.max(F.struct("seq", "action", "saisie")).alias("a"))
    rows = contacts.join(last, "id", "left").withColumn("c", read_correction(F.col("kind"), F.col("a.saisie")))
    holder = F.coalesce(F.concat(F.lit("a"), F.col("association_id").cast("string")), F.concat(F.lit("c"), F.col("code_insee")))
    taken = contacts.select(holder.alias("h"), F.col("kind").alias("k"), F.col("valeur_normalisee").alias("n"), F.col("id").alias("other")).groupBy("h", "k", "n").agg(F.min("other").alias("other"))
    corrected = F.col("a.action") == "corrige"
    rows = rows.withColumn("h", holder).join(taken.withColumnRenamed("h", "th"), (F.col("h") == F.col("th")) & (F.col("kind") == F.col("k")) & (F.col("c.normalisee") == F.col("n")) & corrected, "left")
    refusal = F.when(corrected, F.coalesce(F.col("c.refus"), F.when(F.col("c.normalisee") == F.col("valeur_normalisee"), "identique"), F.when(F.col("other").isNotNull() & (F.col("other") != F.col("id")), "doublon")))
    done = F.coalesce(corrected & refusal.isNull(), F.lit(False))
    status = F.when(F.col("a.action").isNull() | refusal.isNotNull(), F.col("review_statut")).otherwise(F.col("a.action"))
    return rows.select(
        "id", status.alias("review_statut"), "valeur", F.when(done, F.col("c.valeur")).otherwise(F.col("valeur_corrigee")).alias("valeur_corrigee"),
        F.when(done, F.col("c.normalisee")).otherwise(F.col("valeur_normalisee")).alias("valeur_normalisee"),
        F.when(done & (F.col("kind") == "email"), office_or_person(F.col("c.valeur"))).otherwise(F.col("is_generique")).alias("is_generique"),
        F.when(~done, F.col("score_version")).alias("score_version"), refusal.alias("refus"),
    )


def retained(df: DataFrame, at: Column, cutoff: str) -> DataFrame:
    """Rows not older than the cutoff (both ISO texts, compared as instants); without a date they stay."""
    return df.where(at.isNull() | (instant(at) >= instant(F.lit(cutoff))))


def purged(tables: dict[str, tuple[DataFrame, Column]], cutoff: str) -> DataFrame:
    """nom_table, supprimees: how many rows of each table (with the column of their date) are older than the cutoff and go; see retained for those that stay."""
    parts = [df.agg(F.count_if(instant(at) < instant(F.lit(cutoff))).alias("supprimees")).select(F.lit(name).alias("nom_table"), "supprimees") for name, (df, at) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows: a report of that length."""
    return df.orderBy(*order).limit(n)


def export_lines(contacts: DataFrame, associations: DataFrame, communes: DataFrame, *, least_score: float | None = None, rejected: bool = False) -> DataFrame:
    """The rows of the public file, by municipality, association, kind and value, each with its place in its district's file (rang).

    The whole is sorted by range, so a district with most of the rows is many tasks; a row's place is its place in its range and what the ranges before it
    hold of its district.
    """
    kept = contacts if rejected else contacts.where("review_statut <> 'rejete'")
    if least_score is not None:
        kept = kept.where(F.col("score") >= least_score)
    names = associations.select(F.col("id").alias("association_id"), "rna_id", F.col("nom").alias("association"), "type")
    rows = kept.join(communes.select("code_insee", F.col("nom").alias("commune"), "departement"), "code_insee").join(names, "association_id", "left")
    two = {c: F.format_string("%.2f", c).alias(c) for c in ("score", "confiance")}
    made = {"valeur_publiable": F.coalesce("valeur_corrigee", "valeur").alias("valeur_publiable"), "regime": regime(F.col("kind"), F.col("is_generique")).alias("regime"), **two}
    order = [F.col("departement"), F.col("commune").asc_nulls_first(), F.col("association").asc_nulls_first(), F.col("kind"), F.col("valeur"), F.col("id")]
    lines = materialise(rows.select("departement", "id", *(made.get(c, F.col(c)) for c in EXPORT_COLUMNS)).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "export")
    w = Window.partitionBy("_range", "departement").orderBy(*order)
    sizes = lines.groupBy("departement", "_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy("departement").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = lines.withColumn("_at", F.row_number().over(w)).join(before.select("departement", "_range", "_before"), ["departement", "_range"])
    return placed.withColumn("rang", (F.col("_before") + F.col("_at")).cast("int")).select("departement", "rang", "id", *EXPORT_COLUMNS)
