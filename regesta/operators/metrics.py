"""Measures of a directory, per district."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regesta.functions.contacts import email_fault, mail_domain
from regesta.functions.scoring import FEW_CONTACTS, share


def coverage(associations: DataFrame, communes: DataFrame, contacts: DataFrame, domains: DataFrame, *, rejected: bool = False) -> DataFrame:
    """Per district: live associations, those with an e-mail address, with a usable one, with one whose domain takes mail.

    E-mail facts are folded per association first, so contacts never multiply the associations and nothing counts distinct rows.
    The domain is what follows the first @.
    """
    mail = contacts.where("kind = 'email' and association_id is not null")
    mail = mail if rejected else mail.where("review_statut <> 'rejete'")
    domain = F.when(F.col("valeur_normalisee").contains("@"), F.regexp_replace("valeur_normalisee", "^[^@]*@", "")).otherwise(F.col("valeur_normalisee"))
    usable = F.coalesce("score", F.lit(1.0)) > 0
    mx = domains.select(F.col("domaine").alias("d"), "mx")
    facts = mail.withColumn("d", domain).join(mx, "d", "left").groupBy(F.col("association_id").alias("id")).agg(F.max(usable.cast("int")).alias("u"), F.max((usable & F.coalesce(F.col("mx") == 1, F.lit(False))).cast("int")).alias("j"), F.lit(1).alias("e"))
    live = associations.where("date_dissolution is null").select("id", "code_insee").join(communes.select("code_insee", "departement"), "code_insee")
    return live.join(facts, "id", "left").groupBy("departement").agg(F.count("*").alias("actives"), F.count_if(F.col("e") == 1).alias("avec_email"), F.count_if(F.col("u") == 1).alias("avec_email_exploitable"), F.count_if(F.col("j") == 1).alias("avec_email_joignable"))


def coverage_rates(counts: DataFrame) -> DataFrame:
    return counts.select("*", share(F.col("avec_email"), F.col("actives")).alias("taux_email"), share(F.col("avec_email_joignable"), F.col("actives")).alias("taux_joignable"))


def dormancy(associations: DataFrame, communes: DataFrame, since: str) -> DataFrame:
    """Per district: live associations, those that declared anything since that day, those without a date, the rest dormant."""
    live = associations.where("date_dissolution is null").join(communes.select("code_insee", "departement"), "code_insee")
    counts = live.groupBy("departement").agg(F.count("*").alias("actives"), F.count_if(F.col("date_declaration") >= since).alias("non_dormantes"), F.count_if(F.col("date_declaration").isNull()).alias("sans_date"))
    return counts.withColumn("dormantes", F.col("actives") - F.col("non_dormantes") - F.col("sans_date"))


def declarations_by_year(associations: DataFrame, communes: DataFrame) -> DataFrame:
    live = associations.where("date_dissolution is null and date_declaration is not null").join(communes.select("code_insee", "departement"), "code_insee")
    return live.groupBy("departement", F.substring("date_declaration", 1, 4).alias("annee")).agg(F.count("*").alias("associations"))


def page_verdicts(pages: DataFrame, communes: DataFrame) -> DataFrame:
    """Per district and campaign: visited pages, judged, kept, dropped, and kept ones that gave few contacts."""
    seen = pages.where("statut = 'visitee'").join(communes.select("code_insee", "departement"), "code_insee")
    kept = F.coalesce(F.col("prefiltre_verdict") == "retenue", F.lit(False))
    return seen.groupBy("departement", "campagne").agg(
        F.count("*").alias("total"), F.count("prefiltre_verdict").alias("jugees"), F.count_if(kept).alias("retenues"), F.count_if(F.col("prefiltre_verdict") == "ecartee").alias("ecartees"),
        F.count_if(kept & (F.coalesce("contacts_extraits", F.lit(0)) < FEW_CONTACTS)).alias("candidates"),
    )


def histogram(df: DataFrame, by: list[str], value: Column, name: str, width: int = 1) -> DataFrame:
    """Rows per bin of a width; a bin is named by its bound nearer to zero."""
    return df.where(value.isNotNull()).groupBy(*by, ((value / width).cast("int") * width).alias("borne")).agg(F.count("*").alias(name))


def mail_verdicts(contacts: DataFrame, communes: DataFrame, domains: DataFrame) -> DataFrame:
    """Per district: e-mail contacts whose domain takes mail, takes none, or is not known to do either."""
    mail = contacts.where((F.col("kind") == "email") & (F.coalesce("score", F.lit(1.0)) > 0)).join(communes.select("code_insee", "departement"), "code_insee")
    found = mail.withColumn("d", F.regexp_replace("valeur_normalisee", "^[^@]*@", "")).join(domains.select(F.col("domaine").alias("d"), "mx"), "d", "left")
    return found.groupBy("departement").agg(F.count_if(F.col("mx") == 1).alias("avec_mx"), F.count_if(F.col("mx") == 0).alias("sans_mx"), F.count_if(F.col("mx").isNull()).alias("mx_inconnu"))


def domains_to_verify(contacts: DataFrame, domains: DataFrame, now: Column) -> DataFrame:
    """Different domains of well-formed addresses that have no fresh verdict; an unknown verdict is never fresh."""
    from regesta.functions.times import is_fresh

    wanted = contacts.where((F.col("kind") == "email") & email_fault(F.col("valeur_normalisee")).isNull()).select(mail_domain(F.col("valeur_normalisee")).alias("domaine")).where("domaine is not null").distinct()
    fresh = domains.where(F.col("mx").isNotNull() & is_fresh(F.col("verifie_at"), now)).select("domaine")
    return wanted.join(fresh, "domaine", "left_anti")


def review_counts(contacts: DataFrame, communes: DataFrame, version: int) -> DataFrame:
    """Per district: contacts per state of review, those without a score, corrections to score again, and the rate of corrections."""
    rows = contacts.join(communes.select("code_insee", "departement"), "code_insee")
    states = [F.count_if(F.col("review_statut") == s).alias(s) for s in ("a_revoir", "valide", "rejete", "corrige")]
    counted = rows.groupBy("departement").agg(*states, F.count_if(F.col("score").isNull()).alias("non_notes"), F.count_if((F.col("review_statut") == "corrige") & ~F.col("score_version").eqNullSafe(F.lit(version))).alias("corrections_a_noter"))
    settled = F.col("valide") + F.col("rejete") + F.col("corrige")
    return counted.withColumn("arbitres", settled).withColumn("taux_correction", share(F.col("corrige"), settled))


def default_district(asked: DataFrame, runs: DataFrame, communes: DataFrame, fallback: str) -> DataFrame:
    """asked (demande, ...) with the district that is shown (affiche): the one asked for, else that of the last run (campagne, departement), else the first known, else the fallback."""
    last = runs.agg(F.max(F.struct("campagne", "departement"))["departement"].alias("_last"))
    first = communes.agg(F.min("departement").alias("_first"))
    known = F.broadcast(last.join(first))  # a row each
    return asked.join(known).withColumn("affiche", F.coalesce(F.nullif("demande", F.lit("")), "_last", "_first", F.lit(fallback))).drop("_last", "_first")


def normalisation_counts(associations: DataFrame, contacts: DataFrame, communes: DataFrame) -> DataFrame:
    """Per district: living associations, contacts, those with a score, and those found invalid."""
    place = communes.select("code_insee", "departement")
    live = associations.where("date_dissolution is null").join(place, "code_insee").groupBy("departement").agg(F.count("*").alias("associations"))
    counted = contacts.join(place, "code_insee").groupBy("departement").agg(F.count("*").alias("contacts"), F.count("score").alias("notes"), F.count_if(F.col("score") == 0).alias("invalides"))
    return communes.select("departement").distinct().join(live, "departement", "left").join(counted, "departement", "left").fillna(0, ["associations", "contacts", "notes", "invalides"])


def counters(deltas: DataFrame) -> DataFrame:
    """etape, nom, valeur: sums of counted events."""
    return deltas.groupBy("etape", "nom").agg(F.sum("valeur").alias("valeur"))


def counters_json(sums: DataFrame) -> DataFrame:
    """One JSON object per stage, names in order."""
    entries = F.sort_array(F.collect_list(F.struct("nom", "valeur")))
    return sums.groupBy("etape").agg(F.to_json(F.map_from_entries(entries)).alias("compteurs"))
