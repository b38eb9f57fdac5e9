"""Scores of pages and contacts, with their reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_VERSION, CONTACT_VERSION = 1, 2
KEEP_FROM, FEW_CONTACTS, SHORT_TEXT, REFERENCE_LENGTH = 8.0, 2, 200, 1000


def half_up(x: Column) -> Column:
    """To the nearest whole number, halves up, in binary floating point."""
    return F.floor(x + 0.5)


def cents(x: Column) -> Column:
    return half_up(x * 100) / F.lit(100.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def page_score(length: Column, contacts: Column, names: Column, attached: Column, vocabulary: Column, keep_from: float = KEEP_FROM) -> Column:
    """Struct (score, verdict, motif, candidate) of a page.

    length: characters of its text; contacts: how many were read; names: known names in the text; attached: contacts beside a
    known name; vocabulary: the score of its address. A short page without contacts is empty whatever else it has.
    """
    density = contacts * 1000.0 / F.greatest(length, F.lit(REFERENCE_LENGTH))
    parts = {
        "liste": F.least(F.lit(12.0), attached * 4.0),
        "noms": F.least(F.lit(12.0), names * 3.0),
        "contacts": F.least(F.lit(6.0), contacts * 2.0) + F.least(F.lit(4.0), half_up(density * 2).cast("double")),
        "vocabulaire": clamp(vocabulary.cast("double"), -4.0, 4.0),
    }
    empty = (length < SHORT_TEXT) & (contacts == 0)
    whole = reduce(Column.__add__, parts.values())
    kept = ~empty & (whole >= keep_from)
    top = F.greatest(*parts.values())
    leading = reduce(lambda c, n: c.when(parts[n] == top, n), list(parts)[1:], F.when(parts["liste"] == top, "liste"))
    reason = F.when(empty, "vide").when(kept, leading).when(parts["vocabulaire"] < 0, "negatif").otherwise("insuffisant")
    return F.struct(
        F.when(empty, F.lit(0.0)).otherwise(cents(whole)).alias("score"), F.when(kept, "retenue").otherwise("ecartee").alias("verdict"), reason.alias("motif"),
        (kept & (contacts < FEW_CONTACTS)).alias("candidate"),
    )


def contact_score(kind: Column, confidence: Column, corrected: Column, well_formed: Column, mx: Column, office: Column, attached: Column, verdict: Column) -> Column:
    """Struct (score, base, signaux) of a contact: a base times the factors that apply, each named.

    mx: 1, 0 or null (unknown); office: 1, 0 or null; verdict of its page: 'retenue', 'ecartee' or null (not judged).
    """
    sure = F.when(F.isnan(confidence) | confidence.isNull(), F.lit(0.0)).otherwise(clamp(confidence, 0.0, 1.0))
    base = F.when(corrected, F.lit(0.95)).otherwise(sure)
    mail = kind == "email"
    steps = [
        ("mx", F.when(mail & (mx == 0), 0.3).when(mail & mx.isNull(), 0.9)),
        ("regime", F.when(mail & (office == 0), 0.8).when(mail & office.isNull(), 0.95)),
        ("rattachement", F.when(~attached, 0.85)),
        ("page", F.when(verdict == "ecartee", 0.9).when(verdict.isNull(), 0.95)),
    ]
    product = reduce(lambda p, s: p * F.coalesce(s[1], F.lit(1.0)), steps, base)
    note = F.struct(F.lit("revue").alias("signal"), F.lit(1.0).alias("facteur"))
    broken = F.array(F.struct(F.lit("syntaxe").alias("signal"), F.lit(0.0).alias("facteur")))
    factors = F.filter(F.array(*(F.struct(F.lit(n).alias("signal"), f.cast("double").alias("facteur")) for n, f in steps)), lambda s: s["facteur"].isNotNull())
    signals = F.concat(F.when(corrected, F.array(note)).otherwise(F.array().cast("array<struct<signal:string,facteur:double>>")), F.when(well_formed, factors).otherwise(broken))
    return F.struct(F.when(well_formed, cents(clamp(product, 0.0, 1.0))).otherwise(F.lit(0.0)).alias("score"), base.alias("base"), signals.alias("signaux"))


def regime(kind: Column, office: Column) -> Column:
    return F.when(kind != "email", "").when(office == 1, "generique").when(office == 0, "nominatif").otherwise("indetermine")


def share(part: Column, whole: Column) -> Column:
    """part of whole; null where there is nothing to have a part of."""
    return part / F.nullif(whole.cast("double"), F.lit(0.0))
