"""Contacts as they compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regesta.functions.keys import trimmed


def email_key(value: Column) -> Column:
    """An address as it compares: no mailto:, no query, no written-out signs, lower case, no white space."""
    v = F.lower(trimmed(value))
    v = F.regexp_replace(v, r"^mailto:", "")
    v = F.regexp_replace(v, r"\?.*$", "")
    v = F.regexp_replace(v, r"\s*[\[({]\s*(?:at|arobase|chez|@)\s*[\])}]\s*|\s+(?:at|arobase)\s+", "@")
    v = F.regexp_replace(v, r"\s*[\[({]\s*(?:dot|point|\.)\s*[\])}]\s*|\s+(?:dot|point)\s+", ".")
    v = F.regexp_replace(v, r"""^[\s<("']+|[\s>)"',.;]+$|\s+""", "")
    return F.when(F.length(v) > 0, v)


def phone_key(value: Column) -> Column:
    """A French number as +33 and nine digits, however written; another number as its digits."""
    v = F.regexp_replace(trimmed(value), r"\(0\)", "")
    digits = F.regexp_replace(v, r"[^0-9+]", "")
    national = F.regexp_replace(digits, r"^(?:\+33|0033|33(?=[1-9]\d{8}$))0?", "0")
    key = F.when(national.rlike(r"^0[1-9]\d{8}$"), F.concat(F.lit("+33"), F.substring(national, 2, 9))).otherwise(digits)
    return F.when(F.length(key) > 0, key)


def contact_key(kind: Column, value: Column) -> Column:
    return F.when(kind == "phone", phone_key(value)).otherwise(email_key(value))
