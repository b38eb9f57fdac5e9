"""Districts and municipalities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def departement_of(code: Column) -> Column:
    """The district of a municipality's code: three characters overseas, else two; null for a malformed code."""
    return F.when(code.rlike(r"^(2[AB]|\d{2})\d{3}$"), F.when(code.rlike("^9[78]"), F.substring(code, 1, 3)).otherwise(F.substring(code, 1, 2)))


def in_departement(code: Column, departement: Column) -> Column:
    return F.coalesce(departement_of(code) == F.upper(F.trim(departement)), F.lit(False))


def valid_departement(departement: Column) -> Column:
    """A well-formed district that the registry covers (three eastern districts keep registers of their own)."""
    return departement.rlike(r"^(\d{2}|\d[AB]|\d{3})$") & ~departement.isin("57", "67", "68")


def name_from_label(label: Column) -> Column:
    """A municipality's name from a town hall's label."""
    return F.regexp_replace(label, r"(?i)^mairie(\s+\S+)?\s*[-–]\s*", "")


def clean_text(value: Column) -> Column:
    """Trimmed; empty and the registry's date for 'none' give null."""
    return F.nullif(F.nullif(F.trim(value), F.lit("")), F.lit("0001-01-01"))


def site_address(value: Column) -> Column:
    """A web address; a bare host gets its scheme; anything else null."""
    v = F.trim(value)
    return F.when(v.rlike(r"^(?i)https?://[^\s/]+"), v).when(v.rlike(r"^[^\s/:@]+\.[A-Za-z]{2,}(/\S*)?$"), F.concat(F.lit("https://"), v))
