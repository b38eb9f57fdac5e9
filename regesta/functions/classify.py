"""The type of an association by its name or its purpose code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regesta.functions.text import normalise_name

# Families of purpose codes and their types.
FAMILIES = {
    "011": "sportive",
    "005": "culturelle", "006": "culturelle", "010": "culturelle",
    "003": "sociale", "009": "sociale", "017": "sociale", "018": "sociale", "019": "sociale", "020": "sociale", "021": "sociale", "030": "sociale", "036": "sociale", "038": "sociale",
}
# Names that tell the type, in the order in which they are tried.
NAMES = (
    ("comite des fetes", "comite_des_fetes", "nom:comite_des_fetes"),
    ("comite de fetes", "comite_des_fetes", "nom:comite_des_fetes"),
    ("comite danimation", "comite_des_fetes", "nom:comite_danimation"),
    ("comite d animation", "comite_des_fetes", "nom:comite_danimation"),
    ("centre de loisirs", "centre_de_loisirs", "nom:centre_de_loisirs"),
    ("accueil de loisirs", "centre_de_loisirs", "nom:accueil_de_loisirs"),
    ("centre aere", "centre_de_loisirs", "nom:centre_aere"),
    ("alsh", "centre_de_loisirs", "nom:alsh"),
)


def purpose_family(code: Column) -> Column:
    """The first three of six digits; a shorter code lost its leading zeros."""
    c = F.trim(code)
    return F.when(c.rlike(r"^\d+$"), F.substring(F.when(F.length(c) < 6, F.lpad(c, 6, "0")).otherwise(c), 1, 3))


def association_type(code: Column, name: Column) -> Column:
    """Struct (type, source): a telling name wins, then the code's family, then 'diverses'."""
    spaced = F.concat(F.lit(" "), normalise_name(name), F.lit(" "))
    family = purpose_family(code)
    kind = source = None
    for words, t, s in NAMES:
        hit = spaced.contains(f" {words} ")
        kind = F.when(hit, t) if kind is None else kind.when(hit, t)
        source = F.when(hit, s) if source is None else source.when(hit, s)
    table = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    kind = kind.otherwise(F.coalesce(F.try_element_at(table, family), F.lit("diverses")))
    source = source.otherwise(F.coalesce(F.concat(F.lit("rna:"), family), F.lit("defaut")))
    return F.struct(kind.alias("type"), source.alias("source"))
