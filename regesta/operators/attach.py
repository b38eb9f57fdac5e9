"""Attaching contexts to the organisations they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regesta.functions.scoring import cents
from regesta.functions.text import normalise_name

LEAST_NAME = 8


def known_names(associations: DataFrame) -> DataFrame:
    """code_insee, nom_cle, association_id: the names (8 characters and more) of live associations; association_id is null where several bear the name."""
    live = associations.where("date_dissolution is null and code_insee is not null").select("code_insee", normalise_name(F.col("nom")).alias("nom_cle"), "id")
    one = live.where(F.length("nom_cle") >= LEAST_NAME).groupBy("code_insee", "nom_cle").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return one.select("code_insee", "nom_cle", F.when(F.col("first") == F.col("last"), F.col("first")).alias("association_id"))


def named_in(contexts: DataFrame, names: DataFrame) -> DataFrame:
    """contexts (code_insee, ctx_id, texte) with every known name that stands in them as whole words: code_insee, ctx_id, nom_cle, association_id.

    Not a join of all names of a municipality with all its texts: a name is found by its first two words (or its only one), which are
    looked up among the pairs of neighbouring words of the text; then the whole name is compared. A hot municipality costs what its texts have of matching starts.
    """
    spaced = F.concat(F.lit(" "), normalise_name(F.col("texte")), F.lit(" "))
    text = contexts.select("code_insee", "ctx_id", spaced.alias("t")).where("code_insee is not null")

    def starts(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
        return F.array_distinct(F.concat(w, pairs))

    # the words of a text are bound once: a lambda would split the text again for each of them
    singles = F.element_at(F.transform(F.array(F.split(F.trim("t"), " ")), starts), 1)
    found = text.select("code_insee", "ctx_id", "t", F.explode(singles).alias("debut"))
    keyed = names.withColumn("debut", F.when(F.col("nom_cle").contains(" "), F.array_join(F.slice(F.split("nom_cle", " "), 1, 2), " ")).otherwise(F.col("nom_cle")))
    met = found.join(keyed, ["code_insee", "debut"])
    return met.where(F.contains("t", F.concat(F.lit(" "), F.col("nom_cle"), F.lit(" ")))).select("code_insee", "ctx_id", "nom_cle", "association_id").distinct()


def attach(contexts: DataFrame, names: DataFrame) -> DataFrame:
    """For each item the name that it stands beside: item, nom_cle, association_id (null: borne by several).

    contexts: item, code_insee, ctx_id, texte. The shortest context that names anything decides, the longest name in it, then the lesser name.
    """
    hits = named_in(contexts.select("code_insee", "ctx_id", "texte"), names)
    size = contexts.select("item", "code_insee", "ctx_id", F.length("texte").alias("taille"))
    best = size.join(hits, ["code_insee", "ctx_id"]).groupBy("item").agg(F.min(F.struct("taille", "ctx_id", (-F.length("nom_cle")).alias("l"), "nom_cle", "association_id")).alias("b"))
    return best.select("item", "b.nom_cle", "b.association_id")


def attach_contacts(contacts: DataFrame, names: DataFrame) -> DataFrame:
    """Contacts of pages (page, code_insee, kind, valeur_normalisee, methode, confiance, contextes) with the association they belong to, if any.

    A contact whose contexts name exactly one living association of its municipality is attached: its method says so and its
    confidence is nine tenths, to the cent. Any other stays with the municipality. rattachable: a context names something at all.
    """
    item = F.concat_ws("|", "page", "kind", "valeur_normalisee")
    keyed = contacts.withColumn("item", item)
    contexts = keyed.select("item", "code_insee", F.posexplode("contextes").alias("i", "texte")).select("item", "code_insee", F.concat_ws("|", "item", F.col("i").cast("string")).alias("ctx_id"), "texte")
    found = keyed.join(attach(contexts, names), "item", "left")
    own = F.col("association_id").isNotNull()
    return found.select(
        *(c for c in contacts.columns if c not in ("methode", "confiance")), "association_id", F.col("nom_cle").isNotNull().alias("rattachable"), F.when(own, F.concat("methode", F.lit("+nom"))).otherwise(F.col("methode")).alias("methode"),
        F.when(own, cents(F.col("confiance") * 0.9)).otherwise(F.col("confiance")).alias("confiance"),
    )
