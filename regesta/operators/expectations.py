"""What must hold for rows of each table; broken rules are counted in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states that rows may be in, and the bounds of their numbers.
RULES: dict[str, dict[str, Column | str]] = {
    "contact": {
        "provenance": "source_url is not null and methode_extraction is not null and collected_at is not null and confiance is not null",
        "confiance": "confiance between 0 and 1",
        "score": "score is null or score between 0 and 1",
        "rattachement": "association_id is not null or code_insee is not null",
        "kind": "kind in ('email', 'phone')",
        "generique": "is_generique is null or is_generique in (0, 1)",
        "statut": "review_statut in ('a_revoir', 'valide', 'rejete', 'corrige')",
        "correction": "review_statut <> 'corrige' or valeur_corrigee is not null",
    },
    "commune": {"resolution": "statut_resolution <> 'resolue' or (url_mairie is not null and source_resolution is not null)"},
    "domaine_mail": {"mx": "mx is null or mx in (0, 1)"},
    "page": {"statut": "statut in ('a_visiter', 'visitee', 'bloquee', 'erreur', 'hors_type', 'dupliquee')", "profondeur": "profondeur between 0 and 2"},
}


def broken(df: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """regle, lignes, fautes: for each rule the rows that do not fulfil it; a rule that comes out null is broken."""
    def holds(rule: Column | str) -> Column:
        return F.coalesce(F.expr(rule) if isinstance(rule, str) else rule, F.lit(False))

    counts = df.agg(F.count("*").alias("lignes"), *(F.count_if(~holds(r)).alias(n) for n, r in rules.items()))
    return counts.select("lignes", F.explode(F.array(*(F.struct(F.lit(n).alias("regle"), F.col(n).alias("fautes")) for n in rules))).alias("x")).select("x.regle", "lignes", "x.fautes")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row: keys, n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
