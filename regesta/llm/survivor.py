"""One surviving record for each group of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The day from which ages are counted; only the ratio of two votes matters, and that does not depend on it.
_DAY = 20454.0


def survivors(
    records: DataFrame, group: list[str], identity: str, fields: list[str], trust: list[str], recency: str, *, criteria: list[str] | None = None, same: dict[str, Column] | None = None, half_life_days: float = 365.0
) -> DataFrame:
    """Build the surviving record of each group, field by field, and elect the record that represents it.

    records has one row for each identity. Everything is unpivoted to long rows of a field, a value and a vote. The vote is the source trust (the
    product of the trust columns, each a rank of 0 or more, made 1 + rank) times the decay of its age, 0.5 ** (age / half life).
    The votes of equal values are summed, the winner of each field is chosen by max_by, and the winners are pivoted back to one row.

    * fields: the value with the greatest sum of votes (to nine places, so that the order of adding does not matter) wins. Values are equal as their normalised form in `same` says (by default as text);
      what is written is the form of the strongest single vote. Ties go to the greatest normalised value.
    * the identity: its vote is the record's own. Equal votes are decided by the criteria in their order, then by the identity.
    * criteria: columns where more is better and null is least. Here the rank of a value outweighs any sum of votes, so that the winner is the best
      value that anyone in the group has. All criteria of a record together are one more field, whose votes tell how many records share them.

    Votes are summed per group, field and value, and then per group; both sums are combined before their shuffle, so a group of a third of all
    rows is in no single task, and no list of records is made.

    Result: group columns, n (records in the group), elu (the winning identity), the fields' winning values as text, and
    sans_conteste: the elected record has the winning value of every criterion, and no other record has all of them too. A vote never falls as a
    criterion rises, so a record at least as good as all others is elected, or one equal to it; hence this test needs nothing but the winners.
    A group of one record is its own survivor. An empty table gives no row. Rows whose group key is null in every column are no group and are
    left out. Unreadable recency counts as the oldest; null values of a field have no vote.
    """
    criteria, same = criteria or [], same or {}
    at = F.coalesce(F.unix_micros(F.col(recency)).cast("double") / 86400e6, F.lit(-1e6))
    vote = F.pow(F.lit(0.5), (F.lit(_DAY) - at) / F.lit(half_life_days))
    for t in trust:
        vote = vote * (F.lit(1.0) + F.coalesce(F.col(t).cast("double"), F.lit(0.0)))
    marks = [F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) for c in criteria]

    def ballot(field: str, value: Column, form: Column, rank: list[Column]) -> Column:
        ranks = F.array(*rank) if rank else F.array().cast("array<double>")
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), form.cast("string").alias("form"), ranks.alias("rank"))

    names = [f"f{i}" for i in range(len(fields))]
    ballots = [ballot("_id", F.col(identity), F.col(identity), marks)]
    ballots += [ballot(n, F.col(f), same.get(f, F.col(f)), []) for n, f in zip(names, fields, strict=True)]
    ballots += [ballot(f"_c{i}", m, m, [m]) for i, m in enumerate(marks)]
    ballots += [ballot("_all", F.lit(""), F.array_join(F.array(*(m.cast("string") for m in marks)), " "), marks)] if marks else []
    any_known = F.coalesce(*(F.col(g).cast("string") for g in group)).isNotNull()
    long = records.where(any_known).select(*group, vote.alias("vote"), F.explode(F.array(*ballots)).alias("b")).select(*group, "vote", "b.*").where("form is not null")
    by_value = long.groupBy(*group, "field", "form").agg(F.round(F.sum("vote"), 9).alias("vote"), F.count("*").alias("n"), F.max("rank").alias("rank"), F.max_by("value", F.struct("vote", "value")).alias("value"))

    def winner(field: str, what: Column, *order: str) -> Column:
        own = F.col("field") == field
        return F.max_by(F.when(own, what), F.when(own, F.struct(*order)))

    # order of an identity: its vote, its criteria; of a field: the votes, the value; of a criterion and of all of them together: the rank first
    won = by_value.groupBy(*group).agg(
        F.sum(F.when(F.col("field") == "_id", F.col("n"))).alias("n"), winner("_id", F.struct("value", "rank"), "vote", "rank", "value").alias("_elu"), *(winner(n, F.col("value"), "vote", "form").alias(f) for n, f in zip(names, fields, strict=True)),
        *(winner(f"_c{i}", F.col("rank"), "rank", "vote").alias(f"_c{i}") for i in range(len(criteria))), *([winner("_all", F.col("n"), "rank", "vote").alias("_alike")] if criteria else []),
    )
    best = F.flatten(F.array(*(F.col(f"_c{i}") for i in range(len(criteria))))) if criteria else None
    undisputed = (F.col("n") > 1) & (F.col("_elu.rank") == best) & (F.col("_alike") == 1) if criteria else F.lit(False)
    return won.select(*group, "n", F.col("_elu.value").alias("elu"), *fields, undisputed.alias("sans_conteste"))
