"""Mixing sources to target weights."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from regesta.session import materialise

#: Bins of the hash-seeded uniform number, for the calibration of the rates: BINS rows for each source of the targets reach the driver.
BINS = 4096


def source_key(source: Column) -> Column:
    """A source's name as it compares: lower case, words joined by one underscore."""
    key = F.regexp_replace(F.regexp_replace(F.lower(source), r"[\s\p{Z}_\-]+", "_"), "^_+|_+$", "")
    return F.when(F.length(key) > 0, key)


def count_tokens(docs: DataFrame, text: str, ranks: str, pattern: str) -> DataFrame:
    """docs plus tokens: the length of text in a byte-pair vocabulary given as a file of ranks (tiktoken's format).

    The file is read once on the driver and broadcast (a vocabulary's size is fixed); each Python worker builds its
    encoder once. Whole texts are encoded; a null text has 0 tokens.
    """
    with open(ranks, "rb") as f:
        table = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in table.value.splitlines() if line)}
        encoder = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        for batch in batches:
            yield batch.map(lambda t: 0 if t is None else len(encoder.encode_ordinary(t))).astype("int64")

    return docs.withColumn("tokens", F.pandas_udf(encode, LongType())(F.col(text)))


def _uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the seed and the columns only."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(2**48)).cast("double") + 0.5) / F.lit(float(2**48))


def capped_poisson(u: Column, rate: Column, cap: Column) -> Column:
    """The Poisson quantile of u at this rate, at most cap: the number of thresholds P(N <= k), k < cap, that u passes.

    An infinite rate gives cap. The terms are summed in a fold, so no cap is too large.
    """
    # terms by their logarithms, so no rate is too great
    step = F.aggregate(
        F.sequence(F.lit(0), F.greatest(cap - 1, F.lit(0))),
        F.struct((-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("n")),
        lambda s, k: F.struct(
            (s["p"] + F.ln(rate) - F.ln(k + 1)).alias("p"), (s["c"] + F.exp(s["p"] + F.ln(rate) - F.ln(k + 1))).alias("c"), (s["n"] + F.when((u > s["c"]) & (k < cap), 1).otherwise(0)).alias("n")
        ),
    )["n"]
    return F.when(rate == float("inf"), cap).when(rate <= 0, F.lit(0)).otherwise(step)


def _copies(u: np.ndarray, rate: float, cap: int) -> np.ndarray:
    p, c = -rate, math.exp(-rate)
    n = np.zeros(len(u), dtype=int)
    for k in range(cap):
        n += u > c
        p += math.log(rate) - math.log(k + 1)
        c += math.exp(p)
    return n


def calibrated_rate(tokens: np.ndarray, wanted: float, cap: int) -> float:
    """The rate whose draws, for these tokens by bin of u, come nearest to the wanted number of tokens."""
    whole = float(tokens.sum())
    if whole <= 0 or wanted <= 0:
        return 0.0
    if wanted >= cap * whole * (1 - 1e-12):
        return math.inf
    u = (np.arange(len(tokens)) + 0.5) / len(tokens)
    low, high = 0.0, 1.0
    while float((tokens * _copies(u, high, cap)).sum()) < wanted:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float((tokens * _copies(u, mid, cap)).sum()) < wanted else (low, mid)
    return high


def mix(docs: DataFrame, targets: DataFrame, *, doc_id: str, text: str, source: str, size: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Combine docs so that each source of targets (source, poids, repetitions_max) has its share of all tokens.

    docs has tokens (see count_tokens). A text that several documents share (its white space aside) is one text: it stands
    for itself once, in the source of its least doc_id among the sources wanted, so no text is used more often than its cap.
    The whole has `size` tokens, but no more than the caps allow: min(cap x tokens of the source / poids) over the sources with
    texts (the source that binds then has each text cap times); a source without any cannot be served, and the others keep their proportions.

    Each document gets a number in (0, 1) from a hash of the seed and its id; its copies are the Poisson quantile of that
    number at the source's rate, at most the cap. The rate is the mean target repetition, calibrated: tokens by source and bin
    of that number (4096 bins for each source of the targets, whatever the corpus) come to the driver, where the rate is found whose
    draws give the wanted tokens. The copies are exploded and the whole is shuffled by a hash of seed, id and copy.

    Result: (mixture: doc_id, copie, source, tokens, rang; report: source, poids, part, tokens, textes, copies, max_copies).
    rang orders the mixture at random, the same in each run. Documents without source, of other sources or without
    tokens take no part. Two targets of one name count as the first. Repeated ids are one document.
    """
    wanted = targets.select(source_key(F.col("source")).alias("source"), F.col("poids").cast("double").alias("poids"), F.greatest(F.col("repetitions_max").cast("int"), F.lit(0)).alias("cap"))
    goals = {}
    for r in wanted.where("source is not null and poids > 0 and cap is not null").orderBy("source", "poids", "cap").collect():
        goals.setdefault(r.source, (r.poids, r.cap))
    spark = docs.sparkSession
    schema = "source string, poids double, cap int"
    goal_rows = spark.createDataFrame([(s, w, c) for s, (w, c) in goals.items()], schema)
    named = docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("source"), "tokens", F.xxhash64(F.regexp_replace(F.col(text), r"[\s\p{Z}]+", " ")).alias("h1"), F.hash(F.regexp_replace(F.col(text), r"[\s\p{Z}]+", " ")).alias("h2"))
    named = named.where("tokens > 0 and doc_id is not null").join(F.broadcast(goal_rows.select("source")), "source", "left_semi")
    single = named.groupBy("h1", "h2").agg(F.min_by(F.struct("doc_id", "source", "tokens"), F.struct("doc_id", "source")).alias("d")).select("d.*")
    single = materialise(single.dropDuplicates(["doc_id"]).withColumn("u", _uniform(seed, "doc_id")), "mix-docs")

    bins = single.groupBy("source", F.least(F.floor(F.col("u") * BINS), F.lit(BINS - 1)).cast("int").alias("b")).agg(F.sum("tokens").alias("t"))
    table: dict[str, np.ndarray] = {s: np.zeros(BINS) for s in goals}
    for r in bins.toLocalIterator():
        table[r.source][r.b] += r.t
    served = {s: t for s, t in table.items() if t.sum() > 0 and goals[s][1] > 0}
    most = min((goals[s][1] * t.sum() / goals[s][0] for s, t in served.items()), default=0.0)
    # a size is that of the sources that can be served
    wanted_size = most if size is None else min(most, size / max(sum(goals[s][0] for s in served), 1e-12))
    rates = [(s, calibrated_rate(table[s], wanted_size * w, c) if s in served else 0.0, c) for s, (w, c) in goals.items()]
    rate_rows = spark.createDataFrame(rates, "source string, rate double, cap int")
    drawn = single.join(F.broadcast(rate_rows), "source").withColumn("n", capped_poisson(F.col("u"), F.col("rate"), F.col("cap")))
    copies = drawn.where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copie"), "source", "tokens")
    mixture = copies.withColumn("rang", _uniform(seed + 1, "doc_id", "copie"))
    mixture = mixture.repartitionByRange("rang").sortWithinPartitions("rang")

    per = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("tokens"), F.count_if(F.col("n") > 0).alias("textes"), F.sum("n").alias("copies"), F.max("n").alias("max_copies"))
    none = F.lit(0).cast("long")
    every = F.coalesce(F.sum("tokens").over(Window.partitionBy(F.lit(0))), none)  # one row for each target
    report = goal_rows.join(per, "source", "left").select(
        "source", "poids", (F.coalesce("tokens", none) / F.greatest(every, F.lit(1))).alias("part"), F.coalesce("tokens", none).alias("tokens"), F.coalesce("textes", none).alias("textes"),
        F.coalesce("copies", none).alias("copies"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"),
    )
    return mixture, report
