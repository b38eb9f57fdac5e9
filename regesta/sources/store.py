"""Bodies of pages by the hash of their address, and verdicts of an outside resolver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regesta.functions.keys import canonical_url, instant


def keyed_bodies(bodies: DataFrame) -> DataFrame:
    """bodies (url, body, taille, fetched_at) with their key, the last fetch of each; a body of another size than stated counts as absent."""
    own = bodies.withColumn("cle", F.sha2(canonical_url(F.col("url")), 256)).where(F.octet_length("body") == F.col("taille"))
    return own.groupBy("cle").agg(F.max_by(F.struct("url", "body", "fetched_at"), F.struct("fetched_at", "url")).alias("b")).select("cle", "b.*")


def fresh(bodies: DataFrame, now: str, ttl_ms: int) -> DataFrame:
    return bodies.where(F.unix_millis(instant(F.col("fetched_at"))) + ttl_ms > F.unix_millis(instant(F.lit(now))))


def prune(bodies: DataFrame, cutoff: str) -> DataFrame:
    """Without bodies older than the cutoff."""
    return bodies.where(F.col("fetched_at") >= cutoff)


def mx_verdict(answer: list[tuple[int, str]] | None, error: str | None) -> tuple[int | None, list[str]]:
    """1 and the hosts by priority; 0 where there is none, or only '.'; null where the question failed."""
    if error is not None:
        return (0, []) if error in ("ENODATA", "ENOTFOUND", "NXDOMAIN") else (None, [])
    hosts = [h for _, h in sorted(answer or []) if h not in ("", ".")]
    return (1, hosts) if hosts else (0, [])


def resolve_domains(domains: DataFrame, resolver: Callable[[str], tuple[list[tuple[int, str]] | None, str | None]], parallel: int = 8) -> DataFrame:
    """domaine, mx, mx_hotes: each different domain is asked for once, by at most `parallel` tasks at a time."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [mx_verdict(*resolver(d)) for d in b["domaine"]]
            yield pd.DataFrame({"domaine": b["domaine"], "mx": pd.array([g[0] for g in got], dtype="Int32"), "mx_hotes": [g[1] for g in got]})

    return domains.select("domaine").where("domaine is not null").distinct().repartition(parallel).mapInPandas(ask, "domaine string, mx int, mx_hotes array<string>")
