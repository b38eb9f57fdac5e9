"""The states of queued work, as transitions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regesta.functions.keys import instant
from regesta.functions.times import backoff_ms, iso_text

STATES = ("pending", "leased", "done", "skipped", "dead")


def state_counts(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Jobs per state, states without any as 0."""
    return jobs.groupBy(*by).agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES))


def latest_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """Of each state the n jobs that changed last, with their place (rang)."""
    w = Window.partitionBy("state").orderBy(F.desc(instant(F.col("updated_at"))), "id")
    return jobs.withColumn("rang", F.row_number().over(w)).where(F.col("rang") <= n)


PAYLOAD = "codeInsee string, url string, campagne string, profondeur string, maxPages string, avecMobiles string"


def page_payload(text: F.Column) -> F.Column:
    """Struct (faute, code_insee, url, campagne, profondeur, max_pages, avec_mobiles) of a page job's payload, which is JSON.

    A payload without municipality, address or campaign is refused, and faute names the first field that lacks; nothing is guessed. Numbers that are no whole positive numbers are 0.
    """
    p = F.from_json(text, PAYLOAD)

    def lacks(name: str) -> F.Column:
        return F.coalesce(p[name], F.lit("")) == ""

    def whole(name: str) -> F.Column:
        return F.when(p[name].rlike(r"^\d+$"), p[name].try_cast("long")).otherwise(F.lit(0).cast("long"))

    fault = F.when(lacks("codeInsee"), "codeInsee").when(lacks("url"), "url").when(lacks("campagne"), "campagne")
    read = {"code_insee": p["codeInsee"], "url": p["url"], "campagne": p["campagne"], "profondeur": whole("profondeur"), "max_pages": whole("maxPages"), "avec_mobiles": p["avecMobiles"] == "true"}
    return F.struct(fault.alias("faute"), *(F.when(fault.isNull(), c).alias(n) for n, c in read.items()))


def _later(now: str, ms) -> F.Column:
    return iso_text(F.timestamp_millis(F.unix_millis(F.to_timestamp(F.lit(now))) + ms))


def eligible(jobs: DataFrame, now: str) -> DataFrame:
    """Waiting jobs whose time has come, and leased ones whose lease has run out."""
    return jobs.where(((F.col("state") == "pending") & (F.col("available_at") <= now)) | ((F.col("state") == "leased") & (F.col("lease_expires_at") <= now)))


def lease(jobs: DataFrame, now: str, n: int, lease_ms: int) -> DataFrame:
    """The table after n jobs were taken, by priority and id: leased, one attempt more, until the lease ends."""
    first = eligible(jobs, now).orderBy("priority", "id").limit(n).select("id", F.lit(True).alias("_taken"))
    rows = jobs.join(first, "id", "left")
    return rows.select(
        *(F.col(c) for c in jobs.columns if c not in ("state", "attempts", "lease_expires_at")), F.when(F.col("_taken"), "leased").otherwise(F.col("state")).alias("state"),
        (F.col("attempts") + F.when(F.col("_taken"), 1).otherwise(0)).alias("attempts"), F.when(F.col("_taken"), _later(now, F.lit(lease_ms))).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"),
    ).select(jobs.columns)


def settle(jobs: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """The table after events (id, seq, event, lease_ms): complete, skip, fail, release, renew, requeue; the last of an id counts.

    A failure waits longer each time and is final when attempts are used up; a release gives its attempt back; only what has
    ended is queued again, with all its attempts. Where an event does not fit the state, nothing changes.
    """
    last = events.groupBy("id").agg(F.max(F.struct("seq", "event", "lease_ms")).alias("e"))
    rows = jobs.join(last, "id", "left")
    ev, held = F.col("e.event"), F.col("state") == "leased"
    over = F.col("attempts") >= F.col("max_attempts")
    ended = F.col("state").isin("done", "skipped", "dead", "failed")
    state = (
        F.when(held & (ev == "complete"), "done").when(held & (ev == "skip"), "skipped").when(held & (ev == "fail"), F.when(over, "dead").otherwise("pending"))
        .when(held & (ev == "release"), "pending").when(ended & (ev == "requeue"), "pending").otherwise(F.col("state"))
    )
    attempts = F.when(held & (ev == "release"), F.greatest(F.col("attempts") - 1, F.lit(0))).when(ended & (ev == "requeue"), F.lit(0)).otherwise(F.col("attempts"))
    at = F.when(held & (ev == "fail") & ~over, _later(now, backoff_ms(F.col("attempts")))).when((held & (ev == "release")) | (ended & (ev == "requeue")), F.lit(now)).otherwise(F.col("available_at"))
    until = F.when(held & (ev == "renew"), _later(now, F.col("e.lease_ms"))).when(ev.isNull(), F.col("lease_expires_at"))
    return rows.select(*(F.col(c) for c in jobs.columns if c not in ("state", "attempts", "available_at", "lease_expires_at")), state.alias("state"), attempts.cast("int").alias("attempts"), at.alias("available_at"), until.alias("lease_expires_at")).select(jobs.columns)


def resume_points(progress: DataFrame, remote: DataFrame) -> DataFrame:
    """Where the reading of each source goes on: source, depart (byte), suite ('debut', 'reprise' or 'redemarrage').

    progress: source, lus (bytes consumed), entete, etag, modifie, taille; remote: source, etag, modifie, taille, partiel (the rest alone was sent). A
    reading goes on only where its header is known, the rest was sent, and the fingerprint (etag, modifie, taille; missing values are equal) has not changed; else it begins again.
    """
    known = progress.select("source", "lus", "entete", *(F.col(c).alias(f"_{c}") for c in ("etag", "modifie", "taille")))
    rows = known.join(remote, "source")
    same = F.col("etag").eqNullSafe(F.col("_etag")) & F.col("modifie").eqNullSafe(F.col("_modifie")) & F.col("taille").eqNullSafe(F.col("_taille"))
    fresh = F.col("entete").isNull() | (F.col("lus") <= 0)
    step = F.when(fresh, "debut").when(F.col("partiel") & same, "reprise").otherwise("redemarrage")
    return rows.select("source", F.when(step == "reprise", F.col("lus")).otherwise(0).cast("long").alias("depart"), step.alias("suite"))


def gaps(events: DataFrame, key: list[str], at: str, least_ms: int) -> DataFrame:
    """Events that came sooner than least_ms after the one before of their key: key, at, ecart_ms."""
    w = Window.partitionBy(*key).orderBy(at)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = (micros - F.lag(micros).over(w)) / 1000
    return events.withColumn("ecart_ms", gap).where(F.col("ecart_ms") < least_ms).select(*key, at, "ecart_ms")
