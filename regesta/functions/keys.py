"""Keys as they compare: addresses, municipality codes, digests, instants. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, no-break and zero-width spaces included.
SPACE = r"[\s\p{Z}\u0085​﻿]"

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_PLAIN = r"^https?://[a-z0-9.\-]+/[A-Za-z0-9./_~\-]*$"


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends; null where nothing is left."""
    cut = F.when(text.rlike(rf"^{SPACE}|{SPACE}$"), F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")).otherwise(text)
    return F.when(F.length(cut) > 0, cut)


def code_insee(code: Column) -> Column:
    """Trimmed, upper-case code of five characters; a lost leading zero comes back. Null and blank give null."""
    up = F.upper(trimmed(code))
    return F.when(up.rlike(r"^\d{4}$"), F.concat(F.lit("0"), up)).otherwise(up)


def digest(text: Column) -> Column:
    """A hexadecimal digest in lower case, without white space and without the name of its algorithm."""
    return F.lower(F.regexp_replace(trimmed(text), r"^[A-Za-z0-9\-]+[:=]|^0[xX]", ""))


def instant(text: Column) -> Column:
    """An ISO-8601 text as a timestamp; without an offset it is UTC; unreadable text gives null."""
    t = trimmed(text)
    return F.try_to_timestamp(F.when(t.rlike(r"T.*(Z|[+\-]\d\d:?\d\d)$"), t).otherwise(F.concat(t, F.lit("Z"))))


def utc_month(at: Column) -> Column:
    """YYYY-MM of an instant in UTC, whatever the session's time zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM")


def _parameter(text: Column) -> Column:
    """One name or value of a query string, decoded and encoded again as a form does."""
    return F.when(text.rlike(r"^[A-Za-z0-9*\-._]*$"), text).otherwise(F.coalesce(F.url_encode(F.try_url_decode(text)), text))


def _query(query: Column) -> Column:
    """Parameters in the order of their names, equal names in their given order."""
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    keyed = F.transform(
        parts,
        lambda x, i: F.struct(
            _parameter(F.split_part(x, F.lit("="), F.lit(1))).alias("k"),
            i.alias("i"),
            F.when(x.contains("="), _parameter(F.regexp_replace(x, r"^[^=]*=", ""))).otherwise("").alias("v"),
        ),
    )
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&")


def canonical_url(url: Column) -> Column:
    """One form for each address: scheme and host in lower case, no default port, no fragment, parameters in order.

    The path keeps its case. Null and blank give null; what is no address at all stays as it is, trimmed.
    """

    def read(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, _URL, 1))
        host = F.lower(F.regexp_extract(u, _URL, 2))
        host = F.when(scheme == "http", F.regexp_replace(host, r":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, r":(443)?$", "")).otherwise(host)
        path = F.regexp_extract(u, _URL, 3)
        path = F.when(path == "", F.lit("/")).otherwise(F.replace(path, F.lit(" "), F.lit("%20")))
        raw = F.regexp_extract(u, r"\?([^#]*)", 1)
        query = F.when(raw == "", "").otherwise(F.concat(F.lit("?"), _query(raw)))
        return F.when(u.rlike(_URL), F.concat(scheme, F.lit("://"), host, path, F.when(query == "?", "").otherwise(query))).otherwise(u)

    # most addresses are canonical already; for the others the trimmed text is bound once, so the expression stays small
    return F.when(url.rlike(_PLAIN), url).otherwise(F.element_at(F.transform(F.array(trimmed(url)), read), 1))
