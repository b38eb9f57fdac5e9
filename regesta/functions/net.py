"""Networks and robots rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType


def subnet_key(address: Column) -> Column:
    """The /24 of an IPv4 address, the /48 of an IPv6 one, as text."""
    v4 = F.concat(F.regexp_extract(address, r"^(\d+\.\d+\.\d+)\.\d+$", 1), F.lit(".0/24"))
    # '::' stands for as many zero groups as are missing
    groups = F.filter(F.split(F.split_part(address, F.lit("::"), F.lit(1)), ":"), lambda x: x != "")
    head = F.slice(F.concat(groups, F.array_repeat(F.lit("0"), 3)), 1, 3)
    v6 = F.concat(F.array_join(F.transform(head, lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", ""))), ":"), F.lit("::/48"))
    return F.when(address.rlike(r"^\d+\.\d+\.\d+\.\d+$"), v4).when(address.contains(":"), v6)


_POLICY = StructType(
    [StructField("rules", ArrayType(StructType([StructField("allow", BooleanType()), StructField("pattern", StringType())]))), StructField("delay_ms", LongType())]
)


def robots_rules(text: str | None, agent: str) -> tuple[list[tuple[bool, str]], int | None]:
    """The rules and the delay of the first group that names the agent, else of the first for all. A group is a run of agents and what follows it."""
    groups: list[tuple[set[str], list[tuple[bool, str]], list[int]]] = []
    naming = False
    for raw in (text or "").splitlines():
        field, colon, value = raw.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            if not naming:
                groups.append((set(), [], []))
            groups[-1][0].add(value.lower())
            naming = True
            continue
        naming = False
        if not groups:
            continue
        if field in ("allow", "disallow") and value:
            groups[-1][1].append((field == "allow", value))
        elif field == "crawl-delay":
            try:
                seconds = float(value.replace(",", "."))
            except ValueError:
                continue
            if 0 <= seconds < 1e9:
                groups[-1][2].append(int(seconds * 1000))
    for name in (agent.lower(), "*"):
        for names, rules, delays in groups:
            if name in names:
                return rules, delays[-1] if delays else None
    return [], None


def robots_policy(agent: str):
    """A column function: robots text to (rules, delay_ms); batches over Arrow."""

    def read(texts: pd.Series) -> pd.DataFrame:
        got = [robots_rules(t, agent) for t in texts]
        return pd.DataFrame({"rules": [[{"allow": a, "pattern": p} for a, p in r] for r, _ in got], "delay_ms": pd.array([d for _, d in got], dtype="Int64")})

    return F.pandas_udf(read, _POLICY)


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern ('*' any characters, '$' at the end the end) as a regular expression."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))


def allowed(rules: Column, path: Column) -> Column:
    """The longest rule that fits decides, 'allow' among equals; without one all is allowed."""
    fitting = F.filter(rules, lambda r: F.regexp_like(path, pattern_regex(r["pattern"])))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def effective_delay_ms(delay_ms: Column, floor_ms: int) -> Column:
    return F.greatest(F.lit(floor_ms).cast("long"), F.coalesce(delay_ms, F.lit(0).cast("long")))
