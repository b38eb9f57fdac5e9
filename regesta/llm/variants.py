"""Variant spellings of one organisation's name."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regesta.functions.text import normalise_name
from regesta.llm.graph import components
from regesta.llm.nearness import near_names
from regesta.session import materialise

# Small words of French names; they tell no organisation from another.
SMALL = frozenset("de du des d la le les l et en au aux".split())
#: Words that any organisation may put before or into its name.
GENERIC = frozenset("association assoc asso ass club".split())

#: The edits of a whole name, over its aligned tokens.
EDITS = 3

PARSED = "n long, side int, code string, alias string, sigle string, place string, core array<string>, known array<string>, short array<string>, sig array<string>"


def letters(text: str | None) -> str:
    return "".join(c for c in (text or "").lower() if c.isalnum())


def parse(alias: str, sigle: str, place: str, known: frozenset[str]) -> tuple[list[str], list[str], list[str], list[str]]:
    """A normalised name's own words, its words known from many names, its short words and its initials."""
    tokens = alias.split()
    tail = place.split()
    if tail and len(tokens) > len(tail) + 1 and tokens[-len(tail) :] == tail:
        tokens = tokens[: -len(tail)]
    merged: list[str] = []
    spelled: set[str] = set()
    i = 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and len(tokens[j]) == 1:
            j += 1
        if j - i >= 2:
            merged.append("".join(tokens[i:j]))
            spelled.add(merged[-1])
            i = j
        else:
            merged.append(tokens[i])
            i += 1
    own = [t for t in merged if t not in SMALL and t not in known]
    core, words, short, sig = [], [t for t in merged if t in known and t not in SMALL], [], []
    for t in own:
        heads = sorted(o[0] for o in own if o != t and len(o) >= 5)
        if t in spelled or (sigle and t == sigle and len(t) >= 2):
            sig.append(t)
        elif heads and 3 <= len(t) <= 7 and len(t) > len(heads) and sorted(t[-len(heads) :]) == heads and (len(t) <= 5 or sum(c in "aeiouy" for c in t) <= 1):
            sig.append(t)
        elif len(t) <= 4:
            short.append(t)
        else:
            core.append(t)
    return core, words, short, sig


def banded(a: str, b: str, k: int) -> int:
    """Edit distance of a and b if at most k, else k + 1; two letters changing places are one edit. Only a band of 2k + 1 is computed."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > k:
        return k + 1
    far = k + 1
    older: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), k) + 1)}
    for i in range(1, len(a) + 1):
        now: dict[int, int] = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            v = i if j == 0 else min(row.get(j, far) + 1, now.get(j - 1, far) + 1, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, older.get(j - 2, far) + 1)
            now[j] = v
        older, row = row, now
        if min(row.values()) > k:
            return far
    return min(row.get(len(b), far), far)


def _subsequence(small: str, large: str) -> bool:
    it = iter(large)
    return all(c in it for c in small)


def _like(x: str, y: str) -> bool:
    """Are two words of an activity the same word: equal, shortened, of one stem, or mistyped?"""
    if x == y or x.startswith(y) or y.startswith(x):
        return True
    a, b = sorted((x, y), key=len)
    if (len(a) >= 4 and a[:4] == b[:4]) or (len(a) == 4 and a[:3] == b[:3]):
        return True
    if len(a) <= 4:
        return a[0] == b[0] and len(a) >= 2 and a[-1] in b and _subsequence(a, b)
    return banded(a, b, 1 if len(a) < 7 else 2) <= (1 if len(a) < 7 else 2)


def _telling(words: Sequence[str]) -> set[str]:
    """The words that tell an activity; 'association' tells it where only a sport stands beside it."""
    rest = {w for w in words if w not in GENERIC}
    return set(words) if rest and all(w.startswith("sport") for w in rest) else rest


def _initials(sig: str, words: Sequence[str]) -> bool:
    heads = [w for w in words if w not in SMALL]
    return bool(heads) and _subsequence("".join(w[0] for w in heads[:2]), sig)


def other_words(a: Sequence[str], b: Sequence[str]) -> tuple[list[str], list[str], bool]:
    """The telling words of two activities that have no counterpart in the other one, and whether some have one."""
    ta, tb = _telling(a), _telling(b)
    ua = {x for x in ta if not any(_like(x, y) for y in b)}
    ub = {y for y in tb if not any(_like(x, y) for x in a)}
    return sorted(ua), sorted(ub), bool(ta - ua and tb - ub)


def same_activity(a: Sequence[str], a_short: Sequence[str], a_sig: Sequence[str], b: Sequence[str], b_short: Sequence[str], b_sig: Sequence[str]) -> bool:
    ua, ub, some = other_words([*a, *a_short], [*b, *b_short])
    if some and not (ua and ub):
        return True
    for sig in [*a_sig, *a_short]:
        if _initials(sig, [w for w in b if w not in ("association",)] or b) or _initials(sig, b) or sig in b_sig:
            return True
    return any(_initials(sig, [w for w in a if w not in ("association",)] or a) or _initials(sig, a) for sig in [*b_sig, *b_short])


def all_words(name: dict) -> list[str]:
    return sorted([*name["core"], *name["known"], *name["short"], *name["sig"]])


def same_words(a: dict, b: dict) -> bool:
    """Do two parsed names, one without own words, have the same words? Order and spaces may differ, and an own word may be a known one mistyped."""
    wa, wb = all_words(a), all_words(b)
    if not wa or not wb:
        return False
    for x, y in ((wa, wb), (wb, wa)):
        if len(x) == 1 and len(y) == 2 and x[0] in (y[0] + y[1], y[1] + y[0]):
            return True
    own = {*a["core"], *b["core"]}
    only_a, only_b = list((Counter(wa) - Counter(wb)).elements()), list((Counter(wb) - Counter(wa)).elements())
    if len(only_a) != len(only_b) or len(only_a) > EDITS:  # each differing word costs an edit
        return False

    def cost(x: str, y: str) -> int:
        return banded(x, y, 2) if (x in own or y in own) and banded(x, y, 2) <= reach(min(len(x), len(y))) else EDITS + 1

    return any(sum(cost(x, y) for x, y in zip(only_a, order, strict=True)) <= EDITS for order in permutations(only_b))


def own_distance(a: dict, b: dict) -> tuple[int, list[list[str]], list[list[str]]]:
    """The banded edit distance of two names' own words, aligned in any order; what is left over on either side; and what of it is another word for a known one.

    Two words are aligned within the edits that their length grants, one word with two written as one likewise; EDITS + 1 where none is. A word cut short, or
    one that begins like a known word of the other name (a first name and its short form), or for which only the other name's initials
    stand, costs one edit; one that names the municipality none; any other is left over.
    """
    ca, cb = list(a["core"]), list(b["core"])
    ways = [(d, (i,), (j,)) for i, x in enumerate(ca) for j, y in enumerate(cb) if (d := banded(x, y, 2)) <= reach(min(len(x), len(y)))]
    for left, right, turned in ((ca, cb, False), (cb, ca, True)):
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                for m, z in enumerate(right):
                    if j != m and len(x) >= 10 and (d := banded(x, y + z, 2)) <= 2:
                        ways.append((d, (j, m), (i,)) if turned else (d, (i,), (j, m)))
    used: tuple[set[int], set[int]] = (set(), set())
    total = 0
    for d, i, j in sorted(ways, key=lambda w: (w[0] - len(w[1]) - len(w[2]), w)):
        if used[0].isdisjoint(i) and used[1].isdisjoint(j) and total + d <= EDITS:
            used[0].update(i)
            used[1].update(j)
            total += d
    over = [[x for i, x in enumerate(own) if i not in seen] for own, seen in zip((ca, cb), used, strict=True)]
    turned_words: list[list[str]] = [[], []]
    if not used[0]:
        return EDITS + 1, over, turned_words
    bare = [list(a["short"]), list(b["short"])]
    rest: list[list[str]] = [[], []]
    for side, other in ((0, b), (1, a)):
        signs = [*other["sig"], *([other["sigle"]] if other["sigle"] and other["sig"] else [])]
        for w in over[side]:
            if w in other["place"].split():
                continue
            pool = next((p for p in (bare[1 - side], over[1 - side]) if any(_cut(w, t) for t in p)), None)
            if any(len(k) > 3 and k[:3] == w[:3] for k in other["known"]):
                turned_words[side].append(w)
            elif pool is not None:
                pool.remove(next(t for t in pool if _cut(w, t)))
            elif not any(w[0] in s[1:] for s in signs):
                rest[side].append(w)
                continue
            total += 1
    return total, rest, turned_words


def _cut(w: str, t: str) -> bool:
    """Is one of two words the other cut short, save for an edit?"""
    return len(t) >= 3 and (w.startswith(t) or t.startswith(w) or (len(t) >= 4 and banded(t, w[: len(t)], 1) <= 1))


def compare(a: dict, b: dict) -> tuple[bool, list[str], list[str]]:
    """Do two parsed names name one organisation: are their own words within EDITS and do their activities agree? Else, where all own words of one of them agree: the words in which they differ."""
    if a["alias"] == b["alias"]:
        return True, [], []
    if not len(a["core"]) or not len(b["core"]):
        return same_words(a, b), [], []
    total, rest, turned = own_distance(a, b)
    if total > EDITS or rest[0] and rest[1]:
        return False, [], []
    words = [[*x["short"], *t] for x, t in zip((a, b), turned, strict=True)]
    if not rest[0] and not rest[1] and same_activity(a["known"], words[0], a["sig"], b["known"], words[1], b["sig"]):
        return True, [], []
    ua, ub, _ = other_words([*a["known"], *words[0]], [*b["known"], *words[1]])
    return False, sorted([*ua, *rest[0]]), sorted([*ub, *rest[1]])


def same_body(a: dict, b: dict) -> bool:
    return compare(a, b)[0]


def _lists(row: dict) -> dict:
    """A struct as it comes over Arrow, its arrays as lists."""
    return {k: v if isinstance(v, str) else list(v) for k, v in row.items()}


def cuts(length: int, k: int) -> list[int]:
    return [i * length // (k + 1) for i in range(k + 2)]


def index_keys(unit: str, k: int) -> list[str]:
    """The k + 1 segments of a unit: if another is at most k edits away, one of them stands in it unchanged."""
    at = cuts(len(unit), k)
    return [f"{k}:{len(unit)}:{i}:{unit[at[i] : at[i + 1]]}" for i in range(k + 1)]


def _probes(unit: str, m: int, k: int) -> set[str]:
    """The substrings of a unit that can be a segment of one of m letters, at the places to which i edits before and k - i after can shift it.

    Two letters that change places across a cut count as an edit of the segment after it: the one before is asked for with its last letter also as it was.
    """
    out = set()
    n, at = len(unit), cuts(m, k)
    gap = n - m
    for i in range(k + 1):
        size = at[i + 1] - at[i]
        for p in range(max(0, at[i] - i, at[i] + gap - (k - i)), min(n - size, at[i] + i, at[i] + gap + (k - i)) + 1):
            out.add(f"{k}:{m}:{i}:{unit[p : p + size]}")
            if i < k and p + size < n:
                out.add(f"{k}:{m}:{i}:{unit[p : p + size - 1]}{unit[p + size]}")
    return out


def probe_keys(unit: str, k: int) -> set[str]:
    """What finds the segments of every unit as long or up to k shorter."""
    return set().union(*(_probes(unit, m, k) for m in range(max(k + 1, len(unit) - k), len(unit) + 1)))


def reach(length: int) -> int:
    """The edits that same_body grants two words, the shorter of this length."""
    return 1 if length < 6 else 2


def unit_keys(unit: str) -> list[str]:
    return index_keys(unit, reach(len(unit)))


def asked_keys(unit: str, longer: bool) -> set[str]:
    """What finds every unit within reach: those as long or shorter, and the longer ones too."""
    n = len(unit)
    return set().union(*(_probes(unit, m, reach(m)) for m in range(max(2, n - 2), n + (2 if longer else 0) + 1) if abs(n - m) <= reach(m) < m))


def joined_words(core: Sequence[str]) -> list[str]:
    """Any two words written as one, in either order: what a single word of another name may be."""
    return [x + y for i, x in enumerate(core) for j, y in enumerate(core) if i != j]


def name_nodes(base: DataFrame, least: int, share: float, words_of: DataFrame | None = None) -> tuple[DataFrame, frozenset[str]]:
    """The parsed names of nodes (n, side, code, alias, sigle, place), written to the shared folder, and the known words.

    A word is known if it has its share of all names and also of those outside the municipality that has it most: a district's or
    patron's name in a large municipality, or an organisation of many spellings, stays an own word.
    """
    source = base if words_of is None else words_of
    here = F.coalesce("code", F.lit("?")).alias("here")
    local = source.select(here, F.explode(F.array_distinct(F.split("alias", " "))).alias("w")).groupBy("w", "here").agg(F.count("*").alias("k"))
    words = local.groupBy("w").agg(F.sum("k").alias("k"), F.max(F.struct("k", "here")).alias("most"))
    total = source.count()
    often = words.where(F.col("k") >= F.lit(max(least, share * total))).join(source.groupBy(here).agg(F.count("*").alias("size")), F.col("most.here") == F.col("here"))
    known = frozenset(r.w for r in often.where(F.col("k") - F.col("most.k") >= F.lit(share) * (F.lit(total) - F.col("size"))).toLocalIterator())
    return parse_names(base, known), known


def parse_names(base: DataFrame, known: frozenset[str]) -> DataFrame:
    shared = base.sparkSession.sparkContext.broadcast(known)

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse(a, s or "", p, shared.value) for a, s, p in zip(b["alias"], b["sigle"], b["place"], strict=True)]
            yield b.assign(sigle=[s or "" for s in b["sigle"]], **{c: [list(g[i]) for g in got] for i, c in enumerate(("core", "known", "short", "sig"))})

    return materialise(base.select("n", "side", "code", "alias", "sigle", "place").mapInPandas(parsed, PARSED), "names")


def with_names(pairs: DataFrame, a_names: DataFrame, b_names: DataFrame) -> DataFrame:
    for s, names in (("a", a_names), ("b", b_names)):
        pairs = pairs.join(names.select(F.col("n").alias(s), F.struct("alias", "sigle", "place", "core", "known", "short", "sig").alias(f"{s}_name")), s)
    return pairs


def name_owners(records: DataFrame) -> DataFrame:
    """Every name of every id with its node n, which equal names of one municipality share: id, n, code, alias, sigle, place, region."""
    region = F.upper(F.trim("region")) if "region" in records.columns else F.lit(None).cast("string")
    base = records.select(
        "id", "code", region.alias("region"), F.explode(F.array_distinct(F.array(normalise_name(F.col("name")), normalise_name(F.col("alt_name"))))).alias("alias"), F.regexp_replace(normalise_name(F.col("sigle")), " ", "").alias("sigle"),
        F.coalesce(normalise_name(F.col("place")), F.lit("")).alias("place"),
    ).where("id is not null and alias is not null and alias <> ''")
    node = F.xxhash64(F.coalesce("code", F.lit("?")), "alias").alias("n")
    return materialise(base.select("id", node, "code", "alias", "sigle", "place", "region").distinct(), "name-owners")


def owner_nodes(owners: DataFrame) -> DataFrame:
    return materialise(owners.groupBy("n").agg(*(F.max(c).alias(c) for c in ("code", "alias", "sigle", "place"))).withColumn("side", F.lit(1)), "nodes")


def verified_pairs(pairs: DataFrame, names: DataFrame, *, least: int = 2, share: float = 0.3) -> DataFrame:
    """a, b, sides of near pairs whose names name one body.

    Other words for one activity are mined: where names agree but for some words on either side, it is counted in how many municipalities these stand for each other. They
    mean the same if that is so in `least` of them and in a share of the names that have the rarer of the two at all: names with a mere other
    word for something mostly have a partner with the usual one, while two different activities seldom share the rest of their names.
    """
    full = with_names(pairs, names, names)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, j, k, x, y in zip(b["a"], b["b"], b["sides"], b["a_name"], b["b_name"], strict=True):
                p, q = _lists(x), _lists(y)
                same, only_p, only_q = compare(p, q)
                if same:
                    rows.append((i, j, k, None, None))
                elif only_p and only_q:
                    rows.append((i, j, k, *sorted((" ".join(only_p), " ".join(only_q)))))
            yield pd.DataFrame(rows, columns=["a", "b", "sides", "u", "v"])

    judged = materialise(full.mapInPandas(verify, "a long, b long, sides int, u string, v string"), "judged")
    unlike = judged.where("u is not null")
    place = names.select("n", "code")
    placed = unlike.join(place.toDF("a", "ca"), "a").join(place.toDF("b", "cb"), "b").withColumn("here", F.coalesce("ca", "cb"))
    both = materialise(placed.groupBy("u", "v").agg(F.count_distinct("here").alias("k")).where(F.col("k") >= least), "exchanged")
    terms = both.select(F.col("u").alias("t")).unionByName(both.select(F.col("v").alias("t"))).distinct()
    # names with a term: at most as many as with the rarest of its words
    words = names.where("side = 1").select(F.explode(F.array_distinct(F.split("alias", " "))).alias("w"))
    held = terms.select("t", F.explode(F.split("t", " ")).alias("w")).join(words.groupBy("w").agg(F.count("*").alias("n")), "w").groupBy("t").agg(F.min("n").alias("n"))
    mined = both.join(held.toDF("u", "nu"), "u").join(held.toDF("v", "nv"), "v").where(F.col("k") >= F.lit(share) * F.least("nu", "nv"))
    return judged.where("u is null").select("a", "b", "sides").unionByName(unlike.join(mined.select("u", "v"), ["u", "v"]).select("a", "b", "sides"))


def link_nodes(owners: DataFrame, names: DataFrame, verified: DataFrame, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, organisation, code of the owners' ids; loose, organisation: names of unknown municipality that fit several organisations; node, component of all linked nodes).

    others: further edges (a, b), between nodes that no owner has, whose components are found in the same rounds.

    Linked names, and the several names of one id, are components within a municipality, so no organisation spans two. Names without municipality are
    components among themselves; one that fits the names of a single organisation joins it, one that fits several stays on its own and is listed.
    """
    nodes = names.where("side = 1").select(F.col("n").alias("node"), "code", "alias")
    # equal names, also without own words: one municipality known, the other not
    alike = nodes.where("code is null").select(F.col("node").alias("a"), "alias").join(nodes.where("code is not null").select(F.col("node").alias("b"), "alias"), "alias").select("a", "b")
    several = owners.groupBy("id").agg(F.min("n").alias("first"), F.count("*").alias("k")).where("k > 1")
    bridges = owners.join(several, "id").where("n <> first").select(F.col("first").alias("a"), F.col("n").alias("b"))
    links = verified.where("sides = 2").select("a", "b").unionByName(alike).unionByName(bridges)
    places = nodes.select("node", "code")
    edges = links.join(places.select(F.col("node").alias("a"), F.col("code").alias("ca")), "a").join(places.select(F.col("node").alias("b"), F.col("code").alias("cb")), "b")
    edges = materialise(edges.select("a", "b", "ca", "cb"), "links")
    within = edges.where(F.col("ca").eqNullSafe(F.col("cb"))).select("a", "b")
    inner = components(within if others is None else within.unionByName(others))
    placed = places.join(inner, "node", "left").select("node", "code", F.coalesce("component", "node").alias("component"))
    outer = edges.where(F.col("ca").isNull() != F.col("cb").isNull()).select(F.when(F.col("ca").isNull(), F.col("a")).otherwise(F.col("b")).alias("l"), F.when(F.col("ca").isNull(), F.col("b")).otherwise(F.col("a")).alias("r"))
    group = placed.select("node", "component")
    fits = materialise(outer.join(group.toDF("l", "loose"), "l").join(group.toDF("r", "organisation"), "r").select("loose", "organisation").distinct(), "fits")
    single = fits.groupBy("loose").agg(F.count("*").alias("k"), F.min("organisation").alias("to")).where("k = 1").select("loose", "to")
    joined = owners.join(placed.select(F.col("node").alias("n"), "component"), "n").join(single, F.col("component") == F.col("loose"), "left")
    linked = joined.groupBy("id").agg(F.min(F.coalesce("to", "component")).alias("organisation"), F.max("code").alias("code"))
    return linked, fits.join(single.select("loose"), "loose", "left_anti"), inner


def link_variants(records: DataFrame, *, least: int = 8, share: float = 0.007) -> DataFrame:
    """id, organisation (the same for all ids of one organisation, which lies in one municipality), code (null: unknown).

    records: id, code, name, alt_name, sigle, place (the municipality's name). An id may have several rows.

    Names are normalised, and equal names of one municipality are one node, so copies cost nothing. Words found in at least
    `least` names and a share of them (at most words-per-name / share words: the bound of their broadcast), also outside their first municipality, are known
    words, of activities and first names; the others are a name's own. Own words meet that are equal after as many letters are taken out as the verification grants edits;
    any two written together are cut into three segments, which meet the position-shifted substrings of long words; both within one municipality, and across all for names without one.
    Pairs of names of which, on one side, all own words can have a counterpart (near_names) are verified
    by edit distance in a band over the names' aligned tokens; other words for an activity are mined from
    the pairs that differ in nothing else. Linked names and the several names of one id form the organisations as connected components.

    Null or blank names have no node; a name without own words links to names of the same words only. Ties and repeated rows
    change nothing. Empty table: no rows.
    """
    linked, _ = linked_and_loose(records, least=least, share=share)
    return linked


def linked_and_loose(records: DataFrame, *, least: int = 8, share: float = 0.007) -> tuple[DataFrame, DataFrame]:
    """link_variants, and loose, organisation: bodies of unknown municipality that fit several organisations."""
    owners = name_owners(records)
    names, _ = name_nodes(owner_nodes(owners), least, share)
    linked, loose, _ = link_nodes(owners, names, verified_pairs(near_names(names), names))
    return materialise(linked, "organisations"), loose


def variant_pairs(linked: DataFrame, loose: DataFrame) -> DataFrame:
    """id_a < id_b of one organisation; an id of unknown municipality that fits several organisations is paired with the ids of each."""
    sides = [linked.select(F.col("id").alias(f"id_{s}"), "organisation") for s in ("a", "b")]
    inside = sides[0].join(sides[1], "organisation").where("id_a < id_b").select("id_a", "id_b")
    ids = linked.select("id", "organisation")
    across = loose.join(ids.select(F.col("organisation").alias("loose"), F.col("id").alias("x")), "loose").join(ids.select("organisation", F.col("id").alias("y")), "organisation").where("x <> y")
    return inside.unionByName(across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))).distinct()
