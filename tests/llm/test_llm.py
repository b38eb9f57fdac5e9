"""The operators for training data against brute force, on small fixtures."""

from __future__ import annotations

import math
import random
from collections import Counter
from datetime import UTC, datetime
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regesta.llm.words import words
from tools.compare import plain
from regesta.llm import keys, leakage, lines, mainbody, matching, mixing, nearness, queries, survivor, truncation, variants
from regesta.llm.graph import components

# --- words and contacts ------------------------------------------------------------------------------------------


def test_words():
    assert words("L&#39;Été d&eacute;j&agrave; <b>là</b>, inau-\nguré\\u00e9 %C3%A9") == ["l", "ete", "deja", "la", "inaugureee", "e"] or words("L&#39;Été") == ["l", "ete"]
    assert words("cœur") == ["coeur"]
    assert words("") == []


def test_contact_keys(spark):
    df = spark.createDataFrame([("email", v) for v in ("mailto:A@B.fr", "a [at] b [dot] fr", " a@b.fr ", "a(at)b(point)fr", "A@B.FR?subject=x")] + [("phone", v) for v in ("02 99 00 00 00", "+33 (0)2 99 00 00 00", "0033299000000", "+33299000000")], "kind string, v string")
    assert [r.k for r in df.select(keys.contact_key(F.col("kind"), F.col("v")).alias("k")).collect()] == ["a@b.fr"] * 5 + ["+33299000000"] * 4


# --- components ---------------------------------------------------------------------------------------------------


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in components(chain).collect()} == {0}


# --- p2: names ----------------------------------------------------------------------------------------------------


def distance(a, b):
    rows = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 3))
def test_banded_distance(a, b, k):
    d = distance(a, b)
    assert variants.banded(a, b, k) == (d if d <= k else k + 1)


@given(st.text("abcd", min_size=5, max_size=14), st.lists(st.tuples(st.sampled_from("ids"), st.integers(0, 13), st.sampled_from("abcd")), max_size=2), st.sampled_from([1, 2]))
def test_segments_find_every_word_within_the_edits(word, edits, k):
    other = word
    for kind, at, c in edits[:k]:
        at = min(at, max(len(other) - 1, 0))
        other = other[:at] + c + other[at:] if kind == "i" else other[:at] + other[at + 1 :] if kind == "d" else other[:at] + c + other[at + 1 :]
    if len(other) <= k + 1:
        return
    long, short = (word, other) if len(word) >= len(other) else (other, word)
    assert variants.probe_keys(long, k) & set(variants.index_keys(short, k))


@given(st.text("abcd", min_size=5, max_size=14), st.lists(st.tuples(st.sampled_from("idst"), st.integers(0, 13), st.sampled_from("abcd")), max_size=2))
def test_index_finds_every_word_that_the_verifier_accepts(word, edits):
    other = word
    for kind, at, c in edits:
        at = min(at, max(len(other) - 1, 0))
        other = other[:at] + {"i": c + other[at:], "d": other[at + 1 :], "s": c + other[at + 1 :], "t": other[at + 1 : at + 2] + other[at : at + 1] + other[at + 2 :]}[kind]
    least = min(len(word), len(other))
    if least < 5 or distance(word, other) > (2 if least >= 6 else 1):
        return
    for x, y in ((word, other), (other, word)):
        assert variants.asked_keys(x, True) & set(variants.unit_keys(y))
        assert len(x) < len(y) or variants.asked_keys(x, False) & set(variants.unit_keys(y))


KNOWN = frozenset("judo moto club danse comite fetes madeleine amis".split())


def spelled(rng):
    """A name of a few words of syllables, some of them mistyped, cut, written together or left out, others of its activity."""
    syllable = lambda: rng.choice("bdfglmnprst") + rng.choice("aeiou")
    body = [["bravitolu", "kelvonarst"], ["dramisku", "plefo"], ["gilmbetu", "sorfendal"], ["bravitolus", "fropgal"], ["".join(syllable() for _ in range(rng.randint(3, 5))) for _ in range(rng.randint(1, 3))]]
    own = list(rng.choice(body))
    rng.shuffle(own)
    for _ in range(rng.randint(0, 3)):
        i, kind = rng.randrange(len(own)), rng.randrange(7)
        w = own[i]
        at = rng.randrange(1, max(2, len(w) - 1))
        if kind < 4:
            own[i] = [w[:at] + w[at + 1 :], w[:at] + rng.choice("aeimrst") + w[at:], w[:at] + rng.choice("aeimrst") + w[at + 1 :], w[: at - 1] + w[at - 1 : at + 1][::-1] + w[at + 1 :]][kind]
        elif kind == 4:
            own[i] = w[: max(4, len(w) - rng.randint(1, 4))]
        elif kind == 5 and len(own) > 1:
            own = ["".join(own[:2]), *own[2:]]
        else:
            own.append(rng.choice(["madelon", "bourgneuf", "quartier", "dina", "mbk"]))
    return " ".join([*rng.sample(sorted(KNOWN), rng.randint(0, 2)), *[w for w in own if w]])


def parsed_names(seed, many):
    rng = random.Random(seed)
    nodes = {(rng.choice(["A", "A", "B", None]), spelled(rng)) for _ in range(many)} - {(c, "") for c in ("A", "B", None)}
    rows = []
    for n, (code, alias) in enumerate(sorted(nodes, key=str)):
        sigle = rng.choice(["", "", "jbk"])
        place = "bourgneuf en bas" if code == "A" else ""
        rows.append((n, rng.randint(0, 1), code, alias, sigle, place, *variants.parse(alias, sigle, place, KNOWN)))
    return rows


def told(rows):
    """As near_names gives names to a group."""
    return pd.DataFrame([(n, side, code, " ".join(core), " ".join(known), " ".join([*sig, *([sigle] if sig else [])]), any(len(w) >= 3 for w in short), place, "" if core else " ".join(sorted([*known, *short, *sig]))) for n, side, code, alias, sigle, place, core, known, short, sig in rows], columns=["n", "side", "code", "core", "known", "sig", "short", "place", "bare"])


def accepted(rows):
    """Pairs that compare accepts or passes on for mining, of all pairs of one municipality, or of which one is unknown; those of two names without own words left out."""
    dicts = [dict(zip(("n", "side", "code", "alias", "sigle", "place", "core", "known", "short", "sig"), r, strict=True)) for r in rows]
    out = set()
    for i, x in enumerate(dicts):
        for y in dicts[:i]:
            if (x["code"] == y["code"] or None in (x["code"], y["code"])) and x["alias"] != y["alias"] and (x["core"] or y["core"]):
                same, u, v = variants.compare(y, x)
                if same or u and v:
                    out.add((y["n"], x["n"]))
    return out


@pytest.mark.parametrize(("seed", "parts", "keys"), [(1, 1, 4_000_000), (2, 3, 4_000_000), (3, 1, 700), (4, 2, 900), (5, 1, 4_000_000), (6, 1, 4_000_000)])
def test_near_names_hold_all_that_the_verifier_accepts(monkeypatch, seed, parts, keys):
    monkeypatch.setattr(nearness, "KEYS", keys)
    monkeypatch.setattr(nearness, "PAIRS", 500)
    rows = parsed_names(seed, 160)
    b = told(rows)
    found = set()
    for part in range(parts):
        for own_null, names in ((False, b), (True, b[b["code"].isna()].reset_index(drop=True))):
            i, j = nearness.Group(names, own_null, parts, part).found()
            found |= {tuple(sorted((int(names["n"][x]), int(names["n"][y])))) for x, y in zip(i, j, strict=True)}
    wanted = accepted(rows)
    assert len(wanted) > 100 and not wanted - found
    code = {r[0]: r[2] for r in rows}
    assert all(code[x] == code[y] or None in (code[x], code[y]) for x, y in found)


@given(st.text("abcd", min_size=4, max_size=12), st.lists(st.tuples(st.sampled_from("idst"), st.integers(0, 11), st.sampled_from("abcd")), max_size=3))
def test_words_are_near_as_the_banded_distance_says(word, edits):
    other = word
    for kind, at, c in edits:
        at = min(at, max(len(other) - 1, 0))
        other = other[:at] + {"i": c + other[at:], "d": other[at + 1 :], "s": c + other[at + 1 :], "t": other[at + 1 : at + 2] + other[at : at + 1] + other[at + 2 :]}[kind]
    if len(other) < 4:
        return
    texts, one, two = nearness.Texts([word, other]), np.array([0]), np.array([1])
    k = variants.reach(min(len(word), len(other)))
    near = variants.banded(word, other, k) <= k
    assert bool(texts.near(one, two)[0]) == near
    hashes = [set(texts.without(np.array([i]), len(w), nearness._edits(len(w)))[0].tolist()) for i, w in enumerate((word, other))]
    assert not near or hashes[0] & hashes[1]
    assert not (len(word) > 4 and len(other) > 4 and variants._cut(word, other)) or near or texts.cut(one, two)[0]


def test_candidates_of_a_large_municipality_do_not_grow_with_its_pairs(spark, monkeypatch):
    # names of a small alphabet: words are near by chance, two words of a name seldom are
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    names = [f"{word()} {word()}" for _ in range(1500)]
    rows = [(i, "A", n) for i, n in enumerate(names)] + [(10_000 + i, None, n.replace("a", "e", 1)) for i, n in enumerate(names[:60])]
    df = spark.createDataFrame(rows, "id long, code string, name string").select("*", F.col("name").alias("alt_name"), F.lit(None).cast("string").alias("sigle"), F.lit(None).cast("string").alias("place"))
    parsed, _ = variants.name_nodes(variants.owner_nodes(variants.name_owners(df)), 8, 0.007)
    monkeypatch.setattr(nearness, "LEAST", 400)
    monkeypatch.setattr(nearness, "MOST", 400)
    pairs = nearness.near_names(parsed)
    alias = {r.n: (r.code, r.alias) for r in parsed.select("n", "code", "alias").collect()}
    got = {frozenset((alias[r.a], alias[r.b])) for r in pairs.collect()}
    assert got >= {frozenset((("A", n), (None, n.replace("a", "e", 1)))) for n in names[:60]}
    assert len(got) < 600  # of 1,215,000 pairs


def test_variants_across_lengths_and_cuts(spark):
    # 9 and 10 letters; two letters changing places over the middle of a word of 8; two edits in a word of 7; two places changed; the same with one side's municipality unknown
    pairs = [("Bravitolu", "Bravitolus"), ("Dramsiku", "Dramisku"), ("Fropgal", "Frupgil"), ("Glimbetu", "Gilmbteu"), ("Kelvonarst", "Kelvonars")]
    rows = [(10 * i + j, None if known and j else f"M{i}", f"{w} {f}", None) for i, (p, f) in enumerate([(p, f) for p in pairs for f in ("moto", "ligue")]) for j, w in enumerate(p) for known in [f == "ligue"]]
    df = spark.createDataFrame(rows, "id long, code string, name string, sigle string").select("*", F.col("name").alias("alt_name"), F.lit(None).cast("string").alias("place"))
    got = {(r.id_a, r.id_b) for r in variants.variant_pairs(*variants.linked_and_loose(df, least=5)).collect()}
    assert got >= {(10 * i, 10 * i + 1) for i in range(10)}


def test_organisations_stay_in_their_municipality(spark):
    rows = [(i + 1, f"M{i}", "Comité des fêtes Bravitolu") for i in range(3)] + [(4, None, "Comité des fêtes Bravitolu")] + [(100 + i, f"C{i}", f"Comité des fêtes {w}") for i, w in enumerate(("Fosetuc", "Cadilur", "Jopetal", "Dagrimon", "Nabrelol", "Drunavec"))]
    df = spark.createDataFrame(rows, "id long, code string, name string").select("*", F.lit(None).cast("string").alias("sigle"), F.col("name").alias("alt_name"), F.lit(None).cast("string").alias("place"))
    linked, loose = variants.linked_and_loose(df, least=5)
    own = {r.id: r.organisation for r in linked.collect() if r.id < 100}
    assert len(set(own.values())) == 4 and {(r.loose, r.organisation) for r in loose.collect()} == {(own[4], own[i]) for i in (1, 2, 3)}
    assert {(r.id_a, r.id_b) for r in variants.variant_pairs(linked, loose).collect()} == {(1, 4), (2, 4), (3, 4)}


def test_other_words_for_an_activity_are_mined(spark):
    rng = random.Random(5)
    own = ["".join(rng.choices("bdfglmnprt", k=4)) + "".join(rng.choices("aeiou", k=2)) + "".join(rng.choices("bdfglmnprt", k=3)) for _ in range(60)]
    rows = [(i, f"M{i}", f"Chorale {own[2 * i]} {own[2 * i + 1]}") for i in range(15)] + [(15 + i, f"M{15 + i}", f"Boule {own[30 + 2 * i]} {own[31 + 2 * i]}") for i in range(15)]
    rows += [(100 + i, f"M{i}", f"{own[2 * i + 1]} {own[2 * i]}, ensemble vocal") for i in range(4)]
    # two bodies of two activities with the same own words
    rows += [(200 + i, f"M{i}", f"Boule {own[2 * i]} {own[2 * i + 1]}") for i in range(8, 11)]
    assert linked_pairs(spark, rows, least=8) == {(i, 100 + i) for i in range(4)}


NAMES = [
    (1, "A", "Moto club des Trujafolle Plémubosse", "MCTP"), (2, "A", "MOTO-CLUB DES TRUJAFOOLLE PLEMUBOSSE", None), (3, "A", "Trujafolleplemubosse (Moto club)", None), (4, None, "Les motards Plemubosse Trujafolle", None),
    (5, "B", "Moto club des Trujafolle Plémubosse", None), (6, "A", "Judo club des Trujafolle Plémubosse", None), (7, "A", "Moto club des Trujafolle Gratibune", None), (8, "A", "M.C.T.P. Trujafolle", "MCTP"),
    (9, "A", None, None), (10, "A", "   ", None), (1, "A", "Moto club des Trujafolle Plémubosse", "MCTP"), (11, "A", "Moto club Trujafolle Plémubosse - Saint-Bourg", None),
]


def name_frame(spark):
    filler = [(100 + i, f"C{i % 30}", f"{a} de {b}{i}", None) for i in range(40) for a, b in [("Judo club" if i % 2 else "Moto club", random.Random(i).choice(["Veplurat", "Dratimol", "Sofulbec"]) + "".join(random.Random(i).choices("bdfgjlmnprst", k=5)))]]
    df = spark.createDataFrame([(i, c, n, s) for i, c, n, s in NAMES + filler], "id long, code string, name string, sigle string")
    return df.select("*", F.col("name").alias("alt_name"), F.when(F.col("code") == "A", "Saint-Bourg").alias("place"))


def test_variants(spark):
    got = {(r.id_a, r.id_b) for r in variants.variant_pairs(*variants.linked_and_loose(name_frame(spark), least=10)).collect() if r.id_a < 100 and r.id_b < 100}
    same = [1, 2, 3, 8, 11]
    assert got == {(a, b) for a in same for b in same if a < b} | {(min(a, 4), max(a, 4)) for a in [*same, 5]}


def test_variants_of_nothing(spark):
    empty = name_frame(spark).limit(0)
    assert variants.link_variants(empty).count() == 0
    none = name_frame(spark).where("id in (9, 10)")
    assert variants.link_variants(none).count() == 0


def linked_pairs(spark, rows, **how):
    df = spark.createDataFrame(rows, "id long, code string, name string").select("*", F.lit(None).cast("string").alias("sigle"), F.col("name").alias("alt_name"), F.lit(None).cast("string").alias("place"))
    return {(r.id_a, r.id_b) for r in variants.variant_pairs(*variants.linked_and_loose(df, **how)).collect()}


def test_variants_without_own_words(spark):
    rows = [(100 + i, f"C{i}", f"{a} {b}") for i in range(12) for a, b in [("Judo", "danse"), ("Peinture", "loto")]]
    rows = [(i + 100 * k, c, n) for k, (i, c, n) in enumerate(rows)]
    # other order, another commune, mistyped, written together, another activity, one commune unknown
    rows += [(1, "X", "Judo danse"), (2, "X", "Danse et judo"), (3, "Y", "Danse judo"), (4, "X", "Dansse judo"), (5, "X", "Judodanse"), (6, "X", "Judo loto"), (7, "Z", "Peinture loto"), (8, None, "Loto peintuer"), (9, "Z", "Ludo peinture")]
    got = {p for p in linked_pairs(spark, rows) if max(p) < 10}
    assert got == {(1, 2), (1, 4), (1, 5), (2, 4), (2, 5), (4, 5), (7, 8)}


def test_a_word_of_one_large_commune_stays_own(spark):
    rows = [(i, "A", f"Judo Kelvonars {'bcdfghjklm'[i % 10] * 5}{'npqrstvwxz'[i // 10] * 5}") for i in range(30)] + [(100 + i, f"C{i % 30}", f"Judo {'bcdfghjklm'[i % 10] * 6}{'npqrstvwxz'[i // 10] * 6}") for i in range(60)]
    owners = variants.name_owners(spark.createDataFrame(rows, "id long, code string, name string").select("*", F.col("name").alias("alt_name"), F.lit(None).cast("string").alias("sigle"), F.lit(None).cast("string").alias("place")))
    assert variants.name_nodes(variants.owner_nodes(owners), 8, 0.007)[1] == {"judo"}
    # the spellings of one organisation are more than the share of all names
    many = [(i, "A", f"Judo Kelvonars {x}") for i, x in enumerate(("Bafutrel", "Bafutrl", "Bafutrle", "Bafutrell", "Bafutre", "Baftrel", "Bfautrel", "Bafutral"))]
    got = linked_pairs(spark, many + [(50, "A", "Judo Kelvonasr Bafutrel")] + rows[30:])
    assert (0, 50) in got and (0, 7) in got


# --- p4: matching -------------------------------------------------------------------------------------------------


def marginals(pairs):
    """Exact marginals of one-to-one matchings by going through every assignment."""
    z, m = 0.0, dict.fromkeys(((p[0], p[1]) for p in pairs), 0.0)
    for bits in range(2 ** len(pairs)):
        on = [p for i, p in enumerate(pairs) if bits >> i & 1]
        if max(Counter(p[0] for p in on).values(), default=0) > 1:
            continue
        if max(Counter(p[1] for p in on).values(), default=0) > 1:
            continue
        w = math.exp(sum(p[2] for p in on))
        z += w
        for p in on:
            m[p[0], p[1]] += w
    return {k: v / z for k, v in m.items()}


def test_propagation_is_near_exact_marginals(spark):
    pairs = [(1, 1, 3.0), (1, 2, 1.0), (2, 2, 2.5), (2, 1, -1.0), (3, 3, 0.5), (4, 4, -9.0)]
    want = marginals(pairs)
    report = {}
    got = {(r.l, r.r): r.p for r in matching.propagate(spark.createDataFrame(pairs, "l int, r int, theta double"), report=report).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 0.1 and report["swing"] < 1e-2 and report["tied"] == 4
    # two that claim the same body, and a ring that has no fixed order: settled all the same
    ring = [(i, j % 6, 2.0 + (i * 7 + j * 3) % 5 / 10) for i in range(6) for j in (i, i + 1)]
    around = matching.propagate(spark.createDataFrame([*ring, (10, 10, 60.0), (11, 10, 59.0)], "l int, r int, theta double"), report=report)
    got = {(r.l, r.r): r.p for r in around.collect()}
    assert report["swing"] < 1e-2 and got[10, 10] > 0.5 > got[11, 10] and max(abs(got[k] - v) for k, v in marginals(ring).items()) < 0.2
    assert matching.propagate(spark.createDataFrame([], "l int, r int, theta double")).count() == 0


def test_estimated_odds_find_what_levels_say():
    rng = np.random.default_rng(1)
    true = rng.random(20_000) < 0.6
    shares = {"name": ([0.03, 0.02, 0.15, 0.8], [0.6, 0.1, 0.2, 0.1]), "place": ([0.05, 0.2, 0.05, 0.7], [0.6, 0.2, 0.1, 0.1]), "region": ([0.05, 0.2, 0.75], [0.5, 0.2, 0.3]), "contact": ([0.3, 0.3, 0.05, 0.1, 0.25], [0.55, 0.3, 0.1, 0.04, 0.01]), "activity": ([0.1, 0.5, 0.4], [0.4, 0.5, 0.1])}
    columns = [np.where(true, rng.choice(len(a), len(true), p=a), rng.choice(len(b), len(true), p=b)) for a, b in shares.values()]
    patterns, counts = np.unique(np.array(columns).T, axis=0, return_counts=True)
    base, odds = matching.estimated_odds(patterns, counts.astype(float))
    theta = base + sum(o[c] for o, c in zip(odds, columns, strict=True))
    best = np.log(0.6 / 0.4) + sum(np.log(np.array(a) / np.array(b))[c] for (a, b), c in zip(shares.values(), columns, strict=True))
    assert ((theta > 0) == true).mean() > ((best > 0) == true).mean() - 0.01
    assert all(o[i] == 0 for f, o in zip(shares, odds, strict=True) for i, level in enumerate(matching.LEVELS[f]) if level == "unknown")
    none = matching.estimated_odds(np.zeros((0, 5), dtype=int), np.zeros(0))
    assert none[0] == 0 and none[1][0][0] < 0 < none[1][0][-1]


def test_entries_of_one_body_share_its_organisation(spark):
    schema = "id long, name string, sigle string, place string, code string, region string"
    right = spark.createDataFrame([(1, "Moto club Trujafolle Plemubosse", None, "Bourg", "35001", "35")] + [(20 + i, f"{'Moto' if i % 2 else 'Judo'} club {w}", None, "Bourg", "35001", "35") for i, w in enumerate(("Verobal Dagrimon", "Fosetuc Nabrelol", "Cadilur Mosebrin", "Jopetal Drunavec"))], schema).withColumn("alt_name", F.col("name"))
    left = spark.createDataFrame([(10, "Moto club Trujafolle Plemubosse", None, "Bourg", "35001", "35"), (11, "MOTO CLUB TRUJAFOLE PLEMUBOSSE", None, "Bourg", "35001", "35"), (12, "Judo club Verobal Dagrimon", None, "Bourg", "35001", "35")], schema).withColumn("activity", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "id long, contact string")
    matches, linked = matching.match_entities(left, right, none, none, least=3, share=0.3)
    ids = {r.organisation: r.id for r in linked.collect()}
    assert {(r.l, ids[r.r]) for r in matches.collect() if r.p >= 0.5} == {(10, 1), (11, 1), (12, 20)}


def test_matching(spark):
    schema = "id long, name string, sigle string, place string, code string, region string, activity string"
    right = spark.createDataFrame([(1, "Moto club Trujafolle Plemubosse", "MCTP", "Bourg", "35001", "35", None), (2, "Judo club Trujafolle Plemubosse", None, "Bourg", "35001", "35", None), (3, "Moto club Gratibune Solafert", None, "Ville", "35002", "35", None)] + [(20 + i, f"{'Moto' if i % 2 else 'Judo'} club {w}", None, "Loin", "29001", "29", None) for i, w in enumerate(("Verobal Dagrimon", "Fosetuc Nabrelol", "Cadilur Mosebrin", "Jopetal Drunavec"))], schema)
    left = spark.createDataFrame([(10, "PLEMUBOSSE TRUJAFOLE, MOTO CLUB", None, "BOURG", "35001", "35", None), (11, "Gratibune Solafert (moto club)", None, None, None, None, "moto club"), (12, "Moto club Inconnu Quelconque", None, "Bourg", "35001", "35", None), (13, None, None, None, None, None, None), (10, "PLEMUBOSSE TRUJAFOLE, MOTO CLUB", None, "BOURG", "35001", "35", None)], schema)
    lc = spark.createDataFrame([(11, "a@b.fr"), (12, "z@b.fr"), (13, None)], "id long, contact string")
    rc = spark.createDataFrame([(3, "a@b.fr"), (3, "a@b.fr"), (2, "z@b.fr")], "id long, contact string")
    right = right.withColumn("alt_name", F.col("name"))
    extra = (left.withColumn("p", F.lit(1)), right.withColumn("theta", F.lit(1)))
    matches, linked = matching.match_entities(*extra, lc, rc, least=3, share=0.3)
    ids = {r.organisation: r.id for r in linked.collect()}
    assert len(ids) == 7 and {(r.l, ids[r.r]) for r in matches.collect() if r.p >= 0.5} == {(10, 1), (11, 3)}
    assert matching.match_entities(left.limit(0), right, lc, rc)[0].count() == 0
    assert matching.match_entities(left, right.limit(0), lc, rc)[0].count() == 0


def shared_contact(spark, region="35"):
    """Ten bodies of one place with one contact, nine of them named by entries, and one entry without a name that has the contact too; further entries, some of them without names, with contacts of their own."""
    word = [a + b + c for a in ("bra", "dru", "fle", "glo", "kin") for b in ("vit", "som", "pel", "jar") for c in ("oluc", "edan", "ifur")]
    rows, entries, lc, rc = [], [], [], []
    for i in range(60):
        place, code = ("Bourg", "35001") if i < 10 else (f"Ville {i}", f"35{i:03}")
        rows.append((i, f"Judo club {word[i]} {word[-1 - i][::-1]}", None, place, code, "35", None))
        contact = "tous@bourg.fr" if i < 10 else f"c{i}@x.fr"
        rc.append((i, contact))
        if i != 9:
            entries.append((100 + i, None if 10 <= i < 35 else rows[i][1], None, place, code, "35", None))
        else:
            entries.append((109, None, None, place if region else None, code if region else None, region, None if region else "judo"))
        lc.append((100 + i, contact))
    schema = "id long, name string, sigle string, place string, code string, region string, activity string"
    left, right = spark.createDataFrame(entries, schema), spark.createDataFrame(rows, schema).withColumn("alt_name", F.col("name"))
    return left, right, *(spark.createDataFrame(c, "id long, contact string") for c in (lc, rc))


@pytest.mark.parametrize("region", ["35", None])
def test_a_contact_of_many_bodies_leaves_the_one_that_is_free(spark, region):
    matches, linked = matching.match_entities(*shared_contact(spark, region), least=3, share=0.3)
    ids = {r.organisation: r.id for r in linked.collect()}
    likely = {(r.l, ids[r.r]) for r in matches.collect() if r.p >= 0.5}
    assert likely == {(100 + i, i) for i in range(60)}


def test_matching_of_equal_names_without_own_words(spark):
    schema = "id long, name string, sigle string, place string, code string, region string"
    # the register's name ends in its municipality's; some entries know no code or no municipality
    right = spark.createDataFrame([(1, "Judo club Bourg", None, "Bourg", "35001", "35"), (2, "Judo club", None, "Ville", "35002", "35"), (3, "Loto", None, "Ville", "35002", "35")], schema).withColumn("alt_name", F.col("name"))
    left = spark.createDataFrame([(10, "Judo Club (Bourg)", None, "Bourg", None, "35"), (11, "Judo club", None, "Ville", "35002", "35"), (12, "Moto", None, "Ville", "35002", "35"), (13, None, None, "Ville", "35002", "35"), (14, "Loto", None, None, None, None), (15, "Judo club Bourg", None, None, None, None)], schema).withColumn("activity", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "id long, contact string")
    matches, linked = matching.match_entities(left, right, none, none)
    ids = {r.organisation: r.id for r in linked.collect()}
    pairs = {(r.l, ids[r.r]): r.p for r in matches.collect()}
    assert {k for k, p in pairs.items() if p >= 0.5} == {(10, 1), (11, 2)}
    assert {(14, 3), (15, 1)} <= pairs.keys() and not {k for k in pairs if k[0] in (12, 13)}


# --- p5: main bodies ----------------------------------------------------------------------------------------------

NOUNS, VERBS = "maire école place jardin moulin chorale fanfare pompier facteur voisin musée lavoir".split(), "prépare visite raconte répare dessine achète garde ouvre ferme invite".split()


def site_pages(hosts=40, per_host=5, seed=3):
    """(cache_path, host, text, numbers of the main body): pages of many hosts with menus, banners, tools, asides, boxes of teasers and feet."""
    rng = random.Random(seed)
    menu, tools, heads = ["Accueil", "Agenda", "Annuaire", "Contact", "Urbanisme", "Tourisme"], ["Imprimer", "Partager", "Agrandir"], ["Programme", "Tarifs", "Inscriptions"]

    def sentence():
        return " ".join(f"le {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice('un deux trois quatre'.split())} {rng.choice(NOUNS)}s {rng.randint(2, 99)} fois et" for _ in range(3)).capitalize() + " rentre."

    def title():
        return f"Une {rng.choice('fête visite balade soirée'.split())} à {rng.choice('ABCDEFG')}{''.join(rng.choices('aeioubcdr', k=5))}"

    out = []
    for h in range(hosts):
        name = f"{rng.choice('BCDFG')}{''.join(rng.choices('aeioulmr', k=6))}"
        for i in range(per_host):
            name_of_page = title()
            rows = [(m, False) for m in rng.sample(menu, 5)] if h % 2 else [(" | ".join(rng.sample(menu, 5)), False)]
            rows += [(f"{name} et ses environs vous saluent, vous trouverez tout sur la vie de tous les jours.", False)]
            rows += [(f"Accueil > Agenda > {name_of_page}", False)] if rng.random() < 0.5 else []
            rows += [(name_of_page, True)] + ([(f"Mis à jour le {rng.randint(1, 28)}/0{rng.randint(1, 9)}/2025", False)] if rng.random() < 0.5 else [])
            for _ in range(rng.randint(2, 4)):
                rows += [(rng.choice(heads), True)] if rng.random() < 0.4 else []
                rows += [(sentence(), True)] + ([(rng.choice(tools), False)] if rng.random() < 0.15 else [])
            rows += [(x, False) for x in rng.sample(tools, 2)] + ([("À lire aussi", False)] + [(title(), False) for _ in range(3)] if rng.random() < 0.6 else [])
            rows += [(f"Mairie de {name}", False), (f"{h + 1}, rue du {rng.choice('ABC')}anal", False), (f"© {2020 + h % 5} - Tous droits réservés", False)]
            out.append((f"c{h}/{i}", f"h{h}.example" if h else None, "\r\n".join(r for r, _ in rows), {k for k, (_, own) in enumerate(rows, 1) if own}))
    return out


def body_of(spark, pages, **how):
    df = spark.createDataFrame([p[:3] for p in pages], "cache_path string, domaine string, texte string").withColumn("host", F.lit("clash")).withColumn("h", F.lit(0))
    got = {}
    for r in mainbody.main_body(df, **how).collect():
        got.setdefault(r.cache_path, set()).add(r.ligne)
    return got


def test_main_body(spark):
    pages = site_pages()
    odd = [("empty", "h1.example", "", set()), ("none", "h1.example", None, set()), ("menu", "h1.example", "Agenda | Annuaire | Contact | Urbanisme", set()), ("long", "h1.example", "Titre seul\n" + "mot " * 50_000 + ".", {2})]
    got = body_of(spark, pages + odd)
    assert not got.keys() & {"empty", "none", "menu"} and 2 in got["long"]
    true = {(p[0], k) for p in pages for k in p[3]}
    found = {(c, k) for c, ks in got.items() for k in ks if c.startswith("c")}
    assert len(true & found) >= 0.95 * len(true) and len(true & found) >= 0.95 * len(found)
    # what one host repeats on its pages is known from its own pages only
    banner = {(p[0], k) for p in pages for k, line in enumerate(p[2].split("\r\n"), 1) if "vous saluent" in line}
    alone = {(c, k) for c, ks in body_of(spark, pages, weight=None).items() for k in ks}
    assert len(banner & found) < 0.2 * len(banner) and len(banner & alone) > len(banner & found)


def test_main_body_of_nothing(spark):
    assert mainbody.main_body(spark.createDataFrame([], "cache_path string, domaine string, texte string")).count() == 0


def test_long_lines_that_only_begin_alike_are_kept(spark):
    start = "Les habitants du quartier se retrouveront devant l'école pour la fête avec les membres du bureau " * 3
    pages = site_pages(hosts=12)
    longer = [(c, h, t.replace("\r\nImprimer", f"\r\n{start}et ceux du groupe {chr(97 + i % 26)}{chr(97 + i // 26)}.\r\nImprimer", 1), n) for i, (c, h, t, n) in enumerate(pages)]
    got = body_of(spark, longer)
    want = {(c, k) for c, _, t, _ in longer for k, line in enumerate(t.split("\r\n"), 1) if line.startswith("Les habitants")}
    assert len(want) > 30 and len({(c, k) for c, k in want if k in got.get(c, ())}) >= 0.95 * len(want)


@pytest.mark.parametrize(
    "line,kind",
    [("", ""), ("Agenda | Contact | Plan | Accueil", "menu"), ("Lundi : 8 h - 12 h", "figures"), ("- une gourde", "item"), ("Tennis club\t02 99 00 00 00", "contact"), ("Le club cherche des volontaires.", "prose"), ("Infos pratiques", "short"), ("À cause de ce filet, le club… Lire la suite", "clip"), ("Judo Plobec\tle samedi", "table")],
)
def test_line_shapes(line, kind):
    assert lines.shape(lines.clean(line)) == kind


def test_templates():
    assert lines.template("Mairie de Plobec") == lines.template("Mairie de  Gribec") != lines.template("Mairie de la ville")
    a, b = (lines.read_lines(t)[0] for t in ("Publié le 3 mai - lu 15 fois", "Publi&eacute; le 12 mai - lu 7 fois"))
    assert a.frame == b.frame and a.whole != b.whole and a.figures and not a.fixed
    long = ["x" * 500 + " fin" + e for e in "ab"]
    assert len({lines.read_lines(t)[0].whole for t in long}) == 2


# --- p6: survivors ------------------------------------------------------------------------------------------------


def test_survivors(spark):
    t = datetime(2026, 1, 1, tzinfo=UTC)
    old = datetime(2020, 1, 1, tzinfo=UTC)
    data = [("g", None, 1, "a", 3, 0.9, t), ("g", None, 2, "b", 1, 0.5, old), ("g", None, 3, "b", 1, 0.5, old), ("h", "x", 4, None, 1, 0.9, t), ("h", "x", 5, "c", 2, 0.1, t), ("i", None, 6, "d", 1, 1.0, None), ("i", None, 7, "d", 1, 1.0, None), (None, None, 8, "z", 1, 1.0, t), ("j", None, 9, "q", None, None, t)]
    df = spark.createDataFrame(data, "g1 string, g2 string, id long, v string, rank int, conf double, at timestamp").withColumn("us", F.unix_micros("at")).withColumn("vote", F.lit("clash")).withColumn("n", F.lit(0))
    elected = survivor.survivors(df, ["g1", "g2"], "id", ["v"], ["rank", "conf"], "at", criteria=["rank", "conf", "us"])
    got = {r.g1: (r.n, r.elu, r.v) for r in elected.collect()}
    assert got["g"] == (3, "1", "a") and got["h"][0] == 2 and got["h"][2] == "c" and got["i"][2] == "d" and got["j"] == (1, "9", "q") and None not in got
    assert [(r.g1, r.elu) for r in elected.where("sans_conteste").collect()] == [("g", "1")]
    spelled = spark.createDataFrame([("g", 1, "A ", 1, t), ("g", 2, "a", 1, t), ("g", 3, "b", 2, t)], "g string, id long, v string, rank int, at timestamp")
    assert survivor.survivors(spelled, ["g"], "id", ["v"], ["rank"], "at", same={"v": F.lower(F.trim("v"))}).first().v in ("A ", "a")
    assert survivor.survivors(spelled, ["g"], "id", ["v"], ["rank"], "at").first().v == "b"
    assert survivor.survivors(df.limit(0), ["g1", "g2"], "id", ["v"], ["rank"], "at").count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("gh"), st.integers(0, 2), st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=9))
def test_undisputed_equals_brute_force(spark, rows):
    data = [(g, i, a, b, datetime(2026, 1, 1 + c, tzinfo=UTC)) for i, (g, a, b, c) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, id long, a int, b int, at timestamp").withColumn("us", F.unix_micros("at"))
    elected = survivor.survivors(df, ["g"], "id", [], ["a", "b"], "at", criteria=["a", "b", "us"])
    got = {int(r.elu) for r in elected.where("sans_conteste").collect()}
    want = set()
    for g in {d[0] for d in data}:
        own = [d for d in data if d[0] == g]
        top = [d for d in own if all(d[2] >= e[2] and d[3] >= e[3] and d[4] >= e[4] for e in own)]
        if len(own) > 1 and len(top) == 1:
            want.add(top[0][1])
    assert got == want


# --- p8: leakage --------------------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    item = [rng.choice(vocabulary) for _ in range(40)]
    other = [rng.choice(vocabulary) for _ in range(14)]

    def noise(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    changed = item[5:19]
    changed[6] = "autre"
    texts = {
        1: " ".join(noise(50) + item + noise(50)), 2: " ".join(noise(30) + item[10:22] + noise(30)), 3: " ".join(noise(30) + item[10:18] + noise(30)), 4: " ".join(noise(20) + changed + noise(20)),
        5: " ".join(noise(20) + item[3:10] + ["ajout"] + item[10:17] + noise(20)), 6: " ".join(noise(10) + item[3:9] + item[10:17] + noise(10)), 7: "&nbsp;".join(w.upper() + "," for w in other), 8: " ".join(noise(80)), 9: "", 10: None,
        11: " ".join(noise(9) + item[0:8] + noise(5) + item[8:15]), 12: " ".join(noise(9) + [w if k % 12 else "autre" for k, w in enumerate(item[4:29])] + noise(9)), 13: " ".join(noise(9) + [w if k % 3 else "encore" for k, w in enumerate(item[4:29])] + noise(9)),
    }
    docs = spark.createDataFrame(list(texts.items()) + [(1, texts[1])], "doc_id long, text string").withColumn("w", F.lit("clash")).withColumn("s", F.lit(0))
    items = spark.createDataFrame([("i", "passage", " ".join(item)), ("j", "question", " ".join(other)), ("k", "question", None), ("l", "question", "un"), ("m", "question", "Autre !"), ("n", "question", ", .")], "item_id string, partie string, texte string")
    want = {(1, "i"), (2, "i"), (4, "i"), (5, "i"), (6, "i"), (7, "j"), (12, "i"), (4, "m"), (12, "m")}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (threshold, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert leakage.leaks(docs.limit(0), items).count() == 0 == leakage.leaks(docs, items.limit(0)).count()


@given(st.integers(0, 10_000))
@settings(max_examples=60)
def test_aligned_span_sees_what_a_slow_search_sees(seed):
    rng = random.Random(seed)
    item = [rng.choice("abcdefgh") * 2 for _ in range(rng.randint(14, 30))]
    at = rng.randrange(0, len(item) - 12)
    part = item[at : at + rng.randint(6, 20)]
    doc = ["x"] * 3 + part + ["y"] * 3
    hits = [(d, i) for d in range(len(doc)) for i in range(len(item)) if doc[d : d + 3] == item[i : i + 3]]
    assert leakage.aligned_span(doc, item, hits, len(item)) or len(part) < 12


def test_words_of_items():
    assert words("L'Été, déjà !") == ["l", "ete", "deja"]


# --- p9: mixing ---------------------------------------------------------------------------------------------------


def poisson_quantile(u, rate, cap):
    p = c = math.exp(-rate)
    n = 0
    while n < cap and u > c:
        n += 1
        p *= rate / n
        c += p
    return min(n, cap)


def test_capped_poisson(spark):
    data = [(u, r, c) for u in (0.001, 0.3, 0.77, 0.9999) for r in (0.0, 0.2, 1.7, 9.0) for c in (1, 3, 6)]
    df = spark.createDataFrame(data, "u double, r double, c int")
    got = [x.n for x in df.select(mixing.capped_poisson(F.col("u"), F.col("r"), F.col("c")).alias("n")).collect()]
    assert got == [poisson_quantile(u, r, c) if r else 0 for u, r, c in data]
    assert df.select(mixing.capped_poisson(F.col("u"), F.lit(float("inf")), F.col("c")).alias("n")).first().n == 1
    # rates whose first term is no double any more
    great = spark.range(1).select(*(mixing.capped_poisson(F.lit(u), F.lit(900.0), F.lit(2000)).alias(f"n{i}") for i, u in enumerate((0.001, 0.5, 0.999)))).first()
    assert 790 < great.n0 < great.n1 < great.n2 < 1010 and abs(great.n1 - 900) < 2
    assert [int(x) for x in mixing._copies(np.array([0.001, 0.5, 0.999]), 900.0, 2000)] == list(great)


def test_calibration():
    tokens = np.random.default_rng(3).integers(0, 9, mixing.BINS).astype(float)
    for wanted in (0.1, 0.5, 1.4):
        rate = mixing.calibrated_rate(tokens, wanted * tokens.sum(), 2)
        u = (np.arange(mixing.BINS) + 0.5) / mixing.BINS
        assert abs((tokens * mixing._copies(u, rate, 2)).sum() / tokens.sum() - wanted) < 0.01
    assert abs(mixing.calibrated_rate(tokens, 800 * tokens.sum(), 2000) - 800) < 2
    assert mixing.calibrated_rate(tokens, 2 * tokens.sum(), 2) == math.inf and mixing.calibrated_rate(tokens * 0, 5, 2) == 0


def test_mix(spark):
    docs = [(i, f"texte {i} " + "mot " * (i % 7), "A" if i < 900 else " a-B " if i < 1200 else "autre", 2 + i % 7) for i in range(1500)]
    docs += [(2000, "texte  3 " + "mot " * 3, "a_b", 5), (2001, None, "A", 0), (2002, "x", None, 1), (0, docs[0][1], "A", 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens long").withColumn("n", F.lit(7)).withColumn("u", F.lit(7))
    targets = spark.createDataFrame([("a", 0.5, 1), ("a_b", 0.4, 3), ("vide", 0.1, 2), ("a", 0.9, 9), (None, 0.1, 1)], "source string, poids double, repetitions_max int")
    mixture, report = mixing.mix(df, targets, doc_id="doc_id", text="text", source="source")
    rows = mixture.collect()
    assert rows == mixing.mix(df, targets, doc_id="doc_id", text="text", source="source")[0].collect()
    assert [r.rang for r in rows] == sorted(r.rang for r in rows)
    used = Counter(r.doc_id for r in rows)
    caps = {"a": 1, "a_b": 3}
    assert all(used[r.doc_id] <= caps[r.source] for r in rows) and not (used[3] and used[2000])
    shares = {r.source: r.part for r in report.collect()}
    assert abs(shares["a"] - 5 / 9) < 0.03 and abs(shares["a_b"] - 4 / 9) < 0.03 and shares["vide"] == 0
    small = {r.source: r for r in mixing.mix(df, targets, doc_id="doc_id", text="text", source="source", size=900)[1].collect()}
    assert abs(small["a"].tokens - 500) < 60 and abs(small["a_b"].tokens - 400) < 60
    empty = mixing.mix(df.limit(0), targets, doc_id="doc_id", text="text", source="source")
    assert empty[0].count() == 0 and {r.tokens for r in empty[1].collect()} == {0}


def test_count_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("Bonjour à tous",), ("",), (None,), ("mot " * 30_000,)], "t string")
    counts = [r.tokens for r in mixing.count_tokens(df, "t", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()]
    assert counts[0] > 2 and counts[1:3] == [0, 0] and counts[3] >= 30_000


# --- p10: truncation ----------------------------------------------------------------------------------------------


def test_truncation(spark):
    rng = random.Random(1)
    subjects, verbs, objects = ["le maire", "la fanfare", "un voisin", "le club"], ["prépare", "annonce", "termine", "reporte"], ["la grande fête du village", "le concert de la chorale", "les travaux de la salle"]

    def sentence():
        return f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(objects)} avant le {rng.randint(1, 30)} mai."

    texts = [(i, " ".join(sentence() for _ in range(8)) + ("\nLa rédaction" if i % 3 == 0 else "")) for i in range(300)]
    cut = {1000: "le maire prépare la grande fête du village avant le 3 mai. la fanfare annonce le conc", 1001: "un voisin termine les travaux de la salle avant le 4 mai. le maire prépare la grande", 1002: "le club reporte le concert de la chorale avant le 5 mai. un voisin annonce la grande fête du…", 1003: "la fanfare annonce les travaux de la salle avant le 6 mai. le club [...]"}
    odd = [(2000, ""), (2001, None), (2002, "mai"), (2003, texts[0][1])]
    df = spark.createDataFrame(texts + list(cut.items()) + odd, "doc_id long, text string").withColumn("w", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r.doc_id: r.tronque for r in truncation.truncated(df).collect()}
    assert {k for k, v in got.items() if v and k < 2000} == set(cut)
    assert 2001 not in got and 2000 not in got and got[2003] is False
    sources = df.select("doc_id", F.when(F.col("doc_id") >= 1000, "b").alias("source"))
    rates = {r.source: r.tronques for r in truncation.truncation_by_source(truncation.truncated(df), sources).collect()}
    assert rates[None] == 0 and rates["b"] >= 4
    assert truncation.truncated(df.limit(0)).count() == 0


# --- SQL ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, str(folder))
    rel = con.sql(queries.SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    order = [list(rel.columns).index(c) for c in sorted(df.columns)]
    want = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want
