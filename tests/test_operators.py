from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regesta.operators import attach, jobs
from regesta.operators import contacts as oc
from regesta.operators import pages as op
from regesta.operators.expectations import RULES, broken
from regesta.operators.orphans import orphan_references, orphan_report
from regesta.operators.skew import known, least, most, rows, salted_aggregate, total
from regesta.operators.snapshots import read_dictionary, snapshot_changes
from regesta.operators.upserts import fold_communes, insert_new, latest, minimal_communes, upsert_contacts

REFS = "nom_table string, champ string, cle string, periode string, enregistrement string, instant timestamp"
TARGETS = "champ string, cle string, depuis timestamp"


def refs_frame(spark, data):
    df = spark.createDataFrame(data, "nom_table string, champ string, cle string, periode string, enregistrement string, t long")
    return df.select(*df.columns[:-1], F.timestamp_seconds("t").alias("instant"))


def targets_frame(spark, data):
    return spark.createDataFrame(data, "champ string, cle string, t long").select("champ", "cle", F.timestamp_seconds("t").alias("depuis"))


def orphans_by_hand(refs, targets):
    seen = {}
    for field, key, t in targets:
        if key is not None and t is not None:
            old = seen.get((field, key))
            seen[field, key] = t if old is None else min(t, old)
        elif key is not None:
            seen.setdefault((field, key), None)
    out = set()
    for table, field, key, period, record, t in refs:
        if key is None:
            continue
        if (field, key) not in seen:
            out.add((table, field, key, period, record, True))
        elif seen[field, key] is not None and t is not None and seen[field, key] > t:
            out.add((table, field, key, period, record, False))
    return out


KEYS = st.sampled_from(["a", "b", "c", "d", None])


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(st.just("t"), st.sampled_from(["f", "g"]), KEYS, st.sampled_from(["p", "q", None]), st.sampled_from(["1", "2", "3", "4"]), st.one_of(st.none(), st.integers(0, 5))), max_size=30),
    st.lists(st.tuples(st.sampled_from(["f", "g"]), KEYS, st.one_of(st.none(), st.integers(0, 5))), max_size=8),
    st.sampled_from([1, 3, 1000]),
)
def test_orphans_equal_brute_force(spark, refs, targets, heavy):
    got = orphan_references(refs_frame(spark, refs), targets_frame(spark, targets), heavy_keys=heavy).collect()
    bad = orphans_by_hand(refs, targets)
    assert Counter((r.nom_table, r.champ, r.cle, r.periode, r.enregistrement, r.absente) for r in got) == Counter(bad)
    want = {}
    for table, field, key, period, record, _ in {r[:5] + (0,) for r in refs if r[2] is not None}:
        row = want.setdefault((table, field, period), [0, 0, 0])
        row[0] += 1
    for table, field, key, period, record, missing in bad:
        want[table, field, period][1 if missing else 2] += 1
    report = orphan_report(refs_frame(spark, refs), targets_frame(spark, targets), heavy_keys=heavy).collect()
    assert Counter((r.nom_table, r.champ, r.periode, r.references, r.absentes, r.tardives) for r in report) == Counter((*k, *v) for k, v in want.items())


def test_orphans_of_empty_tables_and_extra_columns(spark):
    one = [("t", "f", "k", "p", "1", 3)]
    assert orphan_references(refs_frame(spark, []), targets_frame(spark, [])).count() == 0
    wide = refs_frame(spark, one * 3).withColumn("depuis", F.lit("clash")).withColumn("n", F.lit(1))
    found = orphan_references(wide, targets_frame(spark, []).withColumn("instant", F.lit(1)))
    assert [tuple(r) for r in found.collect()] == [("t", "f", "k", "p", "1", True)]
    assert [tuple(r) for r in orphan_report(wide, targets_frame(spark, [])).collect()] == [("t", "f", "p", 1, 1, 0)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "x", "y", None]), st.integers(0, 9), st.one_of(st.none(), st.integers(-5, 5))), max_size=40), st.sampled_from([0.01, 0.4, 1.1]))
def test_salted_aggregate_equals_plain(spark, data, share):
    df = spark.createDataFrame([(k, i, v, v) for k, i, v in data], "k string, id int, v int, _salt int")
    got = {r.k: (r.n, r.s, r.lo, r.hi, r.c, r.d) for r in salted_aggregate(df, ["k"], ["id"], {"n": rows(), "s": total("v"), "lo": least("v"), "hi": most("v"), "c": known("v")}, distinct={"d": "v"}, heavy_share=share, salts=4).collect()}
    want = {}
    for k in {d[0] for d in data}:
        vs = [v for kk, _, v in data if kk == k]
        real = [v for v in vs if v is not None]
        want[k] = (len(vs), sum(real) if real else None, min(real, default=None), max(real, default=None), len(real), len(set(real)))
    assert got == want


def changes_by_hand(data):
    snaps = sorted({d[1] for d in data if d[0] is not None and d[1] is not None})
    content = {}
    for k, s, v, ver in data:
        if k is None or s is None:
            continue
        content.setdefault((k, s), None)
        if v is not None:
            now = content[k, s]
            rank = ((-1 if ver is None else ver), v)
            if now is None or rank > now:
                content[k, s] = rank
    out = set()
    for a, b in zip(snaps, snaps[1:], strict=False):
        for k in {k for k, _ in content}:
            was, now = (k, a) in content, (k, b) in content
            if now and not was:
                out.add((b, k, "ajoutee"))
            elif was and not now:
                out.add((b, k, "retiree"))
            elif was and now and content[k, a] and content[k, b] and content[k, a][1] != content[k, b][1]:
                out.add((b, k, "modifiee"))
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from([f"k{i}" for i in range(150)])), st.sampled_from(["s1", "s2", "s3", None]), st.one_of(st.none(), st.sampled_from(["u", "v"])), st.one_of(st.none(), st.integers(0, 3))), max_size=120), st.sampled_from([1, 7]))
def test_snapshot_changes_equal_brute_force(spark, data, buckets):
    df = spark.createDataFrame([(*d, 0) for d in data], "k string, s string, v string, ver int, bits int")
    got = snapshot_changes(df, ["k"], "s", "v", "ver", buckets=buckets).collect()
    assert Counter((r.s, r.k, r.changement) for r in got) == Counter(changes_by_hand(data))


def test_ordinals_stay(spark, tmp_path):
    def run(rows, folder):
        df = spark.createDataFrame(rows, "k string, s string, v string").withColumn("ver", F.lit(0))
        got = {(r.s, r.k, r.changement) for r in snapshot_changes(df, ["k"], "s", "v", "ver", dictionary=folder, buckets=2).collect()}
        return got, {r.k: (r.bucket, r.ordinal) for r in read_dictionary(spark, folder)[0].collect()}

    folder = str(tmp_path / "keys")
    rows = [(k, s, "x") for s, keys in (("s1", "abc"), ("s2", "bcd")) for k in keys]
    got, first = run(rows, folder)
    assert got == {("s2", "a", "retiree"), ("s2", "d", "ajoutee")} and len(set(first.values())) == 4
    # the same again adds nothing; a later snapshot changes no ordinal, and gives the same as without a dictionary
    assert run(rows, folder) == (got, first) and read_dictionary(spark, folder)[2] == 1
    more = [*rows, *((k, "s3", "y") for k in "0bz")]
    got, after = run(more, folder)
    assert {k: after[k] for k in first} == first and len(set(after.values())) == len(after) == 6 and read_dictionary(spark, folder)[1:] == (2, 2)
    assert got == run(more, str(tmp_path / "other"))[0]
    # a part that was not written whole does not count
    (tmp_path / "keys/buckets=2/00000002").mkdir()
    assert run(more, folder)[1] == after


def test_upserts(spark):
    data = [(1, "a", "2"), (1, "b", "3"), (1, "b", "3"), (None, "x", "1"), (2, None, "1")]
    df = spark.createDataFrame(data, "id int, v string, t string")
    want = {(1, "b", "3"), (2, None, "1")}
    assert {tuple(r) for r in latest(df, ["id"], ["t"]).collect()} == want
    assert {tuple(r) for r in latest(latest(df, ["id"], ["t"]).union(df), ["id"], ["t"]).collect()} == want
    towns = spark.createDataFrame([("1", "Nom", "d", "http://a", "s", "resolue", "1"), ("1", "", "d", None, None, "sans_site", "2"), ("2", "B", "d", None, None, "sans_site", "1")], "code_insee string, nom string, departement string, url_mairie string, source_resolution string, statut_resolution string, t string")
    got = {tuple(r) for r in fold_communes(towns, "t").collect()}
    assert got == {("1", "Nom", "d", "http://a", "s", "resolue"), ("2", "B", "d", None, None, "sans_site")}
    codes = spark.createDataFrame([("2", "x"), ("3", None), ("4", "Quatre"), (None, "y")], "code_insee string, libelle string")
    assert {(r.code_insee, r.nom) for r in minimal_communes(codes, fold_communes(towns, "t")).collect()} == {("1", "Nom"), ("2", "B"), ("3", "3"), ("4", "Quatre")}


CONTACT = "id long, association_id long, code_insee string, kind string, valeur string, valeur_normalisee string, source_url string, methode_extraction string, confiance double, collected_at string, review_statut string, is_generique int, valeur_corrigee string, score double, score_version int"


def contact(i, a, c, v, conf=0.9, at="2025", status="a_revoir", kind="email", score=None, version=None):
    return (i, a, c, kind, v, v, "u", "m", conf, at, status, None, None, score, version)


def test_contacts(spark):
    data = [contact(1, 7, "A", "x@y.fr", 0.6, "1"), contact(2, 7, "A", "x@y.fr", 0.9, "2"), contact(3, 7, "A", "x@y.fr", 0.9, "3"), contact(4, None, "A", "x@y.fr"), contact(5, None, "B", "x@y.fr"), contact(6, None, None, "z@y.fr")]
    df = spark.createDataFrame(data, CONTACT)
    got = {(r.id, r.confiance, r.collected_at) for r in upsert_contacts(df, [F.col("collected_at")]).collect()}
    assert got == {(1, 0.9, "2"), (4, 0.9, "2025"), (5, 0.9, "2025")}
    once = oc.drop_shadowed(df)
    assert {r.id for r in once.collect()} == {1, 2, 3, 5, 6} == {r.id for r in oc.drop_shadowed(once).collect()}
    dated = spark.createDataFrame([(1, "2026-01-01T00:30:00+02:00"), (2, "2026-01-01T00:00:00.000Z"), (3, None)], "id int, at string")
    assert {r.id for r in oc.retained(dated, F.col("at"), "2026-01-01T00:00:00.000Z").collect()} == {2, 3}


def test_review(spark):
    df = spark.createDataFrame([contact(1, 7, "A", "x@y.fr"), contact(2, 7, "A", "z@y.fr", version=2), contact(3, 8, "A", "+33299000000", kind="phone"), contact(4, 8, "A", "w@y.fr")], CONTACT)
    actions = spark.createDataFrame([(1, 1, "rejete", None), (1, 2, "valide", None), (2, 1, "corrige", "<Contact@N.fr>"), (3, 1, "corrige", "06 12 34 56 78"), (4, 1, "corrige", "w@y.fr")], "id long, seq int, action string, saisie string")
    got = {r.id: r for r in oc.apply_reviews(df, actions).collect()}
    assert got[1].review_statut == "valide" and got[1].refus is None
    assert (got[2].review_statut, got[2].valeur, got[2].valeur_corrigee, got[2].valeur_normalisee, got[2].is_generique, got[2].score_version) == ("corrige", "z@y.fr", "Contact@N.fr", "contact@n.fr", 1, None)
    assert (got[3].review_statut, got[3].refus) == ("a_revoir", "mobile")
    assert got[4].refus == "identique"
    again = spark.createDataFrame([(1, 1, "corrige", "z@y.fr")], "id long, seq int, action string, saisie string")
    assert {r.id: r.refus for r in oc.apply_reviews(df, again).collect()}[1] == "doublon"


def test_attachment(spark):
    schema = "id long, code_insee string, nom string, date_dissolution string"
    assoc = spark.createDataFrame([(1, "A", "Tennis club des Landes", None), (2, "A", "Tennis club", None), (3, "A", "Chorale du Bourg", None), (4, "A", "Chorale du bourg", None), (5, "B", "Judo club de Bruz", None), (6, "A", "Ancien club dissous", "2020-01-01"), (7, "A", "Court", None)], schema)
    ctx = spark.createDataFrame([("x", "A", "c1", "Le tennis-club des Landes, et d'autres"), ("x", "A", "c2", "Chorale du bourg et tennis club des landes : une page bien plus longue"), ("y", "A", "c3", "La CHORALE DU BOURG"), ("z", "A", "c4", "Judo club de Bruz, court, ancien club dissous"), ("w", None, "c5", "Tennis club")], "item string, code_insee string, ctx_id string, texte string")
    got = {r.item: (r.nom_cle, r.association_id) for r in attach.attach(ctx, attach.known_names(assoc)).collect()}
    assert got == {"x": ("tennis club des landes", 1), "y": ("chorale du bourg", None)}


def test_best_links_and_frontier(spark):
    data = [("https://h.fr/", "https://www.h.fr/associations#a", "Clubs", 0), ("https://h.fr/", "https://h.fr/associations", "", 1), ("https://h.fr/", "https://h.fr/agenda", "", 2), ("https://h.fr/", "https://facebook.com/club", "club", 3), ("https://h.fr/", "https://h.fr/club.pdf", "club", 4), ("https://h.fr/", "mailto:a@b.fr", "contact", 5), ("https://h.fr/", "https://h.fr/", "club", 6), ("https://h.fr/", "https://h.fr/sport", "", 7)]
    links = spark.createDataFrame(data, "page string, href string, ancre string, pos int")
    got = [(r.url, r.score, r.ancre) for r in op.best_links(links).orderBy("rang").collect()]
    assert got == [("https://h.fr/associations", 6, "Clubs"), ("https://h.fr/sport", 2, "")]
    roots = spark.createDataFrame([("r", "a")], "root string, url string")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 5), ("b", "a", 9), ("c", "d", 1), ("d", "e", 1)], "source string, url string, score int")
    assert [(r.url, r.profondeur) for r in op.frontier(roots, edges, 9).orderBy("rang").collect()] == [("a", 0), ("c", 1), ("b", 1), ("d", 2)]


def test_jobs(spark):
    schema = "id long, state string, priority int, attempts int, max_attempts int, available_at string, lease_expires_at string"
    now = "2026-01-01T00:00:00.000Z"
    table = spark.createDataFrame([(1, "pending", 5, 0, 2, now, None), (2, "pending", 1, 0, 2, "2027", None), (3, "leased", 1, 1, 2, now, "2025"), (4, "done", 1, 1, 2, now, None)], schema)
    taken = jobs.lease(table, now, 1, 60_000)
    assert {r.id: (r.state, r.attempts) for r in taken.collect()} == {1: ("pending", 0), 2: ("pending", 0), 3: ("leased", 2), 4: ("done", 1)}
    events = spark.createDataFrame([(3, 1, "fail", None), (4, 1, "requeue", None), (1, 1, "complete", None)], "id long, seq int, event string, lease_ms long")
    got = {r.id: (r.state, r.attempts, r.available_at) for r in jobs.settle(taken, events, now).collect()}
    assert got[3][0] == "dead" and got[4] == ("pending", 0, now) and got[1][0] == "pending"
    retry = spark.createDataFrame([(1, "leased", 1, 2, 5, now, "2027")], schema)
    fail = spark.createDataFrame([(1, 1, "fail", None)], "id long, seq int, event string, lease_ms long")
    assert jobs.settle(retry, fail, now).first().available_at == "2026-01-01T00:00:02.000Z"


def test_pages(spark):
    schema = "campagne string, code_insee string, url_hash string, content_hash string, fetched_at string, profondeur int, prefiltre_score double, url string"
    df = spark.createDataFrame([("c", "A", "1", "h", "2", 0, None, "u1"), ("c", "A", "2", "h", "1", 1, 9.0, "u2"), ("c", "B", "3", "h", "1", 0, 1.0, "u3"), ("c", "A", "4", None, "1", 1, 10.0, "u4")], schema)
    assert [(r.url_hash, r.premiere) for r in op.duplicate_content(df).collect()] == [("1", "2")]
    assert {(r.url_hash, r.rang) for r in op.within_budget(df, 2).collect()} == {("1", 1), ("2", 2), ("3", 1)} or {(r.url_hash, r.rang) for r in op.within_budget(df, 2).collect()} == {("1", 1), ("4", 2), ("3", 1)}


def test_expectations(spark):
    df = spark.createDataFrame([contact(1, 7, "A", "x@y.fr"), contact(2, None, None, "x", conf=2.0, status="corrige")], CONTACT)
    got = {r.regle: r.fautes for r in broken(df, RULES["contact"]).collect()}
    assert (got["confiance"], got["rattachement"], got["correction"], got["kind"]) == (1, 1, 1, 0)


@pytest.mark.parametrize("known_rows", [None, [("a", 1)]])
def test_insert_new(spark, known_rows):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 1)], "k string, t int")
    old = None if known_rows is None else spark.createDataFrame(known_rows, "k string, t int")
    got = {(r.k, r.t) for r in insert_new(df, old, ["k"], ["t"]).collect()}
    assert got == ({("a", 1), (None, 1)} if old is None else {(None, 1)})


def test_contacts_of_pages(spark):
    from regesta.functions.pages import parse_page
    from regesta.operators import attach as oa

    html = [
        ("https://plobec.example/liste", "41873", '<header><a href="/">Retour</a></header><table><tr><td>Judo des Moulins<td><a href="mailto:Bureau@judo.example?subject=y">courriel</a><td>02 41 00 00 01</table><p>Fanfare du Lavoir : fanfare [at] courriel [dot] fr'),
        ("https://plobec.example/joindre", "41873", '<ul><li>Accueil <a href="tel:+33241000000">numéro</a><li>Paul, 06 21 43 65 87, paul.durand@plobec.example</ul>'),
    ]
    named = [(1, "41873", "Judo des Moulins", None), (2, "41873", "Fanfare du Lavoir", None), (3, "41873", "Fanfare du lavoir", None)]
    docs = spark.createDataFrame(html, "page string, code_insee string, html string").select("page", "code_insee", parse_page("html", "page").alias("doc"))
    names = oa.known_names(spark.createDataFrame(named, "id long, code_insee string, nom string, date_dissolution string"))
    got = {(r.kind, r.valeur_normalisee): r for r in oa.attach_contacts(op.page_contacts(docs), names).collect()}
    assert {k: (r.methode, r.confiance, r.association_id) for k, r in got.items()} == {
        ("email", "bureau@judo.example"): ("dom:mailto+nom", 0.81, 1), ("phone", "+33241000001"): ("texte:motif+nom", 0.54, 1), ("email", "fanfare@courriel.fr"): ("texte:obfusque", 0.45, None),
        ("phone", "+33241000000"): ("dom:tel", 0.9, None), ("email", "paul.durand@plobec.example"): ("texte:motif", 0.6, None),
    }
    assert got["email", "fanfare@courriel.fr"].rattachable and not got["email", "paul.durand@plobec.example"].rattachable
    assert [tuple(r) for r in op.excluded_mobiles(docs).collect()] == [("https://plobec.example/joindre", 1)]
