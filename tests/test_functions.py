from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regesta.functions import contacts as fc
from regesta.functions import links as fl
from regesta.functions import net, pages, places, times
from regesta.functions.classify import association_type, purpose_family
from regesta.functions.keys import canonical_url, code_insee, digest, instant, trimmed, utc_month
from regesta.functions.scoring import contact_score, page_score
from regesta.functions.text import normalise_name, normalise_name_exact, plain_name


def column(spark, values, f, schema="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_canonical_url(spark):
    pairs = {
        "HTTPS://Exemple.EXAMPLE:443/Chemin?b=2&a=1&b=1#haut": "https://exemple.example/Chemin?a=1&b=2&b=1",
        "http://h.example:80": "http://h.example/",
        "http://h.example:8080/x": "http://h.example:8080/x",
        " https://h.example/a ": "https://h.example/a",
        "https://h.example/?q=a+b&c=%C3%A9&d": "https://h.example/?c=%C3%A9&d=&q=a+b",
        "https://h.example/?": "https://h.example/",
        "pas une adresse": "pas une adresse",
        "": None,
        "  ": None,
        None: None,
    }
    assert column(spark, list(pairs), canonical_url) == list(pairs.values())


def test_codes_and_digests(spark):
    values = [" 01093\t", " 2b564", "1093", "", " ", None, "35XXX"]
    assert column(spark, values, code_insee) == ["01093", "2B564", "01093", None, None, None, "35XXX"]
    assert column(spark, ["sha256:AB", " 0xAb ", None], digest) == ["ab", "ab", None]
    assert column(spark, [" x ", "", None], trimmed) == ["x", None, None]


def test_instants(spark):
    values = ["2025-03-31T23:30:00.000-01:00", "2025-03-31T23:30:00", "nonsense", None]
    assert column(spark, values, lambda c: utc_month(instant(c))) == ["2025-04", "2025-03", None, None]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="aàéÇœŒÉ'-·` Ñ0z", max_size=20), min_size=1, max_size=8))
def test_native_name_equals_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select(normalise_name(F.col("v")).alias("a"), normalise_name_exact(F.col("v")).alias("b"), "v").collect():
        assert r.a == r.b == plain_name(r.v)


def test_emails(spark):
    values = ["<Contact@mairie.example>,", "logo@2x.png", "a@b", "x" * 250 + "@ab.fr", " a.dupont@b.example "]
    assert column(spark, values, fc.clean_email) == ["Contact@mairie.example", None, None, None, "a.dupont@b.example"]
    assert column(spark, ["Contact.asso@x.fr", "marie.dupont@x.fr", "zzz@x.fr"], fc.office_or_person) == [1, 0, None]
    faults = ["a@b.fr", "", "ab.fr", "a@@b.fr", ".a@b.fr", "a@b", "a@-b.fr", "a@b.f1", "u[^@]m.fr"]
    assert column(spark, faults, fc.email_fault) == [None, "longueur", "arobase", "arobase", "partie_locale", "domaine", "domaine", "domaine_de_tete", "partie_locale"]


def test_phones(spark):
    values = ["02 99 00 00 00", "+33 (0)2 99 00 00 00", "0033299000000", "12", "+33299000000", "06.12.34.56.78"]
    assert column(spark, values, fc.international_phone) == ["+33299000000", None, "+33299000000", None, "+33299000000", "+33612345678"]
    assert column(spark, ["+33612345678", "+33299000000"], fc.is_mobile) == [True, False]


def test_contacts_in_text(spark):
    text = "Ecrire à club [at] exemple [point] fr ou marie.dupont@asso.example, tél. 02 99 00 00 00."
    got = column(spark, [text, None, ""], fc.contacts_in_text)
    assert [(c.kind, c.valeur_normalisee, c.confiance) for c in got[0]] == [("email", "marie.dupont@asso.example", 0.6), ("phone", "+33299000000", 0.6), ("email", "club@exemple.fr", 0.45)]
    assert not got[1] and got[2] == []


def test_places(spark):
    assert column(spark, ["35047", "2A004", "97105", "3504", None], places.departement_of) == ["35", "2A", "971", None, None]
    assert column(spark, ["0001-01-01", " ", "x "], places.clean_text) == [None, None, "x"]
    assert column(spark, ["www.a.fr", "http://a.fr/x", "rien", None], places.site_address) == ["https://www.a.fr", "http://a.fr/x", None, None]
    assert column(spark, ["Mairie - Bruz", "Mairie déléguée – Bruz", "Bruz"], places.name_from_label) == ["Bruz", "Bruz", "Bruz"]
    assert column(spark, ["35", "2A", "57", "x"], places.valid_departement) == [True, True, False, False]


def test_classification(spark):
    df = spark.createDataFrame([("11000", "Club"), ("007000", "Comité d'animation"), (None, "X"), ("024000", "Y"), ("abc", "Mon ALSH")], "code string, nom string")
    got = [tuple(r.t) for r in df.select(association_type(F.col("code"), F.col("nom")).alias("t")).collect()]
    assert got == [("sportive", "rna:011"), ("comite_des_fetes", "nom:comite_danimation"), ("diverses", "defaut"), ("diverses", "rna:024"), ("centre_de_loisirs", "nom:alsh")]
    assert column(spark, ["11000", "011000", "x"], purpose_family) == ["011", "011", None]


def test_links(spark):
    df = spark.createDataFrame([("https://h.fr/vie-associative/clubs", "Annuaire"), ("https://h.fr/agenda", ""), ("https://h.fr/a%20b+c", None)], "u string, a string")
    assert [r.s for r in df.select(fl.link_score(F.col("u"), F.col("a")).alias("s")).collect()] == [6 + 4 + 2 + 3, -4, 0]
    assert column(spark, ["www.facebook.com", "facebook.mairie.fr", "x.com", "h.fr"], fl.is_social) == [True, False, True, False]
    assert column(spark, ["https://h.fr/a.PDF", "https://h.fr/.pdf", "https://h.fr/a.pdf/b", "https://h.fr/p?x=a.pdf"], fl.is_no_page) == [True, False, False, False]
    assert column(spark, ["http://h.fr/a#b", "ftp://h.fr", None], fl.town_hall_url) == ["http://h.fr/a", None, None]


def test_page_score(spark):
    rows = [(100, 0.0, 5.0, 5.0, 4), (1000, 2.0, 1.0, 1.0, 2), (1000, 0.0, 0.0, 0.0, -8), (1000, 1.0, 0.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "l int, c double, n double, r double, v int")
    got = [tuple(r.j) for r in df.select(page_score(*(F.col(x) for x in "lcnrv")).alias("j")).collect()]
    assert got == [(0.0, "ecartee", "vide", False), (17.0, "retenue", "contacts", False), (-4.0, "ecartee", "negatif", False), (4.0, "ecartee", "insuffisant", False)]


def test_contact_score(spark):
    rows = [("email", 0.9, False, True, 1, 1, True, "retenue"), ("email", 0.9, False, True, 0, 0, False, "ecartee"), ("email", 0.45, True, True, None, None, True, None), ("phone", 0.6, False, True, None, None, False, "retenue"), ("email", 0.9, False, False, 1, 1, True, "retenue")]
    df = spark.createDataFrame(rows, "k string, c double, cor boolean, ok boolean, mx int, o int, a boolean, v string")
    got = df.select(contact_score(*(F.col(x) for x in ("k", "c", "cor", "ok", "mx", "o", "a", "v"))).alias("s")).collect()
    assert [r.s.score for r in got] == [0.9, 0.17, 0.77, 0.51, 0.0]
    assert [x.signal for x in got[2].s.signaux] == ["revue", "mx", "regime", "page"]
    assert [x.signal for x in got[4].s.signaux] == ["syntaxe"]


def test_times(spark):
    assert column(spark, ["2028-02-29T00:00:00.000Z", "2026-03-01T10:00:00.000Z"], lambda c: times.years_before(c, 3)) == ["2025-03-01T00:00:00.000Z", "2023-03-01T10:00:00.000Z"]
    assert column(spark, [1, 2, 20], times.backoff_ms, "int") == [1000, 2000, 300000]
    assert column(spark, [408, 429, 503, 404], times.is_transient, "int") == [True, True, True, False]
    now = F.lit("2026-08-21T10:00:00.000Z")
    assert column(spark, ["120", "Fri, 21 Aug 2026 10:00:30 GMT", None, "99999"], lambda c: times.retry_after_ms(c, now)) == [120_000, 30_000, 60_000, 3_600_000]


def test_robots(spark):
    text = "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow: /*.pdf$\nCrawl-delay: 3,5\n"
    assert net.robots_rules(text, "B")[0] == [(False, "/x"), (True, "/x/y")]
    df = spark.createDataFrame([(text, "/x/y/z"), (text, "/x"), (text, "/q.pdf"), (None, "/x")], "t string, p string")
    for agent, want in (("b", [True, False, True, True]), ("other", [True, True, False, True])):
        got = df.withColumn("r", net.robots_policy(agent)(F.col("t"))).select(net.allowed(F.col("r.rules"), F.col("p")).alias("ok"), net.effective_delay_ms(F.col("r.delay_ms"), 2000).alias("d")).collect()
        assert [r.ok for r in got] == want
    assert [r.d for r in got] == [3500, 3500, 3500, 2000]


def test_robots_groups():
    text = "User-agent: a\nDisallow: /first\n\nUser-agent: a\nDisallow: /second\nCrawl-delay: 9\n\nUser-agent: *\nDisallow: /\n"
    assert net.robots_rules(text, "a") == ([(False, "/first")], None) and net.robots_rules(text, "b")[0] == [(False, "/")] and net.robots_rules("", "b") == ([], None)


def test_links_to_nowhere():
    doc = pages.read_html('<a href="">x</a><a href=" #top ">y</a><a>z</a><a href="?a=1">w</a>', "https://h.example/p")
    assert [x["href"] for x in doc["liens"]] == ["https://h.example/p?a=1"]


def test_root_states(spark):
    assert column(spark, ["https://h.fr", "ftp://h.fr", "https://www.facebook.com/x", None, "h.fr"], fl.root_state) == ["a_explorer", "invalide", "refuse", "invalide", "invalide"]


def test_html(spark):
    html = '<head><title>no</title></head><ul><li>A <a href="/x">b</a><li>C&eacute;&trade; <br>d</ul><script>no</script><table><tr><td>1<td><a href="mailto:a@b.fr">m</a></table>'
    doc = pages.read_html(html, "https://h.example/p")
    assert doc["texte"] == "A b\nCé&trade;\nd\n1\nm"
    assert [x["href"] for x in doc["liens"]] == ["https://h.example/x", "mailto:a@b.fr"]
    assert [b["texte"] for b in doc["blocs"]] == ["A b", "Cé&trade;\nd", "1", "m", "1\nm"]
    df = spark.createDataFrame([(html, "https://h.example/p"), (None, None), ("", "x")], "h string, b string")
    assert [r.d.texte for r in df.select(pages.parse_page("h", "b").alias("d")).collect()] == [doc["texte"], "", ""]
    assert pages.decode_bytes("é".encode("cp1252"), "text/html; charset=utf-8") == "é"
    assert pages.decode_bytes("é€".encode("cp1252"), "text/html; charset=iso-8859-1") == "é€"
    assert pages.decode_bytes(b'<meta charset="windows-1252">\xe9', None).endswith("é")
    assert column(spark, [None, "", "text/html; charset=x", "application/pdf"], pages.is_html) == [True, True, True, False]


@pytest.mark.parametrize("address,key", [("192.0.2.9", "192.0.2.0/24"), ("2001:0db8::1", "2001:db8:0::/48")])
def test_subnets(spark, address, key):
    assert column(spark, [address], net.subnet_key) == [key]
