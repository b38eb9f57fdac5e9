from __future__ import annotations

import csv
import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regesta.sources import export, registry, services, store
from regesta.sources.ranges import read_ranges
from regesta.streaming import flows

CSV = 'id,titre,objet,objet_social1,adrs_codeinsee,adrs_libcommune,siteweb,date_disso,date_creat,date_decla\r\nW1,"Club, ""le"" Bon","sur\ndeux lignes",011000,41873,Plobec,judo-plobec.example,0001-01-01,2000-01-01,0001-01-01\r\nW2,École,,,09112,,,2020-01-01,,\r\n,sans id,,,41873,,,,,'


def test_registry_csv_and_archive(spark, tmp_path):
    (tmp_path / "rna.csv").write_bytes(CSV.encode())
    rows = registry.to_associations(registry.read_csv(spark, str(tmp_path / "rna.csv")), "41").collect()
    assert [(r.rna_id, r.nom, r.nom_normalise, r.objet, r.site_web, r.date_dissolution, r.date_declaration) for r in rows] == [("W1", 'Club, "le" Bon', "club le bon", "sur\ndeux lignes", "https://judo-plobec.example", None, None)]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/rna_dpt_41.CSV", CSV)
        z.writestr("x/rna_dpt_09.csv", "id,titre\nW9,non")
    (tmp_path / "d.zip").write_bytes(buffer.getvalue())
    got = registry.to_associations(registry.read_archive(spark, str(tmp_path), "41")).collect()
    assert {r.rna_id for r in got} == {"W1", "W2"}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab",;\n\ré ', max_size=6), min_size=3, max_size=3), max_size=12), st.integers(1, 40), st.sampled_from(["\n", "\r\n"]), st.booleans())
def test_ranges_read_what_the_whole_file_holds(spark, tmp_path_factory, rows, size, end, ended):
    rows = [[x.replace("\r", "\r\n") for x in r] for r in rows if any(r)]
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator=end).writerows([["a", "b", "c"], *rows])
    text = buffer.getvalue() if ended else buffer.getvalue()[: -len(end)]
    folder = tmp_path_factory.mktemp("csv")
    (folder / "x.csv").write_bytes(("\ufeff" + text).encode())
    got = read_ranges(spark, str(folder), ("c", "a", "z"), range_bytes=size).orderBy("octet").collect()
    assert [(r.c, r.a, r.z) for r in got] == [(r[2], r[0], "") for r in rows]
    assert not got or got[-1].octet == len(text.encode()) + 3


def test_services(spark, tmp_path):
    hall = {"nom": "Mairie - Plobec", "site_internet": [{"libelle": "", "valeur": "rien"}, {"libelle": "", "valeur": "https://plobec.example"}], "adresse": [], "pivot": [{"type_service_local": "mairie", "code_insee_commune": ["41873", "41873 ", ""]}]}
    other = {"nom": "Caf", "site_internet": [], "adresse": [], "pivot": [{"type_service_local": "caf", "code_insee_commune": ["41873"]}]}
    text = json.dumps({"x": "[", "service": [hall, other, 3]})
    (tmp_path / "s.json").write_text(json.dumps({"service": [hall, other]}))
    lines = services.split_array(text, "service")
    assert len(lines) == 2 and json.loads(lines[0]) == hall
    (tmp_path / "lines.json").write_text("\n".join([*lines, "{broken"]))
    for df in (services.read_services(spark, str(tmp_path / "s.json")), services.read_service_lines(spark, str(tmp_path / "lines.json"))):
        assert [tuple(r) for r in services.town_halls(df, "41").collect()] == [("41873", "Plobec", "https://plobec.example", "41")]
    with pytest.raises(ValueError):
        services.split_array('{"service":[{"a":1', "service")
    with pytest.raises(ValueError):
        services.split_array('{"other":[]}', "service")
    page = '<a href="2026-01-02_030405-data.gouv_local.json"><a href="2026-01-10_000000-data.gouv_local.json">'
    df = spark.createDataFrame([(page,)], "t string")
    assert df.select(services.newest_dump(F.col("t")).alias("x")).first().x == "2026-01-10_000000-data.gouv_local.json"


def test_export(spark, tmp_path):
    data = [(2, "a;b", "=1+1", None), (1, 'say "x"', "+33", 0.5)]
    rows = spark.createDataFrame(data, "rang int, a string, b string, c double")
    lines = [r.ligne for r in export.csv_lines(rows, ("a", "b", "c")).orderBy("rang").collect()]
    assert lines == ["a;b;c", '"say ""x""";\'+33;0.5', "\"a;b\";'=1+1;"]
    export.write_csv(rows, str(tmp_path / "out"), ("a", "b", "c"))
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert whole.decode().split("\r\n")[:3] == [export.BOM + lines[0], *lines[1:]]
    assert json.loads(export.as_json(rows).first().value).keys() == {"rang", "a", "b", "c"}


def test_store(spark):
    bodies = spark.createDataFrame([("http://H.fr/", "ab", 2, "2026-01-01T00:00:00.000Z"), ("http://h.fr", "abc", 3, "2026-01-02T00:00:00.000Z"), ("http://h.fr/x", "abc", 9, "2026-01-02T00:00:00.000Z")], "url string, body string, taille int, fetched_at string")
    kept = store.keyed_bodies(bodies)
    assert [r.body for r in kept.collect()] == ["abc"]
    assert store.fresh(kept, "2026-01-02T00:00:01.000Z", 2000).count() == 1 and store.fresh(kept, "2026-01-03T00:00:01.000Z", 2000).count() == 0
    assert store.mx_verdict([(20, "b"), (10, "a")], None) == (1, ["a", "b"])
    assert store.mx_verdict([(0, ".")], None) == (0, []) == store.mx_verdict(None, "NXDOMAIN")
    assert store.mx_verdict(None, "TIMEOUT") == (None, [])
    df = spark.createDataFrame([("a.fr",), ("a.fr",), (None,)], "domaine string")
    assert [tuple(r) for r in store.resolve_domains(df, lambda d: ([(1, "mx." + d)], None), 2).collect()] == [("a.fr", 1, ["mx.a.fr"])]


def test_upsert_stream_is_idempotent(spark, tmp_path):
    schema = "id int, v string, t int"
    for i, rows in enumerate(([(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (1, "old", 0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        flows.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["id"], ["t"]).awaitTermination()
        flows.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["id"], ["t"]).awaitTermination()
    assert {tuple(r) for r in flows.read_snapshot(spark, str(tmp_path / "out")).collect()} == {(1, "c", 2), (2, "b", 1)}


def test_stateful_streams(spark, tmp_path):
    spark.createDataFrame([(1, 1.0, "take", 1), (1, 2.0, "fail", 1), (2, 1.0, "take", 2), (2, 2.0, "take", 2), (2, 3.0, "complete", 2)], "id long, at double, event string, max_attempts int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at double, event string, max_attempts int").parquet(str(tmp_path / "in"))
    q = flows.lease_states(stream, 60).writeStream.format("memory").queryName("leases").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.id, r.state, r.attempts) for r in spark.table("leases").collect()} == {(1, "dead", 1), (2, "done", 1)}
    events = spark.createDataFrame([("a", "2026-01-01 10:00:00"), ("a", "2026-01-01 11:00:00"), ("b", "2026-01-01 10:00:00"), ("a", "2026-01-02 10:00:00")], "k string, ts string").select("k", F.to_timestamp("ts").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = flows.once_per_period(s, "k", "ts", "day").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 3
