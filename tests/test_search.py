"""Search end to end on a small made corpus, readers, writers, changes and the streamed log."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import changes, relational, reports, vector
from foliant.plans.search import BadRequest, Cache, Corpus, HashingEmbedder, SearchEngine, validate
from foliant.sources import readers, sinks
from foliant.streaming import log

APP = "code string, sub_category string, app string, app_s1 string, app_s2 string, app_s3 string, app_s4 string, app_s5 string, app_s6 string, standard string, table_ref string, row_ref string, page_number int, indoor_outdoor string, lighting_zone string, tm24_eligible int, active int"
PLANE = ", ".join(f"{p}_cat string, {p}_lux double, {p}_fc double, {p}_height_m double, {p}_height_ft double, {p}_basis string, {p}_uniformity string, {p}_cv double, {p}_ratio_basis string" for p in ("hor", "ver"))
OUT = "max_glare_rating string, max_uplight string"


@pytest.fixture(scope="module")
def engine(spark):
    plane = ("P", 300.0, 30.0, None, None, "Avg", None, None, None) + (None,) * 9
    apps = [(f"C{i}", "INTERIOR", app, s1, None, None, None, None, None, std, "Table A-1", f"Row {i}", page, where, zone, 0, 1, *plane, None, None) for i, (app, s1, std, page, where, zone) in enumerate([
        ("Hospital", "Patient room", "RP-29-22", 10, "Indoor", None), ("Hospital", "Operating room", "RP-29-22", 11, "Indoor", None), ("Office", "Open office", "RP-1-20", 5, "Indoor", None), ("Parking", "Garage", "RP-8-25", 7, "Outdoor", "LZ2"), ("Hospital", "Exam room", "RP-29-22", 12, "Indoor", None)])]
    apps = spark.createDataFrame(apps, f"{APP}, {PLANE}, {OUT}")
    prose = "The patient room needs lighting that supports rest and care for every patient and visitor during the night hours"
    chunks = [("RP-29-22-chunk-0", "RP-29-22", "text", 9, 0, "current", prose), ("RP-29-22-chunk-1", "RP-29-22", "table", 10, 0, "current", "patient room 300 300 300"), ("RP-1-20-chunk-0", "RP-1-20", "text", 4, 0, "current", "Open office lighting has to serve many tasks and the people who carry them out across the whole floor plate"),
              ("RP-29-22-chunk-9", "RP-29-22", "reference", 40, 0, "current", "ANSI/IES RP-1-20 Lighting offices, a reference on patient rooms"), ("RP-29-16-chunk-0", "RP-29-16", "text", 9, 0, "deprecated", prose.replace("night", "late")), ("GONE-1-chunk-0", "GONE-1-10", "text", 1, 0, "current", prose)]
    embedder = HashingEmbedder(128)
    rows = apps.select(F.col("code").alias("id"), F.col("standard").alias("standard_code"), F.lit("application").alias("chunk_type"), "page_number", "tm24_eligible", F.lit("current").alias("status"), F.concat_ws(" ", "app", "app_s1").alias("excerpt_text"))
    vectors = embedder.embed(rows.unionByName(spark.createDataFrame(chunks, "id string, standard_code string, chunk_type string, page_number int, tm24_eligible int, status string, excerpt_text string")), "excerpt_text").cache()
    standards = spark.createDataFrame([("RP-29-22", "Hospitals", "ANSI/IES RP-29-22", "Active", None, "u/29"), ("RP-29-16", "Hospitals", "ANSI/IES RP-29-16", "Deprecated", "RP-29-22", None), ("RP-1-20", "Offices", "ANSI/IES RP-1-20", "Active", None, "u/1"), ("RP-8-25", "Roads", "ANSI/IES RP-8-25", "Active", None, None)], "id string, title string, full_designation string, status string, superseded_by string, web_url string")
    return SearchEngine(spark, Corpus(vectors, apps, standards), embedder)


def test_search(engine):
    out = engine.search({"query": "How bright should a patient room be?", "limit": 5})
    first = out["results"][0]
    assert first["kind"] == "application" and first["standard"] == "RP-29-22" and first["citation"].startswith("ANSI/IES RP-29-22 Hospitals, Table A-1, Row ")
    assert first["excerpt"]["page"] == 9 and not any(r["standard"] == "GONE-1-10" for r in out["results"]) and len(out["related"]) > 0
    again = engine.search({"query": "How bright should a patient room be?", "limit": 5})
    assert again["cached"] and again["results"] == out["results"] and engine.log[-1]["cached"]


def test_comparison_references_and_units(engine):
    out = engine.search({"query": "what's new in RP-29 patient room", "limit": 5, "units": "lux"})
    old = [r for r in out["results"] if r.get("is_deprecated")]
    assert [r["superseded_by"] for r in old] == ["RP-29-22"] and not out["low_confidence"]
    assert all("fc" not in r["horizontal"] for r in out["results"] if r.get("horizontal"))
    refs = engine.search({"query": "list of references on patient rooms"})["results"]
    assert [r["link"] for r in refs] == ["u/1"]


def test_filters_and_fan_out(engine):
    out = engine.search({"query": "garage parking LZ2"})
    assert [r["standard"] for r in out["results"] if r["kind"] == "application"] == ["RP-8-25"]
    many = engine.search({"query": "open office, patient room"})
    assert {"RP-1-20", "RP-29-22"} <= {r["standard"] for r in many["results"]} and len({r["code"] for r in many["results"]}) == len(many["results"])


def test_summary_falls_back(engine):
    assert engine.search({"query": "exam room", "includeAISummary": True})["summary"]["degraded"]
    engine.summariser = lambda prompt: "A short answer."
    assert engine.search({"query": "exam room!", "includeAISummary": True})["summary"] == {"text": "A short answer.", "degraded": False}
    engine.summariser = None


def test_requests():
    with pytest.raises(BadRequest):
        validate({"query": "  "})
    assert validate({"query": "x" * 900, "limit": 400})["limit"] == 50
    c = Cache()
    assert c.key("a", {"x": 1, "y": None}) == c.key("a", {"x": 1})
    before = c.key("a", {})
    c.bump()
    assert c.key("a", {}) != before


def test_top_k_is_brute_force(spark):
    import numpy as np

    g = np.random.default_rng(0)
    v = g.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 5) for i, r in enumerate(v)] + [(900, None, 0), (901, [1.0], 0)], "id long, v array<float>, g int").repartition(5)
    q = v[0].tolist()
    got = [r["id"] for r in vector.top_k(df, [(0, q)], "id", "v", 20).collect()]
    w = v.astype(np.float32).astype(float)
    score = w @ v[0] / np.linalg.norm(w, axis=1)
    assert got == sorted(range(300), key=lambda i: (-score[i], i))[:20]
    per = vector.top_k_per_group(df, [(0, q)], "id", "v", "g", 3).collect()
    assert sorted(r["id"] for r in per) == sorted(i for g_ in range(5) for i in sorted(range(g_, 300, 5), key=lambda i: -score[i])[:3])


def test_upsert_is_idempotent(spark):
    cur, delta = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string"), spark.createDataFrame([(2, None, "z"), (3, "c", "")], "k int, p string, q string")
    once = changes.upsert(cur, delta, "k", {"p": changes.KEEP}, empty_is_null=True)
    twice = changes.upsert(once, delta, "k", {"p": changes.KEEP}, empty_is_null=True)
    want = [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_admission_and_guards(spark):
    files = spark.createDataFrame([("a", "RP-1-20", False, 0), ("b", "RP-1-20", True, 1), ("c", "RP-2-10", True, 2), ("d", "RP-2-10", True, 3)], "path string, id string, deprecated boolean, ord int")
    assert {r["path"]: r["decision"] for r in changes.admit(files).collect()} == {"a": "ingest", "b": "skip", "c": "ingest", "d": "skip"}
    req = spark.createDataFrame([("A", "deprecated", None, 1, 1, 1, 0), ("B", "deprecated", "Active", 0, 1, 1, 0), ("C", "current", None, 0, 2, 1, 0), ("D", "current", None, 0, 1, 1, 0)], "standard_id string, status string, current_status string, n_applications int, n_chunks int, n_vectors int, n_empty int")
    assert {r["standard_id"]: r["code"] for r in changes.guard_violations(req).collect()} == {"A": 400, "B": 409, "C": 500}


def test_fallback_lookup(spark):
    from foliant.functions import ids

    std = spark.createDataFrame([("RP-2-20", "Retail")], "sid string, title string")
    df = spark.createDataFrame([("rp-2-20+E1",), ("RP-2-20",), ("RP-9-20",)], "id string")
    got = relational.with_fallback(df, std, [F.upper("id"), ids.base_id(F.col("id"))], "sid", ["title"])
    assert {r["id"]: r["title"] for r in got.collect()} == {"rp-2-20+E1": "Retail", "RP-2-20": "Retail", "RP-9-20": None}


def test_readers(spark, tmp_path):
    (tmp_path / "cat.csv").write_text('Folder Path,TITLE,Doc ID,Web Viewer URL\nA/Deprecated,"ANSI/IES RP-8-18, ""Road""",1,u1\nA,ANSI/IES RP-8-18 new,2,u2\nA,no id,3,u3\n\n')
    assert [tuple(r) for r in readers.catalogue_csv(spark, str(tmp_path / "cat.csv")).collect()] == [("RP-8-18", "2", "u2", False)]
    (tmp_path / "m1.json").write_text('{"_note": "x", "rp-1-20": "d1"}')
    (tmp_path / "m2.json").write_text('[{"standardId": "RP-2-20", "docId": "d2", "webUrl": "u"}, {"id": "RP-3-20"}]')
    assert [tuple(r) for r in readers.mapping_file(spark, str(tmp_path / "m1.json")).collect()] == [("RP-1-20", "d1", None)]
    assert [tuple(r) for r in readers.mapping_file(spark, str(tmp_path / "m2.json")).collect()] == [("RP-2-20", "d2", "u")]
    (tmp_path / "cur.json").write_text(json.dumps({"standards": [{"id": "rp-2-20", "title": "T", "categories": ["x"]}]}))
    assert readers.curated_catalogue(spark, str(tmp_path / "cur.json")).first()["id"] == "RP-2-20"
    for name in ("docs/RP-9-20.pdf", "docs/Others/x.pdf", "docs/Deprecated/RP-9-14.PDF", "docs/readme.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    assert sorted((r["id"], r["deprecated"]) for r in readers.document_files(spark, str(tmp_path / "docs")).collect()) == [("RP-9-14", True), ("RP-9-20", False)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "=cmd"), (2, 'say "x", y')], "a int, b string")
    sinks.write_guarded_csv(df.coalesce(1), ["a", "b"], str(tmp_path / "out"))
    body = next((tmp_path / "out").glob("part-*")).read_bytes().decode()
    assert body == "1,'=cmd\r\n2,\"say \"\"x\"\", y\"\r\n"
    assert json.loads(sinks.as_json(df).first()["json"]) == {"a": 1, "b": "=cmd"}
    assert reports.csv_lines(df, ["a", "b"], [F.col("a")]).first()["n"] == 2


def test_streamed_log(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.sql("select cast(id as bigint) event_id, cast(timestamp'2024-01-01' + make_interval(0,0,0,0,0,id*10) as timestamp_ntz) ts, id % 3 user_id, 'view' event_type, 1.0D value, '{}' props from range(100)").write.parquet(source)
    stream = log.distinct_events(log.read_log(spark, source), "ts", ["event_id"], "1 hour")
    log.append_log(stream, out, mark).awaitTermination(120)
    assert spark.read.parquet(out).count() == 100
    counts = log.window_counts(log.read_log(spark, source), "ts", ["user_id"], "1 hour", late="1 hour")
    q = counts.writeStream.format("memory").queryName("log_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = log.window_counts(spark.read.parquet(source), "ts", ["user_id"], "1 hour")
    assert sorted(map(tuple, spark.table("log_counts").collect())) == sorted(map(tuple, batch.collect()))
