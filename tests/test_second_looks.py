"""Backfill, tail probe, versions in storage, batch embedding and stream upserts, by plain loops and with failures."""

import threading

import pytest
from pyspark.sql import functions as F
from test_search import engine  # noqa: F401

from foliant.operators import retrieval, vector
from foliant.plans.search import Cache, Corpus, SearchEngine
from foliant.sources import embedding
from foliant.sources.files import DataVersion, Folder
from foliant.streaming import log, upserts


def test_backfill_serves_only_groups_left_empty(spark):
    far = lambda i: i * 37 % 151
    kind = lambda i: "app" if i // 6 % 3 == 0 else "ref" if i % 11 == 0 else "text" if i % 6 < 3 or far(i) > 60 else "table"
    rows = [(i, f"g{i % 6}", kind(i), [1.0, float(far(i))]) for i in range(150)]
    df, q = spark.createDataFrame(rows, "id long, g string, kind string, v array<double>"), [(0, [1.0, 0.0])]
    score = {i: 1 / (1 + v[1] ** 2) ** 0.5 for i, _, _, v in rows}
    best = lambda own: sorted(own, key=lambda x: (-score[x[0]], x[0]))
    pool = best(rows)[:40]
    served = {g for _, g, k, _ in pool if k == "text"}
    order = []
    for _, g, k, _ in pool:
        if k == "app" and g not in order:
            order.append(g)
    targets = [g for g in order if g not in served][:2]
    want = {x[0] for g in targets for x in best([r for r in rows if r[1] == g])[:15] if x[2] not in ("app", "ref")}
    found = vector.top_k(df, q, "id", "v", 40, ["g", "kind"])
    lacking = retrieval.lacking(found.where("kind = 'app'"), "g", vector.best_first("id"), found, "g", F.col("kind") == "text", most=2)
    assert [r[0] for r in lacking.collect()] == targets and served and targets
    more = retrieval.backfill(df, lacking, q, "id", "v", "g", ~F.col("kind").isin("app", "ref"), ["kind"])
    assert {r["id"] for r in more.collect()} == want and want
    both = retrieval.backfilled(found, more, "id").collect()
    assert len(both) == len({r["id"] for r in both}) == len({x[0] for x in pool} | want)


@pytest.mark.parametrize("budget", [0, 1, 4, 9, 30])
def test_tail_windows_spend_one_budget(spark, budget):
    groups = [("a", 300, 50), ("b", 90, 50), ("c", 1000, 3), ("d", 70, 0), ("e", None, 9), ("f", 35, 9)] + [(f"x{k}", 50, 1) for k in range(9)]
    want, left = {}, budget
    for g, n, refs in sorted((x for x in groups if x[2] and x[1] is not None), key=lambda x: (-x[2], x[0]))[:8]:
        high, start, used = n, n - min(n, 2 * refs + 40), 0
        while high > start and left > 0:
            high, left, used = max(start, high - 20), left - 1, used + 1
        if used:
            want[g] = (high, used)
    got = retrieval.tail_windows(spark.createDataFrame(groups, "g string, n int, refs int"), "g", "n", "refs", budget=budget).collect()
    assert {r["g"]: (r["from"], r["batches"]) for r in got} == want


def test_engine_looks_twice_and_reads_tails(engine, spark):  # noqa: F811
    """A pool too small for any prose: the second look finds the excerpt."""
    c = engine.corpus
    noise = spark.createDataFrame([(f"N{i}", "RP-8-25", "table", 90, 0, "current", f"patient room exam room {i}") for i in range(60)], "id string, standard_code string, chunk_type string, page_number int, tm24_eligible int, status string, excerpt_text string")
    vectors = c.vectors.unionByName(engine.embedder.embed(noise, "excerpt_text")).withColumn("ordinal", F.when(F.col("chunk_type") == "reference", 9).otherwise(0))
    counts = c.standards.withColumn("chunk_count", F.lit(10)).withColumn("reference_count", F.when(F.col("id") == "RP-29-22", 1).otherwise(0))
    own = SearchEngine(spark, Corpus(vectors, c.applications, counts), engine.embedder, tails_only=True)
    first = own.search({"query": "patient room", "limit": 5, "filters": {"content_types": ["tables"]}})["results"][0]
    assert first["standard"] == "RP-29-22" and first["excerpt"]["page"] == 9
    assert [r["link"] for r in own.search({"query": "list of references on patient rooms"})["results"]] == ["u/1"]
    far = SearchEngine(spark, Corpus(vectors, c.applications, counts.withColumn("chunk_count", F.lit(900))), engine.embedder, tails_only=True)
    assert far.search({"query": "list of references on patient rooms"})["results"] == []


def test_versions_are_shared_and_rise(spark, tmp_path):
    ours, theirs = (DataVersion(spark, f"file://{tmp_path}/v") for _ in range(2))
    assert ours.current() == theirs.current() == 1
    assert (ours.bump(), theirs.bump(), ours.current()) == (2, 3, 3)
    a, b = Cache(stored=ours), Cache(stored=theirs)
    key = a.key("response", {"q": 1})
    a.put(key, "old")
    b.bump()
    assert a.get(a.key("response", {"q": 1})) is None and a.key("response", {"q": 1}) == b.key("response", {"q": 1}) != key
    got = []
    each = [threading.Thread(target=lambda: got.extend(DataVersion(spark, f"file://{tmp_path}/v").bump() for _ in range(5))) for _ in range(3)]
    for t in each:
        t.start()
    for t in each:
        t.join()
    assert len(got) == 15 and ours.current() == max(got) and len(ours.folder.names()) <= 4


def test_files_are_never_written_over(spark, tmp_path):
    f = Folder(spark, f"file://{tmp_path}/f")
    assert f.put_new("a", "é1") and not f.put_new("a", "2") and f.read("a") == "é1" and f.names() == ["a"]


def flaky(fails=0, short=False):
    """A model that fails its first calls in each process, or always answers with a vector too few."""
    calls = []

    def model(texts):
        calls.append(len(texts))
        if len(calls) <= fails:
            raise OSError("busy")
        return [[float(len(t)), 1.0] for t in texts][: -1 if short else None]

    return model


def test_batches_are_tried_again(monkeypatch):
    waits = []
    monkeypatch.setattr(embedding.time, "sleep", waits.append)
    assert embedding.called(flaky(2), ["ab", ""]) == [[2.0, 1.0], [0.0, 1.0]] and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        embedding.called(flaky(3), ["ab"])
    with pytest.raises(ValueError, match="expected 2 vectors, got 1"):
        embedding.called(flaky(short=True), ["a", "b"])


def test_all_vectors_or_none(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 7) if i % 5 else None) for i in range(950)], "id int, text string").repartition(3)
    place = f"file://{tmp_path}/store"
    got = embedding.commit_embedded(df, place, "t1", "text", flaky(2), wait=0.0)
    assert got.count() == 950 and {len(r["text"] or "") for r in got.collect()} == {int(r["values"][0]) for r in got.collect()}
    with pytest.raises(Exception, match="busy"):
        embedding.commit_embedded(df, place, "t2", "text", flaky(10**6), wait=0.0)
    assert Folder(spark, place).names() == ["t1"]
    with pytest.raises(FileExistsError):
        embedding.commit_embedded(df, place, "t1", "text", flaky(), wait=0.0)


def test_stream_upserts_survive_redelivery(spark, tmp_path):
    table = upserts.KeyedTable(spark, f"file://{tmp_path}/t", "k long, at long, v string", "k", buckets=4)
    batch = lambda *rows: spark.createDataFrame(rows, "k long, at long, v string")
    state = lambda: sorted(map(tuple, table.read().collect()))
    assert state() == [] and table.apply(batch((1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "z")), 0, ["at"])
    assert not table.apply(batch((1, 9, "twice")), 0, ["at"]) and state() == [(1, 2, "b"), (2, 1, "c")]
    # a batch that died after its files, before its manifest
    batch((7, 7, "half")).withColumn("__bucket", F.lit(0)).write.partitionBy("__bucket").parquet(f"{tmp_path}/t/batch-1")
    assert state() == [(1, 2, "b"), (2, 1, "c")]
    assert table.apply(batch((2, 5, None), (3, 1, "d")), 1, ["at"], {"v": "coalesce"}) and state() == [(1, 2, "b"), (2, 5, "c"), (3, 1, "d")]
    assert table.apply(batch(), 2) and state() == [(1, 2, "b"), (2, 5, "c"), (3, 1, "d")]
    table.drop_unused(1)
    assert state() == [(1, 2, "b"), (2, 5, "c"), (3, 1, "d")]


def test_stream_from_files_to_keyed_table(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = lambda a, b: spark.sql(f"select id event_id, cast(timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) as timestamp_ntz) ts, id % 7 user_id, 'view' event_type, cast(id as double) value, '{{}}' props from range({a}, {b})")
    rows(0, 100).coalesce(1).write.parquet(f"{source}/a")
    table = upserts.KeyedTable(spark, f"file://{tmp_path}/t", "user_id long, ts timestamp_ntz, value double", "user_id", buckets=3)
    run = lambda mark: upserts.upsert_stream(log.read_log(spark, f"{source}/*", files_per_trigger=1), table, str(tmp_path / mark), ["ts"]).trigger(availableNow=True).start().awaitTermination(120)
    run("mark")
    rows(100, 150).coalesce(1).write.parquet(f"{source}/b")
    run("mark")
    want = {u: float(max(i for i in range(150) if i % 7 == u)) for u in range(7)}
    assert {r["user_id"]: r["value"] for r in table.read().collect()} == want and table.last_batch() == 1
    run("lost")  # the stream's own checkpoint is gone: batches 0 and 1 come again
    assert {r["user_id"]: r["value"] for r in table.read().collect()} == want and table.last_batch() == 1


def test_late_and_repeated_events(spark, tmp_path):
    """Within the watermark an event counts once however often it comes; one that is later than the watermark is dropped."""
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put = lambda name, rows: spark.sql("select * from values " + ", ".join(f"(cast({i} as bigint), timestamp_ntz'2024-01-01 {t}', 1L, 'view', 1.0D, '')" for i, t in rows) + " as t(event_id, ts, user_id, event_type, value, props)").coalesce(1).write.parquet(f"{source}/{name}")
    run = lambda: log.append_log(log.distinct_events(log.read_log(spark, f"{source}/*"), "ts", ["event_id"], "10 minutes"), out, mark).awaitTermination(120)
    put("a", [(1, "10:00:00"), (2, "10:01:00"), (1, "10:00:00")])
    run()
    put("b", [(2, "10:01:00"), (3, "11:00:00")])
    run()
    put("c", [(4, "10:30:00"), (5, "10:55:00"), (3, "11:00:00")])
    run()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 5]
