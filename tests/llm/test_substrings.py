"""Removal of shared word windows against brute force and its SQL, with small shards and crowded anchors too."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from foliant.llm import common, registry, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_rows(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioußtr") for _ in range(r.randrange(1, 6))) for _ in range(60)]
    passages = [r.choices(words, k=r.choice((12, 13, 14, 30, 70))) for _ in range(12)]
    rows = []
    for i in range(150):
        own = r.choices(words, k=r.randrange(0, 25))
        for _ in range(r.randrange(3)):
            own += r.choice(passages)[r.randrange(3) :] + r.choices(words, k=r.randrange(0, 15))
        rows.append((r.choice((i, i, i, i // 3)), r.choice([" ", "\n", "\t "]).join(own)))
    line = r.choices(words, k=12)  # one word short of a window, in ever different surroundings
    rows += [(300 + k, " ".join([words[k % 60], *line, words[k % 7], *line[:5]])) for k in range(60)]
    rows += [(400 + k % 9, rows[3][1]) for k in range(20)] + [(500, None), (501, ""), (None, rows[5][1]), (None, rows[5][1]), (None, None), (502, " ".join(words[:13])), (503, " ".join(words[:13])), (-4, " ".join(words[:13]))]
    rows += [(600, "long " * 30_000), (601, "long " * 13), (602, "long " * 12), (603, " ".join(r.choices(words, k=9000)) + " " + " ".join(passages[4]))]
    return rows + rows[:4]


def brute(rows, window=13):
    least = {}
    each = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in each:
        for k in range(len(w) - window + 1):
            if i is not None:
                own = tuple(w[k : k + window])
                least[own] = min(i, least.get(own, i))
    out = []
    for i, w in each:
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and least[tuple(w[k : k + window])] < i for j in range(window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


by = lambda rows: sorted(rows, key=str)


@pytest.mark.parametrize(("shard", "crowd"), [(300_000, 20_000), (4_000, 3)])
def test_op11(spark, tmp_path, monkeypatch, shard, crowd):
    monkeypatch.setattr(substrings, "SHARD", shard)
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rows = make_rows(shard)
    spark.createDataFrame([(*x, 7, "en") for x in rows], "doc_id long, text string, h int, piece string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in registry.QUERIES["op11_fm_matching"](spark, str(tmp_path)).collect()]
    want = brute(rows)
    assert by(got) == by(want) and sum(x[2] > 0 for x in want) > 50
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert by(con.sql(substrings.OP11_SQL).fetchall()) == by(want)


def test_spans_tell_what_goes(spark):
    rows = [(1, "a b c d e f g"), (2, "x b c d y e f g"), (3, "b c d e f g")]
    got = {x["doc_id"]: ([tuple(s) for s in x["spans"]], x["kept"]) for x in substrings.remove_shared_windows(spark.createDataFrame(rows, "doc_id long, text string"), 3, 2).collect()}
    assert got == {1: ([], "a b c d e f g"), 2: ([(1, 3), (5, 3)], "x y"), 3: ([(0, 6)], "")}


def test_no_rows(spark, no_documents):
    assert substrings.remove_shared_windows(no_documents).count() == 0


def test_odd_documents(spark, odd_documents):
    got = substrings.remove_shared_windows(odd_documents).collect()
    assert len(got) == odd_documents.count() and all(x["n_removed"] == 0 for x in got)


def test_a_crowded_anchor_costs_its_own_windows_alone(spark, monkeypatch):
    fresh = map("a{}".format, itertools.count())
    passages = [" ".join(f"p{k}w{i}" for i in range(60)) for k in range(20)]
    rows = [(k * 20 + j, p) for k, p in enumerate(passages) for j in range(20)]
    line = [f"line{i}" for i in range(12)]
    around = lambda: itertools.islice(fresh, 10)
    rows += [(1000 + k, " ".join([*around(), *line, *around()])) for k in range(60)]
    rows += [(i + 500, t) for i, t in rows[-60::7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def removed(crowd):
        texts = []

        def write(df):
            out = common.materialize(df)
            texts.append(out.count() if "piece" in df.columns else 0)
            return out

        monkeypatch.setattr(substrings, "CROWD", crowd)
        monkeypatch.setattr(substrings, "materialize", write)
        got = substrings.remove_shared_windows(docs).select("doc_id", "n_removed", "kept").collect()
        return by(map(tuple, got)), sum(texts)

    (plain, few), (split, more) = removed(1000), removed(30)
    assert split == plain and sum(x[1] > 0 for x in plain) == 20 * 19 + 9
    assert few > 20 * 20 and 0 < more - few < 60 * 9 * 2
