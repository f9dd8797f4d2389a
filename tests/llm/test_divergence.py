"""Source divergence against its SQL and against whole numbers, on odd rows and with small blocks, tiles and rounds."""

import random

import duckdb
import numpy as np
import pytest

from foliant.llm import divergence


def test_shares_are_exact():
    r = random.Random(3)
    m = [r.randrange(1, 10 ** r.randrange(1, 16)) for _ in range(500)]
    n = [r.randrange(x) for x in m]
    got = divergence.share(np.array(n), np.array(m))
    assert got.tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n, m, strict=True)]
    assert divergence.share(np.array([0]), np.array([1])).tolist() == [10**9 + 1]


def make_rows(seed, n_sources=9):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 4))) for _ in range(90)]
    rows = []
    for i in range(260):
        s = r.choice([None, "", "S", *(f"s{k}" for k in range(n_sources))])
        own = [w.upper() if r.random() < 0.2 else w for w in r.choices(words, weights=[1 / (1 + (k * 7 + len(s or "")) % 90) for k in range(90)], k=r.randrange(0, 30))]
        rows.append((i // 2, r.choice([" ", "-", "9", "\n", " x"]).join(own), r.choice(["en", "en", "en", "de", None, ""]), s))
    rows += [(None, None, "en", "only null"), (1, "", "xx", "a"), (2, "zq zq", "xx", "b"), (3, "alone", "yy", "a"), (4, "LONG long " * 20_000, "en", "s1"), (5, "İ ÀÉ 日本 😀 日本", "en", "s2"), (5, "日本 日本", "en", "s2"), (6, "日本", "en", "s3")]
    return rows + rows[:5]


@pytest.mark.parametrize("small", [False, True])
def test_op12(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(divergence, "BLOCK", 100)
        monkeypatch.setattr(divergence, "CELLS", 30)
        monkeypatch.setattr(divergence, "GROWTH", 2)
    rows = make_rows(1 + small)
    docs = spark.createDataFrame([(*x, 7, 1.0) for x in rows], "doc_id long, text string, lang string, source string, rank int, value double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for top in (200, 3):
        want = con.sql(divergence.OP12_SQL.replace("rank <= 200", f"rank <= {top}")).fetchall()
        got = [tuple(x) for x in divergence.audit(docs, top).collect()]
        assert sorted(got) == sorted(want)
    assert {x[0] for x in got} == {"", "de", "en", "xx"} and any(x[2] == "term" and x[5] == 3 for x in got)


def test_rounds_stop_before_all_terms(spark):
    """One term stands out by so much that the buckets of rarer terms are never evaluated."""
    rows = [(k, "strong " * 40 + " ".join(f"t{k}x{j}" for j in range(30)), "en", "a") for k in range(4)] * 3 + [(k, " ".join(f"t{k % 4}x{j}" for j in range(30)), "en", "b") for k in range(12)]
    corpus = divergence.Corpus(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = divergence.leaning_terms(corpus, 1).collect()
    assert [x["term"] for x in got if x["source"] == "a"] == ["strong"]
    corpus.close()


def test_no_rows(spark, no_documents):
    assert divergence.audit(no_documents).count() == 0


def test_odd_documents(spark, odd_documents):
    got = divergence.audit(odd_documents).collect()
    assert {(x["lang"], x["source"]) for x in got if x["part"] == "pair"} == {("en", "a"), ("en", "b"), ("", ""), ("", "c")}
