"""Runs of words against brute force: Lyndon arrays, comparisons, the query on odd rows."""

import hashlib
import random
import re
import zlib

from foliant.llm import registry, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(word, times, least):
    out, n = [], len(word)
    for p in range(1, n // 2 + 1):
        same = [i + p < n and word[i] == word[i + p] for i in range(n + 1)]
        for i in range(n):
            if same[i] and not (i and same[i - 1]):
                size = same.index(False, i) - i + p
                own = word[i : i + size]
                if size >= max(least, times * p) and not any(own[q:] == own[:-q] for q in range(1, p)):
                    out.append((i, size, p))
    return sorted(out)


def periodic(r, n):
    word = [r.randrange(r.choice((1, 2, 3, 6))) for _ in range(n)]
    if n and r.random() < 0.6:
        word = (word[: r.randint(1, max(1, n // 3))] * n)[:n]
        for _ in range(r.randint(0, 3)):
            word[r.randrange(n)] = r.randrange(4)
    return word


def test_next_smaller_suffixes_and_runs():
    r = random.Random(5)
    for _ in range(800):
        word = periodic(r, r.randint(0, 50))
        n = len(word)
        for step in (1, -1):
            key = [[x * step for x in word[i:]] for i in range(n)]
            assert runs.lyndon(word, step)[0] == [next((j for j in range(i + 1, n) if key[j] < key[i]), n) for i in range(n)]
        for times, least in ((2, 0), (3, 5), (4, 6)):
            want = brute(word, times, least)
            assert runs.runs(word, times, least) == want
            assert runs.runs_of_texts([[b"%d" % x for x in word], [], [b"%d" % x for x in word]], times, least) == [want, [], want]


class Counted(int):
    n = 0

    def __eq__(self, other):
        Counted.n += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def test_comparisons_are_linear():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 6000:
        fib.append(fib[-1] + fib[-2])
    for word in (fib[-1], [0] * 6000, ([0] * 9 + [1]) * 600, [(i & -i).bit_length() for i in range(1, 6001)], [i * i % 7 for i in range(2000)] * 3):
        for step in (1, -1):
            Counted.n = 0
            runs.lyndon([Counted(x) for x in word], step)
            assert Counted.n <= 3 * len(word)


def want_of(doc_id, text):
    word = WORD.findall(text or "")
    n = len(word)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        word = [word[i] if i < a else word[a + (i - a) % p] for i in range(n)]
    found = brute(word, 4, 6)
    best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    return {
        "doc_id": doc_id, "n_runs": len(found), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), "collapsed_sha256": sha(" ".join(w for i, w in enumerate(word) if i not in gone)),
    }


def test_op13(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{x}é" for x in periodic(r, r.randint(0, 90)))) for i in range(-5, 250)] + [(900, "a b\tc\na b c\x0ba b c a b c a"), (901, "x " * 300), (902, "x x " * 7)]
    rows += [(903, " ".join(str(k * 7919 % 4001) for k in range(1500)) + " q r s t" * 40), (904, None), (905, ""), (None, "y " * 9), (None, None)]
    rows += rows[:3]
    spark.createDataFrame([(*x, 7, "en") for x in rows], "doc_id long, text string, n_runs int, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [x.asDict() for x in registry.QUERIES["op13_lyndon_runs"](spark, str(tmp_path)).collect()]
    key = lambda x: str(sorted(x.items()))
    assert sorted(got, key=key) == sorted((want_of(*x) for x in rows), key=key)
    assert sum(x["n_runs"] for x in got) > 100


def test_op13_without_rows(spark, no_documents):
    assert runs.digests(runs.periodic_runs(no_documents)).count() == 0


def test_odd_documents(spark, odd_documents):
    got = runs.periodic_runs(odd_documents).collect()
    assert len(got) == odd_documents.count() and sum(len(x["runs"]) for x in got) == 1 and {x["collapsed"] for x in got if x["doc_id"] == 3} == {"word"}
