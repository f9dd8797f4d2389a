"""The row grammar as columns against a plain reading of the same rules, on lines made of tokens in every order."""

import random

from pyspark.sql import functions as F

from foliant.operators import extraction, row_grammar

TOKENS = [
    "Room", "Court 2", "Hall (avg.)", "Min", "A", "T", "L", "M", "H", "P", "O", "w", "100 lx @ TS", "12.5 lux @ 0.76 m", "7 lx", "A50 lx", "(x)T 20 lx", "10 fc @ 2.5 ft", "3 footcandles @ TS", "1.5 fc", "5 fc @ 0 ft", "#", "# 0.76 m", "# 2.5 ft", "#TS",
    "Avg", "Max", "Max:Avg:Min", "Avg:Min", "3:1", "1.2:1", "CV 12%", "CV: 3.5 %", "40%", "G3", "U0", "300 lm", "Dim to 30%", "Curfew", "3000 K to 4000 K", "2700K–3000K", "Class of Play: II", "Class IV", "< 50 people,", "Room Max", "See ANSI/IES RP-8-25", "¹²", "x³", "(a)", "12",
]


def test_lines_of_every_form(spark):
    r = random.Random(8)
    lines = [r.choice(["", " "]) + r.choice([" ", " ", "  "]).join(r.choices(TOKENS, k=r.randrange(0, 11))) for _ in range(3000)]
    lines += ["Conference rm, < 50 people T # 0.76 m # 2.5 ft … O 200 lx @ 1.22 m 20 fc @ 4 ft Avg", "Day A P 200 lx @ 0 m 20 fc @ 0 ft Avg 3:1 Avg:Min N 100 lx @ TS 10 fc @ TS Min 2:1", "Room (avg.)A50 lx", "A", "T 5 lx"]
    got = row_grammar.parsed(spark.createDataFrame(list(enumerate(lines)), "i int, text string"), "text").collect()
    for x in got:
        want = extraction.parse_data_row(lines[x["i"]])
        assert {k: x[k] for k in want} == want, lines[x["i"]]
    assert len(got) == len(lines)


def test_names(spark):
    r = random.Random(9)
    lines = [" ".join(r.choices(TOKENS, k=r.randrange(1, 5))) for _ in range(500)] + ["BSR/IES RP-2-20 first", "Emergency entry¹", "Lobby Refer to ANSI/IES RP-1-20", "Bay (b)", "A Room 12"]
    got = row_grammar.named(spark.createDataFrame(list(enumerate(lines)), "i int, label string"), "label").withColumn("clean", row_grammar.clean(F.col("name"))).collect()
    for x in got:
        name, link = extraction.split_link(lines[x["i"]])
        name, raised = extraction.split_superscript(name)
        assert (x["name"], x["link"], x["raised"], x["clean"]) == (name, link, raised, extraction.clean_name(name)), lines[x["i"]]
