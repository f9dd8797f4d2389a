"""Chat formatting: records of many layouts to canonical turns, and a reversible template with a loss mask.

A record is a JSON document. Its fingerprint hashes its nested field paths: the shape that
the variant type reports, with the types of scalars taken away. The fingerprint picks a
declarative mapping (where the turns stand, what role and text are called), and the mapping
alone says how canonical turns, array<struct<role, text>>, come about.

The template writes ``<|role|>``, role, ``<|text|>``, text, ``<|end|>`` per turn. Control strings within
roles and texts get one backslash more after their first character (``<|`` becomes ``<\\|``,
``<\\|`` becomes ``<\\\\|``); reading back takes it away. The output is kept as segments with a loss
flag: the texts of assistants are loss, all else is not.

Edge cases: a null role or text is an empty one. Records that are no JSON, or whose
fingerprint no mapping has, get the layout ``unknown`` and null turns; op4 has none. Turns
with equal numbers order by (role, text), so rows that repeat come twice. A conversation is
one training example and one row, however long; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"

#: name, field paths, where the turns come from: either (path of the list, role field, text field, role names), or fixed (role, paths) in order.
MAPPINGS: list[dict] = [
    {"name": "role_text", "paths": ["role", "text"], "row": ("role", "text")},
    {"name": "role_content", "paths": ["role", "content"], "row": ("role", "content")},
    {"name": "messages", "paths": ["messages[].role", "messages[].content"], "list": ("messages", "role", "content")},
    {"name": "messages_text", "paths": ["messages[].role", "messages[].text"], "list": ("messages", "role", "text")},
    {"name": "conversations", "paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant", "bing": "assistant"}},
    {"name": "prompt_completion", "paths": ["prompt", "completion"], "fixed": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "prompt_response", "paths": ["prompt", "response"], "fixed": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "question_answer", "paths": ["question", "answer"], "fixed": [("user", ["question"]), ("assistant", ["answer"])]},
    {"name": "instruction", "paths": ["instruction", "output"], "fixed": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"name": "instruction_input", "paths": ["instruction", "input", "output"], "fixed": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "system_instruction", "paths": ["system", "instruction", "output"], "fixed": [("system", ["system"]), ("user", ["instruction"]), ("assistant", ["output"])]},
    {"name": "data_messages", "paths": ["data.messages[].role", "data.messages[].content"], "list": ("data.messages", "role", "content")},
]


def shape(paths: list[str]) -> str:
    """The canonical shape of field paths (``a.b``, ``a[].b``): fields by name, scalars without a type."""
    tree: dict = {}
    for path in paths:
        at, parts = tree, path.split(".")
        for k, part in enumerate(parts):
            at = at.setdefault(part, {} if k < len(parts) - 1 else None)

    def write(node: dict) -> str:
        fields = []
        for key in sorted(node, key=lambda x: x.removesuffix("[]")):
            inner = "*" if node[key] is None else write(node[key])
            fields.append(f"{key.removesuffix('[]')}: " + (f"ARRAY<{inner}>" if key.endswith("[]") else inner))
        return f"OBJECT<{', '.join(fields)}>"

    return write(tree)


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256(shape(paths).encode()).hexdigest()


def fingerprint(record: Column) -> Column:
    """Hash of a JSON record's nested field paths; null if it is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(record))
    return F.sha2(F.regexp_replace(kind, r"(?<=: |ARRAY<)(?:VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9,]+\)|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT)(?=[,>])", "*"), 256)


def _turns(mapping: dict, record: Column) -> Column:
    text = lambda x: F.coalesce(x, F.lit(""))
    roles = mapping.get("roles", {})

    def role(x: Column) -> Column:
        out = text(x)
        for old, new in roles.items():
            out = F.when(x == old, new).otherwise(out)
        return out

    if "row" in mapping:
        r, t = mapping["row"]
        got = F.from_json(record, f"`{r}` string, `{t}` string")
        return F.array(F.struct(role(got[r]).alias("role"), text(got[t]).alias("text")))
    if "list" in mapping:
        path, r, t = mapping["list"]
        parts = path.split(".")
        kind = f"array<struct<`{r}`:string,`{t}`:string>>"
        for part in reversed(parts):
            kind = f"struct<`{part}`:{kind}>"
        got = F.from_json(record, kind)
        for part in parts:
            got = got[part]
        return F.transform(got, lambda x: F.struct(role(x[r]).alias("role"), text(x[t]).alias("text")))
    names = [p for _, paths in mapping["fixed"] for p in paths]
    got = F.from_json(record, ", ".join(f"`{n}` string" for n in names))
    joined = lambda paths: F.array_join(F.filter(F.array(*[text(got[p]) for p in paths]), lambda x: x != ""), "\n")
    return F.array(*[F.struct(F.lit(r).alias("role"), joined(paths).alias("text")) for r, paths in mapping["fixed"]])


def canonical_turns(records: DataFrame, record: str = "record", mappings: list[dict] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout`` (a mapping's name or ``unknown``) and ``turns``."""
    marked = records.withColumn("__print", fingerprint(F.col(record)))
    layout, turns = F.lit("unknown"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        fits = F.col("__print") == fingerprint_of(m["paths"])
        layout = F.when(fits, m["name"]).otherwise(layout)
        turns = F.when(fits, _turns(m, F.col(record))).otherwise(turns)
    return marked.withColumns({"layout": layout, "turns": turns}).drop("__print")


#: Control strings: the template's own and those of common chat formats; a string is what follows any number of backslashes.
CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"(<|\[)\\(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"


def escaped(x: Column) -> Column:
    return F.regexp_replace(x, CONTROL, r"$1\\$2$3")


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, ESCAPED, "$1$2$3")


def segments(turns: Column) -> Column:
    """array<struct<text, loss>>: their texts in a row are the formatted conversation."""
    part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                part(F.concat(F.lit(ROLE), escaped(F.coalesce(t["role"], F.lit(""))), F.lit(TEXT)), F.lit(False)),
                part(escaped(F.coalesce(t["text"], F.lit(""))), F.coalesce(t["role"] == "assistant", F.lit(False))),
                part(F.lit(END), F.lit(False)),
            ),
        )
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> conv_id, segments, formatted: one row per conversation."""
    each = F.struct("turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("__turns"))
    parts = whole.select("conv_id", segments(F.col("__turns")).alias("segments"))
    return parts.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns that a formatted conversation holds."""
    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)
    own = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    at = lambda p: F.split(p, r"\Q" + TEXT + r"\E", 2)
    return F.transform(own, lambda p: F.struct(unescaped(F.substring(at(p)[0], len(ROLE) + 1, 1 << 30)).alias("role"), unescaped(at(p)[1]).alias("text")))


def op4(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    keep = {"ignoreNullFields": "false"}
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), keep)
    same = "</s>[INST] ok [/INST]"
    message = lambda role: F.struct(F.lit(role).alias("role"), F.lit(same).alias("content"))
    added = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.to_json(F.struct(F.array(message("user"), message("assistant")).alias("messages")), keep).alias("record"))
    records = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), record.alias("record")).unionByName(added)
    turns = canonical_turns(records).select("conv_id", "turn", "layout", F.posexplode("turns").alias("pos", "t"))
    ordered = turns.select("conv_id", F.struct("turn", "pos").alias("turn"), "t.role", "t.text")
    got = format_conversations(ordered).select("conv_id", "segments", "formatted", read_back(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
