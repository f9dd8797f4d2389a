"""The tokens of a criteria row as columns: what stands where in a line, for its two planes.

A line is ``<name> <A|T> <veiling risk> <category> <n> lx @ <height> <n> fc @ <height> <metrics>``, the data once or
twice: the first pair is the horizontal plane, the second the vertical one. A placeholder (#) before the first value leaves the
horizontal plane empty. Metrics count for the plane they follow. A pattern's matches are taken once a line, as arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import extraction as fixed

#: Fields that are read from a stretch of the line: name -> (pattern, group, whether it is a number).
METRICS = {"basis": (fixed.BASIS, 1, False), "uniformity": (fixed.RATIO, 1, False), "ratio_basis": (fixed.RATIO_BASIS, 1, False), "cv": (fixed.CV, 1, True)}
PLANE = ("cat", "lux", "height_m", "fc", "height_ft")


def java(pattern) -> str:
    """A pattern with its flags, as Spark takes it."""
    return ("(?i)" if pattern.flags & 2 else "") + pattern.pattern


def first(c: Column, pattern, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(c, java(pattern), group), F.lit(""))


def _height(token: Column) -> Column:
    """A height in its own unit; a task surface and the ground are none."""
    return F.nullif(first(token, _NUMBER).cast("double"), F.lit(0.0))


class _Pattern:
    def __init__(self, pattern: str, flags: int = 0):
        self.pattern, self.flags = pattern, flags


_NUMBER, _GLARE, _PERCENT = _Pattern(r"^\s*(\d+(?:\.\d+)?)"), _Pattern(r"\bG([0-5])\b"), _Pattern(r"(\d+(?:\.\d+)?)\s*%")
_UPLIGHT, _LUMEN = _Pattern(r"\bU([0-5])\b"), _Pattern(r"(\d+(?:\.\d+)?)\s*lm\b")


def parsed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with has_data, label, area_or_task, veiling_risk, the fields of both planes (hor_*, ver_*) and those of the surroundings."""
    t = F.col(text)
    found = lambda pattern, group: F.regexp_extract_all(t, F.lit(java(pattern)), F.lit(group))
    out = df.withColumns({
        "__l": found(fixed.LUX, 0), "__lc": found(fixed.LUX, 1), "__ln": found(fixed.LUX, 2), "__lh": found(fixed.LUX, 3), "__f": found(fixed.FC, 0), "__fn": found(fixed.FC, 1), "__fh": found(fixed.FC, 2),
        "__p": F.nullif(F.regexp_instr(t, F.lit(java(fixed.PLACEHOLDER))), F.lit(0)),
    })
    # a match begins where its text first stands after the match before: had it stood earlier, it would have matched there
    at = lambda m, k, after: F.when(F.size(m) > k, F.call_function("locate", F.get(m, F.lit(k)), t, after))
    for m in ("l", "f"):
        out = out.withColumn(f"__{m}0", at(F.col(f"__{m}"), 0, F.lit(1)))
        out = out.withColumn(f"__{m}1", at(F.col(f"__{m}"), 1, F.col(f"__{m}0") + F.length(F.get(f"__{m}", F.lit(0)))))
    out = out.withColumn("__v", F.when(F.coalesce(F.col("__p") < F.col("__l0"), F.col("__p").isNotNull()), 0).otherwise(1))  # which pair is the vertical plane's
    pick = lambda a, plane: F.nullif(F.get(a, F.col("__v") if plane == "ver" else F.when(F.col("__v") == 1, 0)), F.lit(""))
    fields = {}
    for plane in ("hor", "ver"):
        fields |= {f"{plane}_cat": F.upper(pick("__lc", plane)), f"{plane}_lux": pick("__ln", plane).cast("double"), f"{plane}_height_m": _height(pick("__lh", plane))}
        fields |= {f"{plane}_fc": pick("__fn", plane).cast("double"), f"{plane}_height_ft": _height(pick("__fh", plane))}
    out = out.withColumns(fields).withColumn("has_data", F.coalesce("hor_lux", "hor_fc", "ver_lux", "ver_fc").isNotNull())
    end = lambda m: F.when(F.col("__v") == 1, F.col(f"__{m}0") + F.length(F.get(f"__{m}", F.lit(0))))
    split = F.coalesce(F.when(F.col("__v") == 1, F.col("__l1")).otherwise(F.col("__l0")), F.length(t) + 1)
    out = out.withColumns({"__split": split, "__after": F.greatest(end("l"), end("f"))})
    tails = {"hor": F.coalesce(F.substring(t, F.col("__after"), F.greatest(F.lit(0), F.col("__split") - F.col("__after"))), F.lit("")), "ver": F.substring(t, F.col("__split"), F.length(t))}
    out = out.withColumns({f"__{p}": c for p, c in tails.items()})
    out = out.withColumns({f"{p}_{n}": first(F.col(f"__{p}"), pattern, g).cast("double" if number else "string") for p in tails for n, (pattern, g, number) in METRICS.items()})
    # the name ends at the first token; letters of their own before it are marks, two at most
    ends = F.least(F.lit(None).cast("int"), F.col("__l0"), F.col("__f0"), F.col("__p"))
    words = F.split(F.trim(F.regexp_replace(F.coalesce(F.substring(t, F.lit(1), ends - 1), t), r"\s+", " ")), " ")
    out = out.withColumn("__w", words)
    letter = lambda left: F.when((F.size(left) > 1) & F.element_at(left, -1).isin("A", "T", "L", "M", "H"), F.element_at(left, -1))
    rest = lambda left, mark: F.when(F.col(mark).isNotNull(), F.slice(left, 1, F.greatest(F.lit(0), F.size(left) - 1))).otherwise(left)
    out = out.withColumn("__m1", letter(F.col("__w"))).withColumn("__w", rest(F.col("__w"), "__m1"))
    out = out.withColumn("__m2", F.when(F.col("__m1").isNotNull(), letter(F.col("__w")))).withColumn("__w", rest(F.col("__w"), "__m2"))
    kind = lambda *of: F.coalesce(*[F.when(F.col(m).isin(*of), F.col(m)) for m in ("__m2", "__m1")])
    spelled = lambda c: F.when(c == "T", "Task").when(c == "A", "Area")
    glued = first(t, fixed.GLUED)
    out = out.withColumns({"__a": spelled(kind("A", "T")), "veiling_risk": kind("L", "M", "H"), "__g": spelled(glued), "__n": F.array_join("__w", " ")})
    loose = F.col("__a").isNull() & F.col("__g").isNotNull()
    bare = F.regexp_replace(t, java(fixed.CV), "")
    out = out.withColumns({
        "area_or_task": F.coalesce("__a", "__g"), "label": F.when(loose, F.trim(F.regexp_replace("__n", r"[AT]\s*$", ""))).otherwise(F.col("__n")),
        "glare_max": F.coalesce(F.concat(F.lit("G"), first(t, _GLARE)), F.concat(first(bare, _PERCENT), F.lit("%"))), "uplight_max": F.coalesce(F.concat(F.lit("U"), first(t, _UPLIGHT)), F.concat(first(t, _LUMEN), F.lit(" lm"))),
        "controls": first(t, fixed.CONTROLS), "spectrum": F.concat(first(t, fixed.SPECTRUM, 1), F.lit("K to "), first(t, fixed.SPECTRUM, 2), F.lit("K")), "class_of_play": F.upper(first(t, fixed.CLASS_OF_PLAY)),
    })
    return out.drop(*[c for c in out.columns if c.startswith("__") and c not in df.columns])


def named(df: DataFrame, label: str) -> DataFrame:
    """``df`` with name (the label without a link and raised digits), link and raised (numbers of raised digits)."""
    whole = F.trim(F.col(label))
    link_at = F.regexp_instr(whole, F.lit(java(fixed.LINK)))
    out = df.withColumns({"__t": F.when(link_at > 1, F.trim(F.substring(whole, F.lit(1), link_at - 1))).otherwise(whole), "link": F.when(link_at > 1, F.trim(first(whole, fixed.LINK)))})
    digits = F.translate(first(F.col("__t"), fixed.SUPERSCRIPT_END), "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789").cast("int")
    return out.withColumns({"name": F.trim(F.regexp_replace("__t", java(fixed.SUPERSCRIPT_END), "")), "raised": F.array_compact(F.array(digits))}).drop("__t")


def clean(name: Column) -> Column:
    """A row's own name without what counts or marks it."""
    for pattern in (r"\s*[⁰¹²³⁴⁵⁶⁷⁸⁹]+$", r"\s+\d+$", r"\s*\([a-z]\)$", r"^[AT]\s+"):
        name = F.regexp_replace(name, pattern, "")
    return F.trim(name)
