"""Request-scoped search: intents, pools, relational fetch, excerpts, blending, fallback, comparison, summary.

Every stage is a plan over vectors (id, standard_code, chunk_type, page_number, tm24_eligible,
status, excerpt_text, values), applications and standards that ends in a top-k: the driver
sees at most ``POOL`` rows of each.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import ids, text
from foliant.functions.vocabulary import COMPARISON_PATTERNS, REFERENCE_PATTERNS
from foliant.operators import relational, retrieval, vector
from foliant.operators.references import reference_links
from foliant.sources.files import DataVersion

POOL, EXCERPT_RADIUS, STRONG, MIN_RESULTS = 50, 5, 0.60, 3
DEPRECATED_KEPT, FAMILY_KEPT, REFERENCES_KEPT, MAX_LIMIT = 3, 20, 30, 50
LEVELS = ["app", "app_s1", "app_s2", "app_s3", "app_s4", "app_s5", "app_s6"]


class HashingEmbedder:
    """Feature hashing of words: deterministic, no model. Anything with ``size`` and ``__call__`` can take its place."""

    def __init__(self, size: int = 256):
        self.size = size

    def __call__(self, s: str) -> list[float]:
        v = np.zeros(self.size)
        for w in re.findall(r"[a-z0-9]+", s.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % self.size] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    def embed(self, df: DataFrame, text_col: str, name: str = "values") -> DataFrame:
        """``df`` with vectors; batches of rows go to Python as Arrow."""

        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.fillna("").map(self)

        vectors.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}  # annotations are strings in this module
        return df.withColumn(name, F.pandas_udf(vectors, "array<float>")(F.col(text_col)))


class Cache:
    """Least-recently-used results under versioned keys; a new data version makes all older ones unreachable.

    With ``stored`` the version is read from storage with each key, so that what one driver ingests ends the results that all others keep.
    """

    def __init__(self, size: int = 256, stored: DataVersion | None = None):
        self.size, self.stored, self.kept, self._version = size, stored, OrderedDict(), 1

    @property
    def version(self) -> int:
        return self.stored.current() if self.stored else self._version

    def key(self, kind: str, params: dict) -> str:
        stable = json.dumps({k: v for k, v in params.items() if v is not None}, sort_keys=True, separators=(",", ":"), default=str)
        return f"{kind}:v{self.version}:{hashlib.sha256(stable.encode()).hexdigest()}"

    def get(self, key: str):
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        return None

    def put(self, key: str, value) -> None:
        self.kept[key] = value
        while len(self.kept) > self.size:
            self.kept.popitem(last=False)

    def bump(self) -> None:
        if self.stored:
            self.stored.bump()
        else:
            self._version += 1


class BadRequest(ValueError):
    pass


def validate(request: dict) -> dict:
    """A query of at most 500 characters, a limit from 1 to 50, known units."""
    query = str(request.get("query") or "").strip()[:500]
    if not query:
        raise BadRequest("query is required")
    limit = min(MAX_LIMIT, max(1, int(request.get("limit") or 10)))
    units = request.get("units") if request.get("units") in ("lux", "fc") else "both"
    return {"query": query, "limit": limit, "units": units, "filters": dict(request.get("filters") or {}), "summary": bool(request.get("includeAISummary"))}


def _matches(q: str, patterns: list[str]) -> bool:
    return any(re.search(p, q) for p in patterns)


@dataclass
class Corpus:
    vectors: DataFrame
    applications: DataFrame
    standards: DataFrame  # id, title, full_designation, status, superseded_by, web_url; for tails also chunk_count, reference_count


@dataclass
class SearchEngine:
    spark: SparkSession
    corpus: Corpus
    embedder: HashingEmbedder = field(default_factory=HashingEmbedder)
    summariser: Callable[[str], str] | None = None
    cache: Cache = field(default_factory=Cache)
    tails_only: bool = False  # references from the tails of documents alone (vectors have ``ordinal`` then), not from all vectors
    log: list[dict] = field(default_factory=list)

    # ------------------------------------------------------------ query text

    def _column(self, q: str, f: Callable[[Column], Column]):
        """A column function of one string: the same code as over tables."""
        return self.spark.range(1).select(f(F.lit(q)).alias("x")).first()["x"]

    def infer_filters(self, q: str, comparison: bool) -> dict:
        zone = self._column(q, ids.lighting_zone)
        family = self._column(q, ids.cited_family) if comparison else None
        return {k: v for k, v in {"lighting_zone": zone, "standard_prefix": family}.items() if v}

    # ------------------------------------------------------------ one query

    def pool(self, q: list[float], where: Column, k: int) -> DataFrame:
        keep = ["standard_code", "chunk_type", "page_number", "status", "excerpt_text"]
        return vector.top_k(self.corpus.vectors.where(where), [(0, q)], "id", "values", k, keep)

    def filter_apps(self, filters: dict) -> DataFrame:
        wanted = {"standard": filters.get("standard"), "lighting_zone": filters.get("lighting_zone"), "tm24_eligible": 1 if filters.get("tm24_eligible") else None}
        place = filters.get("indoor_outdoor")
        prefix = filters.get("standard_prefix")
        return relational.dynamic_filter(self.corpus.applications, active="active", either=("indoor_outdoor", place, "Both") if place else None, equal=wanted, prefix=("standard", prefix.rstrip("-") + "-") if prefix else None)

    def search_one(self, query: str, filters: dict, limit: int, types: set[str]) -> list[dict]:
        prepared = self._column(query, text.prepare_query)
        q = self.embedder(prepared)
        scope = F.lit(True) if not filters.get("standard") else F.col("standard_code") == filters["standard"]
        if filters.get("tm24_eligible"):
            scope = scope & (F.col("tm24_eligible") == 1)
        if "references" in types:
            return self.references(q, scope, limit)
        shared = self.pool(q, scope, POOL).cache()
        try:
            out = self.applications(q, shared, filters, limit) if "tables" in types else []
            if "tables" in types and len(out) < MIN_RESULTS:
                out += [r for r in self.keywords(query, filters, limit) if r["code"] not in {x["code"] for x in out}]
            if "body" in types:
                scoped = self.pool(q, scope & (F.col("chunk_type") == "text"), POOL)
                out += self.prose(vector.keyed_union([shared, scoped], "id", []), limit)
        finally:
            shared.unpersist()
        out.sort(key=lambda r: (-(r["score"] * 100 // 1), r["order"]))
        return self.clustered(out)[:limit]

    def live(self, hits: DataFrame) -> DataFrame:
        """Hits whose standard is known and not deprecated."""
        known = self.corpus.standards.select(F.col("id").alias("standard_code"), F.col("status").alias("owner_status"))
        joined = hits.join(known, "standard_code")
        return joined.where((F.coalesce("status", F.lit("")) != "deprecated") & (F.coalesce("owner_status", F.lit("")) != "Deprecated"))

    def applications(self, q: list[float], shared: DataFrame, filters: dict, limit: int) -> list[dict]:
        codes = shared.where("chunk_type = 'application'").select(F.col("id").alias("code"), "score").orderBy(F.col("score").desc(), "code").limit(2 * limit)
        found = codes.join(self.filter_apps(filters), "code").orderBy(F.col("score").desc(), "code").limit(limit)
        return self.shaped(found, self.excerpts(q, found, shared))

    def chunks_behind(self, q: list[float], apps: DataFrame, shared: DataFrame) -> DataFrame:
        """The pool's chunks, and a second look for the best standards of ``apps`` that the pool leaves without prose."""
        hits = shared.where(~F.col("chunk_type").isin("application", "reference"))
        enough = (F.col("chunk_type") != "table") & ~text.table_like(F.col("excerpt_text"))
        targets = retrieval.lacking(apps, "standard", [F.desc("score"), F.asc("code")], hits, "standard_code", enough)
        wanted = ~F.col("chunk_type").isin("application", "reference") & (F.coalesce("excerpt_text", F.lit("")) != "")
        more = retrieval.backfill(self.corpus.vectors, targets, [(0, q)], "id", "values", "standard_code", wanted, ["chunk_type", "page_number", "status", "excerpt_text"])
        return retrieval.backfilled(hits, more, "id")

    def excerpts(self, q: list[float], apps: DataFrame, shared: DataFrame) -> dict:
        """The chunk of the same standard nearest by page (prose first, within the radius), else its best one."""
        standards = [r[0] for r in apps.select("standard").distinct().limit(MAX_LIMIT).collect()]
        if not standards:
            return {}
        q_hits = self.chunks_behind(q, apps, shared).where(F.col("standard_code").isin(standards))
        prose = text.displayable(F.col("excerpt_text"), F.col("chunk_type"))
        both = apps.select("code", "standard", F.col("page_number").alias("app_page")).join(q_hits, F.col("standard") == F.col("standard_code"))
        near = F.abs(F.col("page_number") - F.col("app_page"))
        tier = F.when(prose & (near <= EXCERPT_RADIUS), 0).when(near <= EXCERPT_RADIUS, 1).when(prose, 2).otherwise(3)
        rank = [tier, F.when(tier < 2, near).otherwise(F.lit(0)), F.col("score").desc(), F.col("id")]
        return {r["code"]: {"text": (r["excerpt_text"] or "")[:400], "page": r["page_number"]} for r in vector.top_per(both, ["code"], rank, 1).collect()}

    def keywords(self, query: str, filters: dict, limit: int) -> list[dict]:
        columns = ["app", "app_s1", "app_s2", "app_s3", "sub_category"]
        found = relational.keyword_all_terms(self.filter_apps(filters), columns, query).withColumn("score", F.lit(0.0)).orderBy("code").limit(2 * limit)
        return self.shaped(found, {})

    def prose(self, hits: DataFrame, limit: int) -> list[dict]:
        """The best displayable chunk of each live standard."""
        kept = self.live(hits).where(text.displayable(F.col("excerpt_text"), F.col("chunk_type")) & ~F.col("chunk_type").isin("application", "reference"))
        best = vector.top_per(kept, ["standard_code"], vector.best_first("id"), 1).orderBy(F.col("score").desc(), "id").limit(limit)
        return [self.chunk(r) for r in best.collect()]

    def chunk(self, r) -> dict:
        return {"kind": r["chunk_type"], "code": r["id"], "standard": r["standard_code"], "score": _rounded(r["score"]), "excerpt": {"text": (r["excerpt_text"] or "")[:400], "page": r["page_number"]}, "order": (1, r["id"]), "group": r["id"]}

    def reference_tails(self, q: list[float], scope: Column) -> DataFrame:
        """References stand near the end: the tails of the active documents that have most of them, within the budget for all."""
        windows = retrieval.tail_windows(self.corpus.standards.where("status = 'Active'"), "id", "chunk_count", "reference_count").withColumnRenamed("id", "standard_code")
        keep = ["standard_code", "chunk_type", "page_number", "status", "excerpt_text"]
        return retrieval.tail_probe(self.corpus.vectors.where(scope), windows, [(0, q)], "id", "values", "standard_code", "ordinal", F.col("chunk_type") == "reference", keep)

    def references(self, q: list[float], scope: Column, limit: int) -> list[dict]:
        hits = self.live(self.reference_tails(q, scope) if self.tails_only else self.pool(q, scope & (F.col("chunk_type") == "reference"), REFERENCES_KEPT))
        linked = reference_links(hits, "excerpt_text", self.corpus.standards).orderBy(F.col("score").desc(), "id").limit(limit)
        return [self.chunk(r) | {"link": r["link"], "link_type": r["link_type"]} for r in linked.collect()]

    def shaped(self, apps: DataFrame, excerpts: dict) -> list[dict]:
        known = self.corpus.standards.select(F.col("id").alias("standard"), F.col("title").alias("std_title"), "full_designation", "web_url")
        name = text.compose_name(F.coalesce("full_designation", "standard"), F.when(F.col("std_title") != F.col("standard"), F.col("std_title")))
        full = F.array_join(F.filter(F.array(*[F.col(c) for c in LEVELS]), lambda x: F.coalesce(x, F.lit("")) != ""), " → ")
        keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate([x for c in ("app_s1", "app_s2", "app_s3", "app_s4") for x in relational.hierarchy_keys(c)])], relational.row_number_of(F.col("row_ref")).alias("row"), F.col("code").alias("code"))
        rows = apps.join(known, "standard", "left").withColumns({"full_name": full, "citation": text.citation(name, F.col("table_ref"), F.col("row_ref"), F.lit(None).cast("string"), F.col("page_number")), "keys": keys})
        out = []
        for r in rows.collect():  # at most twice the limit
            plane = lambda p, r=r: None if r[f"{p}_lux"] is None else {k: r[f"{p}_{k}"] for k in ("cat", "lux", "fc", "height_m", "height_ft", "basis", "uniformity", "cv", "ratio_basis")}
            out.append({
                "kind": "application", "code": r["code"], "standard": r["standard"], "full_name": r["full_name"], "citation": r["citation"], "score": _rounded(r["score"]), "horizontal": plane("hor"), "vertical": plane("ver"),
                "outdoor": {k: r[k] for k in ("lighting_zone", "max_glare_rating", "max_uplight")} if r["indoor_outdoor"] in ("Outdoor", "Both") else None,
                "excerpt": excerpts.get(r["code"]), "web_url": r["web_url"], "order": (0, *map(_sortable, r["keys"])), "group": (r["standard"], r["table_ref"], r["app"]), "tm24_eligible": bool(r["tm24_eligible"]),
            })
        return sorted(out, key=lambda x: (-x["score"], x["code"]))

    @staticmethod
    def clustered(results: list[dict]) -> list[dict]:
        """Siblings take the place of their best member, in publication order."""
        place: dict = {}
        for i, r in enumerate(results):
            place.setdefault(r["group"], i)
        return sorted(results, key=lambda r: (place[r["group"]], r["order"]))

    # ------------------------------------------------------------ comparison, relatives, summary

    def compare(self, query: str, filters: dict, hint: str) -> list[dict]:
        """The best displayable excerpts of a family's deprecated editions, one for each, flagged."""
        scope = filters.get("standard_prefix") or re.sub(r"-\d{2}(?:\+E\d+)?$", "", filters.get("standard") or "")
        if not scope:
            return []
        scope = scope.upper()
        topic = f"{scope} {hint[:400]}" if len(hint.strip()) >= 60 else self._column(query, text.prepare_query)
        old = (F.col("status") == "deprecated") & F.startswith(F.upper("standard_code"), F.lit(scope.rstrip("-") + "-"))
        hits = self.pool(self.embedder(topic), old, FAMILY_KEPT).where(text.displayable(F.col("excerpt_text"), F.col("chunk_type")))
        best = vector.top_per(hits, ["standard_code"], vector.best_first("id"), 1).orderBy(*vector.best_first("id")).limit(DEPRECATED_KEPT)
        known = self.corpus.standards.select(F.col("id").alias("standard_code"), "superseded_by")
        out = []
        for r in best.join(known, "standard_code", "left").orderBy(*vector.best_first("id")).collect():
            by = r["superseded_by"]
            out.append(self.chunk(r) | {"is_deprecated": True, "superseded_by": by, "notice": f"{r['standard_code']} is deprecated" + (f" and has been replaced by {by}." if by else ".")})
        return out

    def related(self, code: str, n: int = 4) -> list[str]:
        """Siblings, then cousins, then what shares the banner."""
        seed = self.corpus.applications.where(F.col("code") == code).limit(1).collect()
        if not seed:
            return []
        active = self.corpus.applications.where("active = 1")
        layers = [("standard", "app", "app_s1"), ("standard", "app"), ("standard", "sub_category")]
        order = [*[k for c in ("app_s1", "app_s2", "app_s3") for k in relational.hierarchy_keys(c)], relational.row_number_of(F.col("row_ref"))]
        return [r["code"] for r in relational.layered(active, seed[0].asDict(), layers, "code", order, n).collect()]

    def prompt(self, query: str, results: list[dict]) -> str:
        current, old = [r for r in results if not r.get("is_deprecated")], [r for r in results if r.get("is_deprecated")]
        chosen = current[:3] + old[:2] if old else current[:5]
        lines = [f"[{i}] {r.get('citation') or r['standard']}: {r.get('full_name') or ''} {((r.get('excerpt') or {}).get('text') or '')[:220]}".strip() for i, r in enumerate(chosen, 1)]
        return f"Question: {query}\n" + "\n".join(lines)

    def summarise(self, query: str, results: list[dict]) -> dict:
        """The model's text if there is one and it keeps the quotation policy, else what the results say."""
        try:
            said = self.summariser(self.prompt(query, results)) if self.summariser else ""
        except Exception:  # a summary is optional: any failure of the model falls back
            said = ""
        if said.strip() and not self._column(said, text.policy_violations):
            return {"text": said.strip(), "degraded": False}
        names = "; ".join(r.get("citation") or r["standard"] for r in results[:3])
        return {"text": f"Relevant provisions: {names}." if names else "No provisions were found.", "degraded": True}

    # ------------------------------------------------------------ a request

    def search(self, request: dict) -> dict:
        req = validate(request)
        key = self.cache.key("response", req)
        if (hit := self.cache.get(key)) is not None:
            self.note(req, hit, cached=True)
            return hit | {"cached": True}
        query = req["query"]
        comparison = _matches(query, COMPARISON_PATTERNS)
        filters = self.infer_filters(query, comparison) | {k: v for k, v in req["filters"].items() if k != "content_types" and v not in (None, "")}
        asked = [str(x).lower() for x in req["filters"].get("content_types") or []]
        types = {t for t in asked if t in ("tables", "body", "references")}
        if _matches(query, REFERENCE_PATTERNS):
            types = (types | {"references"}) if types else {"references"}
        types = types or {"tables", "body"}
        parts = self._column(query, text.split_multi_query)
        results: list[dict] = []
        for part in parts:
            found = self.search_one(part, filters, req["limit"] if len(parts) == 1 else min(5, req["limit"]), types)
            results += [r for r in found if r["code"] not in {x["code"] for x in results}]
        if len(parts) > 1:
            results = self.clustered(results)
        top = max((r["score"] for r in results), default=0.0)
        if comparison or "compare" in asked:
            hint = next((r["excerpt"]["text"] for r in results if r.get("excerpt")), "")
            results += self.compare(query, filters, hint)
        first = next((r["code"] for r in results if r["kind"] == "application"), None)
        payload = {
            "query": query, "results": [_in_units({k: v for k, v in r.items() if k not in ("order", "group")}, req["units"]) for r in results],
            "related": self.related(first) if first else [], "low_confidence": top < STRONG and types != {"references"} and not comparison,
        }
        if req["summary"]:
            payload["summary"] = self.summarise(query, results)
        if not payload.get("summary", {}).get("degraded"):
            self.cache.put(key, payload)
        self.note(req, payload, cached=False)
        return payload | {"cached": False}

    def note(self, req: dict, payload: dict, cached: bool) -> None:
        self.log.append({"query": req["query"], "n_results": len(payload["results"]), "standards": list(dict.fromkeys(r["standard"] for r in payload["results"])), "cached": cached})


def _rounded(x: float) -> float:
    return float(np.floor(x * 1000 + 0.5) / 1000)


def _sortable(x):
    return (x is None, x if x is not None else 0)


def _in_units(result: dict, units: str) -> dict:
    """Only lux and metres, or only footcandles and feet."""
    drop = {"lux": ("fc", "height_ft"), "fc": ("lux", "height_m")}.get(units, ())
    return {k: {a: b for a, b in v.items() if a not in drop} if k in ("horizontal", "vertical") and v else v for k, v in result.items()}
