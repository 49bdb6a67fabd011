"""Versioned cut-event documents: assembly, and validation as a table of rule violations.

Documents are JSON text. VARIANT keeps what a fixed schema loses: an explicit null against a missing
key, booleans against numbers, integers against decimals.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FORMAT, VERSION = "cut-events", 2
# fixed values of the document format
KINDS = ("hard", "gradual", "unknown")
STATUS = ("complete", "partial", "failed")
FLAGS = ("strobe_suppressed",)


def build_documents(runs: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, document: nested JSON with events in time order, their count and projection derived.

    ``runs``: keys, video, detector, fps, duration (null or not above zero: unknown), status, and optional
    warnings, path, size_bytes, mtime_utc, detector_id (the detector if absent), backend, tool_commit,
    tool_dirty, model, settings (a struct or map), generated_by, generated_utc. ``events``: keys, time,
    frame, kind and optional span_start, span_end, value, metric, flags. Absent values are omitted,
    never null and never made up: a document without its file's size and time breaks the rule ``source``.
    """
    has = lambda c: F.col(c) if c in events.columns else F.lit(None)
    told = lambda c, kind: F.col(c) if c in runs.columns else F.lit(None).cast(kind)
    span = F.when(has("span_start").isNotNull(), F.struct(has("span_start").cast("double").alias("start"), has("span_end").cast("double").alias("end")))
    confidence = F.when(has("value").isNotNull(), F.struct(has("value").cast("double").alias("value"), has("metric").cast("string").alias("metric"), F.lit(True).alias("higher_is_stronger")))
    flags = has("flags").cast("array<string>")
    event = F.struct(F.col("time"), F.col("frame"), F.col("kind").alias("transition_kind"), span.alias("span"), confidence.alias("confidence"), F.when(F.size(flags) > 0, flags).alias("flags"))
    lists = events.groupBy(*keys).agg(F.array_sort(F.collect_list(event)).alias("events"))
    joined = runs.join(lists, keys, "left")
    found = F.coalesce("events", F.array().cast(lists.schema["events"].dataType))
    duration = F.when((F.col("duration") > 0) & ~F.isnan(F.col("duration").cast("double")), F.bround("duration", 3))
    covered = F.when(duration.isNotNull(), F.array(F.struct(F.lit(0.0).alias("start"), duration.alias("end")))).otherwise(F.array().cast("array<struct<start:double,end:double>>"))
    source = F.struct(F.coalesce(told("path", "string"), F.col("video")).alias("path"), told("size_bytes", "long").alias("size_bytes"), told("mtime_utc", "string").alias("mtime_utc"), duration.alias("duration_seconds"))
    texts = [told(c, "string").alias(c) for c in ("tool_commit", "model", "generated_by", "generated_utc")]
    settings = F.col("settings") if "settings" in runs.columns else F.create_map().cast("map<string,string>")
    run = F.struct(F.coalesce(told("detector_id", "string"), F.col("detector")).alias("detector_id"), told("backend", "string").alias("backend"), texts[0], told("tool_dirty", "boolean").alias("tool_dirty"), texts[1], settings.alias("settings"), texts[2], texts[3])
    document = F.struct(
        F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("schema_version"), source.alias("source"), run.alias("run"),
        F.struct(F.col("status"), covered.alias("coverage"), F.size(found).alias("event_count"), F.coalesce(told("warnings", "array<string>"), F.array().cast("array<string>")).alias("warnings")).alias("analysis"),
        found.alias("cut_events"), F.transform(found, lambda e: e["time"]).alias("cuts"), F.col("fps"), F.col("video"), F.col("detector"),
    )
    return joined.select(*keys, F.to_json(document).alias("document"))


def event_rows(docs: DataFrame, keys: list[str], document: str) -> DataFrame:
    """keys, event_no, time, frame, kind, span_start, span_end, value, metric, higher_is_stronger, flags of each event of a document.

    Tolerant: absent fields are null, unknown ones are left out, an absent kind is ``unknown``.
    """
    parsed = docs.select(*keys, F.posexplode(_get(F.try_parse_json(document), "$.cut_events", "array<variant>")).alias("event_no", "_e"))
    e = F.col("_e")
    return parsed.select(
        *keys, "event_no", _time(e).alias("time"), _get(e, "$.frame", "long").alias("frame"), F.coalesce(_get(e, "$.transition_kind", "string"), F.lit("unknown")).alias("kind"),
        _get(e, "$.span.start", "double").alias("span_start"), _get(e, "$.span.end", "double").alias("span_end"), _get(e, "$.confidence.value", "double").alias("value"),
        _get(e, "$.confidence.metric", "string").alias("metric"), _get(e, "$.confidence.higher_is_stronger", "boolean").alias("higher_is_stronger"), _get(e, "$.flags", "array<string>").alias("flags"),
    )


def checked(docs: DataFrame, keys: list[str], document: str) -> DataFrame:
    """The same rows; reading one whose document breaks a rule raises. Writers and readers share the rule tables."""
    own = document_violations(docs, keys, document).groupBy(*keys).agg(F.collect_set("rule").alias("_own"))
    events = event_violations(docs, keys, document).groupBy(*keys).agg(F.collect_set("rule").alias("_events"))
    joined = docs.join(own, keys, "left").join(events, keys, "left")
    none = F.array().cast("array<string>")
    rules = F.array_sort(F.array_union(F.coalesce("_own", none), F.coalesce("_events", none)))
    wrong = F.raise_error(F.concat(F.lit("rules broken: "), F.array_join(rules, ", "))).cast("string")
    return joined.withColumn(document, F.when(F.size(rules) == 0, F.col(document)).otherwise(wrong)).drop("_own", "_events")


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _has(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNotNull()


def _kind(v: Column, path: str) -> Column:
    """BIGINT, DOUBLE, DECIMAL(..), STRING, BOOLEAN, OBJECT<..>, ARRAY<..> or VOID; null where the path is missing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _number(kind: Column) -> Column:
    return F.coalesce(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def _time(event: Column) -> Column:
    """The event's time, null unless a number: casts would turn true into one."""
    return F.when(_number(_kind(event, "$.time")), _get(event, "$.time", "double"))


def event_violations(docs: DataFrame, keys: list[str], document: str) -> DataFrame:
    """keys, event_no, rule for each broken rule of each event; text that is no JSON breaks ``json``."""
    parsed = docs.select(*keys, F.try_parse_json(document).alias("_d"))
    coverage = F.coalesce(_get(F.col("_d"), "$.analysis.coverage", "array<struct<start:double,end:double>>"), F.array().cast("array<struct<start:double,end:double>>"))
    # an event travels with its own and its predecessor's time only
    listed = parsed.select(*keys, F.col("_d").isNull().alias("_bad"), coverage.alias("_cov"), F.posexplode_outer(_get(F.col("_d"), "$.cut_events", "array<variant>")).alias("event_no", "_e"))
    listed = listed.where("_bad or event_no is not null").withColumn("_t", _time(F.col("_e")))
    events = listed.withColumn("_before", F.lag("_t").over(Window.partitionBy(*keys).orderBy("event_no")))
    e, t, before = F.col("_e"), F.col("_t"), F.col("_before")
    kind, span = _get(e, "$.transition_kind", "string"), _has(e, "$.span")
    lo, hi = _get(e, "$.span.start", "double"), _get(e, "$.span.end", "double")
    flags = _get(e, "$.flags", "array<string>")
    frame = _get(e, "$.frame", "long")
    rules = {
        "object": ~F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False)),
        "time": ~(_number(_kind(e, "$.time")) & F.coalesce(t >= 0, F.lit(False))),
        "kind": ~F.coalesce(kind.isin(*KINDS), F.lit(False)),
        "order": F.coalesce(t < before, F.lit(False)),
        "duplicate": F.coalesce(t == before, F.lit(False)),
        "frame": _has(e, "$.frame") & ~F.coalesce((_kind(e, "$.frame") == "BIGINT") & (frame >= 0), F.lit(False)),
        "span": span & ~F.coalesce((kind == "gradual") & (lo <= t) & (t <= hi) & _number(_kind(e, "$.span.start")) & _number(_kind(e, "$.span.end")), F.lit(False)),
        "confidence": _has(e, "$.confidence") & ~F.coalesce(_number(_kind(e, "$.confidence.value")) & (_kind(e, "$.confidence.metric") == "STRING") & (_kind(e, "$.confidence.higher_is_stronger") == "BOOLEAN"), F.lit(False)),
        "flags": _has(e, "$.flags") & ~F.coalesce(F.forall(flags, lambda f: f.isin(*FLAGS)), F.lit(False)),
        "coverage": (F.size("_cov") > 0) & ~F.coalesce(F.exists("_cov", lambda c: t.between(c["start"], c["end"])), F.lit(False)),
    }
    names = F.filter(F.array(*[F.when(broke, F.lit(name)) for name, broke in rules.items()]), lambda x: x.isNotNull())
    names = F.when(F.col("_bad"), F.array(F.lit("json"))).otherwise(names)
    return events.select(*keys, F.coalesce("event_no", F.lit(-1)).alias("event_no"), F.explode(names).alias("rule"))


def document_violations(docs: DataFrame, keys: list[str], document: str, tag: str = FORMAT) -> DataFrame:
    """keys, rule for each broken rule of the document itself; ``tag`` is the format name it must bear."""
    d = F.col("_d")
    text = lambda path: F.coalesce((_kind(d, path) == "STRING") & (F.length(_get(d, path, "string")) > 0), F.lit(False))
    coverage = _get(d, "$.analysis.coverage", "array<struct<start:double,end:double>>")
    times = F.transform(_get(d, "$.cut_events", "array<variant>"), _time)
    ordered = F.forall(coverage, lambda c: c["start"] < c["end"]) & F.forall(F.sequence(F.lit(1), F.greatest(F.size(coverage) - 1, F.lit(1))), lambda k: F.coalesce(F.get(coverage, k)["start"] >= F.get(coverage, k - 1)["end"], F.lit(True)))
    fps = _get(d, "$.fps", "double")
    rules = {
        "json": d.isNull(),
        "format": ~F.coalesce(_get(d, "$.format", "string") == tag, F.lit(False)),
        "version": ~F.coalesce((_kind(d, "$.schema_version") == "BIGINT") & (_get(d, "$.schema_version", "int") == VERSION), F.lit(False)),
        "fps": ~F.coalesce(_number(_kind(d, "$.fps")) & (fps > 0), F.lit(False)),
        "video": ~text("$.video"),
        "detector": ~text("$.detector"),
        "status": ~F.coalesce(_get(d, "$.analysis.status", "string").isin(*STATUS), F.lit(False)),
        "warnings": ~F.coalesce(_get(d, "$.analysis.warnings", "array<string>").isNotNull(), F.lit(False)),
        "coverage": _has(d, "$.analysis.coverage") & ~F.coalesce(ordered, F.lit(False)),
        "event_count": ~F.coalesce((_kind(d, "$.analysis.event_count") == "BIGINT") & (_get(d, "$.analysis.event_count", "int") == F.size(times)), F.lit(False)),
        "cuts": ~F.coalesce(_get(d, "$.cuts", "array<double>") == times, F.lit(False)),
        "source": ~(text("$.source.path") & text("$.source.mtime_utc") & F.coalesce((_kind(d, "$.source.size_bytes") == "BIGINT") & (_get(d, "$.source.size_bytes", "long") >= 0), F.lit(False))),
        "source_duration": _has(d, "$.source.duration_seconds") & ~F.coalesce(_number(_kind(d, "$.source.duration_seconds")) & (_get(d, "$.source.duration_seconds", "double") > 0), F.lit(False)),
        "run": ~(text("$.run.detector_id") & F.coalesce(_kind(d, "$.run.settings").startswith("OBJECT"), F.lit(False))),
        "run_optional": reduce(or_, [_has(d, f"$.run.{k}") & ~text(f"$.run.{k}") for k in ("backend", "model", "tool_commit", "generated_by", "generated_utc")]) | (_has(d, "$.run.tool_dirty") & ~F.coalesce(_kind(d, "$.run.tool_dirty") == "BOOLEAN", F.lit(False))),
        # outside of strings, null can only be the value
        "null": F.coalesce(F.regexp_replace("_text", r'"(\\.|[^"\\])*"', '""').rlike("null"), F.lit(False)),
    }
    names = F.filter(F.array(*[F.when(F.coalesce(broke, F.lit(True)), F.lit(name)) for name, broke in rules.items()]), lambda x: x.isNotNull())
    return docs.select(*keys, F.col(document).alias("_text"), F.try_parse_json(document).alias("_d")).select(*keys, F.explode(names).alias("rule"))


def fail_on_violation(violations: DataFrame) -> DataFrame:
    """The same rows, but reading one raises."""
    return violations.withColumn("rule", F.raise_error(F.concat(F.lit("rule broken: "), F.col("rule"))).cast("string"))


def cache_documents(cuts: DataFrame, rates: DataFrame, keys: list[str], time: str, tag: str = "score-cache") -> DataFrame:
    """keys, document of a tagged score cache: its format, cuts in order and rate. ``rates``: keys, fps."""
    lists = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(time).cast("double"))).alias("cuts"))
    joined = rates.join(lists, keys, "left")
    return joined.select(*keys, F.to_json(F.struct(F.lit(tag).alias("format"), F.coalesce("cuts", F.array().cast("array<double>")).alias("cuts"), "fps")).alias("document"))


def score_cache(docs: DataFrame, keys: list[str], document: str, tag: str = "score-cache") -> DataFrame:
    """keys, accepted, cuts, fps: a tagged cache, or an untagged one with exactly cuts and fps, of a usable rate."""
    d = F.col("_d")
    fps = _get(d, "$.fps", "double")
    names = F.json_object_keys(F.col("_text"))
    tagged = _get(d, "$.format", "string")
    shape = F.when(_has(d, "$.format"), F.coalesce(tagged == tag, F.lit(False))).otherwise(F.coalesce(F.size(F.array_except(names, F.array(F.lit("cuts"), F.lit("fps")))) == 0, F.lit(False)))
    good = shape & _number(_kind(d, "$.fps")) & F.coalesce(fps > 0, F.lit(False)) & F.coalesce(_get(d, "$.cuts", "array<double>").isNotNull(), F.lit(False))
    found = docs.select(*keys, F.col(document).alias("_text"), F.try_parse_json(document).alias("_d")).withColumn("accepted", good)
    return found.select(*keys, "accepted", F.when(F.col("accepted"), _get(d, "$.cuts", "array<double>")).alias("cuts"), F.when(F.col("accepted"), fps).alias("fps"))


EVENT = T.StructType([T.StructField("time", T.DoubleType(), False), T.StructField("frame", T.LongType()), T.StructField("transition_kind", T.StringType(), False)])


def project_cuts(events: Column) -> Column:
    """Times of an event list in its order."""
    return F.transform(events, lambda e: e["time"])


def wrap_times(times: Column) -> Column:
    """Bare times as minimal events."""
    return F.transform(times, lambda t: F.struct(t.alias("time"), F.lit("unknown").alias("transition_kind")))
