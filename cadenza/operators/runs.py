"""What a detector run tells beside its events: identity, diagnostics, duration, warnings; and whole documents from runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import timecode
from cadenza.operators import documents

# fixed values: detector keys with their id and backend
DETECTOR_IDS = {
    "ffmpeg-cpu": ("ffmpeg-scene", "cpu"),
    "ffmpeg-cuda": ("ffmpeg-scene", "cuda"),
    "psd-content": ("psd-content", "cpu"),
    "psd-adaptive": ("psd-adaptive", "cpu"),
    "torch-cpu": ("torch-gpu", "cpu"),
    "torch-cuda": ("torch-gpu", "cuda"),
    "transnet-cpu": ("transnetv2", "cpu"),
    "transnet-cuda": ("transnetv2", "cuda"),
    "motion-vectors": ("motion-vectors", "cpu"),
}
# fixed values: model name by detector id, and texts of warnings
MODELS = {"transnetv2": "transnetv2-pytorch (weights as installed)"}
DECODER_FAILED = "decoder exited nonzero"
FROM_STREAM = "source duration from ffprobe stream timing (container duration unavailable)"
FROM_FRAMES = "source duration estimated from n_frames/fps (ffprobe container/stream timing unavailable)"
NO_DURATION = "source duration unavailable; coverage omitted (time-in-coverage check relaxes to time >= 0)"
#: Characters of an error log that a diagnostic carries.
TAIL = 1500


def detector_id(key: Column) -> Column:
    """struct<detector_id, backend>; a key that is not known stands for itself, without backend."""
    pick = lambda k: F.create_map(*[F.lit(x) for name, v in DETECTOR_IDS.items() for x in (name, v[k])])[key]
    return F.struct(F.coalesce(pick(0), key).alias("detector_id"), pick(1).alias("backend"))


def model_name(detector: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in MODELS.items() for x in pair])[detector]


def filter_decode(code: Column, log: Column) -> Column:
    """struct<decode_ok, decode_detail> of the scene filter: null on a clean exit; the log's tail where no frame was shown."""
    head = F.format_string("ffmpeg-scene exited %d", code.cast("int"))
    lost = F.concat(head, F.lit("; unusable decode:\n"), F.right(F.coalesce(log, F.lit("")), F.lit(TAIL)))
    detail = F.when(F.coalesce(F.contains(log, F.lit("showinfo")), F.lit(False)), head).otherwise(lost)
    return F.when(code != 0, F.struct(F.lit(False).alias("decode_ok"), detail.alias("decode_detail")))


def net_decode(code: Column, log: Column) -> Column:
    """The same of the net's decoder: the stripped log's tail if there is any."""
    head = F.format_string("transnet decode (ffmpeg) exited %d", code.cast("int"))
    tail = F.regexp_replace(F.coalesce(log, F.lit("")), r"(?s)^\s+|\s+\z", "")
    detail = F.when(tail != "", F.concat(head, F.lit("; stderr tail:\n"), F.right(tail, F.lit(TAIL)))).otherwise(head)
    return F.when(code != 0, F.struct(F.lit(False).alias("decode_ok"), detail.alias("decode_detail")))


def positive(text: Column) -> Column:
    """A finite number above zero, or null."""
    x = text.try_cast("double")
    return F.when(timecode.usable_rate(x), x)


def probed_duration(container: Column, streams: Column) -> Column:
    """struct<seconds, method>: the container's length, else the longest stream's, else nulls. Texts that are no number do not count."""
    whole, longest = positive(container), F.array_max(F.transform(streams, positive))
    return F.struct(F.coalesce(whole, longest).alias("seconds"), F.when(whole.isNotNull(), "container").when(longest.isNotNull(), "stream").alias("method"))


def source_duration(probed: Column, n_frames: Column, fps: Column) -> Column:
    """struct<seconds, method>: what was probed, else frames over rate (``frames``), else null and ``none``."""
    by_frames = F.when(n_frames > 0, n_frames / fps)
    method = F.when(probed["seconds"].isNotNull(), probed["method"]).when(by_frames.isNotNull(), "frames").otherwise("none")
    return F.struct(F.coalesce(probed["seconds"], by_frames).alias("seconds"), method.alias("method"))


def subtitle_duration(stated: Column, n_frames: Column, fps: Column, probed: Column, last_cut: Column) -> Column:
    """Length of a subtitle track: as stated, frames over rate, as probed, five seconds past the last cut, or five."""
    nonzero = lambda x: F.when(x != 0, x)
    return F.coalesce(nonzero(stated).cast("double"), nonzero(n_frames) / nonzero(fps), probed, last_cut + 5.0, F.lit(5.0))


def run_warnings(decode_ok: Column, detail: Column, extra: Column, method: Column) -> Column:
    """Warnings of a run in their fixed order."""
    notes = F.array(
        F.when(~F.coalesce(decode_ok, F.lit(True)), F.coalesce(detail, F.lit(DECODER_FAILED))), F.when(extra != "", extra),
        F.when(method == "stream", FROM_STREAM), F.when(method == "frames", FROM_FRAMES), F.when(method == "none", NO_DURATION),
    )
    return F.filter(notes, lambda x: x.isNotNull())


def documents_from_runs(runs: DataFrame, events: DataFrame, keys: list[str], generated_by: str, generated_utc: Column | None = None, check: bool = True) -> DataFrame:
    """keys, document of completed runs; a broken rule raises when it is read, as long as ``check``.

    ``runs``: keys, video, detector_key, detector, fps, n_frames, container and streams (probed lengths as
    texts), size_bytes, mtime_utc, and optional decode_ok, decode_detail, warning, settings (a struct or
    map), tool_commit, tool_dirty. ``events`` as in ``documents.build_documents``.
    """
    has = lambda name, kind: F.col(name) if name in runs.columns else F.lit(None).cast(kind)
    fps = F.when(timecode.usable_rate("fps"), F.col("fps")).otherwise(F.raise_error(F.concat(F.lit("fps must be positive and finite for export, not "), F.coalesce(F.col("fps").cast("string"), F.lit("null")))))
    ok = F.coalesce(has("decode_ok", "boolean"), F.lit(True))
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = runs.join(counts, keys, "left").withColumn("_id", detector_id(F.col("detector_key"))).withColumn("fps", fps)
    found = found.withColumn("_length", source_duration(probed_duration(F.col("container"), F.col("streams")), F.col("n_frames"), F.col("fps")))
    stated = found.select(
        *keys, "video", "detector", "fps", F.col("_length.seconds").alias("duration"), timecode.run_status(ok, F.coalesce("_n", F.lit(0))).alias("status"),
        run_warnings(ok, has("decode_detail", "string"), has("warning", "string"), F.col("_length.method")).alias("warnings"),
        F.col("video").alias("path"), "size_bytes", "mtime_utc", F.col("_id.detector_id").alias("detector_id"), F.col("_id.backend").alias("backend"),
        model_name(F.col("_id.detector_id")).alias("model"), has("tool_commit", "string").alias("tool_commit"), has("tool_dirty", "boolean").alias("tool_dirty"),
        *([F.col("settings")] if "settings" in runs.columns else []), F.lit(generated_by).alias("generated_by"),
        (generated_utc if generated_utc is not None else F.date_format(F.to_utc_timestamp(F.now(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("generated_utc"),
    )
    built = documents.build_documents(stated, events, keys)
    return documents.checked(built, keys, "document") if check else built
