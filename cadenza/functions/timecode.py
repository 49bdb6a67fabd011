"""Scalar expressions on media time: seconds, frames, timecodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def frame_time(frame: Column | str, fps: Column | float, digits: int = 4) -> Column:
    """Seconds of a frame, rounded half to even; the rounded value is the key that builders dedupe on."""
    return F.bround(_c(frame) / _c(fps), digits)


def time_frame(seconds: Column | str, fps: Column | float) -> Column:
    return F.rint(_c(seconds) * _c(fps)).cast("long")


def _two(x: Column) -> Column:
    text = x.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def smpte(seconds: Column | str, fps: Column | float) -> Column:
    """HH:MM:SS:FF without frame dropping; the rounded rate is the frame base."""
    base = F.rint(_c(fps)).cast("long")
    frames = time_frame(seconds, fps)
    whole = F.floor(frames / base)
    return F.concat_ws(":", _two(F.floor(whole / 3600)), _two(F.pmod(F.floor(whole / 60), F.lit(60))), _two(F.pmod(whole, F.lit(60))), _two(F.pmod(frames, base)))


def srt_time(seconds: Column | str) -> Column:
    """HH:MM:SS,mmm."""
    ms = F.rint(_c(seconds) * 1000).cast("long")
    whole = F.floor(ms / 1000)
    clock = F.concat_ws(":", _two(F.floor(whole / 3600)), _two(F.pmod(F.floor(whole / 60), F.lit(60))), _two(F.pmod(whole, F.lit(60))))
    return F.concat(clock, F.lit(","), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))


def affine(t: Column | str, scale: Column | float, offset: Column | float, digits: int = 4) -> Column:
    """Remapped time; callers filter out what falls below zero."""
    return F.bround(_c(scale) * _c(t) + _c(offset), digits)


def usable_rate(fps: Column | str) -> Column:
    """Finite and above zero; NaN compares above every number in Spark, so it is tested by name."""
    x = _c(fps)
    return F.coalesce((x > 0) & ~F.isnan(x) & (x != float("inf")), F.lit(False))


def throughput(n: Column | str, elapsed: Column | str) -> Column:
    """n per elapsed second, NaN without elapsed time."""
    return F.when(_c(elapsed) > 0, _c(n) / _c(elapsed)).otherwise(F.lit(float("nan")))


def hue_distance(a: Column, b: Column) -> Column:
    """Distance on the unit circle of hues."""
    d = F.abs(a - b)
    return F.least(d, 1 - d)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct<h, s, v> of channels in [0, 1]; grey has hue zero."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    safe = span + F.lit(1e-6)
    hue = F.when(high == r, (g - b) / safe).when(high == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4) / 6
    return F.struct(F.when(span > 0, hue - F.floor(hue)).otherwise(0.0).alias("h"), (span / (high + 1e-6)).alias("s"), high.alias("v"))


def backward_share(cov: Column | str, bwd: Column | str) -> Column:
    return F.when(_c(cov) > 0, _c(bwd) / F.greatest(_c(cov), F.lit(1e-9))).otherwise(0.5)


def sync_verdict(rate: Column | str) -> Column:
    return F.when(_c(rate) > 0.75, "same").when(_c(rate) > 0.4, "partial").otherwise("none")


def run_status(decode_ok: Column | str, n_events: Column | str) -> Column:
    return F.when(_c(decode_ok), "complete").when(_c(n_events) > 0, "partial").otherwise("failed")


def duration(probed: Column, n_frames: Column, fps: Column) -> Column:
    """struct<seconds, method>: the probed length, else frames over rate, else zero."""
    by_frames = F.when(usable_rate(fps) & (n_frames > 0), n_frames / fps)
    ok = (probed > 0) & ~F.isnan(probed) & (probed != float("inf"))
    seconds = F.coalesce(F.when(ok, probed), by_frames, F.lit(0.0))
    method = F.when(F.coalesce(ok, F.lit(False)), "probed").when(by_frames.isNotNull(), "frames").otherwise("none")
    return F.struct(seconds.alias("seconds"), method.alias("method"))


def in_region(t: Column | str, lo: Column | float, hi: Column | float) -> Column:
    """Whether a time lies in a closed region; false for null."""
    return F.coalesce(_c(t).between(_c(lo), _c(hi)), F.lit(False))


def drop_none(values: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(values, lambda _, v: v.isNotNull())
