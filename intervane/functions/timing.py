"""Timecodes and time transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from intervane.functions.rounding import half_away

_TIME = r"^\s*([+-]?\d+):([+-]?\d+):\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"
#: The usual form, whose fields have their places.
_USUAL = r"^\d\d:\d\d:\d\d[.,]\d\d\d\z"


def parse_time(text: Column) -> Column:
    """Seconds of h:mm:ss.cc or hh:mm:ss,mmm; NULL if it is neither. The usual form is cut at its places, any other by a pattern for each field."""
    t = F.replace(text, F.lit(","), F.lit("."))
    part = lambda k: F.regexp_extract(t, _TIME, k)
    any_ = F.when(t.rlike(_TIME), part(1).try_cast("double") * 3600.0 + part(2).try_cast("double") * 60.0 + part(3).try_cast("double"))
    field = lambda at, n, kind: F.replace(F.substring(text, at, n), F.lit(","), F.lit(".")).try_cast(kind)
    return F.when(text.rlike(_USUAL), field(1, 2, "int") * 3600.0 + field(4, 2, "int") * 60.0 + field(7, 6, "double")).otherwise(any_)


def format_time(seconds: Column, kind: str) -> Column:
    """kind "srt": hh:mm:ss,mmm; else h:mm:ss.cc. Negative times are zero; halves round away from zero."""
    unit = 1000 if kind == "srt" else 100
    return _format(F.floor(F.greatest(seconds, F.lit(0.0)) * float(unit) + 0.5).cast("long"), kind, unit)


def _format(n: Column, kind: str, unit: int) -> Column:
    whole = F.floor(n / unit).cast("long")
    h, m, s = F.floor(whole / 3600).cast("long"), F.floor(whole / 60).cast("long") % 60, whole % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hour = F.when(h < 10, two(h)).otherwise(h.cast("string")) if kind == "srt" else h.cast("string")
    return F.concat(hour, F.lit(":"), two(m), F.lit(":"), two(s), F.lit("," if kind == "srt" else "."), F.lpad((n % unit).cast("string"), 3 if kind == "srt" else 2, "0"))


def shift_only(scale: Column) -> Column:
    return F.abs(scale - 1.0) < 1e-9


def identity(scale: Column, offset: Column) -> Column:
    return shift_only(scale) & (F.abs(offset) < 1e-9)


def apply(scale: Column, offset: Column, t: Column) -> Column:
    return scale * t + offset


def _signed(offset: Column) -> Column:
    ms = half_away(F.abs(offset) * 1000).cast("long")
    sign = F.when((offset < 0) & (ms > 0), "-").otherwise("+")
    return F.concat(sign, F.floor(ms / 1000).cast("long").cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("s"))


def describe(scale: Column, offset: Column) -> Column:
    """unchanged, +2.500s, or x1.042709 -0.120s."""
    digits = F.regexp_replace(F.format_number(scale, 6), r"(\.\d*?)0+$", "$1")
    factor = F.concat(F.lit("x"), F.regexp_replace(F.replace(digits, F.lit(","), F.lit("")), r"\.$", ""))
    return F.when(identity(scale, offset), "unchanged").when(shift_only(scale), _signed(offset)).otherwise(F.concat_ws(" ", factor, _signed(offset)))


def two_point(at_start: Column, at_end: Column, first: Column, last: Column) -> Column:
    """struct<scale, offset> of a correction given at the first and last cue; a plain shift if they agree or lie within a second."""
    stretched = at_end.isNotNull() & (last - first > 1) & (F.abs(at_end - at_start) > 1e-9)
    scale = F.when(stretched, 1.0 + (at_end - at_start) / (last - first)).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.when(stretched, at_start - (scale - 1.0) * first).otherwise(at_start).alias("offset"))


def sane(scale: Column, offset: Column, max_offset: float = 30.0, max_scale_deviation: float = 0.1) -> Column:
    """A correction small enough to be a timing error rather than the wrong file."""
    return (F.abs(offset) <= max_offset) & (F.abs(scale - 1.0) <= max_scale_deviation)
