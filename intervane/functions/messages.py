"""Sentences about outcomes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(x: Column) -> Column:
    return F.format_string("%.2f", x)


def weak_match(correlation: Column, ratio: Column, least: Column, min_ratio: Column) -> Column:
    """Why a fit was not trusted: both figures, the correlation, or the uniqueness; NULL for one that passes."""
    low, common = correlation < least, ratio < min_ratio
    return (
        F.when(low & common, F.concat(F.lit("no convincing alignment: correlation "), _two(correlation), F.lit(" of "), _two(least), F.lit(", uniqueness "), _two(ratio), F.lit(" of "), _two(min_ratio)))
        .when(low, F.concat(F.lit("correlation "), _two(correlation), F.lit(" is below "), _two(least)))
        .when(common, F.concat(F.lit("uniqueness "), _two(ratio), F.lit(" is below "), _two(min_ratio)))
    )


def outcome(verdict: Column, described: Column, reason: Column) -> Column:
    """One line about a result: what was done to the file, or why nothing was."""
    return (
        F.when(verdict == "Exact", "already in sync")
        .when(verdict == "ConstantOffset", F.concat(F.lit("shifted by "), described))
        .when(verdict == "FramerateDrift", F.concat(F.lit("rescaled: "), described))
        .when(verdict == "PiecewiseCut", "matched in sections")
        .otherwise(F.concat(F.lit("declined: "), F.coalesce(reason, F.lit("unknown"))))
    )


def reference_note(n_streams: Column, n_usable: Column, source: Column) -> Column:
    """Where the reference came from: NULL source and no usable stream say why there is none."""
    return F.when(source.isNotNull(), F.concat(F.lit("reference: "), source)).when(n_streams == 0, "no embedded subtitle streams").when(n_usable == 0, F.concat(n_streams.cast("string"), F.lit(" streams, none usable"))).otherwise("no reference chosen")
