"""Alignment of probe tracks with reference tracks: drift refinement and verdicts, for all pairs at once; operators.search finds what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervane import config as C
from intervane.operators import piecewise as PW
from intervane.operators import search as S
from intervane.tables import save


def drift(ref_cues: DataFrame, probe_cues: DataFrame, keys: list[str], settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """(keys, scale, shift, correlation, refined): the best unscaled fit, refined by its residual drift where that correlates better."""
    return S.found(ref_cues, probe_cues, keys, settings, drift_only=True).select(*keys, "scale", "shift", "correlation", "refined")


VERDICT = f"verdict string, scale double, shift double, correlation double, ratio double, coverage double, on_screen double, matched_on string, n_blocks int, blocks {PW.BLOCKS}, reason string"
_ONSETS, _OVERLAP = "onsets", "overlap"


def align(ref_cues: DataFrame, probe_cues: DataFrame, keys: list[str], settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """Verdict of each key's probe against its reference: (keys, VERDICT). Cues: (keys, src_ix, start, stop); the probe may also have different_cut and karaoke.

    Cues are exchanged once, and all pairs go through each step at once; see operators.search. Only pairs that are undecided after
    the global fit, or of another cut, go on to the piecewise program; a CASE says the rest. What is found is written to the shared
    folder. A key without reference cues, or with too few of its own, is declined.
    """
    x = save(S.found(ref_cues, probe_cues, keys, settings), "found")
    x = x.withColumn("representation", F.when(F.col("rep_ix") == 0, _OVERLAP).when(F.col("rep_ix") == 1, _ONSETS))
    said = PW.credible(x.withColumn("blocks", F.col("found")).withColumn("global_correlation", F.col("correlation")).withColumn("global_coverage", F.col("reference_covered")), settings)
    return said.select(*keys, *_spoken(settings))


def _spoken(settings: C.Settings) -> list[Column]:
    """The columns of VERDICT from those of both fits."""
    c = F.col
    cut = c("credible")
    none = c("representation").isNull()
    scaled = F.abs(c("scale") - 1.0) > 1e-9
    far = F.abs(c("scale") - 1.0) > settings.max_scale_deviation
    sung = c("karaoke") & F.lit(settings.decline_karaoke)
    exact = ~none & ~cut & c("good") & ~scaled & (F.abs("shift") < settings.min_correction)
    say = F.format_string
    cases = [
        (c("n_cues") < C.MIN_CUES_TO_ALIGN, "Declined", say("only %d usable cues", c("n_cues"))),
        (none, "Declined", F.lit("the search gave no result")),
        (cut, "PiecewiseCut", say("%d sections", F.size("blocks"))),
        (~c("good"), "Declined", say("correlation %.2f, uniqueness %.2f", c("correlation"), c("peak_ratio"))),
        (scaled & far, "Declined", say("scale %.4f is too far from 1", c("scale"))),
        (scaled & sung, "Declined", F.lit("karaoke timing would need scaling")),
        (scaled, "FramerateDrift", say("scale %.6f, offset %+.3fs", c("scale"), c("shift"))),
        (F.abs("shift") > settings.max_offset, "Declined", say("a shift of %+.1fs is beyond the limit", c("shift"))),
        (exact, "Exact", say("already in sync (%+.3fs)", c("shift"))),
    ]
    verdict, reason = F.lit("ConstantOffset"), say("constant offset of %+.3fs", c("shift"))
    for when, v, r in reversed(cases):
        verdict, reason = F.when(when, v).otherwise(verdict), F.when(when, r).otherwise(reason)
    blocks = F.when(cut, c("blocks")).otherwise(F.array().cast(PW.BLOCKS))
    return [
        verdict.alias("verdict"),
        F.when(none | exact, 1.0).otherwise(c("scale")).alias("scale"),
        F.when(none | exact, 0.0).otherwise(c("shift")).alias("shift"),
        F.when(cut, c("split_correlation")).otherwise(F.coalesce("correlation", F.lit(0.0))).alias("correlation"),
        F.coalesce("peak_ratio", F.lit(0.0)).alias("ratio"),
        F.when(cut, c("split_coverage")).otherwise(c("reference_covered")).alias("coverage"),
        F.when(cut, c("split_screen")).otherwise(c("on_screen")).alias("on_screen"),
        c("representation").alias("matched_on"),
        F.size(blocks).alias("n_blocks"),
        blocks.alias("blocks"),
        reason.alias("reason"),
    ]


def is_acceptable(verdict):
    return verdict.isin(*C.ACCEPTABLE)


def decide(x: DataFrame, settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """Verdict of a global fit (scale, shift, correlation, peak_ratio, min_correlation, karaoke) as a CASE.

    The scaled path ends before the limit on the shift is looked at.
    """
    good = (F.col("correlation") >= F.col("min_correlation")) & (F.col("peak_ratio") >= settings.min_ratio)
    scaled = F.abs(F.col("scale") - 1.0) > 1e-9
    blocked = (F.abs(F.col("scale") - 1.0) > settings.max_scale_deviation) | (F.col("karaoke") & F.lit(settings.decline_karaoke))
    verdict = (
        F.when(~good, "Declined")
        .when(scaled & blocked, "Declined")
        .when(scaled, "FramerateDrift")
        .when(F.abs("shift") > settings.max_offset, "Declined")
        .when(F.abs("shift") < settings.min_correction, "Exact")
        .otherwise("ConstantOffset")
    )
    return x.withColumn("verdict", verdict)


def precedence(x: DataFrame) -> DataFrame:
    """Which evaluation of a candidate holds: manual offset, same checksum, no reference (waived or declined), alignment, waived alignment.

    x: manual_offset, exact_release, has_reference, force, use_measured, verdict, scale, shift. Adds path, final_verdict, final_scale, final_shift.
    """
    from intervane.functions import timing as T

    ok = is_acceptable(F.col("verdict"))
    measured = F.col("use_measured") & ~T.identity(F.col("scale"), F.col("shift")) & T.sane(F.col("scale"), F.col("shift"))
    path = (
        F.when(F.col("manual_offset").isNotNull(), "manual")
        .when(F.col("exact_release"), "checksum")
        .when(~F.col("has_reference") & F.col("force"), "unverified")
        .when(~F.col("has_reference"), "no reference")
        .when(ok | ~F.col("force"), "aligned")
        .when(measured, "measured anyway")
        .otherwise("unchanged anyway")
    )
    x = x.withColumn("path", path)
    verdict = (
        F.when(F.col("path") == "manual", F.when(F.abs("manual_offset") < 1e-9, "Exact").otherwise("ConstantOffset"))
        .when(F.col("path").isin("checksum", "unverified", "unchanged anyway"), "Exact")
        .when(F.col("path") == "no reference", "Declined")
        .when(F.col("path") == "measured anyway", F.when(T.shift_only(F.col("scale")), "ConstantOffset").otherwise("FramerateDrift"))
        .otherwise(F.col("verdict"))
    )
    keep = F.col("path").isin("aligned", "measured anyway")
    return x.withColumn("final_verdict", verdict).withColumn("final_scale", F.when(keep, F.col("scale")).otherwise(1.0)).withColumn("final_shift", F.when(F.col("path") == "manual", F.col("manual_offset")).when(keep, F.col("shift")).otherwise(0.0))
