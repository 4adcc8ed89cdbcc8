"""End to end: candidate documents of episodes against a reference, measured, corrected for bias, ranked and rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane import config as C
from intervane.functions import names as N
from intervane.operators import align as AL
from intervane.operators import bias as B
from intervane.operators import candidates as CA
from intervane.operators import piecewise as PW
from intervane.operators import ranking as R
from intervane.plans.registry import query
from intervane.sources import subtitles as SU
from intervane.tables import save


def sync(episodes: DataFrame, reference: DataFrame, files: DataFrame, documents: DataFrame, profiles: DataFrame | None = None, settings: C.Settings = C.DEFAULTS) -> dict[str, DataFrame]:
    """One subtitle for each episode: {"candidates", "measured", "chosen", "rewritten"}.

    episodes: (episode_id, video, episode); reference: (episode_id, src_ix, start, stop); files: (episode_id, entry_id, file_id,
    name, size); documents: (doc_id = file_id, content); profiles: (episode_id, p_group, p_entry, votes).
    Files are rejected, scored and ranked by name, the first max_candidates measured, their shared bias taken off, and the best
    of the acceptable ones rewritten. What several steps read (tried files, lines, timed lines, measurements, the choice) is
    written to the shared folder, so that later steps plan and run from there. Cheap filters come before documents are parsed, and parsing before alignment.
    """
    video = episodes.select("episode_id", "episode", F.col("video").alias("_video"))
    # A number of partitions, as names are short and the patterns that they are held against are not.
    files = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "episode_id", "entry_id")
    f = CA.with_releases(CA.rejection(files, ["episode_id", "entry_id"], settings.allow_archives).join(video, "episode_id"), {"_video": "_v", "name": "_s"})
    f = f.withColumn("_m", N.agree(F.col("_v"), F.col("_s"), F.col("episode"))).withColumn("score", F.col("_m.score")).withColumn("source_match", F.col("_m.source_match")).withColumn("different_cut", F.col("_m.source_mismatch")).withColumn("exact_release", F.col("_m.exact"))
    f = f.withColumn("language", N.language(F.col("name"))).withColumn("usable", (F.col("rejection") == "none") & ~F.col("_m.episode_mismatch")).withColumn("group", F.col("_s.named"))
    if profiles is not None:
        f = CA.with_profile(f, profiles, "episode_id").withColumn("preferred", CA.preferred(F.col("group"), F.col("entry_id"), F.col("p_group"), F.col("p_entry"), F.col("votes"), settings.min_votes))
    else:
        f = f.withColumn("preferred", F.lit(False))
    tried = CA.rank(f.where("usable"), ["episode_id"], settings.max_candidates).select("episode_id", "entry_id", "file_id", "name", "language", "score", "source_match", "preferred", "different_cut", "exact_release", F.col("place").alias("tried"))
    tried = save(tried, "tried")

    # Files, and what is found of each, grow with the episodes: their tables are small on disk and not in memory, and are not broadcast.
    docs = documents.join(tried.select(F.col("file_id").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")
    lines = save(SU.lines(docs), "lines")
    timed = save(SU.timed(lines), "timed")
    blocks, tags = SU.marks(timed)
    cues = SU.dialogue(timed, blocks).select(F.col("doc_id").alias("file_id"), "src_ix", "start", "stop").join(SU.karaoke(timed).withColumnRenamed("doc_id", "file_id").hint("shuffle_hash"), "file_id")
    pairs = tried.select("episode_id", "file_id", "different_cut")
    probe = cues.join(pairs.hint("shuffle_hash"), "file_id").select("episode_id", "file_id", "src_ix", "start", "stop", "different_cut", "karaoke")
    ref = reference.join(pairs.select("episode_id", "file_id").hint("shuffle_hash"), "episode_id").select("episode_id", "file_id", "src_ix", "start", "stop")
    verdicts = AL.align(ref, probe, ["episode_id", "file_id"], settings)
    heard = reference.where("stop > start").select("episode_id").distinct().withColumn("_heard", F.lit(True))
    x = tried.join(verdicts.hint("merge"), ["episode_id", "file_id"], "left").join(heard.hint("merge"), "episode_id", "left").withColumns({"has_reference": F.coalesce("_heard", F.lit(False)), "manual_offset": F.lit(None).cast("double"), "force": F.lit(False), "use_measured": F.lit(False), "verdict": F.coalesce("verdict", F.lit("Declined")), "scale": F.coalesce("scale", F.lit(1.0)), "shift": F.coalesce("shift", F.lit(0.0))})
    x = AL.precedence(x).withColumn("verdict", F.col("final_verdict")).withColumn("scale", F.col("final_scale")).withColumn("shift", F.col("final_shift"))
    x = B.correct(x, ["episode_id"], settings).withColumn("quality", R.quality(F.col("coverage"), F.coalesce("correlation", F.lit(0.0)), F.coalesce("ratio", F.lit(0.0)), F.col("shift"), settings))
    x = save(x, "measured")
    good = R.ranked(x.where(AL.is_acceptable(F.col("verdict"))), ["episode_id"])
    chosen = R.choose(good, ["episode_id"], settings).join(x.select("episode_id", "file_id", "name", "verdict", "scale", "shift", "correlation", "coverage", "n_blocks", "blocks").hint("merge"), ["episode_id", "file_id"])
    chosen = save(chosen, "chosen")

    whole = chosen.where("verdict <> 'PiecewiseCut'").select(F.col("file_id").alias("doc_id"), "scale", "shift")
    pieces = chosen.where("verdict = 'PiecewiseCut'").select(F.col("file_id").alias("doc_id"), F.explode("blocks").alias("b")).select("doc_id", "b.*")
    by_line = timed.join(pieces.select("doc_id").distinct(), "doc_id", "left_semi")
    placed = PW.block_offsets(SU.dialogue(timed, blocks).join(pieces.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "cue_ix", "timed_ix"), pieces, ["doc_id"]).select("doc_id", "timed_ix", "offset")
    seed = pieces.groupBy("doc_id").agg(F.min_by("offset", "first_cue").alias("seed"))
    carried = PW.carry_forward(by_line.select("doc_id", "timed_ix").join(placed, ["doc_id", "timed_ix"], "left").join(seed, "doc_id").withColumn("line_ix", F.col("timed_ix")), ["doc_id"])
    per_line = timed.select("doc_id", "timed_ix").join(whole, "doc_id").unionByName(carried.select("doc_id", "timed_ix", F.lit(1.0).alias("scale"), F.col("offset").alias("shift")))
    rewritten = SU.rewrite(lines.join(per_line.select("doc_id").distinct(), "doc_id", "left_semi"), timed, per_line, tags)
    return {"candidates": f, "measured": x, "chosen": chosen, "rewritten": rewritten}


@query()
def sync_pipeline(spark, sf_dir):
    """Every user's track as an episode with three candidate files: one late, one from another user, one scaled."""
    from intervane.plans.derived import tracks

    t = tracks(spark, sf_dir)
    n = t.agg(F.max("track_id")).first()[0] + 1
    ref = t.select(F.col("track_id").alias("episode_id"), "src_ix", "start", "stop")
    episodes = ref.select("episode_id").distinct().select("episode_id", F.lit("[G1] Show - 02 (BD 1920x1080 HEVC FLAC).mkv").alias("video"), F.lit(2).alias("episode"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(g).alias("tag")) for k, g in enumerate(("[G1] Show - 02 (BD).srt", "[G2] Show - 02 (WEB).srt", "[G3] Show - 02 (BD).srt"))]))
    files = episodes.select("episode_id", kinds.alias("k")).select("episode_id", F.col("k.kind").cast("long").alias("entry_id"), (F.col("episode_id") * 10 + F.col("k.kind")).alias("file_id"), F.col("k.tag").alias("name"), F.lit(9000).alias("size"))
    from intervane.functions import timing as T

    made = []
    for k in range(3):
        own = t.withColumn("file_id", (((F.col("track_id") + 1) % n) if k == 1 else F.col("track_id")) * 10 + k)
        a, b = (F.col("start") + 3.25, F.col("stop") + 3.25) if k == 0 else (F.col("start"), F.col("stop")) if k == 1 else (F.col("start") * 0.96, F.col("stop") * 0.96)
        made.append(own.withColumn("line", F.concat(T.format_time(a, "srt"), F.lit(" --> "), T.format_time(b, "srt"), F.lit("\nx\n\n"))).select("file_id", "src_ix", "line"))
    lines = made[0].unionByName(made[1]).unionByName(made[2])
    docs = lines.groupBy(F.col("file_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src_ix", "line"))), lambda s: s["line"]), "").alias("content"))
    out = sync(episodes, ref, files, docs)
    return out["chosen"].join(out["rewritten"].select(F.col("doc_id").alias("file_id"), "rewritten", "clamped"), "file_id").drop("blocks")
