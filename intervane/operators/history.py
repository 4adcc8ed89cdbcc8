"""Attempt logs, votes and limits: ordered folds over events."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervane import config as C


def statuses(attempts: DataFrame, key: str) -> DataFrame:
    """attempts (key, seq, status Applied or Declined) as a log keeps them: an applied attempt with a later applied one is Superseded; only the newest 20 stay."""
    w = Window.partitionBy(key).orderBy("seq")
    later = F.max(F.when(F.col("status") == "Applied", F.col("seq"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    x = attempts.withColumn("status", F.when((F.col("status") == "Applied") & later.isNotNull(), "Superseded").otherwise(F.col("status")))
    return x.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where(F.col("_r") <= C.MAX_ATTEMPTS).drop("_r")


def latest(attempts: DataFrame, key: str) -> DataFrame:
    """Latest-state row: the newest attempt, even a decline after an applied one."""
    return attempts.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where("_r = 1").drop("_r")


def last_applied(log: DataFrame, key: str) -> DataFrame:
    return latest(log.where("status = 'Applied'"), key)


def reject_current(log: DataFrame, rejections: DataFrame, key: str) -> DataFrame:
    """log with the last applied attempt of each rejected key set to Rejected; its file joins the rejected names."""
    hit = last_applied(log, key).join(rejections.select(key).distinct(), key, "left_semi").select(key, F.col("seq").alias("_s"))
    return log.join(hit, key, "left").withColumn("status", F.when(F.col("seq") == F.col("_s"), "Rejected").otherwise(F.col("status"))).drop("_s")


def backfill(rows: DataFrame) -> DataFrame:
    """Rows from before attempts were kept get one attempt made of their latest state."""
    from_state = F.array(F.struct(F.col("seq").alias("seq"), F.col("status").alias("status")))
    return rows.withColumn("attempts", F.when(F.coalesce(F.size("attempts"), F.lit(0)) <= 0, from_state).otherwise(F.col("attempts")))


def skip(state: DataFrame, now: Column, files: DataFrame | None = None, retry_days: int = C.DEFAULTS.retry_days) -> DataFrame:
    """Adds skip: an applied episode whose file is still there, or one declined less than retry_days ago.

    state: verdict, at (timestamp), path. files: (path) that exist; None takes none as there.
    """
    there = state.join(files.select(F.col("path")).distinct().withColumn("_there", F.lit(True)), "path", "left") if files is not None else state.withColumn("_there", F.lit(None).cast("boolean"))
    young = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) < retry_days * 86_400_000_000
    return there.withColumn("skip", F.when(F.col("verdict").isin(*C.ACCEPTABLE), F.coalesce("_there", F.lit(False))).otherwise(young)).drop("_there")


def counters(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    x = outcomes.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("applied", "declined", "skipped")], F.count("*").alias("total"))
    return x.withColumn("fraction", (F.col("applied") + F.col("declined") + F.col("skipped")) / F.col("total"))


def vote(events: DataFrame, key: str, most: int = C.MAX_CONFIRMATIONS) -> DataFrame:
    """Preferred group of each key after its events (key, seq, outcome success|reject, group, entry_id): (key, p_group, p_entry, votes).

    A success of the group confirms it, up to most; of another group it spends a vote, or replaces at one vote or none. A
    success without a group only sets the entry while there are no votes. A rejection of the group spends a vote and clears it
    at none. Ordered, so a fold over the sorted events of a key.
    """
    state = "struct<p_group:string,p_entry:bigint,votes:int>"
    zero = F.struct(F.lit("").alias("p_group"), F.lit(0).cast("long").alias("p_entry"), F.lit(0).alias("votes")).cast(state)

    def make(g, e, v) -> Column:
        return F.struct(g.alias("p_group"), e.alias("p_entry"), v.cast("int").alias("votes")).cast(state)

    def step(s: Column, x: Column) -> Column:
        g, e = F.trim(F.coalesce(x["group"], F.lit(""))), x["entry_id"]
        same = F.lower(g) == F.lower(s["p_group"])
        spent = F.greatest(s["votes"] - 1, F.lit(0))
        good = (
            F.when(F.length(g) == 0, F.when(s["votes"] == 0, make(s["p_group"], e, s["votes"])).otherwise(s))
            .when(same, make(s["p_group"], e, F.least(s["votes"] + 1, F.lit(most))))
            .when(s["votes"] <= 1, make(g, e, F.lit(1)))
            .otherwise(make(s["p_group"], s["p_entry"], s["votes"] - 1))
        )
        bad = F.when((F.length(g) == 0) | ~same, s).when(spent == 0, zero).otherwise(make(s["p_group"], s["p_entry"], spent))
        return F.when(x["outcome"] == "success", good).when(x["outcome"] == "reject", bad).otherwise(s)

    log = F.array_sort(F.collect_list(F.struct("seq", "outcome", "group", F.col("entry_id").cast("long").alias("entry_id"))))
    return events.groupBy(key).agg(log.alias("log")).select(key, F.aggregate("log", zero, step).alias("s")).select(key, "s.*")


def admit(requests: DataFrame, key: str, permits: int = 25, window_ms: int = 60_000, grace_ms: int = 50) -> DataFrame:
    """When each request (key, seq, at_ms) passes a sliding-window limit, served in order: (key, seq, at_ms, admitted_ms).

    A request passes at once if fewer than permits passed in the window before it; else a window and a grace after the one
    permits places before it. Delays feed back, so requests are walked in order of seq: sorted partitions, read in batches,
    with the last permits admissions of one key in hand.
    """
    kind = dict(requests.dtypes)[key]
    x = requests.select(key, F.col("seq").cast("long").alias("seq"), F.col("at_ms").cast("long").alias("at_ms"))

    def run(batches):
        now, last = object(), deque()
        for pdf in batches:
            out = []
            for k, at in zip(pdf[key], pdf["at_ms"]):
                if k != now:
                    now, last = k, deque(maxlen=permits)
                if last:
                    at = max(at, last[-1])
                if len(last) == permits and last[0] + window_ms > at:
                    at = last[0] + window_ms + grace_ms
                last.append(at)
                out.append(at)
            yield pdf.assign(admitted_ms=out)

    return x.repartition(F.col(key)).sortWithinPartitions(key, "seq").mapInPandas(run, f"`{key}` {kind}, seq long, at_ms long, admitted_ms long")


def applied_paths(log: DataFrame, key: str) -> DataFrame:
    """Distinct paths of applied attempts of each key."""
    return log.where("status = 'Applied' and path is not null and path <> ''").select(key, "path").distinct()


def targets(sessions: DataFrame, interactive: Column) -> DataFrame:
    """Sessions to notify: those playing; if none is and the request is interactive, those active lately."""
    anyone = sessions.agg(F.coalesce(F.bool_or("playing"), F.lit(False)).alias("_anyone")).withColumn("_one", F.lit(1))
    x = sessions.withColumn("_one", F.lit(1)).join(F.broadcast(anyone), "_one")  # a table of one row
    return x.where(F.when(F.col("_anyone"), F.col("playing")).otherwise(interactive & F.col("recent"))).select(*sessions.columns)


def learns(x: DataFrame) -> DataFrame:
    """Adds learns: an applied result that the user chose, of which a series preference may learn."""
    return x.withColumn("learns", F.coalesce((F.col("status") == "Applied") & F.col("chosen_by_user") & ~F.col("manual"), F.lit(False)))
