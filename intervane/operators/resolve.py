"""References of items through a small cache: which lookups are answered from it, and what is built, from what, for the others."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: items that a cache remembers.
MOST = 16


def lookups(requests: DataFrame, cache: str, most: int = MOST) -> DataFrame:
    """requests (cache, seq, item long, path, stamp long) with answered ("hit", "stale" or "new") and evicted (an item, or null).

    A hit has the path and the stamp of what is kept for its item; else the item is built anew and takes its place as the latest.
    Then, while more than most are kept, the one built longest ago goes. Failed builds are kept like others. Caches are walked in
    order of seq over sorted partitions, with most entries in hand; a null path is an empty one.
    """
    kinds = dict(requests.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = object(), {}
        for pdf in batches:
            answered, evicted = [], []
            for key, item, path, stamp in zip(pdf[cache], pdf["item"], pdf["path"], pdf["stamp"]):
                if key != now:
                    now, kept = key, {}
                if kept.get(item) == (path, stamp):
                    answered.append("hit")
                    evicted.append(None)
                    continue
                answered.append("stale" if item in kept else "new")
                kept.pop(item, None)
                kept[item] = (path, stamp)
                out = next(iter(kept)) if len(kept) > most else None
                if out is not None:
                    del kept[out]
                evicted.append(out)
            out = pdf.assign(answered=answered)
            out["evicted"] = pd.array(evicted, dtype="Int64")
            yield out

    r = requests.select(cache, F.col("seq").cast("long").alias("seq"), F.col("item").cast("long").alias("item"), F.coalesce("path", F.lit("")).alias("path"), F.col("stamp").cast("long").alias("stamp"))
    walked = r.repartition(F.col(cache)).sortWithinPartitions(cache, "seq")
    return walked.mapInPandas(run, f"`{cache}` {kinds[cache]}, seq long, item long, path string, stamp long, answered string, evicted long")


def built(looked: DataFrame, embedded: DataFrame, sound: DataFrame, allow_sound: bool = True) -> DataFrame:
    """looked with source: what the reference that a lookup gets, or builds, is made of: "embedded", else "sound" if allowed, else "none".

    embedded, sound: (item, stamp) for which there is a usable track. Only different (item, stamp) meet them.
    """
    pairs = looked.select("item", "stamp").distinct()
    mark = lambda d, n: d.select("item", "stamp").distinct().withColumn(n, F.lit(True))
    known = pairs.join(mark(embedded, "_e"), ["item", "stamp"], "left").join(mark(sound, "_s"), ["item", "stamp"], "left")
    source = F.when(F.col("_e"), "embedded").when(F.col("_s") & F.lit(allow_sound), "sound").otherwise("none")
    return looked.join(known.select("item", "stamp", source.alias("source")), ["item", "stamp"], "left")
