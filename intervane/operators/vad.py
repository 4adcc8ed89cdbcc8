"""Voice activity from frames of sound: band energy against an adaptive noise floor.

Spectra are of single frames, so they are found wherever the frames lie; only one number a frame goes on to the noise floor
(operators.floor), and scores are expressions of energy, flatness and floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervane.operators import floor as FL
from intervane.tables import save

# Rate, frame, band (Hz); gates on duty and frames.
RATE, FRAME, LOW, HIGH = 16_000, 512, 300.0, 3400.0
MIN_FRAMES, MIN_DUTY, MAX_DUTY = 100, 0.02, 0.95
#: First and last bin of the band.
FIRST_BIN, LAST_BIN = int(np.floor(LOW * FRAME / RATE)), min(int(np.ceil(HIGH * FRAME / RATE)), FRAME // 2 - 1)


def spectra(frames: DataFrame, key: str) -> DataFrame:
    """(key, frame_no, energy, flatness) of the speech band of frames (key, frame_no, samples). Short frames are filled with zeros, null ones silent."""
    window = np.hanning(FRAME)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.zeros((len(pdf), FRAME))
            for i, f in enumerate(pdf["samples"]):
                if f is not None:
                    x[i, : min(len(f), FRAME)] = f[:FRAME]
            power = np.abs(np.fft.rfft(x * window, axis=1)[:, FIRST_BIN : LAST_BIN + 1]) ** 2
            flat = np.exp(np.log(power + 1e-12).mean(axis=1)) / np.maximum(power.mean(axis=1), 1e-300)
            yield pdf[[key, "frame_no"]].assign(energy=power.sum(axis=1), flatness=flat)

    kind = dict(frames.dtypes)[key]
    narrow = frames.select(key, F.col("frame_no").cast("long").alias("frame_no"), F.col("samples").cast("array<double>").alias("samples"))
    return narrow.mapInPandas(run, f"`{key}` {kind}, frame_no long, energy double, flatness double")


def score(energy: Column, flatness: Column, floor: Column) -> Column:
    """Score in [0, 1]: loudness over the noise floor, and peakiness; 0 for silence."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    loud = unit(F.log10(energy / F.greatest(floor, F.lit(1e-12))) / 1.5)
    return F.when(energy > 0, unit(0.6 * loud + 0.4 * unit((0.5 - flatness) / 0.35))).otherwise(0.0)


def band_energy(frames: DataFrame, key: str) -> DataFrame:
    """(key, frame_no, score) of frames (key, frame_no, samples array<double>)."""
    x = save(spectra(frames, key), "spectra")  # read three times; what it comes from is 512 samples a row
    floors = FL.floors(x, [key])
    return x.join(floors, [key, "frame_no"]).select(key, "frame_no", score(F.col("energy"), F.col("flatness"), F.col("floor")).alias("score"))


DETECTORS = {"band-energy": band_energy}


def detector(name: str | None):
    """A registered detector: a function of frames and their key to scores; an unknown name falls back to band energy."""
    return DETECTORS.get(name or "", band_energy)


def scores(frames: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """(key, frame_no, score) by the named detector. frame_no must be of one frame of a key."""
    return detector(name)(frames, key)


def usable(scored: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """(key, n_frames, duty, usable): enough frames, and neither nearly silent nor nearly always active."""
    x = scored.groupBy(key).agg(F.count("*").alias("n_frames"), F.avg((F.col("score") >= threshold).cast("double")).alias("duty"))
    return x.withColumn("usable", (F.col("n_frames") >= MIN_FRAMES) & F.col("duty").between(MIN_DUTY, MAX_DUTY))
