"""Media columns: bytes kept losslessly as 8-bit audio, and features computed from what is read back.

Features: polyphase resampling, overlapped log-mel filterbanks, and energy segments with hysteresis. Frames are stored as
fixed-shape Arrow tensors of FRAMES x MELS with their time spans.
"""

from __future__ import annotations

import hashlib
import io
import math
import wave
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from intervane.llm.common import docs_of, from_rows, save, slices

RATE, UP, DOWN = 16_000, 1, 2  # samples a second as stored; resampled to RATE * UP / DOWN
WINDOW, HOP, MELS, FRAMES = 256, 128, 24, 32
BLOCK = 192
_CHUNK = 1 << 17  # resampled samples worked on at a time


def payload_of(text: str) -> bytes:
    """UTF-8 with spaces up to a positive multiple of 192 bytes."""
    b = text.encode("utf-8", "surrogatepass")
    return b.ljust(max(BLOCK, -(-len(b) // BLOCK) * BLOCK), b" ")


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """A WAVE file of one channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wave(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a WAVE file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("one channel of 8-bit samples is needed")
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache(maxsize=8)
def _phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """Windowed-sinc low-pass filter cut into its up phases: row p holds the taps for outputs whose position is p mod up."""
    wide = max(up, down)
    n = np.arange(-half * wide, half * wide + 1)
    taps = np.sinc(n / wide) * np.hamming(len(n)) / wide * up
    out = np.zeros((up, -(-len(taps) // up)), dtype=np.float32)
    for p in range(up):
        own = taps[p::up]
        out[p, : len(own)] = own
    return out


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by up/down: each output sample costs one phase of the filter, no zeros are multiplied."""
    if up == down:
        return x.astype(np.float32)
    phases = _phases(up, down)
    taps = phases.shape[1]
    n = -(-len(x) * up // down)
    centre = (phases.shape[1] * up) // 2
    padded = np.concatenate([np.zeros(taps, np.float32), x.astype(np.float32), np.zeros(taps + centre // up + 1, np.float32)])
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase
        at = first * down + centre
        p, base = at % up, at // up + taps
        count = -(-(n - first) // up)
        acc = np.zeros(count, np.float32)
        for t in range(taps):
            acc += phases[p, t] * padded[base - t : base - t + (count - 1) * down + 1 : down]
        out[first::up] = acc
    return out


@lru_cache(maxsize=4)
def _mel(rate: float, window: int = WINDOW, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a real transform; fixed formula 2595 log10(1 + f/700)."""
    top = 2595 * math.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1) / (rate / window)
    bins = np.arange(window // 2 + 1)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def frames(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames, frame energies) over windows of WINDOW samples that overlap by half; the last is filled with zeros."""
    n = max(1, -(-max(0, len(x) - WINDOW) // HOP) + 1)
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + WINDOW - len(x)), np.float32)])
    taper, bank = np.hanning(WINDOW).astype(np.float32), _mel(rate)
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    step = _CHUNK // HOP
    for a in range(0, n, step):
        b = min(n, a + step)
        view = np.lib.stride_tricks.as_strided(x[a * HOP :], (b - a, WINDOW), (x.strides[0] * HOP, x.strides[0]))
        energy[a:b] = (view * view).mean(axis=1)
        power = np.abs(np.fft.rfft(view * taper, axis=1)).astype(np.float32) ** 2
        mel[a:b] = np.log(power @ bank + 1e-6)
    return mel, energy


def segments(energy: np.ndarray, rate: float, rise: float = 1.15, fall: float = 0.95) -> list[tuple[float, float]]:
    """Time spans of high energy with hysteresis: a span opens above rise x median and closes below fall x median."""
    level = float(np.median(energy))
    mark = np.where(energy > rise * level, 1, np.where(energy < fall * level, -1, 0))
    at = np.nonzero(mark)[0]
    if not len(at):
        return []
    turns = at[np.concatenate([[True], mark[at[1:]] != mark[at[:-1]]])]
    spans, opened = [], None
    for k in turns:
        if mark[k] > 0:
            opened = k
        elif opened is not None:
            spans.append((opened * HOP / rate, k * HOP / rate))
            opened = None
    if opened is not None:
        spans.append((opened * HOP / rate, ((len(energy) - 1) * HOP + WINDOW) / rate))
    return spans


def tensors(mel: np.ndarray, rate: float) -> pa.RecordBatch:
    """Frames as fixed-shape Arrow tensors of FRAMES x MELS in half precision, with start and stop in seconds and the number of frames that are not filling."""
    n = -(-len(mel) // FRAMES)
    full = np.zeros((n * FRAMES, MELS), np.float16)
    full[: len(mel)] = mel
    used = np.minimum(FRAMES, len(mel) - np.arange(n) * FRAMES)
    start = np.arange(n) * FRAMES * HOP / rate
    stop = start + ((used - 1) * HOP + WINDOW) / rate
    values = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, FRAMES, MELS))
    return pa.RecordBatch.from_arrays([pa.array(start), pa.array(stop), pa.array(used.astype(np.int32)), values], names=["start", "stop", "frames", "mel"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def from_ipc(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def analyse(media: bytes) -> tuple[np.ndarray, list[tuple[float, float]], float]:
    """(log-mel frames, energy segments, rate after resampling) of a WAVE file."""
    samples, rate = from_wave(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y, rate = resample(x), rate * UP / DOWN
    mel, energy = frames(y, rate)
    return mel, segments(energy, rate), rate


def summary(mel: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """Frames, segments, seconds of high energy, and the mean and deviation of each band, in tenths."""
    mean, dev = mel.mean(axis=0, dtype=np.float64), mel.std(axis=0, dtype=np.float64)
    q = lambda v: ",".join(str(round(float(a) * 10)) for a in v)
    return f"frames={len(mel)};segments={len(spans)};active_ms={round(1000 * sum(b - a for a, b in spans))};mean={q(mean)};dev={q(dev)}"


#: A span of time, in seconds.
_SPANS = pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())]))
MEDIA = "doc_id long, n_bytes long, media binary"
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "segments array<struct<start:double,stop:double>>, tensors binary"
)
_FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("segments", _SPANS), ("tensors", pa.binary())]
)
_FEATURE = pa.schema([*list(_FEATURES)[:7], pa.field("feature", pa.string())])


def _mapped(rows: DataFrame, row, schema: str, arrow: pa.Schema) -> DataFrame:
    names = rows.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                yield from_rows([row(*values) for values in zip(*(part.column(c).to_pylist() for c in names))], arrow)

    return rows.mapInArrow(run, schema)


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a WAVE file of 8-bit samples. Null and empty texts are one block of spaces; repeated rows stay."""

    def row(k, text):
        return k, len(text.encode("utf-8", "surrogatepass")), to_wave(payload_of(text))

    return _mapped(docs_of(docs), row, MEDIA, _MEDIA)


def features(media_rows: DataFrame) -> DataFrame:
    """What the media column (doc_id, n_bytes, media) holds, as read back from it, and its features.

    payload: the samples. tensors: an Arrow stream of fixed-shape tensors of log-mel frames with their time spans, see
    from_ipc(). segments: time spans of high energy. Other columns are left behind.
    """

    def row(k, n, wave_file):
        back, _ = from_wave(wave_file)
        mel, spans, rate = analyse(wave_file)
        digests = hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(wave_file), hashlib.sha256(wave_file).hexdigest()
        return k, n, len(back), *digests, [{"start": a, "stop": b} for a, b in spans], to_ipc(tensors(mel, rate))

    return _mapped(media_rows.select("doc_id", "n_bytes", "media"), row, FEATURES, _FEATURES)


def summaries(feature_rows: DataFrame) -> DataFrame:
    """The rows of features() with what their tensors and segments say in short, in place of these columns: see summary()."""

    def row(*values):
        *kept, spans, raw = values
        got = from_ipc(raw)
        mel = np.concatenate([c.to_numpy_ndarray().reshape(-1, MELS) for c in got["mel"].chunks])[: sum(got["frames"].to_pylist())]
        return *kept, summary(mel, [(s["start"], s["stop"]) for s in spans])

    return _mapped(feature_rows.select(*_FEATURES.names), row, FEATURES.split(", segments")[0] + ", feature string", _FEATURE)


def stored_features(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, features) of docs, both written to the shared folder and read back: the features are those of the stored media."""
    stored = save(media(docs), "media", "zstd")
    return stored, save(features(stored), "media-features", "zstd")


def digests(docs: DataFrame) -> DataFrame:
    """Sizes and digests of each row's stored media and of the payload read back from it, and its stored features in short.

    One row for each row of docs. Null and empty texts are one block of spaces; equal texts give equal values.
    """
    return summaries(stored_features(docs)[1])
