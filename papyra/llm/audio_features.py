"""Audio features of stored media: polyphase resampling, log-mel filterbanks, hysteresis energy segmentation.

Media are 8-bit mono WAV files in a binary column. A file's samples are resampled by ``up/down`` with a windowed-sinc
polyphase filter (only the filter taps that meet a sample are evaluated), cut into frames of ``frame`` samples every
``hop``, and turned into log-mel energies. Energy segments begin above a high threshold and last while the energy
stays above a low one. Features are stored as one Arrow stream for each file: a fixed-shape tensor column
(``tile`` frames x ``mels``) with the time span of each tensor, and the spans of the segments.

Work on a file goes by blocks of ``block`` frames: samples are resampled for one block at a time, straight from the
stored bytes. Besides its bytes a file takes the memory of one block and of its tensors (``mels`` numbers for each
``hop`` samples) as numbers and as the stream.

Defined results: a null text is an empty text; a payload holds at least one unit of 576 bytes, so every file has
frames; repeated rows give repeated rows, equal texts equal values; an empty table gives an empty table; other
columns are ignored; media that are no whole 8-bit mono WAV file raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.shared import Stored, plain, small_batches, text_slices

UNIT = 576
PAD = 255
WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")
MEDIA = "doc_id bigint, n_bytes bigint, media binary"
FEATURES = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, "
    "n_frames int, spans array<struct<start_s: double, end_s: double>>, tensors binary"
)


@dataclass(frozen=True)
class AudioSetting:
    rate: int = 8000
    up: int = 2
    down: int = 3
    half_taps: int = 12
    frame: int = 192
    hop: int = 96
    mels: int = 20
    tile: int = 8
    high: float = 1.0
    low: float = 0.0
    block: int = 4096

    def taps(self) -> np.ndarray:
        """Taps by phase, (up, taps of a phase): a Hann-windowed sinc cut off at the lower of both rates."""
        wide = max(self.up, self.down)
        n = np.arange(-self.half_taps * wide, self.half_taps * wide + 1)
        h = np.sinc(n / wide) * np.hanning(len(n) + 2)[1:-1] * self.up / wide
        h = np.append(h, np.zeros(-len(h) % self.up))
        return h.reshape(-1, self.up).T.astype(np.float32)

    def filters(self) -> np.ndarray:
        """Triangular mel filters, (bins, mels)."""
        top = self.rate * self.up / self.down / 2
        mel = np.linspace(0, 2595 * np.log10(1 + top / 700), self.mels + 2)
        at = 700 * (10 ** (mel / 2595) - 1) / top * (self.frame // 2)
        bins = np.arange(self.frame // 2 + 1)[:, None]
        rise, fall = (bins - at[:-2]) / (at[1:-1] - at[:-2]), (at[2:] - bins) / (at[2:] - at[1:-1])
        return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def to_wav(payload: bytes, rate: int) -> bytes:
    return WAV.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate; raises ValueError on anything but 8-bit mono."""
    riff, _, wave, fmt, _, kind, channels, rate, _, _, bits, data, size = WAV.unpack_from(media)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) < WAV.size + size:
        raise ValueError("not a whole 8-bit mono WAV file")
    return media[WAV.size : WAV.size + size], rate


def resampled_length(n: int, s: AudioSetting) -> int:
    return -(-n * s.up // s.down)


def resample(x: np.ndarray, taps: np.ndarray, s: AudioSetting, first: int = 0, end: int | None = None) -> np.ndarray:
    """Samples ``first`` to ``end`` of x at up/down of its rate; only the samples of x that these need are touched.

    Bytes are taken as 8-bit samples. Output m takes phase (m * down + centre) mod up and the samples before (m * down + centre) div up.
    """
    up, down, width = s.up, s.down, taps.shape[1]
    end = resampled_length(len(x), s) if end is None else end
    centre = s.half_taps * max(up, down)
    low = (first * down + centre) // up - width + 1  # the first sample needed; before 0 and after the end is silence
    high = (max(first, end - 1) * down + centre) // up + 1
    inner = x[max(0, low) : max(0, min(len(x), high))]
    inner = (inner.astype(np.float32) - 128) / 128 if x.dtype == np.uint8 else inner.astype(np.float32)
    held = np.zeros(high - low, np.float32)
    held[max(0, -low) : max(0, -low) + len(inner)] = inner
    out = np.empty(max(0, end - first), np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(held, width) if len(held) >= width else np.zeros((0, width), np.float32)
    for k in range(min(up, len(out))):
        at = (first + k) * down + centre
        begin = at // up - width + 1 - low
        count = len(range(k, len(out), up))
        out[k::up] = windows[begin::down][:count] @ taps[at % up][::-1]
    return out


def log_mel(x: np.ndarray, s: AudioSetting, taps: np.ndarray, window: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """(frames, mels) of the resampled x: overlapped frames, the last padded with silence; one block of frames at a time."""
    n = resampled_length(len(x), s)
    frames = max(1, -(-max(0, n - s.frame) // s.hop) + 1)
    out = np.empty((frames, s.mels), np.float32)
    for i in range(0, frames, s.block):
        count = min(s.block, frames - i)
        first, end = i * s.hop, (i + count - 1) * s.hop + s.frame
        held = np.zeros(end - first, np.float32)
        got = resample(x, taps, s, first, min(end, n))
        held[: len(got)] = got
        power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(held, s.frame)[:: s.hop] * window, axis=1)) ** 2
        out[i : i + count] = np.log(power.astype(np.float32) @ filters + 1e-3)
    return out


def segments(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Runs of frames above low that reach above high (thresholds in median absolute deviations from the median)."""
    level = energy - np.median(energy)
    level = level / (np.median(np.abs(level)) + 1e-6)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (level > low).astype(np.int8), [0]])))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if level[a:b].max() > high]


def tensor_stream(mel: np.ndarray, s: AudioSetting) -> bytes:
    """An Arrow stream: fixed-shape tensors (tile, mels) with the time span of each; the last tile is padded by its floor."""
    tiles = -(-len(mel) // s.tile)
    full = np.full((tiles * s.tile, s.mels), np.float32(np.log(1e-3)), np.float32)
    full[: len(mel)] = mel
    second = s.hop / (s.rate * s.up / s.down)
    starts = np.arange(tiles) * s.tile * second
    ends = np.minimum(np.arange(1, tiles + 1) * s.tile, len(mel)) * second
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(tiles, s.tile, s.mels))
    batch = pa.record_batch([pa.array(starts), pa.array(ends), column], names=["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _store(s: AudioSetting):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in text_slices(batch):
                texts = [(t or "").encode() for t in cut.column("text").to_pylist()]
                media = [to_wav(t + bytes([PAD]) * (max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t)), s.rate) for t in texts]
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return run


def features_of(media: bytes, s: AudioSetting, taps: np.ndarray, window: np.ndarray, filters: np.ndarray) -> dict:
    payload, rate = from_wav(media)
    mel = np.round(log_mel(np.frombuffer(payload, np.uint8), s, taps, window, filters), 3)
    found, second = segments(mel.mean(axis=1), s.high, s.low), s.hop / (rate * s.up / s.down)
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(), "n_frames": len(mel), "spans": [{"start_s": a * second, "end_s": b * second} for a, b in found], "tensors": tensor_stream(mel, s),
    }


FEATURE_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64())]
    + [("media_sha256", pa.string()), ("n_frames", pa.int32()), ("spans", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("tensors", pa.binary())]
)


def _features(s: AudioSetting):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taps, filters, window = s.taps(), s.filters(), np.hanning(s.frame).astype(np.float32)
        for batch in batches:
            for cut in text_slices(batch, "media"):
                rows = [
                    {"doc_id": d, "n_bytes": n} | features_of(m.as_py(), s, taps, window, filters)
                    for d, n, m in zip(cut.column("doc_id").to_pylist(), cut.column("n_bytes").to_pylist(), cut.column("media"))
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=FEATURE_SCHEMA)

    return run


def store_media(docs: DataFrame, setting: AudioSetting = AudioSetting()) -> Stored:
    """Write every text as a WAV file (binary column) in the shared folder."""
    small_batches(docs.sparkSession)
    return Stored(plain(docs, ("doc_id", "text")).mapInArrow(_store(setting), MEDIA), "media")


def audio_features(media: DataFrame, setting: AudioSetting = AudioSetting()) -> DataFrame:
    """One row for each row of ``media`` (doc_id, n_bytes, media)."""
    small_batches(media.sparkSession)
    return plain(media, ("doc_id", "n_bytes", "media")).mapInArrow(_features(setting), FEATURES)


def feature() -> Column:
    """A short name of a row of features: frames, segments, their seconds, and a digest of the tensors and spans."""
    seconds = F.aggregate("spans", F.lit(0.0), lambda n, x: n + x["end_s"] - x["start_s"])
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", F.format_number(x["start_s"], 3), F.format_number(x["end_s"], 3))), " ")
    return F.concat_ws(":", F.col("n_frames").cast("string"), F.size("spans").cast("string"), F.format_number(seconds, 3), F.md5(F.concat(F.col("tensors"), F.encode(spans, "UTF-8"))))


def store_features(media: DataFrame, setting: AudioSetting = AudioSetting()) -> Stored:
    """The features of all media, tensors and spans among them, written in the shared folder."""
    return Stored(audio_features(media, setting), "audio-features")
