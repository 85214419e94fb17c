"""Media columns: bytes as 8-bit audio, and features of what is read back.

A payload is stored as a mono WAV file of unsigned 8-bit samples at 16 kHz. Features: polyphase resampling to 12 kHz
(three output phases for four input samples, Kaiser-windowed sinc), log-mel energies of half-overlapping Hann frames,
and active segments by two energy thresholds with hysteresis. Log-mel frames are cut into tensors of one fixed shape,
each with its time span, and stored as an Arrow stream of the fixed-shape tensor type; `feature` is made of what is
read back from it.

Everything is computed row by row, so that a value depends on its own bytes only. Samples stay bytes and are
resampled and filtered in blocks of frames; the stored file and the tensors are the only things held whole, about
three bytes in all for a byte of text.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from plumbline.llm.rows import with_computed

RATE, UNIT = 16_000, 192
UP, DOWN, HALF = 3, 4, 10
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, MELS, STEPS = 256, 128, 20, 64
BLOCK = 4096
FLOOR_DB = -100.0
#: Decibels above the median frame at which a segment starts, and to which it lasts.
RISE, HOLD = 1.5, 0.5


def padded(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of UNIT."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def to_wav(payload: bytes) -> bytes:
    head = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(head) + len(payload)) + head + payload


def from_wav(media: bytes) -> bytes:
    """Sample bytes of a file that to_wav made."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    size = struct.unpack_from("<I", media, at + 4)[0]
    return media[at + 8 : at + 8 + size]


def _phases() -> np.ndarray:
    """A column of filter taps for each output phase, over input samples from HALF before to HALF + DOWN after."""
    tap = np.arange(-HALF, HALF + DOWN)[:, None] - np.arange(UP) * DOWN / UP
    cut = 0.46 * UP / DOWN
    window = np.i0(8.0 * np.sqrt(np.maximum(0, 1 - (tap / (HALF + 1)) ** 2))) / np.i0(8.0) * (np.abs(tap) <= HALF + 1)
    h = 2 * cut * np.sinc(2 * cut * tap) * window
    return h / h.sum(axis=0)


def _filters() -> np.ndarray:
    """Triangular mel filters over the bins of a frame's spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(mel(60), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / OUT_RATE)[:, None]
    low, mid, high = edge[:-2], edge[1:-1], edge[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))


PHASES, FILTERS = _phases(), _filters()
HANN = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)


def resampled(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """Samples first:last at OUT_RATE of 8-bit samples `x`, silence around them; first is a multiple of UP."""
    a, b = first // UP, -(-last // UP)
    low, high = a * DOWN - HALF, (b - 1) * DOWN + HALF + DOWN
    part = (x[max(low, 0) : max(high, 0)] - 128.0) / 128.0
    part = np.concatenate((np.zeros(max(-low, 0)), part, np.zeros(max(0, high - max(low, 0) - len(part)))))
    rows = np.lib.stride_tricks.sliding_window_view(part, len(PHASES))[::DOWN]
    return (rows @ PHASES).ravel()[: last - first]


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Decibels (frames, MELS) as float32; the last frame is filled with silence."""
    total = -(-len(samples) * UP // DOWN)
    frames = max(1, -(-(total - FRAME) // HOP) + 1)
    out = np.empty((frames, MELS), np.float32)
    for f in range(0, frames, BLOCK):
        g = min(f + BLOCK, frames)
        first = f * HOP - f * HOP % UP
        y = resampled(samples, first, (g - 1) * HOP + FRAME)[f * HOP - first :]
        rows = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * HANN
        spectrum = np.fft.rfft(rows, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2) @ FILTERS
        out[f:g] = 10 * np.log10(np.maximum(power, 1e-10))
    return out


def active(mel: np.ndarray) -> list[tuple[int, int]]:
    """[first, last) frame ranges: from a frame RISE dB above the median loudness until one below HOLD dB above it."""
    loud = mel.mean(axis=1)
    loud = loud - np.median(loud)
    turn = np.where(loud >= RISE, 1, np.where(loud < HOLD, 0, -1))
    last = np.maximum.accumulate(np.where(turn >= 0, np.arange(len(turn)), -1))
    on = np.concatenate(([False], np.where(last >= 0, turn[last], 0) == 1, [False]))
    edge = np.flatnonzero(on[1:] != on[:-1]).tolist()
    return list(zip(edge[::2], edge[1::2]))


def tensors(mel: np.ndarray) -> np.ndarray:
    """(n, STEPS, MELS) float32; the last one is filled with FLOOR_DB."""
    n = -(-len(mel) // STEPS)
    out = np.full((n * STEPS, MELS), FLOOR_DB, np.float32)
    out[: len(mel)] = mel
    return out.reshape(n, STEPS, MELS)


def milliseconds(frame: int) -> int:
    return frame * HOP * 1000 // OUT_RATE


def to_arrow(values: np.ndarray, frames: int) -> bytes:
    """An Arrow stream: fixed-shape tensors with the time span of each."""
    kind = pa.fixed_shape_tensor(pa.float32(), values.shape[1:])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), int(np.prod(values.shape[1:])))
    start = [milliseconds(i * STEPS) for i in range(len(values))]
    end = [milliseconds(min((i + 1) * STEPS, frames)) for i in range(len(values))]
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, flat), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["log_mel", "start_ms", "end_ms"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def from_arrow(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def read_back(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames of a stream of to_arrow, (tensors, STEPS, MELS), and the time span of each tensor."""
    table = from_arrow(stream).combine_chunks()
    column = table["log_mel"].chunk(0)
    return column.to_numpy_ndarray(), np.stack([table[c].to_numpy() for c in ("start_ms", "end_ms")], axis=1)


def digest(stream: bytes, segments: list[tuple[int, int]]) -> str:
    """Shape of the tensors, number of active segments and a hash of tensors (tenths of a decibel), spans and segments."""
    values, spans = read_back(stream)
    h = hashlib.sha256(np.rint(values * 10).astype("<i2").tobytes())
    h.update(spans.astype("<i8").tobytes() + np.array(segments, "<i8").tobytes())
    return f"{'x'.join(map(str, values.shape))};{len(segments)};{h.hexdigest()[:32]}"


DIGESTS = [StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType())]
SEGMENTS = ArrayType(StructType([StructField("start_ms", LongType()), StructField("end_ms", LongType())]))
TIMED = [StructField("tensor_bytes", LongType()), StructField("tensor_sha256", StringType()), StructField("segments", SEGMENTS)]
STORED = [StructField("media", BinaryType()), StructField("log_mel", BinaryType())]


def described(text: bytes) -> dict[str, object]:
    media = to_wav(padded(text))
    payload = from_wav(media)
    mel = log_mel(np.frombuffer(payload, np.uint8))
    stream = to_arrow(tensors(mel), len(mel))
    segments = [(milliseconds(a), milliseconds(b)) for a, b in active(mel)]
    return {
        "n_bytes": len(text), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": digest(stream, segments),
        "tensor_bytes": len(stream), "tensor_sha256": hashlib.sha256(stream).hexdigest(), "segments": [{"start_ms": a, "end_ms": b} for a, b in segments],
        "media": media, "log_mel": stream,
    }


def media_columns(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, stored: bool = True) -> DataFrame:
    """Columns `keep` of `docs` (None: all) plus digests of the payload, the stored file and its features, segments
    (active time spans) and, if `stored`, media (the WAV file) and log_mel (an Arrow stream of tensors and spans).

    Null and empty texts are one unit of spaces. Equal texts have equal values. No rows give no rows. Columns of
    `docs` named like an output column are replaced.
    """
    made = DIGESTS + TIMED + (STORED if stored else [])

    def start():
        def compute(texts: list[bytes]) -> dict[str, object]:
            rows: dict[str, list] = {f.name: [] for f in made}
            for t in texts:
                one = described(t)
                for name, column in rows.items():
                    column.append(one[name])
            return rows

        return compute

    return with_computed(docs, text_col, StructType(made), start, keep)


def op8(docs: DataFrame) -> DataFrame:
    """Contract columns of the media query, the size and hash of the stored tensors, and active segments.

    Files and tensors are made, stored in memory, read back and given up row by row; media_columns keeps them.
    """
    return media_columns(docs.select("doc_id", "text"), keep=["doc_id"], stored=False)
