"""Numpy features of one recording at 16 kHz, for Arrow batches. Each returns a flat {name: float}."""

from __future__ import annotations

import io
import wave

import numpy as np

RATE = 16_000


def decode_wav(data: bytes | None) -> np.ndarray | None:
    """PCM WAV as float32, channels averaged; None if it can't be read or is empty; non-finite never occurs."""
    x = read_wav(data)
    return x if x is not None and len(x) else None


def read_wav(data: bytes | None) -> np.ndarray | None:
    """As decode_wav, but a recording of no samples, that ends where they would begin, is read: there are none."""
    try:
        with wave.open(f := io.BytesIO(data or b"")) as w:
            width, channels, raw = w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
            ended = not w.getnframes() and not f.read(1)
    except (wave.Error, EOFError):
        return None
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 2:
        x = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768
    elif width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) - ((b[:, 2] >> 7) << 24)).astype(np.float32) / 8388608
    elif width == 4:
        x = np.frombuffer(raw[: len(raw) // 4 * 4], "<i4").astype(np.float32) / 2147483648
    else:
        return None
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1) if channels else x[:0]
    return x if len(x) or ended else None


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Overlapping frames; a short signal is one zero-padded frame."""
    if len(x) < size:
        x = np.concatenate((x, np.zeros(size - len(x), x.dtype)))
    x = np.ascontiguousarray(x)
    return np.ndarray(((len(x) - size) // hop + 1, size), x.dtype, x, 0, (hop * x.itemsize, x.itemsize))


def windows(x: np.ndarray, size: int, hop: int | None = None) -> np.ndarray:
    """Windows with one flush with the end; a short signal is repeated to one window."""
    hop = hop or size // 2
    if len(x) < size:
        return np.resize(x, size)[None]
    starts = list(range(0, len(x) - size + 1, hop))
    if starts[-1] != len(x) - size:
        starts.append(len(x) - size)
    return np.stack([x[s : s + size] for s in starts])


def spectrum(x: np.ndarray, size: int = 512, hop: int = 160) -> tuple[np.ndarray, np.ndarray]:
    """Power (frames, bins) and the bins' frequencies."""
    f = frames(np.asarray(x, np.float64), size, hop) * np.hanning(size)
    return np.abs(np.fft.rfft(f, axis=1)) ** 2 + 1e-12, np.fft.rfftfreq(size, 1 / RATE)


def trim(x: np.ndarray, top_db: float = 35.0, size: int = RATE // 50, least_s: float = 1.0) -> np.ndarray:
    """The part between the first and last frame within top_db of the loudest; all of it if that leaves too little."""
    n = len(x) // size
    if not n:
        return x
    level = 20 * np.log10(np.sqrt((x[: n * size].reshape(n, size) ** 2).mean(axis=1)) + 1e-12)
    loud = np.flatnonzero(level >= level.max() - top_db)
    kept = x[loud[0] * size : (loud[-1] + 1) * size]
    return kept if len(kept) >= least_s * RATE else x


def band_limit(x: np.ndarray, cutoff: float = 7250.0, width: float = 600.0, ripple_db: float = 45.0) -> np.ndarray:
    """Kaiser-windowed low pass without delay."""
    taps = int(np.ceil((ripple_db - 7.95) / (2.285 * 2 * np.pi * width / RATE))) | 1
    n = np.arange(taps) - taps // 2
    beta = 0.5842 * (ripple_db - 21) ** 0.4 + 0.07886 * (ripple_db - 21)
    h = 2 * cutoff / RATE * np.sinc(2 * cutoff / RATE * n) * np.kaiser(taps, beta)
    return np.convolve(x, h, "same") if len(x) >= taps else np.convolve(x, h)[taps // 2 : taps // 2 + len(x)]


def cosines(n: int, kept: int) -> np.ndarray:
    """The first `kept` rows of the orthonormal cosine transform of n values."""
    basis = np.sqrt(2 / n) * np.cos(np.pi * np.arange(kept)[:, None] * (2 * np.arange(n) + 1) / (2 * n))
    basis[0] /= np.sqrt(2)
    return basis


def moving(v: np.ndarray, name: str) -> dict[str, float]:
    """Mean, deviation and deviation of the change of each column."""
    d = np.diff(v, axis=0) if len(v) > 1 else np.zeros((1, v.shape[1]))
    found = zip(v.mean(axis=0).tolist(), v.std(axis=0).tolist(), d.std(axis=0).tolist())
    return {f"{name}{i}_{n}": x for i, of in enumerate(found) for n, x in zip(("mean", "std", "move"), of)}


#: Filter bank and transform of the cepstra by their settings, made once in a process.
_BANKS: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def cepstra(x: np.ndarray, bands: int = 40, kept: int = 20, top: float = 7000.0, power: np.ndarray | None = None) -> dict[str, float]:
    """Linear-frequency cepstra: mean, deviation and deviation of the change of each; power: the clip's spectrum if known."""
    p = spectrum(x)[0] if power is None else power
    if (bands, kept, top) not in _BANKS:
        f, edge = np.fft.rfftfreq(512, 1 / RATE), np.linspace(0, top, bands + 2)
        bank = np.maximum(0, np.minimum((f[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f[:, None]) / (edge[2:] - edge[1:-1])))
        _BANKS[bands, kept, top] = bank, cosines(bands, kept).T
    bank, basis = _BANKS[bands, kept, top]
    return moving(np.log(p @ bank + 1e-10) @ basis, "lfcc")


def add_noise(x: np.ndarray, snr_db: float, seed: int) -> np.ndarray:
    """White noise at an exact signal-to-noise ratio."""
    n = np.random.default_rng(seed).standard_normal(len(x))
    power = (x * x).mean() / 10 ** (snr_db / 10)
    return x + n * np.sqrt(power / max((n * n).mean(), 1e-12))


def tilt(x: np.ndarray, db_per_khz: float) -> np.ndarray:
    s = np.fft.rfft(x)
    return np.fft.irfft(s * 10 ** (db_per_khz * np.fft.rfftfreq(len(x), 1 / RATE) / 1000 / 20), len(x))


def resample_speed(x: np.ndarray, factor: float) -> np.ndarray:
    at = np.arange(0, len(x) - 1, factor)
    return np.interp(at, np.arange(len(x)), x)


PERTURBATIONS = {"none": lambda x, seed: x, "noise20": lambda x, seed: add_noise(x, 20, seed), "speed": lambda x, seed: resample_speed(x, 1.02), "shift1": lambda x, seed: np.roll(x, 1), "tilt": lambda x, seed: tilt(x, -1.5)}


def lag_of(x: np.ndarray, y: np.ndarray, limit: int = 4000) -> int:
    """By how many samples y is late against x: the largest cross-correlation within the limit; the smallest lag of equals."""
    n = len(x) + len(y)
    if not len(x) or not len(y):
        return 0
    size = 1 << (n - 1).bit_length()
    c = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)
    lags = np.arange(-min(limit, len(x) - 1), min(limit, len(y) - 1) + 1)
    lags = lags[np.argsort(np.abs(lags), kind="stable")]
    return int(lags[np.argmax(np.round(c[lags], 9))])


def snr_db(x: np.ndarray, y: np.ndarray) -> float:
    """Level of x over that of y - x on their common part, in dB between -120 and 120."""
    n = min(len(x), len(y))
    power = lambda v: float(np.mean(np.square(v, dtype=np.float64))) if n else 0.0
    return float(np.clip(10 * np.log10((power(x[:n]) + 1e-30) / (power(y[:n] - x[:n]) + 1e-30)), -120, 120))
