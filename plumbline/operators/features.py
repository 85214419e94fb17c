"""Feature extraction over binary recordings, in Arrow batches; one decode for each clip, one batch out for each in."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.dsp import PERTURBATIONS, RATE, decode_wav, lag_of, read_wav, snr_db, trim
from plumbline.functions.headers import wav_facts
from plumbline.functions.signal import Clip, deployed, safe, safe_all, segment
from plumbline.operators.fusion import gate_reasons

#: Clips are read from Arrow batches in slices of so many, so that results of few are held at once.
SLICE = 256
#: Samples of clips that are measured together, one clip at least.
TOGETHER = 1 << 20


def dealt(clips: DataFrame, key: str = "path", seed: int = 42, times: int = 1) -> DataFrame:
    """`clips` dealt to tasks by their keys' hash, another way for another seed; times: as often is each among them.

    A file of few row groups is read by as few tasks, however large it is; what is done with a clip takes far longer
    than to move it. Their number is set, so that Spark does not merge tasks down to about one for each core, of
    which some would be dealt a second one while the others wait.
    """
    spark = clips.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return clips.repartition(n * times, F.xxhash64(F.lit(seed), key))


def _column(values: list | tuple, kind: pa.DataType) -> pa.Array:
    """Values as Arrow; dicts by their keys and values in line, which takes a twentieth of the time of pairs."""
    if not pa.types.is_map(kind):
        return pa.array(values, kind)
    ends = np.cumsum([0, *map(len, values)])
    keys, items = [k for d in values for k in d], [v for d in values for v in d.values()]
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, kind.key_type), pa.array(items, kind.item_type))


def _each(clips: DataFrame, key: str, content: str, made: str, rows: Callable[[list[bytes | None]], Iterable[list[tuple]]]) -> DataFrame:
    """`rows` of clips in a list, a list of rows for each, beside their keys; made: their columns."""
    kind = clips.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                done = list(rows(b.column(1).to_pylist()))
                place = np.repeat(np.arange(b.num_rows), [len(d) for d in done])
                columns = list(zip(*[r for d in done for r in d])) or [[]] * len(wanted)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place)), *[_column(c, f.type) for c, f in zip(columns, wanted)]], names=["key", *wanted.names])

    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(clips.sparkSession.createDataFrame([], made).schema)
    return clips.select(key, content).mapInArrow(run, f"key {kind}, {made}").withColumnRenamed("key", key)


def _decoded(contents: list[bytes | None], decode: Callable = decode_wav) -> Iterator[list[np.ndarray | None]]:
    """Samples of each content in groups of at most TOGETHER samples, or of one clip."""
    group, size = [], 0
    for data in contents:
        x = decode(data)
        n = 0 if x is None else len(x)
        if group and size + n > TOGETHER:
            yield group
            group, size = [], 0
        group.append(x)
        size += n
    if group:
        yield group


def features(clips: DataFrame, families: list[str], key: str = "path", content: str = "content", empty: bool = False) -> DataFrame:
    """(key, family, features map, status): broken clips have a status and no features.

    empty: a recording of no samples is silence; else it is broken.
    """

    def rows(contents):
        for group in _decoded(contents, read_wav if empty else decode_wav):
            some = [None if x is None else Clip(x) for x in group]
            gates = safe_all(some, "gate") if "gate" in families else [None] * len(some)
            for i, gate in enumerate(gates):
                clip, some[i] = some[i], None  # what families share is held for one clip
                yield [(f, d, s) for f in families for d, s in [gate if f == "gate" else safe(clip, f)]]

    return _each(clips, key, content, "family string, features map<string,double>, status string", rows)


def decode_stats(clips: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, n_samples, peak, lead_s, trimmed_s, clipped, status) of WAV recordings."""

    def rows(data):
        x = decode_wav(data)
        if x is None:
            return [(None, None, None, None, None, "decode_error")]
        loud = np.flatnonzero(np.abs(x) > 0.01)
        return [(len(x), float(np.abs(x).max()), float(loud[0] / RATE) if len(loud) else None, len(trim(x)) / RATE, int((np.abs(x) >= 0.999).sum()), "ok")]

    return _each(clips, key, content, "n_samples long, peak double, lead_s double, trimmed_s double, clipped long, status string", lambda contents: map(rows, contents))


def header_probe(clips: DataFrame, key: str = "path", content: str = "content", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, format, channels, rate, bits, frames, seconds, error) from headers alone; also: columns to keep."""
    return wav_facts(clips.select(key, *also, content), content)


def speech_gate(clips: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, status, reasons): why a clip is not speech, measured on its audio; a clip that cannot be read has none."""
    d = features(clips, ["gate"], key, content)
    f = lambda name: F.try_element_at("features", F.lit(name))
    reasons = gate_reasons(f("level_db"), f("flatness"), f("voiced"), f("energy_std"), f("pitch_std"))
    return d.select(key, "status", F.when(F.col("status") == "ok", reasons).otherwise(F.array().cast("array<string>")).alias("reasons"))


def prepared(clips: DataFrame, seconds: float = 8.0, seed: int | None = None, key: str = "path", content: str = "content") -> DataFrame:
    """(key, samples, segment_s, deployed_std): clips as models take them, band-limited, trimmed and cut."""

    def rows(data):
        x = decode_wav(data)
        if x is None:
            return [(None, None, None)]
        y = segment(x, seconds, seed)
        return [(y.astype(np.float32).tolist(), len(y) / RATE, float(deployed(x, seconds).std()))]

    return _each(clips, key, content, "samples array<float>, segment_s double, deployed_std double", lambda contents: map(rows, contents))


def perturbed(clips: DataFrame, family: str, kinds: list[str], key: str = "path", content: str = "content") -> DataFrame:
    """(key, kind, features, status) of each clip under each perturbation, seeded by place in the list of kinds."""

    def rows(contents):
        for group in _decoded(contents):
            changed = [None if x is None else Clip(PERTURBATIONS[k](x.astype(np.float64), s)) for x in group for s, k in enumerate(kinds)]
            found = iter(safe_all(changed, family))
            for _ in group:
                yield [(k, d, s) for k in kinds for d, s in [next(found)]]

    return _each(clips, key, content, "kind string, features map<string,double>, status string", rows)


def alignment(clips: DataFrame, kinds: list[str], key: str = "path", content: str = "content") -> DataFrame:
    """(key, kind, lag, snr_db) of each perturbed clip against the clip itself; both null for a clip that cannot be read."""

    def rows(data):
        x = decode_wav(data)
        if x is None:
            return [(k, None, None) for k in kinds]
        x = x.astype(np.float64)
        return [(k, lag_of(x, y), snr_db(x, y)) for s, k in enumerate(kinds) for y in [PERTURBATIONS[k](x, s)]]

    return _each(clips, key, content, "kind string, lag int, snr_db double", lambda contents: map(rows, contents))
