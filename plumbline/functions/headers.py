"""WAV headers read by column expressions, without a look at the samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many chunks of a file are looked at for its format and samples.
CHUNKS = 32


def little(data: Column, at: Column, n: int) -> Column:
    """An unsigned number of n bytes, least first, behind `at` bytes; null beyond the end."""
    byte = lambda i: F.conv(F.hex(F.substring(data, (at + i + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    whole = sum((byte(i) * 256**i for i in range(1, n)), byte(0))
    return F.when(at + n <= F.octet_length(data), whole)


def wav_facts(d: DataFrame, content: str) -> DataFrame:
    """`d` without its content, and format, channels, rate, bits, frames and seconds of PCM WAV, or only an error.

    Chunks are walked from one to the next by their sizes; samples are never looked at. The number of frames is what
    the header says, whole frames only. error: null for a recording, else `empty`, `no RIFF`, `no format`, `not PCM` or
    `no samples`. Columns of `d` named like one of these are replaced.
    """
    made = ("format", "channels", "rate", "bits", "frames", "seconds", "error")
    keep = [f"`{c}`" for c in d.columns if c != content and c not in made]
    data = F.col(f"`{content}`")
    name = lambda at: F.decode(F.substring(data, (at + 1).cast("int"), F.lit(4)), "ISO-8859-1")
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(12).cast("long").alias("at"), none.alias("fmt"), none.alias("data"))

    def step(s: Column, _: Column) -> Column:
        here, length = s["at"], little(data, s["at"] + 4, 4)
        on = s["data"].isNull() & (here + 8 <= F.octet_length(data))
        return F.struct(
            F.when(on, here + 8 + F.floor((length + 1) / 2) * 2).otherwise(here).alias("at"),
            F.when(on & s["fmt"].isNull() & (name(here) == "fmt "), here).otherwise(s["fmt"]).alias("fmt"),
            F.when(on & (name(here) == "data"), here).otherwise(s["data"]).alias("data"),
        )

    riff = (F.substring(data, 1, 4) == F.lit(b"RIFF")) & (F.substring(data, 9, 4) == F.lit(b"WAVE"))
    walked = F.when(riff, F.aggregate(F.sequence(F.lit(1), F.lit(CHUNKS)), start, step))
    # Each step is a projection of its own, so that the walk is not made again for each fact.
    d = d.select(*keep, data, F.coalesce(F.octet_length(data), F.lit(0)).alias("_size"), F.coalesce(riff, F.lit(False)).alias("_riff"), walked.alias("_at"))
    at = F.col("_at.fmt") + 8
    numbers = {"_kind": (at, 2), "_channels": (at + 2, 2), "_rate": (at + 4, 4), "_bits": (at + 14, 2), "_bytes": (F.col("_at.data") + 4, 4)}
    d = d.select(*keep, "_size", "_riff", (F.col("_at.fmt") < F.col("_at.data")).alias("_order"), *[little(data, a, n).alias(k) for k, (a, n) in numbers.items()])
    width = F.col("_channels") * F.ceil(F.col("_bits") / 8)
    error = (
        F.when(F.col("_size") == 0, "empty").when(~F.col("_riff"), "no RIFF").when(F.col("_bits").isNull() | ~F.coalesce("_order", F.lit(True)), "no format")
        .when(~F.col("_kind").isin(1, 65534) | (width == 0), "not PCM").when(F.col("_bytes").isNull(), "no samples")
    )
    d = d.withColumns({"error": error, "_frames": F.floor(F.col("_bytes") / F.nullif(width, F.lit(0)))})
    facts = {"format": F.lit("WAV"), "channels": F.col("_channels").cast("int"), "rate": F.col("_rate").cast("int"), "bits": F.col("_bits").cast("int"), "frames": F.col("_frames").cast("long"), "seconds": F.col("_frames") / F.nullif(F.col("_rate"), F.lit(0)).cast("double")}
    return d.select(*keep, *[F.when(F.col("error").isNull(), v).alias(k) for k, v in facts.items()], "error")
