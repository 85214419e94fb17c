"""Scalar functions of the scoring pipeline as Spark columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Costs and prior of the two conventions: false alarm, miss, prior of the positive class. Fixed values.
BRIEF = (4.0, 1.0, 0.3)
AVERSE = (1.0, 4.0, 0.5)
#: Decision block: pinned top, failure top, weight of jitter. Fixed values.
BLOCK, FAILED, JITTER = 0.001, 0.0001, 0.01
#: Logit clip of learned scores and of stored scores. Fixed values.
CLIP_LEARNED, CLIP_STORED = 1e-6, 1e-4


def jitter(key: Column) -> Column:
    """First eight bytes of SHA-1 as a fraction of 2**64."""
    return F.conv(F.substring(F.sha1(key), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 18446744073709551616.0


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, clip: float = CLIP_LEARNED) -> Column:
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.log(q / (1.0 - q))


def bayes_threshold(c_fa: float, c_miss: float, prior: float) -> float:
    return math.log(c_fa / c_miss) - math.log(prior / (1 - prior))


def posterior(llr: Column, prior: float) -> Column:
    """Posterior from a log likelihood ratio; a missing one leaves the prior."""
    return sigmoid(F.coalesce(llr, F.lit(0.0)) + math.log(prior / (1 - prior)))


def platt(x: Column, a: float, b: float, prior_shift: float = 0.0) -> Column:
    return sigmoid(a * x + b + prior_shift)


def decibels(power: Column, floor: float = 1e-12) -> Column:
    return 10.0 * F.log10(F.greatest(power, F.lit(floor)))


def determinate(p: Column) -> Column:
    """Scores of decided files lie above the pinned block."""
    return BLOCK + (1 - BLOCK) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether a lower-cased text holds any of the terms; null text holds none."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.lower(text).contains(t) for t in terms]), F.lit(False))


def finite(*cols: Column) -> Column:
    """Not null, not NaN and not infinite in every column."""
    return reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in cols])


def row_id(source: Column, path: Column) -> Column:
    return F.concat(source, F.lit("_"), F.substring(F.sha1(path), 1, 12))


def group_key(label: Column, generator: Column, speaker: Column, utt: Column) -> Column:
    """Spoofs by generator; utterances of the one-speaker corpus by chapter; other speech by speaker."""
    return F.when(label == "spoof", F.concat(F.lit("gen:"), generator)).when(speaker == "ljspeech", F.concat(F.lit("lj:"), F.substring(utt, 1, 5))).otherwise(F.concat(F.lit("spk:"), speaker))


def label_normalised(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "-", "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays with a small constant in each norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


#: Names of tools that make speech, and words that say that something was made. Fixed values.
AI_TOOL_TERMS = (
    "elevenlabs", "eleven labs", "play.ht", "playht", "resemble", "descript", "murf", "speechify", "tortoise", "coqui", "xtts", "bark", "suno", "polly", "wellsaid", "lovo",
    "respeecher", "voicebox", "openvoice", "styletts", "tacotron", "fastspeech", "wavegrad", "diffwave", "hifigan", "hifi-gan", "text-to-speech", "text to speech", "tts",
)
SYNTH_TERMS = ("synthetic", "synthesized", "synthesised", "generated", "cloned", "deepfake", "ai voice", "ai-generated")


def first_term(text: Column, terms: tuple[str, ...]) -> Column:
    """The first of the terms that a text holds, in their order; `tts` counts as a whole word only. Null without one."""
    low = F.lower(text)
    hit = lambda t: low.rlike(r"\btts\b") if t == "tts" else low.contains(t)
    return F.coalesce(*[F.when(hit(t), t) for t in terms])


def tag_score(tags: Column) -> tuple[Column, Column]:
    """Score of a recording by the values of its tags, and the term that says so; keys are no evidence. No tags: 0.5."""
    text = F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: e["value"]), " "), F.lit(""))
    tool, made = first_term(text, AI_TOOL_TERMS), first_term(text, SYNTH_TERMS)
    return F.when(tool.isNotNull(), 0.9).when(made.isNotNull(), 0.75).otherwise(0.5), F.coalesce(tool, made)


def sorted_pairs(tags: Column, first: int = 4) -> Column:
    """The first entries of a string map by key as k=v, joined."""
    return F.array_join(F.slice(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), 1, first), "|")


def human_size(n: Column) -> Column:
    """B, KB or MB with one decimal."""
    tenth = lambda x: F.round(x, 1).cast("decimal(12,1)").cast("string")
    large = F.when(n < 1048576, F.concat(tenth(n / 1024.0), F.lit(" KB"))).otherwise(F.concat(tenth(n / 1048576.0), F.lit(" MB")))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(large)


def config_hash(**settings: Column) -> Column:
    """SHA-256 of the settings as JSON with sorted names; missing ones are null."""
    return F.sha2(F.to_json(F.struct(*[settings[k].alias(k) for k in sorted(settings)]), {"ignoreNullFields": "false"}), 256)
