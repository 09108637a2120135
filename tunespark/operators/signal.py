"""Measures of decoded signals (arrays of samples): excerpts, loudness, onsets, pulse."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunespark.operators.vectors import TunesparkError
from tunespark.vocab import PULSE_MIN, TEMPO_LIMITS

SILENCE = 1e-5


def excerpt_starts(n: Column | str, window: int, most: int) -> Column:
    """Where excerpts start: 0 for a short clip, the middle if one fits, else evenly spread with half-even rounding."""
    if window < 1 or most < 1:
        raise TunesparkError("window and most must be positive")
    n = F.col(n) if isinstance(n, str) else n
    count = F.least(F.lit(most), F.floor(n / window)).cast("int")
    span = n - window
    spread = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.bround(i * span / (count - 1), 0).cast("bigint"))
    middle = F.array(F.floor(span / 2).cast("bigint"))
    return F.when(n <= window, F.array(F.lit(0).cast("bigint"))).when(count <= 1, middle).otherwise(spread)


def repeat_pad(samples: Column | str, window: int) -> Column:
    """A signal repeated until it fills one window, and cut to it."""
    samples = F.col(samples) if isinstance(samples, str) else samples
    times = F.ceil(F.lit(window) / F.greatest(F.size(samples), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(samples, times)), 1, window)


def extract_excerpts(signals: DataFrame, window: int, most: int) -> DataFrame:
    """(track_id, excerpt, start, samples) of each window; a short clip is repeated into one."""
    starts = signals.select("track_id", "samples", F.posexplode(excerpt_starts(F.size("samples"), window, most)).alias("excerpt", "start"))
    cut = F.slice("samples", (F.col("start") + 1).cast("int"), F.lit(window))
    return starts.select("track_id", "excerpt", "start", F.when(F.size("samples") < window, repeat_pad("samples", window)).otherwise(cut).alias("samples"))


def mono_and_gate(signals: DataFrame) -> DataFrame:
    """(track_id, channels array<array>) -> (track_id, samples, reason): the mean of the channels, and why it is refused, or null."""
    n = F.size("channels")
    total = F.aggregate(F.slice("channels", 2, F.greatest(n - 1, F.lit(0))), F.transform(F.col("channels")[0], lambda x: x.cast("double")), lambda s, c: F.zip_with(s, c, lambda a, b: a + b))
    mono = signals.select("track_id", F.when(n > 0, F.transform(total, lambda x: (x / n).cast("float"))).alias("samples"))
    bad = F.exists("samples", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(F.coalesce(F.size("samples"), F.lit(0)) < 1, "empty").when(bad, "non-finite").when(F.array_max(F.transform("samples", F.abs)) < SILENCE, "silent")
    return mono.withColumn("reason", reason)


def loudness_dbfs(samples: Column | str) -> Column:
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.round(20 * F.log10(F.greatest(F.sqrt(square / F.size(samples)), F.lit(1e-10))), 2)


def onset_rate(onsets: Column | str, n_samples: Column | str, sample_rate: int) -> Column:
    n = F.col(n_samples) if isinstance(n_samples, str) else n_samples
    return F.round(F.size(onsets) / (n / sample_rate), 3)


def _clarity(envelope: np.ndarray, per_second: float) -> float:
    x = np.asarray(envelope, np.float64)
    low, high = int(per_second * 60 / TEMPO_LIMITS[1]), int(per_second * 60 / TEMPO_LIMITS[0])
    if len(x) <= low + 1:
        return 0.0
    x = x - x.mean()
    power = float(x @ x)
    if power == 0:
        return 0.0
    lags = range(max(1, low), min(high, len(x) - 1) + 1)
    return max((float(x[:-lag] @ x[lag:]) / power for lag in lags), default=0.0)


@F.pandas_udf(T.DoubleType())
def pulse_clarity(envelope: pd.Series, frames_per_second: pd.Series) -> pd.Series:
    """Peak of the normalised autocorrelation of an onset envelope at lags of 30 to 300 beats a minute; 0 if flat or too short.

    Not rounded: gated_bpm() compares the value as it is; round it to 4 places where it is stored.
    """
    return pd.Series([_clarity(e, f) if e is not None else 0.0 for e, f in zip(envelope, frames_per_second, strict=True)])


def gated_bpm(bpm: Column | str, clarity: Column | str) -> Column:
    """A tempo, to one decimal, only where the pulse is clear."""
    clarity = F.col(clarity) if isinstance(clarity, str) else clarity
    return F.when(clarity >= PULSE_MIN, F.round(bpm, 1))
