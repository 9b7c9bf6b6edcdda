"""Sound samples as array columns: levels, limits, gates and trimming."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from parley.functions.text import let


def to_mono(frames: Column) -> Column:
    """Mean over the channels of each frame."""
    return F.transform(frames, lambda f: F.aggregate(f, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(f))


def pcm_to_float(samples: Column, limit: float = 1.0) -> Column:
    """Divide 16-bit values by 32768 when any value leaves the float range (``limit`` 1.5 on the live path)."""
    outside = (F.array_max(samples) > limit) | (F.array_min(samples) < -limit)
    return F.transform(samples, lambda x: F.when(outside, x / 32768.0).otherwise(x.cast("double")))


def mean_square(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return total / F.size(samples)


def rms(samples: Column) -> Column:
    """Root mean square, 0 for no samples."""
    return F.when(F.size(samples) > 0, F.sqrt(mean_square(samples))).otherwise(F.lit(0.0))


def decibel(level: Column) -> Column:
    return 20.0 * F.log10(level + F.lit(1e-10))


def rms_db(samples: Column) -> Column:
    return decibel(rms(samples))


def peak(samples: Column) -> Column:
    return F.greatest(F.abs(F.array_max(samples)), F.abs(F.array_min(samples))).cast("double")


def _clip(x: Column, ceiling: Column) -> Column:
    return F.greatest(-ceiling, F.least(ceiling, x))


def peak_limit(samples: Column, limit_db: float = -3.0) -> Column:
    """Clip at ``limit_db`` below full scale; no change for 0 dB and above."""
    doubles = F.transform(samples, lambda x: x.cast("double"))
    if limit_db >= 0:
        return doubles
    ceiling = F.lit(10.0 ** (limit_db / 20.0))
    return F.transform(doubles, lambda x: _clip(x, ceiling))


def normalize_loudness(samples: Column, target_db: float = -20.0) -> Column:
    """Scale to peak 1, then to the target RMS level, and clip to the float range; silence stays as it is."""
    target = 10.0 ** (target_db / 20.0)
    doubles = F.transform(samples, lambda x: x.cast("double"))

    def scale(s: Column) -> Column:
        # level of the peak-normalised signal; dividing by the peak first keeps tiny signals exact
        level = let(peak(s), lambda p: F.struct(
            p.alias("p"), F.sqrt(mean_square(F.transform(s, lambda x: x / p))).alias("rms")))
        return let(level, lambda lv: F.transform(
            s, lambda x: _clip(x / lv["p"] * (F.lit(target) / lv["rms"]), F.lit(1.0))))

    return let(doubles, lambda s: F.when(F.coalesce(peak(s), F.lit(0.0)) > 0, scale(s)).otherwise(s))


def voice_gate(samples: Column, threshold_db: float = -40.0) -> Column:
    """True when the RMS level is above the threshold; no samples are no voice."""
    return (F.size(samples) > 0) & (rms_db(samples) > threshold_db)


def voiced_fraction(samples: Column, sr: Column, frame_ms: int = 30, is_voiced: Callable[[Column], Column] = voice_gate) -> Column:
    """Share of whole frames that are voiced; null when the signal is shorter than a frame."""
    width = (sr * frame_ms / 1000).cast("int")
    frames = F.floor(F.size(samples) / width).cast("int")
    flags = F.transform(
        F.sequence(F.lit(0), frames - 1),
        lambda i: is_voiced(F.slice(samples, i * width + 1, width)).cast("int"),
    )
    return F.when(frames > 0, F.aggregate(flags, F.lit(0), lambda s, x: s + x) / frames)


def trim_bounds(x: np.ndarray, sr: int, top_db: float) -> tuple[int, int]:
    """First and last (exclusive) sample whose mean energy reaches the threshold."""
    win = min(int(0.02 * sr), max(1, len(x) // 4))
    sums = np.concatenate([[0.0], np.cumsum(x * x)])
    at = np.arange(len(x)) - win // 2
    energy = (sums[np.minimum(at + win, len(x))] - sums[np.maximum(at, 0)]) / win
    loud = np.flatnonzero(energy >= energy.max() * 10 ** (-top_db / 10))
    return int(loud[0]), int(loud[-1]) + 1


def trim_silence(samples: Column, sr: int, top_db: float = 25.0) -> Column:
    """Cut the quiet ends: keep from the first to the last sample whose mean energy reaches the threshold.

    The energy is the mean of squares in a window of 20 ms (a quarter of the signal when that is
    shorter), centred on the sample, with zeros beyond the ends.  A running sum gives every window
    by a difference; array functions have none, so this step runs on Arrow batches.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def trim(batch: pd.Series) -> pd.Series:
        out = []
        for s in batch:
            if s is None or len(s) == 0:
                out.append(s)
                continue
            x = np.asarray(s, dtype="float64")
            first, end = trim_bounds(x, sr, top_db)
            out.append(x[first:end])
        return pd.Series(out)

    return trim(samples)


def segment_slice(samples: Column, sr: Column, start: Column, end: Column, min_seconds: float = 0.05, min_samples: int = 256) -> Column:
    """Samples between two times; null when the segment is too short to be worth a call."""
    i0 = F.greatest((start * sr).cast("int"), F.lit(0))
    i1 = F.least((end * sr).cast("int"), F.size(samples))
    n = i1 - i0
    long_enough = (end - start >= min_seconds) & (n >= min_samples)
    return F.when(long_enough, F.slice(samples, i0 + 1, F.greatest(n, F.lit(0))))
