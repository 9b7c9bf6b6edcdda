"""Noise profiles, spectral subtraction and the cleaning chain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from parley.functions import signal as S

FRAME = 512
MAX_FRAMES = 20
DOUBLES = T.ArrayType(T.DoubleType())


def _frames(x: np.ndarray, frame: int) -> np.ndarray:
    """Half-overlapping windowed frames of a signal at least one frame long."""
    return np.lib.stride_tricks.sliding_window_view(x, frame)[:: frame // 2] * np.hanning(frame)


def noise_profile(
    clips: DataFrame, session: str = "session", samples: str = "samples", sr: int = 16000,
    seconds: float = 0.5, frame: int = FRAME,
) -> DataFrame:
    """(session, bin, magnitude): mean magnitude spectrum of the first frames of the calibration clips.

    Each clip gives the sum of its spectra and its number of frames; sums per (session, bin) are
    Spark's, so a session with very many clips combines before the shuffle.  A clip shorter than a
    frame adds nothing; a session of only such clips has a zero profile.
    """
    limit = min(MAX_FRAMES, max(1, int(seconds * sr) // (frame // 2)))

    @F.pandas_udf(DOUBLES)
    def spectra(batch: pd.Series) -> pd.Series:
        out = []
        for s in batch:
            x = np.asarray(s, dtype="float64")
            if len(x) < frame:
                out.append([0.0] * (frame // 2 + 2))
                continue
            f = _frames(x, frame)[:limit]
            out.append([*np.abs(np.fft.rfft(f, axis=1)).sum(axis=0), float(len(f))])
        return pd.Series(out)

    bins = frame // 2 + 1
    one = clips.select(session, spectra(samples).alias("_s"))
    long = one.select(session, F.element_at("_s", bins + 1).alias("_n"), F.posexplode(F.slice("_s", 1, bins)).alias("bin", "_m"))
    return long.groupBy(session, "bin").agg(
        F.when(F.sum("_n") > 0, F.sum("_m") / F.sum("_n")).otherwise(F.lit(0.0)).alias("magnitude")
    )


def profile_arrays(profile: DataFrame, session: str = "session") -> DataFrame:
    """One array per session; its length is the fixed number of bins."""
    pairs = F.array_sort(F.collect_list(F.struct("bin", "magnitude")))
    return profile.groupBy(session).agg(F.transform(pairs, lambda p: p["magnitude"]).alias("profile"))


def subtract(x: np.ndarray, profile: np.ndarray, frame: int = FRAME) -> np.ndarray:
    """Magnitude less the profile, floored at 2 % of it, phase kept, overlap-added."""
    n = (len(x) - frame) // (frame // 2) + 1
    if n < 2 or not profile.any():
        return x
    spec = np.fft.rfft(_frames(x, frame)[:n], axis=1)
    magnitude = np.maximum(np.abs(spec) - profile, np.maximum(profile * 0.02, 1e-10))
    back = np.fft.irfft(magnitude * np.exp(1j * np.angle(spec)), n=frame, axis=1) * np.hanning(frame)
    out = np.zeros(len(x))
    for i, f in enumerate(back):
        at = i * (frame // 2)
        out[at : at + frame] += f
    return out * 2.0


def denoise(clips: DataFrame, profiles: DataFrame, session: str = "session", samples: str = "samples", frame: int = FRAME) -> DataFrame:
    """Subtract the session's noise profile from its clips; sessions without one stay as they are.

    ``profiles`` comes from :func:`profile_arrays`.  The join is left to Spark: broadcast while the
    profile table is under the threshold, a shuffle with runtime skew handling beyond.
    """

    @F.pandas_udf(DOUBLES)
    def run(xs: pd.Series, ps: pd.Series) -> pd.Series:
        return pd.Series([
            x if x is None or p is None
            else subtract(np.asarray(x, dtype="float64"), np.asarray(p, dtype="float64"), frame)
            for x, p in zip(xs, ps)
        ])

    run = run.asNondeterministic()  # else it is put into every expression that uses the samples
    return clips.join(profiles, session, "left").withColumn(samples, run(samples, "profile")).drop("profile")


def clean_audio(
    clips: DataFrame, samples: str = "samples", sr: int = 16000, limit_db: float = -3.0, target_db: float = -20.0,
    gate_db: float = -40.0, top_db: float = 25.0, channels: bool = False, profiles: DataFrame | None = None,
    session: str = "session", frame: int = FRAME,
) -> DataFrame:
    """Mix down, take out noise, limit, normalise, gate and trim clips; ``status`` is ok, no_voice or empty, and no clip stops the job.

    ``channels`` says that the samples are frames of several channels; ``profiles`` (see :func:`profile_arrays`)
    hold the noise of each ``session``.
    """
    if channels:
        clips = clips.withColumn(samples, S.to_mono(F.col(samples)))
    if profiles is not None:
        clips = denoise(clips, profiles, session, samples, frame)
    limited = clips.withColumn(samples, S.peak_limit(F.col(samples), limit_db))
    level = limited.withColumn(samples, S.normalize_loudness(F.col(samples), target_db))
    empty = F.coalesce(F.size(samples), F.lit(0)) <= 0
    status = F.when(empty, "empty").when(S.voice_gate(F.col(samples), gate_db), "ok").otherwise("no_voice")
    gated = level.withColumn("status", status)
    return gated.withColumn(samples, S.trim_silence(F.when(F.col("status") == "ok", F.col(samples)), sr, top_db))


def clean_summary(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
