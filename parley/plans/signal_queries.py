"""Sound arrays: the 64 numbers of an embedding stand for samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import signal as S
from parley.operators import audio
from parley.plans.base import query, rounded, table
from parley.session import work_dir
from parley.streaming import live

SR = 400
FRAME = 16

X = "x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS s FROM embeddings)"


def _clips(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("samples"))


def _digest(df, name="samples"):
    """Length, sum of magnitudes and weighted sum: enough to tell two arrays apart."""
    s = F.transform(name, lambda v: v.cast("double"))
    place = F.transform(s, lambda v, i: v * (i + 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    return df.select("vec_id", *[c for c in df.columns if c in ("status",)], F.size(name).cast("long").alias("n"),
                     F.round(total(F.transform(s, F.abs)), 4).alias("size"), F.round(total(place), 4).alias("weighted"))


def digest_sql(s: str, src: str, extra: str = "") -> str:
    return f"""SELECT vec_id, {extra} CAST(len({s}) AS BIGINT) AS n, round(COALESCE(list_sum(list_transform({s}, lambda v: abs(v))), 0), 4) AS size,
        round(COALESCE(list_sum(list_transform({s}, lambda v, i: v * i)), 0), 4) AS weighted FROM {src}"""


@query("rms", f"WITH {X} SELECT vec_id, round(sqrt(list_sum(list_transform(s, lambda v: v * v)) / len(s)), 6) AS rms, round(20 * log10(sqrt(list_sum(list_transform(s, lambda v: v * v)) / len(s)) + 1e-10), 6) AS db FROM x")
def _(spark, d):
    s = F.col("samples")
    return rounded(_clips(spark, d).select("vec_id", S.rms(s).alias("rms"), S.rms_db(s).alias("db")))


@query("to_mono", f"WITH {X}, m AS (SELECT vec_id, list_transform(range(1, 33), lambda i: (s[i] + s[i + 32]) / 2) AS m FROM x) {digest_sql('m', 'm')}")
def _(spark, d):
    # two channels: the first and the second half of the array
    frames = F.arrays_zip(F.slice("samples", 1, 32).alias("l"), F.slice("samples", 33, 32).alias("r"))
    stereo = F.transform(frames, lambda z: F.array(z["l"], z["r"]))
    return _digest(_clips(spark, d).withColumn("frames", stereo).withColumn("samples", S.to_mono(F.col("frames"))))


@query("pcm_to_float", f"WITH {X}, m AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_transform(s, lambda v: v * 30000 / 32768) ELSE s END AS m FROM x) {digest_sql('m', 'm')}")
def _(spark, d):
    c = _clips(spark, d)
    pcm = F.when(F.col("vec_id") % 2 == 0, F.transform("samples", lambda v: v.cast("double") * 30000)).otherwise(F.transform("samples", lambda v: v.cast("double")))
    return _digest(c.withColumn("samples", S.pcm_to_float(pcm)))


CEILING = "pow(10, -15 / CAST(20 AS DOUBLE))"
LIMITED = f"lim AS (SELECT vec_id, label, list_transform(s, lambda v: greatest(-{CEILING}, least({CEILING}, v))) AS s FROM x)"


@query("peak_limit", f"WITH {X}, {LIMITED} {digest_sql('s', 'lim')}")
def _(spark, d):
    return _digest(_clips(spark, d).withColumn("samples", S.peak_limit(F.col("samples"), -15.0)))


def loud_sql(src: str, name: str) -> str:
    """Peak 1, then RMS -20 dB, clipped."""
    return f"""{name}p AS (SELECT *, list_max(list_transform(s, lambda v: abs(v))) AS p FROM {src}),
    {name}r AS (SELECT *, sqrt(list_sum(list_transform(s, lambda v: (v / p) * (v / p))) / len(s)) AS r FROM {name}p),
    {name} AS (SELECT vec_id, label, list_transform(s, lambda v: greatest(-1, least(1, v / p * (0.1 / r)))) AS s FROM {name}r)"""


@query("normalize_loudness", f"WITH {X}, {loud_sql('x', 'loud')} {digest_sql('s', 'loud')}")
def _(spark, d):
    return _digest(_clips(spark, d).withColumn("samples", S.normalize_loudness(F.col("samples"))))


@query("voice_gate", f"""WITH {X}, f AS (SELECT vec_id, list_transform(range(0, 5), lambda i: CASE WHEN 20 * log10(sqrt(list_sum(list_transform(s[i * 12 + 1:i * 12 + 12], lambda v: v * v)) / 12) + 1e-10) > -18 THEN 1 ELSE 0 END) AS f, s FROM x)
    SELECT vec_id, 20 * log10(sqrt(list_sum(list_transform(s, lambda v: v * v)) / len(s)) + 1e-10) > -18 AS voice, round(list_sum(f) / CAST(5 AS DOUBLE), 6) AS voiced, list_sum(f) / CAST(5 AS DOUBLE) >= 0.3 AS speech FROM f""")
def _(spark, d):
    gate = lambda s: S.voice_gate(s, -18.0)
    share = S.voiced_fraction(F.col("samples"), F.lit(SR), is_voiced=gate)
    return rounded(_clips(spark, d).select("vec_id", gate(F.col("samples")).alias("voice"), share.alias("voiced"), (share >= 0.3).alias("speech")))


def trim_sql(src: str, name: str, db: float) -> str:
    """Window of 8 samples around each sample: four before, itself and three after."""
    return f"""{name}e AS (SELECT *, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[greatest(i - 4, 1):least(i + 3, len(s))], lambda v: v * v)) / 8) AS e FROM {src}),
    {name}l AS (SELECT *, list_filter(range(1, len(s) + 1), lambda i: e[i] >= list_max(e) * pow(10, {-db} / CAST(10 AS DOUBLE))) AS l FROM {name}e),
    {name} AS (SELECT * EXCLUDE (s, e, l), s[l[1]:l[-1]] AS s FROM {name}l)"""


@query("trim_silence", f"WITH {X}, {trim_sql('x', 'cut', 3)} {digest_sql('s', 'cut')}")
def _(spark, d):
    return _digest(_clips(spark, d).withColumn("samples", S.trim_silence(F.col("samples"), SR, 3.0)))


@query("segment_slice", f"WITH {X}, c AS (SELECT vec_id, s[vec_id % 10 + 1:vec_id % 10 + 30] AS s FROM x WHERE vec_id % 3 <> 0) {digest_sql('s', 'c')}")
def _(spark, d):
    # a hundred samples a second; every third segment is too short and gives nothing
    start = (F.col("vec_id") % 10 + 0.5) / 100
    seconds = F.when(F.col("vec_id") % 3 == 0, 0.04).otherwise(0.30)
    cut = S.segment_slice(F.col("samples"), F.lit(100), start, start + seconds, min_samples=4)
    return _digest(_clips(spark, d).withColumn("samples", cut).filter(F.col("samples").isNotNull()))


WINDOW = f"(0.5 - 0.5 * cos(2 * pi() * (j - 1) / {FRAME - 1}))"
SPECTRA = f"""fr AS (SELECT vec_id, label, f, list_transform(s[f * 8 + 1:f * 8 + {FRAME}], lambda v, j: v * {WINDOW}) AS w FROM (SELECT *, unnest(range(0, 7)) AS f FROM x)),
    sp AS (SELECT vec_id, label, f, bin, sqrt(pow(list_sum(list_transform(w, lambda v, j: v * cos(2 * pi() * bin * (j - 1) / {FRAME}))), 2)
        + pow(list_sum(list_transform(w, lambda v, j: v * sin(2 * pi() * bin * (j - 1) / {FRAME}))), 2)) AS m FROM (SELECT *, unnest(range(0, 9)) AS bin FROM fr))"""


@query("noise_profile", f"WITH {X}, {SPECTRA} SELECT CAST(label AS BIGINT) AS label, bin, round(avg(m), 6) AS magnitude FROM sp GROUP BY 1, 2")
def _(spark, d):
    return rounded(audio.noise_profile(_clips(spark, d), "label", frame=FRAME))


def _profiles(spark, d):
    quiet = _clips(spark, d).withColumn("samples", F.transform("samples", lambda v: v * F.lit(0.2)))
    return audio.profile_arrays(audio.noise_profile(quiet, "label", frame=FRAME), "label")


def denoise_sql(src: str, name: str) -> str:
    """Discrete Fourier transform, subtraction of a fifth of the mean magnitudes of ``sp``, inverse and overlap-add."""
    turn = f"2 * pi() * bin * (j - 1) / {FRAME}"
    return f"""{name}p AS (SELECT label, bin, 0.2 * avg(m) AS p FROM sp GROUP BY 1, 2),
    {name}f AS (SELECT vec_id, label, f, list_transform(s[f * 8 + 1:f * 8 + {FRAME}], lambda v, j: v * {WINDOW}) AS w FROM (SELECT *, unnest(range(0, 7)) AS f FROM {src})),
    {name}c AS (SELECT vec_id, label, f, bin, list_sum(list_transform(w, lambda v, j: v * cos({turn}))) AS re, -list_sum(list_transform(w, lambda v, j: v * sin({turn}))) AS im
        FROM (SELECT *, unnest(range(0, 9)) AS bin FROM {name}f)),
    {name}g AS (SELECT vec_id, label, f, bin, re, im, greatest(sqrt(re * re + im * im) - p, greatest(p * 0.02, 1e-10)) / sqrt(re * re + im * im) AS g FROM {name}c JOIN {name}p USING (label, bin)),
    {name}t AS (SELECT vec_id, label, f * 8 + j AS i, sum(CASE WHEN bin IN (0, {FRAME // 2}) THEN 1 ELSE 2 END * g * (re * cos({turn}) - im * sin({turn}))) / {FRAME} * any_value({WINDOW}) AS v
        FROM {name}g, range(1, {FRAME + 1}) r(j) GROUP BY vec_id, label, f, j),
    {name} AS (SELECT vec_id, any_value(label) AS label, list(v ORDER BY i) AS s FROM (SELECT vec_id, label, i, 2 * sum(v) AS v FROM {name}t GROUP BY ALL) GROUP BY vec_id)"""


DENOISED = f"WITH {X}, {SPECTRA}, {denoise_sql('x', 'den')} {digest_sql('s', 'den')}"


@query("denoise", DENOISED)
def _(spark, d):
    return _digest(audio.denoise(_clips(spark, d), _profiles(spark, d), "label", frame=FRAME))


CLEAN = f"""lim AS (SELECT vec_id, label, list_transform(CASE WHEN vec_id % 4 = 0 THEN [] WHEN vec_id % 4 = 1 THEN list_transform(s, lambda v: v * 0) ELSE s END, lambda v: greatest(-{CEILING}, least({CEILING}, v))) AS s FROM x)"""


@query("clean_audio", f"""WITH {X}, {CLEAN}, full_ AS (SELECT * FROM lim WHERE vec_id % 4 > 1), {loud_sql('full_', 'loud')}, {trim_sql('loud', 'cut', 3)}
    SELECT 'ok' AS status, * FROM ({digest_sql('s', 'cut')}) UNION ALL SELECT CASE WHEN vec_id % 4 = 0 THEN 'empty' ELSE 'no_voice' END, vec_id, 0, 0, 0 FROM lim WHERE vec_id % 4 < 2""")
def _(spark, d):
    k = F.col("vec_id") % 4
    planted = F.when(k == 0, F.array().cast("array<float>")).when(k == 1, F.transform("samples", lambda v: F.lit(0.0).cast("float"))).otherwise(F.col("samples"))
    out = audio.clean_audio(_clips(spark, d).withColumn("samples", planted), sr=SR, limit_db=-15.0, top_db=3.0)
    return _digest(out.withColumn("samples", F.coalesce("samples", F.array().cast("array<double>"))))


@query("clean_summary", "SELECT CASE WHEN vec_id % 4 = 1 THEN 'no_voice' ELSE 'ok' END AS status, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, d):
    silent = F.when(F.col("vec_id") % 4 == 1, F.transform("samples", lambda v: F.lit(0.0).cast("float"))).otherwise(F.col("samples"))
    return audio.clean_summary(audio.clean_audio(_clips(spark, d).withColumn("samples", silent), sr=SR))


@query("clean_audio_chain", f"""WITH {X}, {SPECTRA}, mono AS (SELECT vec_id, label, list_transform(s, lambda v: v * 0.75) AS s FROM x), {denoise_sql('mono', 'den')},
    lim AS (SELECT vec_id, label, list_transform(s, lambda v: greatest(-{CEILING}, least({CEILING}, v))) AS s FROM den), {loud_sql('lim', 'loud')}, {trim_sql('loud', 'cut', 3)}
    {digest_sql('s', 'cut', "'ok' AS status,")}""")
def _(spark, d):
    # two channels, the second at half the level
    frames = F.transform("samples", lambda v: F.array(v.cast("double"), v * F.lit(0.5)))
    return _digest(audio.clean_audio(_clips(spark, d).withColumn("samples", frames), sr=SR, limit_db=-15.0, top_db=3.0, channels=True,
                                     profiles=_profiles(spark, d), session="label", frame=FRAME))


@query("calibrated_stream", DENOISED)
def _(spark, d):
    s = live.chunk_stream(spark, f"{d.rstrip('/')}/embeddings.parquet", table(spark, d, "embeddings").schema)
    s = s.select("vec_id", "label", F.col("embedding").alias("samples"))
    return _digest(live.drain(live.calibrated_stream(s, _profiles(spark, d), "label", frame=FRAME), work_dir(spark)))
