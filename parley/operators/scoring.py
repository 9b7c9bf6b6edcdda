"""Translation and transcript metrics per corpus, group or row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions import metrics as M
from parley.functions.text import strip, words
from parley.operators.beside import beside
from parley.operators.glossary import Glossary
from parley.operators.selection import bucket_of, quantiles
from parley.operators.rows import ERROR_MARK, has_text


def _sums(columns: Sequence[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def exact_match(df: DataFrame, by: Sequence[str] = (), ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Rows and share of rows that agree after trim and lower case; 0 for no rows."""
    hit = M.is_exact_match(F.col(ref), F.col(hyp)).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(hit), F.lit(0.0)), 4).alias("exact_match")
    )


def token_f1(df: DataFrame, by: Sequence[str] = (), ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Mean F1 of the word sets, 0-100."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(M.token_f1(F.col(ref), F.col(hyp))) * 100).alias("token_f1")
    )


def sentence_bleu(df: DataFrame, ref: str = "ref", hyp: str = "hyp", known: Column | None = None) -> DataFrame:
    """Add ``sentence_bleu`` to every row; nothing is shuffled.  Rows with ``known`` statistics need no count."""
    scored = M.with_bleu_stats(df, ref, hyp, known).withColumn("sentence_bleu", M.bleu_score(effective_order=True))
    return scored.drop(*M.BLEU_STATS)


def sentence_chrf(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Add ``sentence_chrf`` to every row; a blank reference scores 0."""
    score = F.when(has_text(F.col(ref)), M.chrf_score()).otherwise(F.lit(0.0))
    return M.with_chrf_stats(df, ref, hyp).withColumn("sentence_chrf", score).drop(*M.CHRF_STATS)


def corpus_bleu(df: DataFrame, by: Sequence[str] = (), ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """BLEU per group: integer statistics per row, their sums, one formula."""
    sums = M.with_bleu_stats(df.select(*by, ref, hyp), ref, hyp).groupBy(*by).agg(*_sums(M.BLEU_STATS))
    return sums.withColumn("bleu", F.coalesce(M.bleu_score(), F.lit(0.0)))


def corpus_chrf(df: DataFrame, by: Sequence[str] = (), ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """chrF per group, in the same two steps."""
    sums = M.with_chrf_stats(df.select(*by, ref, hyp), ref, hyp).groupBy(*by).agg(*_sums(M.CHRF_STATS))
    return sums.withColumn("chrf", F.coalesce(M.chrf_score(), F.lit(0.0)))


def mean_sentence_bleu(df: DataFrame, by: Sequence[str] = (), ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Mean sentence BLEU per group, failed predictions left out."""
    ok = df.filter(~F.contains(F.coalesce(F.col(hyp), F.lit("")), F.lit(ERROR_MARK))).select(*by, ref, hyp)
    return sentence_bleu(ok, ref, hyp).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("sentence_bleu"), F.lit(0.0)).alias("mean_sentence_bleu")
    )


def wer(df: DataFrame, by: Sequence[str] = (), ref: str = "ref", hyp: str = "hyp", target: float = 0.10) -> DataFrame:
    """Word edits over reference words, summed before dividing."""
    return df.groupBy(*by).agg(
        F.sum(M.word_edits(F.col(ref), F.col(hyp))).alias("edits"),
        F.sum(F.size(words(F.col(ref)))).cast("long").alias("ref_words"),
    ).withColumn("wer", F.when(F.col("ref_words") > 0, F.col("edits") / F.col("ref_words")).otherwise(F.lit(0.0))
    ).withColumn("meets_target", F.col("wer") < target)


def wer_parts(df: DataFrame, by: Sequence[str] = (), ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Word edits by kind, over the reference words."""
    kinds = ("substitutions", "deletions", "insertions")
    rows = df.select(*by, M.word_edit_parts(F.col(ref), F.col(hyp)).alias("_e"), F.size(words(F.col(ref))).alias("_n"))
    return rows.groupBy(*by).agg(*[F.sum(f"_e.{k}").alias(k) for k in kinds], F.sum("_n").cast("long").alias("ref_words"))


def wer_setdiff(df: DataFrame, by: Sequence[str] = (), ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """The order-blind error rate: words on one side only over reference words."""
    return df.groupBy(*by).agg(
        F.sum(M.set_difference_errors(F.col(ref), F.col(hyp))).alias("errors"),
        F.sum(F.size(words(F.col(ref)))).cast("long").alias("ref_words"),
    ).withColumn("wer", F.when(F.col("ref_words") > 0, F.col("errors") / F.col("ref_words")).otherwise(F.lit(0.0)))


def match_by_length(df: DataFrame, ref: str = "ref", hyp: str = "hyp", short: int = 50) -> DataFrame:
    """2 x 2 counts: short or long reference by exact match; blank references are left out, empty cells are 0."""
    is_short = F.length(strip(F.col(ref))) < short
    hit = M.is_exact_match(F.col(ref), F.col(hyp))
    cells = [(s, e) for s in (True, False) for e in (False, True)]
    one = df.filter(has_text(F.col(ref))).agg(F.array(*[
        F.struct(F.lit(s).alias("short_ref"), F.lit(e).alias("exact"),
                 F.count_if((is_short == F.lit(s)) & (hit == F.lit(e))).alias("n"))
        for s, e in cells
    ]).alias("cells"))
    return one.select(F.explode("cells").alias("c")).select("c.*")


def score_histogram(df: DataFrame, col: str) -> DataFrame:
    """Equal bins from min to max, ``min(30, max(10, n // 5))`` of them, the last one closed on the right."""
    stats = df.agg(F.count(col).alias("_n"), F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    bins = F.least(F.lit(30), F.greatest(F.lit(10), F.floor(F.col("_n") / 5)))
    # a single value gets a bin range of one around it
    same = F.col("_lo") == F.col("_hi")
    stats = stats.select(
        bins.cast("long").alias("bins"),
        F.when(same, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
        F.when(same, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"),
    )
    at = F.floor((F.col(col) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))).cast("long")
    placed = beside(df.filter(F.col(col).isNotNull()).select(col), stats).withColumn("bin", F.least(at, F.col("bins") - 1))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edges = stats.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"), "lo", "hi", "bins")
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return edges.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + width * F.col("bin")).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n")
    )


def validation_table(
    df: DataFrame, by: str = "config_id", ref: str = "ref", hyp: str = "hyp",
    terms: DataFrame | None = None, bleu_target: float = 40.0, glossary_target: float = 0.95,
) -> DataFrame:
    """All metrics per config from one pass over the predictions.

    BLEU, chrF, exact match and the glossary are sums over statistics of the rows, so they share one scan (and one call of the
    model a row) and one aggregate.
    """
    base = df.select(by, ref, hyp).withColumn(hyp, F.coalesce(hyp, F.lit("")))
    if terms is not None:
        base = base.withColumn("_terms", Glossary(terms).counts(ref, hyp))
    scored = F.col("_has").cast("long")
    stats = M.with_chrf_stats(M.with_bleu_stats(base, ref, hyp), ref, hyp).withColumns({
        "_has": has_text(F.col(ref)), "_hit": M.is_exact_match(F.col(ref), F.col(hyp)),
    })
    sums = stats.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(scored).alias("n_scored"),
        F.sum((F.col("_has") & F.col("_hit")).cast("long")).alias("_hits"),
        *[F.sum(F.when(F.col("_has"), F.col(c)).otherwise(F.lit(0))).alias(c) for c in (*M.BLEU_STATS, *M.CHRF_STATS)],
        *([] if terms is None else [F.sum("_terms.terms").alias("_in_ref"), F.sum("_terms.kept").alias("_kept")]),
    )
    columns = [
        by, "n", "n_scored", M.bleu_score().alias("bleu"), M.chrf_score().alias("chrf"),
        F.when(F.col("n_scored") > 0, F.col("_hits") / F.col("n_scored")).otherwise(F.lit(0.0)).alias("exact_match"),
    ]
    if terms is not None:
        columns.append(F.when(F.col("_in_ref") > 0, F.round(F.col("_kept") / F.col("_in_ref"), 4)).alias("glossary"))
    out = sums.select(*columns).withColumn("meets_bleu_target", F.col("bleu") >= bleu_target)
    return out if terms is None else out.withColumn("meets_glossary_target", F.col("glossary") >= glossary_target)


def same_reference_ab(df: DataFrame, ref: str, hyp_a: str, hyp_b: str) -> DataFrame:
    """Corpus BLEU of two hypothesis columns over the same references, and the difference.

    Rows need both; fewer than two give no result.
    """
    both = df.filter(F.col(hyp_a).isNotNull() & F.col(hyp_b).isNotNull())
    sides = both.select(
        F.col(ref).alias("ref"),
        F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col(hyp_a).alias("hyp")),
                          F.struct(F.lit("b").alias("side"), F.col(hyp_b).alias("hyp")))).alias("x"),
    ).select("ref", "x.side", "x.hyp")
    sums = M.with_bleu_stats(sides, "ref", "hyp").groupBy("side").agg(F.count(F.lit(1)).alias("n"), *_sums(M.BLEU_STATS))
    scores = sums.select("side", "n", M.bleu_score().alias("bleu"))
    return scores.agg(
        F.max("n").alias("n_rows"),
        F.max(F.when(F.col("side") == "a", F.col("bleu"))).alias("bleu_a"),
        F.max(F.when(F.col("side") == "b", F.col("bleu"))).alias("bleu_b"),
    ).withColumn("delta", F.col("bleu_b") - F.col("bleu_a")).filter(F.col("n_rows") >= 2)


def quartile_bucket(df: DataFrame, col: str, name: str = "bucket") -> DataFrame:
    """Quartile of an integer column: right-closed bins, the lowest closed on both sides, equal edges merged.

    The exact quartiles are found by counting (see ``selection``), so no task sees all values; rows without a value are in the lowest bin.
    """
    edges = sorted(set(quantiles(df.select(F.col(col).cast("long").alias("v")), "v", (0.0, 0.25, 0.5, 0.75, 1.0))))
    if len(edges) < 2:
        return df.withColumn(name, F.lit("all"))
    return df.withColumn(name, F.concat(F.lit("q"), bucket_of(F.coalesce(F.col(col), F.lit(edges[0])), edges).cast("string")))


def stratified_means(df: DataFrame, score: str, strata: dict[str, Column]) -> DataFrame:
    """Mean score and rows per value of each stratum: (stratum, value, n, mean)."""
    long = df.select(score, F.explode(F.array(*[
        F.struct(F.lit(k).alias("stratum"), v.cast("string").alias("value")) for k, v in strata.items()
    ])).alias("s")).select(score, "s.*")
    return long.groupBy("stratum", "value").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))
