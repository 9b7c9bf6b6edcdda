"""The prediction column: a user function applied to rows, and what is built around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from parley.functions import metrics as M
from parley.functions.prompts import parse_tagged_lines
from parley.functions.text import NO_SPEECH, SPACE, blank_to_null, has_source, strip
from parley.operators.joins import config_grid, with_grid
from parley.operators.scoring import corpus_bleu, corpus_chrf, sentence_bleu, sentence_chrf

# What stands in for a translation when there is nothing to translate.
EMPTY_MESSAGE = "(nothing was said)"

# Settings a config has when its file does not say.
CONFIG_DEFAULTS = {"provider": "vertex-ai", "temperature": 0.0, "top_p": 1.0, "max_output_tokens": 256}


def predict_column(df: DataFrame, fn: Callable[..., Sequence], inputs: Sequence[str], out: str = "translated_text_model") -> DataFrame:
    """Add ``out`` = ``fn(batch)`` in Arrow batches.

    ``fn`` gets a pandas DataFrame of the input columns and gives a sequence of texts.  When it
    raises for a batch the batch is halved until the failing rows stand alone, and such a row gets ``(error: ...)``.
    A short answer is padded with empty texts; answers are trimmed.  Partition count caps the
    number of calls at a time; write the result once and read it for every metric, so that no
    recomputation repeats the calls.
    """
    names = list(inputs)

    def answers(pdf: pd.DataFrame) -> list:
        try:
            return (list(fn(pdf)) + [""] * len(pdf))[: len(pdf)]
        except Exception as e:
            if len(pdf) < 2:
                return [f"(error: {e})"] * len(pdf)
            half = len(pdf) // 2
            return answers(pdf.iloc[:half]) + answers(pdf.iloc[half:])

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            yield pd.Series([str("" if g is None else g).strip() for g in answers(pdf)])

    # not deterministic: the optimizer may then neither copy nor repeat the call inside a plan
    return df.withColumn(out, run.asNondeterministic()(F.struct(*names)))


def skip_or_call(
    df: DataFrame, call: Callable[[DataFrame], DataFrame], source: str = "source_text",
    out: str = "translated_text_model", message: str = EMPTY_MESSAGE,
) -> DataFrame:
    """Call the model only for rows with a source; the others get a fixed message.

    The filter stands before the call, so the function never sees a skipped row.  ``called``
    tells the two apart and counts the calls.
    """
    has = has_source(F.col(source))
    made = call(df.filter(has)).withColumn("called", F.lit(True))
    skipped = df.filter(~has).withColumn(out, F.lit(message)).withColumn("called", F.lit(False))
    return made.unionByName(skipped)


def with_defaults(configs: Sequence[dict], overrides: dict | None = None) -> list[dict]:
    """Config rows with defaults filled in and call-time overrides applied."""
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    return [{**CONFIG_DEFAULTS, **{k: v for k, v in c.items() if v is not None}, **given} for c in configs]


def load_configs(spark: SparkSession, path: str, overrides: dict | None = None, pattern: str = "*.yaml") -> DataFrame:
    """One row per file of flat ``key: value`` lines under a folder, with defaults and overrides.

    The folder is searched at every depth for file names that match ``pattern``.
    """
    return parse_configs(spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern), overrides)


def config_by_id(configs: DataFrame, config_id: str) -> DataFrame:
    """The config with an id, which its file name need not have; no row when there is none."""
    return configs.filter(F.col("config_id") == config_id)


def parse_configs(files: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Configs out of whole file texts (column ``value``)."""

    def value(key: str) -> Column:
        raw = F.regexp_extract("value", rf"(?m)^{key}:[ \t]*[\"']?([^\"'#\r\n]*)", 1)
        got = blank_to_null(F.trim(raw))
        return F.coalesce(F.lit((overrides or {}).get(key)).cast("string"), got, F.lit(CONFIG_DEFAULTS.get(key)).cast("string"))

    return files.select(
        value("id").alias("config_id"), *[value(k).alias(k) for k in ("provider", "model_name", "prompt_template_id", "system_prompt_id")],
        value("temperature").cast("double").alias("temperature"), value("top_p").cast("double").alias("top_p"),
        value("max_output_tokens").cast("int").alias("max_output_tokens"),
    )


def config_search(df: DataFrame, configs: Sequence[dict], predict: Callable[[DataFrame], DataFrame], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Corpus BLEU per config: grid, prediction, one grouped metric."""
    runs = predict(config_grid(df, configs))
    return corpus_bleu(runs, ["ord", "config_id"], ref, hyp).select("ord", "config_id", F.col("bleu").alias("score"))


def rank_configs(results: DataFrame, score: str = "score", order: str = "ord") -> DataFrame:
    return results.orderBy(F.col(score).desc(), F.col(order))


def best_config(results: DataFrame, target: float | None = 40.0, score: str = "score", order: str = "ord") -> DataFrame:
    """The highest score; of equal ones the config listed first."""
    best = results.agg(F.max_by(F.struct("config_id", F.col(score).alias("score")), F.struct(F.col(score), -F.col(order))).alias("b"))
    out = best.select("b.config_id", "b.score")
    return out if target is None else out.withColumn("meets_target", F.col("score") >= target)


def best_score(results: DataFrame, best_id: DataFrame, score: str = "score") -> DataFrame:
    """The score of the named config, 0 when it has no result."""
    return best_id.select("config_id").join(results.select("config_id", score), "config_id", "left").select(
        "config_id", F.coalesce(F.col(score), F.lit(0.0)).alias("score"))


def sweep(
    df: DataFrame, predict: Callable[[DataFrame], DataFrame], metric: str = "bleu", ref: str = "ref", hyp: str = "hyp", **values: Sequence
) -> DataFrame:
    """Corpus metric under every combination of the swept settings, in one job."""
    runs = predict(with_grid(df, **values))
    by = list(values)
    scored = corpus_chrf(runs, by, ref, hyp) if metric == "chrf" else corpus_bleu(runs, by, ref, hyp)
    return scored.select(*by, metric)


def repeat_stats(scores: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Mean and sample deviation over repeats; one repeat deviates by 0."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("repeats"), F.avg(score).alias("mean"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"),
    )


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _places(words_: pa.Array) -> pa.Array:
    """The byte at which each word begins in its text, the words joined by single spaces."""
    count = pc.fill_null(pc.list_value_length(words_), 0).to_numpy().astype(np.int64)
    size = pc.binary_length(words_.flatten()).to_numpy().astype(np.int64) + 1
    begin, edge = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(count)])
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(begin[:-1] - np.repeat(begin[edge[:-1]], count), pa.int32()))


def _words_of(text: Column) -> Column:
    return F.split(strip(text), f"{SPACE}+")


def _joined(words_: Column) -> Column:
    """The words with single spaces as bytes, which are cut without a look at the letters before the place."""
    return F.concat_ws(" ", words_).cast("binary")


def _without(joined: Column, place: Column, word: Column) -> Column:
    """The joined text without the word at a place, nor the space behind it (before it, if it is the last)."""
    size, gone = F.octet_length(joined), F.octet_length(word) + 1
    return F.concat(F.substring(joined, F.lit(1), F.least(place, size - gone)), F.substring(joined, place + gone + 1, size)).cast("string")


def leave_one_out(df: DataFrame, text: str, max_words: int | None = None, out: str = "ablated", along: Sequence[str] = ()) -> DataFrame:
    """One row per left-out word (of the first ``max_words``, if given): (…, removed_index, removed_word, ablated text); texts of one word give none.

    Array columns ``along`` have a value a word, of which a row gets its own (null where there are fewer).
    """
    rows = df.withColumn("_w", _words_of(F.col(text))).filter(F.size("_w") >= 2).withColumns({"_p": _places("_w"), "_j": _joined(F.col("_w"))})
    most = F.least(F.size("_w"), F.lit(max_words)) if max_words else F.size("_w")
    each = F.posexplode(F.slice(F.arrays_zip("_w", "_p", *along), 1, most)).alias("removed_index", "_e")
    rows = rows.select("*", each).withColumns({
        "removed_word": F.col("_e._w"), out: _without(F.col("_j"), F.col("_e._p"), F.col("_e._w")), **{c: F.col("_e")[c] for c in along}})
    return rows.drop("_w", "_p", "_j", "_e")


def ablation_delta(
    df: DataFrame, keys: Sequence[str], predict: Callable[[DataFrame, str, str], DataFrame], source: str, ref: str,
    max_words: int | None = None, metric: str = "bleu",
) -> DataFrame:
    """How much the row score drops when a word is left out of the source.

    ``predict(df, source_column, out_column)`` adds the model's answer.  The score of the full
    text is computed once per row and travels with it, so the difference needs no join.

    The BLEU statistics of the full answer without each of its words come from count changes, once per row.  An answer that is, byte by
    byte, one of these has its statistics; any other answer is counted for itself.
    """
    score = sentence_chrf if metric == "chrf" else sentence_bleu
    name = f"sentence_{metric}"
    base = predict(df.select(*keys, source, ref), source, "_full")
    full = score(base, ref, "_full").withColumnRenamed(name, "full_score")
    if metric == "chrf":
        each = score(predict(leave_one_out(full.drop("_full"), source, max_words), "ablated", "_part"), ref, "_part")
    else:
        full = full.withColumn("_a", _words_of(F.coalesce("_full", F.lit(""))))
        full = full.withColumns({"_at": _places("_a"), "_known": M.left_out_stats(F.col("_a"), F.col(ref)), "_joined": _joined(F.col("_a"))}).drop("_full")
        each = predict(leave_one_out(full, source, max_words, along=["_a", "_at", "_known"]), "ablated", "_part")
        known = F.when(F.col("_part") == _without(F.col("_joined"), F.col("_at"), F.col("_a")), F.col("_known.stats"))
        each = sentence_bleu(each, ref, "_part", known)
    return each.select(*keys, "removed_index", "removed_word", "full_score", (F.col("full_score") - F.col(name)).alias("delta"))


def word_ablation_delta(df: DataFrame, keys: Sequence[str], answer: Callable[[Column], Column], source: str, ref: str) -> DataFrame:
    """:func:`ablation_delta` for a model that answers word by word (``answer`` is a column expression of one word).

    The answer without a word is then the answer's other words, so the scores come from the changes of the n-gram counts around the gap: a
    text costs its length, not the square of it, and no text but the full one is made.
    """
    rows = df.select(*keys, source, ref, _words_of(F.col(source)).alias("_w")).withColumn("_full", answer(F.col(source)))
    full = sentence_bleu(rows, ref, "_full").withColumnRenamed("sentence_bleu", "full_score").filter(F.size("_w") >= 2)
    each = full.withColumn("_o", F.explode(M.left_out_stats(F.transform("_w", answer), F.col(ref))))
    scored = each.withColumns(M.bleu_columns(F.col("_o.stats"))).withColumn("_part", M.bleu_score(effective_order=True))
    return scored.select(*keys, F.col("_o.removed_index").alias("removed_index"), F.get("_w", F.col("_o.removed_index")).alias("removed_word"),
                         "full_score", (F.col("full_score") - F.col("_part")).alias("delta"))


def manifest_predict(
    manifest: DataFrame, transcript: str, translate: Callable[[DataFrame], DataFrame],
    generate: Callable[[DataFrame], DataFrame], tag: str = "ES", has_audio: str = "has_audio",
) -> DataFrame:
    """Manifest rows to (source_phrase, translated_text_model).

    Rows with audio: the transcript and its translation; no speech gives ``(no speech)``.  Rows
    without: ``generate`` writes a text from the label into ``answer`` and the tagged lines of it
    are taken apart.  ``translate`` adds ``translated_text_model`` for ``source_phrase``.
    """
    keep = manifest.columns
    heard = manifest.filter(F.col(has_audio)).withColumn("source_phrase", blank_to_null(strip(F.coalesce(F.col(transcript), F.lit("")))))
    spoken = translate(heard.filter(F.col("source_phrase").isNotNull())).select(*keep, "source_phrase", "translated_text_model")
    silent = heard.filter(F.col("source_phrase").isNull()).select(
        *keep, F.lit(NO_SPEECH).alias("source_phrase"), F.lit("").alias("translated_text_model"))
    written = generate(manifest.filter(~F.col(has_audio)))
    parsed = written.withColumn("_p", parse_tagged_lines(F.col("answer"), tag)).select(
        *keep, F.col("_p")["source_phrase"].alias("source_phrase"), F.col("_p")["translated"].alias("translated_text_model"))
    return spoken.unionByName(silent).unionByName(parsed)
