"""Text metrics, fairness, config search and gates over the pair tables."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from parley.functions import metrics as M
from parley.operators import fairness, gates, glossary, joins, predict, scoring
from parley.operators.beside import beside
from parley.operators.ledger import Ledger
from parley.plans.base import (
    bleu_ctes, bleu_sql, chrf_ctes, chrf_sql, manifest, pairs, query, rounded, sql, sql_norm, sql_words, table, terms, without_first_word,
)
from parley.session import work_dir
from parley.sources import tables

HIT = f"CASE WHEN {sql_norm('ref')} = {sql_norm('hyp')} THEN 1 ELSE 0 END"
KEY = "conv_id, turn"

# --- single metrics ----------------------------------------------------------


@query("exact_match", sql("pairs", f"SELECT dataset, count(*) AS n, round(avg({HIT}), 4) AS exact_match FROM pairs GROUP BY 1"))
def _(spark, d):
    return scoring.exact_match(pairs(spark, d), ["dataset"])


F1 = f"""f AS (SELECT *, list_distinct({sql_words('lower(ref)')}) AS r, list_distinct({sql_words('lower(hyp)')}) AS h FROM pairs),
    f1 AS (SELECT *, CASE WHEN len(r) = 0 AND len(h) = 0 THEN 1 WHEN len(list_intersect(r, h)) = 0 THEN 0 ELSE 2 * len(list_intersect(r, h)) / CAST(len(r) + len(h) AS DOUBLE) END AS f1 FROM f)"""


@query("token_f1", sql("pairs", "SELECT dataset, count(*) AS n, round(avg(f1) * 100, 6) AS token_f1 FROM f1 GROUP BY 1", F1))
def _(spark, d):
    return rounded(scoring.token_f1(pairs(spark, d), ["dataset"]))


@query("wer_setdiff", sql("pairs", f"""SELECT dataset, CAST(sum(CASE WHEN len(r) = 0 THEN len(h) ELSE len(list_filter(list_distinct(h), lambda w: NOT list_contains(r, w))) + len(list_filter(list_distinct(r), lambda w: NOT list_contains(h, w))) END) AS BIGINT) AS errors,
    CAST(sum(len(r)) AS BIGINT) AS ref_words, round(sum(CASE WHEN len(r) = 0 THEN len(h) ELSE len(list_filter(list_distinct(h), lambda w: NOT list_contains(r, w))) + len(list_filter(list_distinct(r), lambda w: NOT list_contains(h, w))) END) / CAST(sum(len(r)) AS DOUBLE), 6) AS wer
    FROM (SELECT dataset, {sql_words('ref')} AS r, {sql_words('hyp')} AS h FROM pairs) GROUP BY 1"""))
def _(spark, d):
    return rounded(scoring.wer_setdiff(pairs(spark, d), ["dataset"]))


# Edit distance over whole texts: one row of the distance table per reference word and pair; the
# reduce carries the left neighbour along the row.
EDITS = f"""w AS (SELECT conv_id, turn, dataset, {sql_words('ref')} AS r, {sql_words('hyp')} AS h FROM pairs),
    dp(conv_id, turn, i, line) AS (
      SELECT conv_id, turn, 0, range(0, len(h) + 1) FROM w
      UNION ALL SELECT conv_id, turn, i, list_reduce(list_transform(costs, lambda c: [c]), lambda a, b: list_append(a, least(b[1], a[-1] + 1))) FROM (
        SELECT p.conv_id, p.turn, p.i + 1 AS i, list_transform(p.line, lambda c, j: CASE WHEN j = 1 THEN c + 1
            ELSE least(c + 1, p.line[j - 1] + CASE WHEN w.h[j - 1] = w.r[p.i + 1] THEN 0 ELSE 1 END) END) AS costs
        FROM dp p JOIN w ON w.conv_id = p.conv_id AND w.turn = p.turn WHERE p.i < len(w.r)))"""


@query("wer", sql("pairs", """SELECT dataset, CAST(sum(line[-1]) AS BIGINT) AS edits, CAST(sum(len(r)) AS BIGINT) AS ref_words,
    round(sum(line[-1]) / CAST(sum(len(r)) AS DOUBLE), 6) AS wer, sum(line[-1]) / CAST(sum(len(r)) AS DOUBLE) < 0.1 AS meets_target
    FROM dp JOIN w ON w.conv_id = dp.conv_id AND w.turn = dp.turn AND i = len(r) GROUP BY 1""", EDITS))
def _(spark, d):
    return rounded(scoring.wer(pairs(spark, d), ["dataset"]))


@query("wer_parts", sql("pairs", """SELECT dataset, CAST(sum(len(r)) AS BIGINT) AS ref_words, CAST(sum(len(r) - len(h)) AS BIGINT) AS shorter, CAST(sum(line[-1]) AS BIGINT) AS edits
    FROM dp JOIN w ON w.conv_id = dp.conv_id AND w.turn = dp.turn AND i = len(r) GROUP BY 1""", EDITS))
def _(spark, d):
    parts = scoring.wer_parts(pairs(spark, d), ["dataset"])
    edits = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return parts.select("dataset", "ref_words", (F.col("deletions") - F.col("insertions")).alias("shorter"), edits.alias("edits"))


@query("match_by_length", sql("pairs", f"""SELECT short_ref, exact, CAST(count(ref) AS BIGINT) AS n FROM (VALUES (TRUE, FALSE), (TRUE, TRUE), (FALSE, FALSE), (FALSE, TRUE)) c(short_ref, exact)
    LEFT JOIN (SELECT ref, length(trim(ref)) < 50 AS s, {HIT} = 1 AS e FROM pairs WHERE trim(ref) <> '') ON s = short_ref AND e = exact GROUP BY 1, 2"""))
def _(spark, d):
    return scoring.match_by_length(pairs(spark, d))


BINS = """st AS (SELECT least(30, greatest(10, count(*) // 5)) AS bins, min(f1) AS lo, max(f1) AS hi FROM f1),
    b AS (SELECT unnest(range(0, bins)) AS bin, lo, (hi - lo) / bins AS width, bins FROM st)"""


@query("score_histogram", sql("pairs", """SELECT b.bin, round(lo + width * b.bin, 6) AS left_edge, CAST(COALESCE(n, 0) AS BIGINT) AS n FROM b LEFT JOIN (
      SELECT least(CAST(floor((f1 - lo) / ((hi - lo) / bins)) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM f1, st GROUP BY 1) c ON c.bin = b.bin""", F1, BINS))
def _(spark, d):
    p = pairs(spark, d).withColumn("f1", M.token_f1(F.col("ref"), F.col("hyp")))
    return rounded(scoring.score_histogram(p, "f1"))


@query("sentence_bleu", sql("pairs", f"SELECT conv_id, turn, round(bleu, 6) AS sentence_bleu FROM ({bleu_sql(KEY, True)})", *bleu_ctes("pairs", KEY)))
def _(spark, d):
    return rounded(scoring.sentence_bleu(pairs(spark, d).select("conv_id", "turn", "ref", "hyp")).drop("ref", "hyp"))


@query("corpus_bleu", sql("pairs", f"SELECT dataset, round(bleu, 6) AS bleu FROM ({bleu_sql('dataset')})", *bleu_ctes("pairs", KEY, "dataset")))
def _(spark, d):
    return rounded(scoring.corpus_bleu(pairs(spark, d), ["dataset"]).select("dataset", "bleu"))


@query("chrf", sql("pairs", f"SELECT dataset, round(chrf, 6) AS chrf FROM ({chrf_sql('dataset')})", *chrf_ctes("pairs", KEY, "dataset")))
def _(spark, d):
    return rounded(scoring.corpus_chrf(pairs(spark, d), ["dataset"]).select("dataset", "chrf"))


@query("sentence_chrf", sql("pairs", f"SELECT conv_id, turn, round(chrf, 6) AS sentence_chrf FROM ({chrf_sql(KEY)})", *chrf_ctes("pairs", KEY)))
def _(spark, d):
    return rounded(scoring.sentence_chrf(pairs(spark, d).select("conv_id", "turn", "ref", "hyp")).drop("ref", "hyp"))


PLANTED = """planted AS (SELECT conv_id, turn, dataset, ref, CASE WHEN conv_id % 5 = 0 THEN '(error: quota) ' || hyp ELSE hyp END AS hyp FROM pairs),
    fine AS (SELECT * FROM planted WHERE NOT contains(hyp, '(error:'))"""


@query("mean_sentence_bleu", sql("pairs", f"""SELECT p.dataset, count(*) AS n, round(avg(bleu), 6) AS mean_sentence_bleu FROM ({bleu_sql(KEY, True)}) s JOIN fine p USING (conv_id, turn) GROUP BY 1""", PLANTED, *bleu_ctes("fine", KEY)))
def _(spark, d):
    p = pairs(spark, d).withColumn("hyp", F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("(error: quota) "), "hyp")).otherwise(F.col("hyp")))
    return rounded(scoring.mean_sentence_bleu(p, ["dataset"]))


# --- glossary ----------------------------------------------------------------

HITS = """hits AS (SELECT conv_id, turn, dataset, term, contains(lower(hyp), term) AS kept FROM pairs JOIN terms ON contains(lower(ref), term))"""


@query("glossary_hits", sql("pairs terms", "SELECT conv_id, turn, term, kept FROM hits", HITS))
def _(spark, d):
    return glossary.glossary_hits(pairs(spark, d), terms(spark, d), ["conv_id", "turn"])


# The same terms in shards of 4 KB, as a glossary too large for one automaton would be.
@query("glossary_hits_by_anchor", sql("pairs terms", "SELECT conv_id, turn, term, kept FROM hits", HITS))
def _(spark, d):
    return glossary.glossary_hits(pairs(spark, d), terms(spark, d), ["conv_id", "turn"], shard=4096)


@query("glossary_enforcement", sql("pairs terms", "SELECT count(*) AS terms, count(*) FILTER (WHERE kept) AS kept, round(count(*) FILTER (WHERE kept) / CAST(count(*) AS DOUBLE), 4) AS enforcement FROM hits", HITS))
def _(spark, d):
    return glossary.glossary_enforcement(pairs(spark, d), terms(spark, d))


@query("glossary_presence", sql("pairs terms", "SELECT conv_id, turn, EXISTS (SELECT 1 FROM terms WHERE contains(lower(ref), term)) AS has_term FROM pairs"))
def _(spark, d):
    return glossary.with_glossary_flag(pairs(spark, d), terms(spark, d)).select("conv_id", "turn", "has_term")


@query("glossary_guard", sql("pairs terms", "SELECT conv_id, turn, term FROM hits WHERE NOT kept", HITS))
def _(spark, d):
    return glossary.glossary_guard(pairs(spark, d), terms(spark, d), ["conv_id", "turn"])


# --- fairness ----------------------------------------------------------------

GROUPS = f"""sb AS ({bleu_sql(KEY, True)}),
    gm AS (SELECT GROUPING(dataset) = 1 AS overall, dataset, emotion, count(*) AS n, round(avg(hit), 4) AS exact_match, round(avg(bleu), 4) AS mean_sentence_bleu
      FROM (SELECT dataset, emotion, {HIT} AS hit, bleu FROM pairs JOIN sb USING (conv_id, turn)) GROUP BY GROUPING SETS ((), (dataset, emotion))),
    ov AS (SELECT exact_match AS o FROM gm WHERE overall),
    gp AS (SELECT gm.*, o, abs(o - exact_match) AS gap FROM gm, ov WHERE NOT overall)"""
BLEU_PAIRS = bleu_ctes("pairs", KEY)


def _groups(spark, d):
    return fairness.group_metrics(pairs(spark, d), ["dataset", "emotion"])


@query("group_metrics", sql("pairs", "SELECT * FROM gm", *BLEU_PAIRS, GROUPS))
def _(spark, d):
    return _groups(spark, d)


@query("disparities", sql("pairs", "SELECT dataset, emotion, n, exact_match AS group_metric, mean_sentence_bleu, o AS overall_metric, round(gap, 4) AS absolute_gap FROM gp WHERE gap > 0.02", *BLEU_PAIRS, GROUPS))
def _(spark, d):
    return fairness.disparities(_groups(spark, d), threshold=0.02)


@query("disparity_summary", sql("pairs", """SELECT count(*) FILTER (WHERE gap > 0.02) AS disparities, max(round(gap, 4)) FILTER (WHERE gap > 0.02) AS max_gap,
    min(exact_match) AS min_group, max(exact_match) AS max_group, max(o) AS overall FROM gp""", *BLEU_PAIRS, GROUPS))
def _(spark, d):
    return fairness.disparity_summary(_groups(spark, d), threshold=0.02)


@query("mean_of_groups", sql("pairs", "SELECT dataset, round(avg(exact_match), 6) AS exact_match FROM gp GROUP BY 1", *BLEU_PAIRS, GROUPS))
def _(spark, d):
    return rounded(fairness.mean_of_groups(_groups(spark, d), "dataset"))


@query("group_grid", """WITH m AS (SELECT COALESCE(NULLIF(lang, 'de'), 'unknown') AS lang, source FROM documents WHERE doc_id IS NOT NULL)
    SELECT lang, source, CAST(COALESCE(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT lang FROM m) CROSS JOIN (SELECT DISTINCT source FROM m)
    LEFT JOIN (SELECT lang, source, count(*) AS n FROM m GROUP BY ALL) USING (lang, source)""")
def _(spark, d):
    t = table(spark, d, "documents").select(F.nullif(F.col("lang"), F.lit("de")).alias("lang"), "source")
    return fairness.group_grid(t, ["lang", "source"])


@query("model_bias_report", sql("pairs", """SELECT 'overall' AS section, 'n' AS key, CAST(n AS DOUBLE) AS value FROM gm WHERE overall
    UNION ALL SELECT 'overall', 'exact_match', exact_match FROM gm WHERE overall
    UNION ALL SELECT 'group', dataset || '|' || emotion, exact_match FROM gp
    UNION ALL SELECT 'disparity', dataset || '|' || emotion, round(gap, 4) FROM gp WHERE gap > 0.02
    UNION ALL SELECT 'summary', 'disparities', CAST(count(*) FILTER (WHERE gap > 0.02) AS DOUBLE) FROM gp
    UNION ALL SELECT 'summary', 'max_gap', max(round(gap, 4)) FILTER (WHERE gap > 0.02) FROM gp
    UNION ALL (SELECT 'widest', dataset || '|' || emotion, round(gap, 4) FROM gp WHERE gap > 0.02 ORDER BY gap DESC, 2 LIMIT 1)""", *BLEU_PAIRS, GROUPS))
def _(spark, d):
    return fairness.model_bias_report(pairs(spark, d), ["dataset", "emotion"], threshold=0.02)


@query("custom_metric", sql("pairs", "SELECT dataset, round(avg(abs(length(ref) - length(hyp))), 6) AS metric FROM pairs GROUP BY 1"))
def _(spark, d):
    def partial(true: pd.Series, pred: pd.Series):
        return (true.str.len() - pred.str.len()).abs().sum(), len(true)
    return rounded(fairness.custom_metric(pairs(spark, d), ["dataset"], partial, ["off", "n"], F.col("off") / F.col("n"), "ref", "hyp"))


# --- prediction, search, sensitivity ----------------------------------------

CONFIGS = predict.with_defaults([{"config_id": c} for c in ("copy", "lower", "drop", "echo", "copy_again")], {"temperature": 0.2})


def _stub(batch: pd.DataFrame) -> list[str]:
    """Stands for a model: what it does to the text depends on the config."""
    out = []
    for text, config in zip(batch["ref"], batch["config_id"]):
        if config == "lower":
            text = text.lower()
        elif config == "drop":
            text = re.sub(r"^\S+\s*", "", text)
        elif config == "echo":
            text = text + " " + text
        out.append(text)
    return out


def _runs(spark, d):
    base = pairs(spark, d).select("conv_id", "turn", "ref")
    return predict.predict_column(joins.config_grid(base, CONFIGS), _stub, ["ref", "config_id"], "hyp")


RUNS = r"""runs AS (SELECT conv_id, turn, ord, config_id, ref, trim(CASE config_id WHEN 'lower' THEN lower(ref) WHEN 'drop' THEN regexp_replace(ref, '^\S+\s*', '')
    WHEN 'echo' THEN ref || ' ' || ref ELSE ref END) AS hyp FROM pairs, (VALUES (0, 'copy'), (1, 'lower'), (2, 'drop'), (3, 'echo'), (4, 'copy_again')) c(ord, config_id))"""
RUN_KEY = "conv_id, turn, ord"
RUN_BLEU = [RUNS, *bleu_ctes("runs", RUN_KEY, "config_id")]
SEARCH = f"found AS (SELECT CAST(ord AS BIGINT) AS ord, b.config_id, bleu AS score FROM ({bleu_sql('config_id')}) b JOIN (SELECT DISTINCT ord, config_id FROM runs) USING (config_id))"


def _search(spark, d):
    base = pairs(spark, d).select("conv_id", "turn", "ref")
    return predict.config_search(base, CONFIGS, lambda df: predict.predict_column(df, _stub, ["ref", "config_id"], "hyp"))


@query("config_search", sql("pairs", "SELECT ord, config_id, round(score, 6) AS score FROM found", *RUN_BLEU, SEARCH))
def _(spark, d):
    return rounded(_search(spark, d))


@query("best_config", sql("pairs", "SELECT config_id, round(score, 6) AS score, score >= 40 AS meets_target FROM found ORDER BY round(score, 9) DESC, ord LIMIT 1", *RUN_BLEU, SEARCH))
def _(spark, d):
    return rounded(predict.best_config(_search(spark, d)))


@query("rank_configs", sql("pairs", "SELECT ord, config_id, round(score, 6) AS score FROM found", *RUN_BLEU, SEARCH))
def _(spark, d):
    return rounded(predict.rank_configs(_search(spark, d)))


@query("best_score", sql("pairs", "SELECT 'lower' AS config_id, round(score, 6) AS score FROM found WHERE config_id = 'lower' UNION ALL SELECT 'gone', 0", *RUN_BLEU, SEARCH))
def _(spark, d):
    wanted = spark.createDataFrame([("lower",), ("gone",)], "config_id string")
    return rounded(predict.best_score(_search(spark, d), wanted))


@query("validation_table", sql("pairs terms", f"""SELECT b.config_id, b.n_rows AS n, b.n_rows AS n_scored, round(bleu, 6) AS bleu, round(chrf, 6) AS chrf, round(em, 6) AS exact_match, bleu >= 40 AS meets_bleu_target,
    g AS glossary, g >= 0.95 AS meets_glossary_target
    FROM ({bleu_sql('config_id')}) b JOIN ({chrf_sql('config_id')}) c USING (config_id) JOIN (SELECT config_id, avg({HIT}) AS em FROM runs GROUP BY 1) e USING (config_id)
    JOIN (SELECT config_id, round(count(*) FILTER (WHERE contains(lower(hyp), term)) / CAST(count(*) AS DOUBLE), 4) AS g FROM runs JOIN terms ON contains(lower(ref), term) GROUP BY 1) USING (config_id)""",
    *RUN_BLEU, *chrf_ctes("runs", RUN_KEY, "config_id")))
def _(spark, d):
    return rounded(scoring.validation_table(_runs(spark, d), terms=terms(spark, d)))


# The sweep drops words by position modulo the setting.
def _sweep_stub(df):
    keep = F.filter(F.split("ref", " "), lambda w, i: (i + 1) % F.col("keep") != 0)
    return df.withColumn("hyp", F.array_join(keep, " "))


SWEEP = """swept AS (SELECT conv_id, turn, keep, ref, array_to_string(list_filter(string_split(ref, ' '), lambda w, i: i % keep <> 0), ' ') AS hyp FROM pairs, (VALUES (2), (3), (5), (9)) k(keep))"""
SWEEP_BLEU = [SWEEP, *bleu_ctes("swept", "conv_id, turn, keep")]


@query("sweep", sql("pairs", f"SELECT CAST(keep AS BIGINT) AS keep, round(bleu, 6) AS bleu FROM ({bleu_sql('keep')})", *SWEEP_BLEU))
def _(spark, d):
    return rounded(predict.sweep(pairs(spark, d).select("conv_id", "turn", "ref"), _sweep_stub, keep=[2, 3, 5, 9]))


@query("repeat_stats", sql("pairs", f"SELECT keep > 3 AS wide, count(*) AS repeats, round(avg(bleu), 6) AS mean, round(COALESCE(stddev_samp(bleu), 0), 6) AS std FROM ({bleu_sql('keep')}) GROUP BY 1", *SWEEP_BLEU))
def _(spark, d):
    scores = predict.sweep(pairs(spark, d).select("conv_id", "turn", "ref"), _sweep_stub, keep=[2, 3, 5, 9])
    return rounded(predict.repeat_stats(scores.withColumn("wide", F.col("keep") > 3), ["wide"], "bleu"))


LEFT_OUT = rf"""lw AS (SELECT conv_id, turn, string_split_regex(regexp_replace(ref, '^\s+|\s+$', '', 'g'), '\s+') AS w, ref FROM pairs),
    lo AS (SELECT conv_id, turn, ref, i AS removed_index, w[i + 1] AS removed_word, array_to_string(list_concat(w[1:i], w[i + 2:len(w)]), ' ') AS ablated
      FROM (SELECT *, unnest(range(0, len(w))) AS i FROM lw WHERE len(w) >= 2))"""


@query("leave_one_out", sql("pairs", "SELECT conv_id, turn, removed_index, removed_word, ablated FROM lo", LEFT_OUT))
def _(spark, d):
    return rounded(predict.leave_one_out(pairs(spark, d), "ref").select("conv_id", "turn", "removed_index", "removed_word", "ablated"))


ABLATED = [LEFT_OUT, "part AS (SELECT conv_id, turn, removed_index, removed_word, ref, lower(ablated) AS hyp FROM lo)",
           *bleu_ctes("part", "conv_id, turn, removed_index"), f"pb AS ({bleu_sql('conv_id, turn, removed_index', True)})"]
FULL = [c.replace("bleu_", "full_") for c in ["low AS (SELECT conv_id, turn, ref, lower(ref) AS hyp FROM pairs)", *bleu_ctes("low", KEY), f"fb AS ({bleu_sql(KEY, True)})"]]


DELTA = sql("pairs", "SELECT conv_id, turn, removed_index, removed_word, round(fb.bleu, 6) AS full_score, round(fb.bleu - pb.bleu, 6) AS delta FROM pb JOIN fb USING (conv_id, turn) JOIN lo USING (conv_id, turn, removed_index)", *ABLATED, *FULL)


@query("ablation_delta", DELTA)
def _(spark, d):
    lower = lambda df, src, out: df.withColumn(out, F.lower(src))
    p = pairs(spark, d).select("conv_id", "turn", "ref").withColumn("src", F.col("ref"))
    return rounded(predict.ablation_delta(p, ["conv_id", "turn"], lower, "src", "ref"))


# The same for a model that answers word by word, from count changes around the gap.
@query("ablation_delta_by_word", DELTA)
def _(spark, d):
    p = pairs(spark, d).select("conv_id", "turn", "ref").withColumn("src", F.col("ref"))
    return rounded(predict.word_ablation_delta(p, ["conv_id", "turn"], F.lower, "src", "ref"))


STRATA = f"""q AS (SELECT *, greatest(len({sql_words('ref')}), 1) AS wc, EXISTS (SELECT 1 FROM terms WHERE contains(lower(ref), term)) AS has_term FROM f1),
    e AS (SELECT list_distinct(quantile_cont(wc, [0, 0.25, 0.5, 0.75, 1])) AS edges FROM q),
    b AS (SELECT q.*, CASE WHEN len(edges) < 2 THEN 'all' ELSE 'q' || greatest(len(list_filter(edges, lambda x: x < wc)), 1) END AS bucket FROM q, e)"""


@query("quartile_means", sql("pairs terms", """SELECT stratum, value, count(*) AS n, round(avg(f1), 6) AS mean FROM (SELECT 'length' AS stratum, bucket AS value, f1 FROM b UNION ALL SELECT 'glossary', CAST(has_term AS VARCHAR), f1 FROM b UNION ALL SELECT 'emotion', emotion, f1 FROM b) GROUP BY 1, 2""", F1, STRATA))
def _(spark, d):
    p = glossary.with_glossary_flag(pairs(spark, d), terms(spark, d))
    p = p.withColumns({"f1": M.token_f1(F.col("ref"), F.col("hyp")), "wc": F.greatest(F.size(M.words(F.col("ref"))), F.lit(1))})
    strata = {"length": F.col("bucket"), "glossary": F.col("has_term"), "emotion": F.col("emotion")}
    return rounded(scoring.stratified_means(scoring.quartile_bucket(p, "wc"), "f1", strata))


AB = r"""ab AS (SELECT conv_id, turn, side, ref, CASE side WHEN 'a' THEN lower(ref) ELSE regexp_replace(ref, '^\S+\s*', '') END AS hyp FROM pairs, (VALUES ('a'), ('b')) s(side) WHERE turn > 0)"""


@query("same_reference_ab", sql("pairs", f"""SELECT max(n_rows) AS n_rows, round(max(bleu) FILTER (WHERE side = 'a'), 6) AS bleu_a, round(max(bleu) FILTER (WHERE side = 'b'), 6) AS bleu_b,
    round(max(bleu) FILTER (WHERE side = 'b') - max(bleu) FILTER (WHERE side = 'a'), 6) AS delta FROM ({bleu_sql('side')})""", AB, *bleu_ctes("ab", "conv_id, turn, side")))
def _(spark, d):
    p = pairs(spark, d)
    p = p.withColumns({"stt": F.lower("ref"), "script": F.when(F.col("turn") > 0, without_first_word(F.col("ref")))})
    return rounded(scoring.same_reference_ab(p, "ref", "stt", "script"))


@query("skip_or_call", sql("pairs", r"""SELECT conv_id, turn, CASE WHEN turn = 1 THEN '(nothing was said)' ELSE lower(trim(ref)) END AS translated_text_model, turn <> 1 AS called FROM pairs"""))
def _(spark, d):
    p = pairs(spark, d).select("conv_id", "turn", F.when(F.col("turn") == 1, F.lit(" NaN ")).otherwise(F.col("ref")).alias("source_text"))
    ledger = Ledger(spark, work_dir(spark) + "-ledger")
    call = lambda df: ledger.predict(df, lambda b: [t.lower() for t in b["source_text"]], ["source_text"])
    return predict.skip_or_call(p, call).drop("source_text")


@query("predict_column", sql("pairs", """SELECT conv_id, turn, CASE WHEN turn = 2 THEN '(error: no answer)' ELSE upper(replace(trim(ref), 'ß', 'ss')) END AS hyp FROM pairs"""))
def _(spark, d):
    def model(batch: pd.DataFrame) -> list[str]:
        if (batch["turn"] == 2).any():
            raise ValueError("no answer")
        return [f" {t.upper()} " for t in batch["ref"]]
    return predict.predict_column(pairs(spark, d).select("conv_id", "turn", "ref"), model, ["ref", "turn"], "hyp").drop("ref")


@query("model_ledger", sql("pairs", f"""SELECT conv_id, turn, config_id, hyp, (SELECT count(*) FROM (SELECT DISTINCT ref, config_id FROM runs)) AS calls FROM runs""", RUNS))
def _(spark, d):
    """Two steps ask for the same predictions; the second finds every answer in the ledger."""
    ledger = Ledger(spark, work_dir(spark) + "-ledger")
    grid = joins.config_grid(pairs(spark, d).select("conv_id", "turn", "ref"), CONFIGS)
    for _ in range(2):
        runs = ledger.predict(grid, _stub, ["ref", "config_id"], "hyp")
    return beside(runs.select("conv_id", "turn", "config_id", "hyp"), ledger.answers().agg(F.count(F.lit(1)).alias("calls")))


@query("manifest_predict", r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'first ' || lang WHEN doc_id % 3 = 1 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE '(no speech)' END AS source_phrase,
    CASE WHEN doc_id % 3 = 0 THEN 'hola ' || lang WHEN doc_id % 3 = 1 THEN lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) ELSE '' END AS translated_text_model FROM documents""")
def _(spark, d):
    i = F.col("doc_id") % 3
    m = table(spark, d, "documents").select("doc_id", "lang", F.when(i == 1, F.col("text")).when(i == 2, "  ").alias("transcript"), (i != 0).alias("has_audio"))
    ledger = Ledger(spark, work_dir(spark) + "-ledger")
    translate = lambda df: ledger.predict(df, lambda b: [t.lower() for t in b["source_phrase"]], ["source_phrase"])
    generate = lambda df: df.withColumn("answer", F.concat(F.lit("EN: first "), "lang", F.lit("\nes: hola "), "lang"))
    return predict.manifest_predict(m, "transcript", translate, generate).select("doc_id", "source_phrase", "translated_text_model")


# --- gates -------------------------------------------------------------------

def _metrics(spark, d):
    """One row of corpus metrics over all pairs."""
    p = pairs(spark, d).withColumn("config_id", F.lit("stub"))
    return scoring.validation_table(p).select("bleu", "chrf", F.col("exact_match").alias("exact_match_accuracy"))


METRIC_ROWS = [*BLEU_PAIRS, *chrf_ctes("pairs", KEY), f"""mr AS (SELECT 'bleu' AS metric, bleu AS value, 1.0 AS minimum FROM ({bleu_sql('')}) UNION ALL SELECT 'chrf', chrf, 5.0 FROM ({chrf_sql('')})
    UNION ALL SELECT 'exact_match_accuracy', avg({HIT}), 0.0 FROM pairs)"""]


@query("gates", sql("pairs", "SELECT metric, round(value, 6) AS value, CAST(minimum AS DOUBLE) AS minimum, value >= minimum AS ok FROM mr", *METRIC_ROWS))
def _(spark, d):
    return rounded(gates.quality_gate(_metrics(spark, d)))


@query("gates_from_report", sql("pairs", "SELECT kind, metric, round(value, 6) AS value, CAST(minimum AS DOUBLE) AS minimum, value >= minimum AS ok FROM mr, (VALUES ('metrics'), ('configs'), ('flat')) k(kind)", *METRIC_ROWS))
def _(spark, d):
    # the same metrics in the three shapes of a report, written once and read back
    row = F.struct("bleu", "chrf", "exact_match_accuracy")
    m = spark.read.parquet(tables.write_table(_metrics(spark, d), f"{work_dir(spark)}.parquet"))
    shapes = {"metrics": m.select(row.alias("metrics")), "configs": m.select(F.array(row).alias("configs")), "flat": m}
    return rounded(reduce(DataFrame.unionByName, [gates.quality_gate(gates.report_metrics(r)).withColumn("kind", F.lit(k)) for k, r in shapes.items()]))


@query("baseline_diff", sql("pairs", "SELECT metric, round(value, 6) AS value, CAST(b AS DOUBLE) AS baseline, value < b AS regressed FROM mr JOIN (VALUES ('bleu', 1.0), ('chrf', 99.0), ('exact_match_accuracy', 0.0)) v(metric, b) USING (metric)", *METRIC_ROWS))
def _(spark, d):
    base = spark.createDataFrame([("bleu", 1.0), ("chrf", 99.0), ("exact_match_accuracy", 0.0)], "metric string, value double")
    return rounded(gates.baseline_diff(gates.long_metrics(_metrics(spark, d)), base))


@query("rollback_gate", sql("pairs", "SELECT count(*) FILTER (WHERE value < b) AS regressed, count(*) FILTER (WHERE value < b) = 0 AS ok FROM mr JOIN (VALUES ('bleu', 1.0), ('chrf', 99.0), ('exact_match_accuracy', 0.0)) v(metric, b) USING (metric)", *METRIC_ROWS))
def _(spark, d):
    base = spark.createDataFrame([("bleu", 1.0), ("chrf", 99.0), ("exact_match_accuracy", 0.0)], "metric string, value double")
    return gates.rollback_gate(gates.long_metrics(_metrics(spark, d)), base)


@query("bias_gate", sql("pairs", "SELECT n AS disparities, CASE WHEN n = 0 THEN 'pass' WHEN n <= 2 THEN 'warn' ELSE 'fail' END AS verdict FROM (SELECT count(*) AS n FROM gp WHERE gap > 0.02)", *BLEU_PAIRS, GROUPS))
def _(spark, d):
    return gates.bias_gate(fairness.disparities(_groups(spark, d), threshold=0.02))


@query("search_gate", sql("pairs terms", """SELECT config_id, round(score, 6) AS score, score >= 40 AS meets_target, g AS glossary, score < 40 AS fails_score, g < 0.95 AS fails_glossary, NOT (score < 40 OR g < 0.95) AS ok
    FROM (SELECT * FROM found ORDER BY round(score, 9) DESC, ord LIMIT 1), (SELECT round(count(*) FILTER (WHERE kept) / CAST(count(*) AS DOUBLE), 4) AS g FROM hits)""", *RUN_BLEU, SEARCH, HITS))
def _(spark, d):
    best = predict.best_config(_search(spark, d))
    share = glossary.glossary_enforcement(pairs(spark, d), terms(spark, d)).select(F.col("enforcement").alias("glossary"))
    return rounded(gates.search_gate(beside(best, share)))


@query("stage_status", """SELECT CAST(sum(toxic) AS BIGINT) AS failed, count(*) AS total, sum(toxic) = 0 AS strict_ok, NOT (sum(toxic) = count(*)) AS lenient_ok FROM labels""")
def _(spark, d):
    stage = table(spark, d, "labels").groupBy("quality").agg(F.sum("toxic").alias("failed"), F.count(F.lit(1)).alias("total"))
    return gates.stage_status(stage)
