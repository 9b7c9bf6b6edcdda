"""The operators bound to the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.llm.store import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# --- 10: near duplicates ------------------------------------------------------

_SETS = r"""words AS (SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words)"""


@query("op10_near_duplicates", f"""
  WITH RECURSIVE {_SETS},
  grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
            WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
  least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from parley.llm.near_dup import Join, near_duplicates
    return near_duplicates(table(spark, folder, "documents"), Join(percent=85))


# --- 1: packing ---------------------------------------------------------------

@query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    from parley.llm.packing import packed
    return packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


# --- 3: quality rules ---------------------------------------------------------

_RULES = r"""w AS (SELECT doc_id, source, COALESCE(text, '') AS t, list_filter(string_split_regex(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
      FROM documents),
  lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM w),
  grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
  twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) v(k) GROUP BY doc_id),
  m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, COALESCE(n, 0) AS n_repeat_words
      FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
  b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
  fails AS (SELECT source, unnest(['few_words', 'repeated_words', 'symbols', 'repeated_lines', 'word_length']) AS rule,
      unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words, 100 * n_symbols > 10 * n_words, 100 * n_dup_lines > 2 * n_words,
              word_chars < 3 * n_words OR word_chars > 10 * n_words]) AS failed FROM b WHERE source IS NOT NULL),
  hosts AS (SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS f FROM fails GROUP BY source, rule),
  sums AS (SELECT rule, count(*) AS k, sum(n) AS t, sum(n * n) AS q, sum(f) AS s, sum(f * f / n) AS e FROM hosts GROUP BY rule),
  spread AS (SELECT *, s / t AS mean, CASE WHEN k > 1 THEN (e - s * s / t) / (k - 1) END AS between_hosts,
      CASE WHEN t > k THEN (s - e) / (t - k) END AS within_hosts FROM sums),
  prior AS (SELECT rule, mean, CASE WHEN between_hosts > within_hosts
      THEN (t - q / t) / (k - 1) * within_hosts / (between_hosts - within_hosts) END AS weight FROM spread),
  rates AS (SELECT source, mean, n + COALESCE(weight, 0) AS size, COALESCE((f + weight * mean) / (n + weight), mean) AS rate
      FROM hosts JOIN prior USING (rule)),
  bad AS (SELECT DISTINCT source FROM rates WHERE rate > 0.5 
      OR (rate - 3 * sqrt(rate * (1 - rate) / (size + 1)) > 0.1 AND rate * (1 - mean) > 4 * mean * (1 - rate)))"""


@query("op3_host_rules", f"""WITH {_RULES}
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
         NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM b""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from parley.llm.rules import judged
    return judged(table(spark, folder, "documents")).drop("host")


# --- 4: BPE -------------------------------------------------------------------

@query("op4_bpe_round_trip")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    from parley.llm.bpe import Vocabulary, round_trip
    rows = round_trip(table(spark, folder, "documents"), Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json")))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


# --- 8: WARC ------------------------------------------------------------------

_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {s}) & 31 AS INTEGER) + 1, 1)"
                       for g in range(8) for s in (15, 10, 5, 0))


@query("op8_warc_salvage", f"""
  WITH p AS (SELECT page_id, COALESCE(html, '') AS b FROM pages), d AS (SELECT page_id, CAST(strlen(b) AS BIGINT) AS n, sha1(b) AS h FROM p),
  e AS (SELECT page_id, n, {_LETTERS} AS digest, max(page_id) OVER (PARTITION BY h, n) AS best FROM d)
  SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
         CASE WHEN page_id <> best THEN best END AS refers_to FROM e""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from parley.llm.warc import page_records, read_archives, verdicts, write_archives
    files = write_archives(verdicts(table(spark, folder, "pages")))
    records, _ = read_archives(files, payloads=False)
    return page_records(kept(records, "records"))


# --- 9: repeated strings ------------------------------------------------------

@query("op9_suffix_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from parley.llm.repeats import letters, without_repeats
    return without_repeats(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("rest", 256).alias("kept_sha256"), letters(F.col("rest")).alias("text"))


# --- 2: language-model scores -------------------------------------------------

@query("op2_pitman_yor")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from parley.llm.pitman_yor import scored
    return scored(table(spark, folder, "documents"))


# --- 5: quality classifier ----------------------------------------------------

@query("op5_attention_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from parley.llm.mil import scored
    return scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


# --- 7: nearest neighbours ----------------------------------------------------

@query("op7_nn_descent")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from parley.llm.nn_descent import neighbours
    return neighbours(table(spark, folder, "embeddings"), lambda i: i % 20 == 0)


# --- 6: main text of pages ----------------------------------------------------

@query("op6_dom_content")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from parley.llm.dom_content import extracted
    return extracted(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


# --- 11: sharding -------------------------------------------------------------

# The checksum byte by byte with its table of 256 values made by rule; the jumps in 128-bit numbers.
_SHARDS = """t AS (SELECT list_transform(range(256), lambda v: list_reduce(range(8), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), v)) AS crc),
  b AS (SELECT doc_id, COALESCE(text, '') AS x FROM documents),
  c AS (SELECT doc_id, CAST(strlen(x) + 1 AS BIGINT) AS size, xor(list_reduce(range(strlen(x)), lambda a, i:
      xor(a >> 8, crc[(xor(a, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
      FROM (SELECT doc_id, x, hex(x) AS h FROM b), t)"""


def _jump_sql(shards: int) -> str:
    return f"""CAST(list_reduce(range({shards}), lambda a, k: CASE WHEN a[3] >= {shards} THEN a ELSE
      list_transform([(a[1] * 2862933555777941757 + 1) % 18446744073709551616],
        lambda s: [s, a[3], CAST(floor((a[3] + 1) * (2147483648.0::DOUBLE / CAST((s >> 33) + 1 AS DOUBLE))) AS HUGEINT)])[1] END,
      [CAST(doc_id AS HUGEINT), 0::HUGEINT, 0::HUGEINT])[2] AS INTEGER)"""


@query("op11_jump_shards", f"""WITH {_SHARDS}
  SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard
  FROM (SELECT *, {_jump_sql(16)} AS shard, {_jump_sql(17)} AS grown_shard FROM c)""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from parley.llm.sharding import sharded
    return sharded(table(spark, folder, "documents"))


# --- 12: repeating words ------------------------------------------------------

@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from parley.llm.periodic import periodic_runs, with_periods
    docs = table(spark, folder, "documents")
    rows = periodic_runs(docs.select("doc_id", with_periods(F.col("text"), F.col("doc_id")).alias("text")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return rows.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.encode(listed, "utf-8"), 256).alias("runs_sha256"),
                       F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"))


# --- 13: ranked search --------------------------------------------------------

_TERMS = (r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


@query("op13_ranked_search", f"""
  WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
  total AS (SELECT count(*) FILTER (len(w) > 0) AS documents, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
  tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
  w AS (SELECT t, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY t, documents),
  q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
  s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // terms)))) AS BIGINT) AS score
        FROM q JOIN tf USING (t) JOIN w USING (t), total GROUP BY ALL)
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0 QUALIFY rank <= 50""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from parley.llm.ranked import ranked
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
