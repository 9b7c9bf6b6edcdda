"""Registry of queries, and the test tables seen as manifests, pairs, word streams and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.functions.text import SPACE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# --- views: Spark side -------------------------------------------------------

def micros_of(ts: Column) -> Column:
    """Microseconds since 1970; the tables hold timestamps without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    lang = F.col("lang")
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file"),
        F.col("source").alias("dataset"),
        lang.alias("emotion"),
        (F.col("doc_id") % 97).cast("string").alias("speaker_id"),
        (F.col("n_chars") / 200.0).alias("duration_sec"),
        F.when(lang == "en", "test").when(lang == "fr", "dev").otherwise("holdout").alias("split"),
    )


def known_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that exist: the labelled documents, and one more per label of a toxic one that no manifest lists."""
    docs = table(spark, folder, "documents").select("doc_id", F.lit(True).alias("_there"), "lang")
    lang = F.col("lang")
    split = F.when(lang == "en", "test").when(lang == "fr", "dev").otherwise("holdout")

    def file(prefix: str, split: Column) -> Column:
        return F.struct(split.alias("split"), F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("file"))

    found = F.array(F.when(F.col("_there"), file("doc_", split)), F.when(F.col("toxic") == 1, file("extra_", F.lit("dev"))))
    return table(spark, folder, "labels").join(docs, "doc_id", "left").select(F.explode(F.array_compact(found)).alias("f")).select("f.*")


def file_meta(spark: SparkSession, folder: str) -> DataFrame:
    """File metadata with wrong rates, stereo files and unreadable files planted by document number."""
    i = F.col("doc_id")
    return table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("doc_"), i.cast("string")).alias("path"),
        F.when(i % 11 == 0, 8000).when(i % 13 == 0, F.lit(None)).otherwise(16000).cast("int").alias("sample_rate"),
        F.when(i % 7 == 0, 2).otherwise(1).cast("int").alias("channels"),
        (F.col("n_chars") / 200.0).alias("duration_sec"),
        F.lit("WAV").alias("format"), F.col("lang").alias("emotion"),
    )


def without_first_word(c: Column) -> Column:
    return F.regexp_replace(c, rf"^\S+{SPACE}*", "")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Reference and hypothesis texts: each turn against a stub of itself or the turn after it."""
    c = table(spark, folder, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("_next"))
    kind = (F.col("conv_id") + F.col("turn")) % 3
    return c.join(after, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.col("role").alias("dataset"),
        F.concat(F.lit("mood"), (F.col("turn") % 4).cast("string")).alias("emotion"),
        F.col("text").alias("ref"),
        F.when(kind == 0, F.concat(F.lit("  "), "text")).when(kind == 1, without_first_word(F.col("text")))
        .otherwise(F.coalesce("_next", F.lit(""))).alias("hyp"),
    ).hint("rebalance")  # the metrics are bound by CPU: even partitions are worth one shuffle of the texts


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Word stream: one event is one word, errors are audio events, signups have no speaker, low values no text."""
    e = table(spark, folder, "events")
    start = micros_of(F.col("ts")) / 1e6
    return e.select(
        F.col("user_id").alias("session"), micros_of(F.col("ts")).alias("pos"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("speaker_id"),
        (F.col("event_type") == "error").alias("is_event"),
        F.when(F.col("value") < 5, "").otherwise(F.concat(F.lit("w"), F.col("event_id").cast("string"))).alias("text"),
        start.alias("start"), (start + F.col("value")).alias("end"), "event_id", "event_type", "value", "props",
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Audio chunks: energy from the value, length from the number in the properties."""
    k = F.regexp_extract("props", r"\d+", 0).cast("int")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("session"), micros_of(F.col("ts")).alias("seq"), F.col("value").alias("level"),
        ((k % 5 + 1) * F.lit(0.1)).alias("seconds"),
    )


def terms(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary: the words of the benchmark passages, and each passage's first 40 letters and spaces; terms of 1 to 40 letters."""
    low = F.lower("text")
    w = F.explode(F.concat(F.split(low, r"[^\p{L}]+"), F.array(F.regexp_extract(low, r"^[\p{L} ]{1,40}", 0))))
    return table(spark, folder, "benchmark").select(w.alias("term")).filter("term <> ''").distinct()


# --- views: SQL side ---------------------------------------------------------

VIEWS = {
    "manifest": """manifest AS (SELECT doc_id, 'doc_' || doc_id AS file, source AS dataset, lang AS emotion,
        CAST(doc_id % 97 AS VARCHAR) AS speaker_id, n_chars / CAST(200 AS DOUBLE) AS duration_sec,
        CASE lang WHEN 'en' THEN 'test' WHEN 'fr' THEN 'dev' ELSE 'holdout' END AS split FROM documents)""",
    "known": """known AS (
        SELECT CASE lang WHEN 'en' THEN 'test' WHEN 'fr' THEN 'dev' ELSE 'holdout' END AS split, 'doc_' || l.doc_id AS file
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id
        UNION ALL SELECT 'dev', 'extra_' || doc_id FROM labels WHERE toxic = 1)""",
    "meta": """meta AS (SELECT doc_id, 'doc_' || doc_id AS path,
        CASE WHEN doc_id % 11 = 0 THEN 8000 WHEN doc_id % 13 = 0 THEN NULL ELSE 16000 END AS sample_rate,
        CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS channels, n_chars / CAST(200 AS DOUBLE) AS duration_sec,
        lang AS emotion FROM documents)""",
    "pairs": r"""pairs AS (SELECT c.conv_id, c.turn, c.role AS dataset, 'mood' || (c.turn % 4) AS emotion, c.text AS ref,
        CASE (c.conv_id + c.turn) % 3 WHEN 0 THEN '  ' || c.text WHEN 1 THEN regexp_replace(c.text, '^\S+\s*', '')
        ELSE COALESCE(n.text, '') END AS hyp
        FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)""",
    "words": """words AS (SELECT user_id AS session, epoch_us(ts) AS pos,
        CASE WHEN event_type <> 'signup' THEN event_type END AS speaker_id, event_type = 'error' AS is_event,
        CASE WHEN value < 5 THEN '' ELSE 'w' || event_id END AS text,
        epoch_us(ts) / CAST(1e6 AS DOUBLE) AS start, epoch_us(ts) / CAST(1e6 AS DOUBLE) + value AS "end",
        event_id, event_type, value, props FROM events)""",
    "chunks": r"""chunks AS (SELECT user_id AS session, epoch_us(ts) AS seq, value AS level,
        (CAST(regexp_extract(props, '\d+') AS INT) % 5 + 1) * CAST(0.1 AS DOUBLE) AS seconds FROM events)""",
    "terms": r"""terms AS (SELECT DISTINCT term FROM (
        SELECT unnest(list_append(string_split_regex(lower(text), '[^\p{L}]+'), regexp_extract(lower(text), '^[\p{L} ]{1,40}'))) AS term FROM benchmark) WHERE term <> '')""",
}


def sql(views: str, body: str, *more: str) -> str:
    """A statement over named views (space separated) and further common table expressions."""
    parts = [VIEWS[v] for v in views.split()] + list(more)
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


# Words of a text, without white space in the Unicode sense, as SQL.
def sql_words(c: str) -> str:
    return rf"list_filter(string_split_regex(COALESCE({c}, ''), '\s+'), lambda w: w <> '')"


def sql_norm(c: str) -> str:
    return rf"lower(regexp_replace(COALESCE({c}, ''), '^\s+|\s+$', '', 'g'))"


def sql_tokens(c: str) -> str:
    """13a tokens of a text."""
    t = f"COALESCE({c}, '')"
    for old, new in (("<skipped>", ""), ("-' || chr(10) || '", ""), ("' || chr(10) || '", " "),
                     ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, '{old}', '{new}')"
    t = f"' ' || {t} || ' '"
    for pattern, new in ((r"([{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                         (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return sql_words(t)


def bleu_ctes(src: str, key: str, by: str = "") -> list[str]:
    """Common table expressions ``bleu_rows`` (per key) and ``bleu_sums`` (per group) over (key, by, ref, hyp) of ``src``."""
    group = f"{by}, " if by else ""
    n = "(VALUES (1), (2), (3), (4)) v(n)"
    gram = lambda side: (
        f"SELECT {key}, n, g, count(*) AS c FROM (SELECT {key}, n, unnest(list_transform(range(1, len({side}) - n + 2), "
        f"lambda i: array_to_string({side}[i:i + n - 1], ' '))) AS g FROM bleu_tok, {n}) GROUP BY ALL")
    join = " AND ".join(f"h.{k.strip()} = r.{k.strip()}" for k in key.split(","))
    keys = ", ".join(f"h.{k.strip()}" for k in key.split(","))
    return [
        f"bleu_tok AS (SELECT {key}, {group}{sql_tokens('ref')} AS r, {sql_tokens('hyp')} AS h FROM {src})",
        f"bleu_h AS ({gram('h')})", f"bleu_r AS ({gram('r')})",
        f"bleu_m AS (SELECT {keys}, h.n, sum(least(h.c, r.c)) AS m FROM bleu_h h JOIN bleu_r r ON {join} AND h.n = r.n AND h.g = r.g GROUP BY ALL)",
        f"bleu_long AS (SELECT {key}, {group}n, greatest(len(h) - n + 1, 0) AS t, len(h) AS hl, len(r) AS rl, COALESCE(m, 0) AS m "
        f"FROM bleu_tok CROSS JOIN {n} LEFT JOIN bleu_m USING ({key}, n))",
    ]


def bleu_sql(by: str, effective: bool = False) -> str:
    """Rows (by, n_rows, bleu) from ``bleu_long``."""
    group = f"{by}, " if by else ""
    over = f"PARTITION BY {by} ORDER BY n" if by else "ORDER BY n"
    orders = "sum(CASE WHEN t > 0 THEN 1 ELSE 0 END)" if effective else "4"
    complete = "TRUE" if effective else "min(t) > 0"
    tail = f"GROUP BY {by}" if by else ""
    return f"""SELECT {group} max(rows) AS n_rows, CASE WHEN sum(m) > 0 AND {complete} THEN
          CASE WHEN max(hl) < max(rl) THEN exp(1 - max(rl) / CAST(max(hl) AS DOUBLE)) ELSE 1 END
          * exp(sum(CASE WHEN t > 0 THEN ln(CASE WHEN m = 0 THEN 100 / (pow(2, z) * t) ELSE 100 * m / CAST(t AS DOUBLE) END) ELSE 0 END) / {orders})
        ELSE 0 END AS bleu
      FROM (SELECT *, sum(CASE WHEN m = 0 AND t > 0 THEN 1 ELSE 0 END) OVER ({over}) AS z FROM (
        SELECT {group} n, count(*) AS rows, CAST(sum(m) AS DOUBLE) AS m, CAST(sum(t) AS DOUBLE) AS t, sum(hl) AS hl, sum(rl) AS rl
        FROM bleu_long GROUP BY {group} n)) {tail}"""


def chrf_ctes(src: str, key: str, by: str = "") -> list[str]:
    """``chrf_long``: per key and order, matches and n-gram counts of both sides."""
    group = f"{by}, " if by else ""
    n = "(VALUES (1), (2), (3), (4), (5), (6)) v(n)"
    gram = lambda side: (
        f"SELECT {key}, n, g, count(*) AS c FROM (SELECT {key}, n, unnest(list_transform(range(1, length({side}) - n + 2), "
        f"lambda i: substr({side}, i, n))) AS g FROM chrf_tok, {n}) GROUP BY ALL")
    chars = lambda c: rf"regexp_replace(COALESCE({c}, ''), '\s', '', 'g')"
    join = " AND ".join(f"h.{k.strip()} = r.{k.strip()}" for k in key.split(","))
    keys = ", ".join(f"h.{k.strip()}" for k in key.split(","))
    return [
        f"chrf_tok AS (SELECT {key}, {group}{chars('ref')} AS r, {chars('hyp')} AS h FROM {src})",
        f"chrf_h AS ({gram('h')})", f"chrf_r AS ({gram('r')})",
        f"chrf_m AS (SELECT {keys}, h.n, sum(least(h.c, r.c)) AS m FROM chrf_h h JOIN chrf_r r ON {join} AND h.n = r.n AND h.g = r.g GROUP BY ALL)",
        f"chrf_long AS (SELECT {key}, {group}n, CASE WHEN length(r) >= n THEN greatest(length(h) - n + 1, 0) ELSE 0 END AS ht, "
        f"greatest(length(r) - n + 1, 0) AS rt, COALESCE(m, 0) AS m FROM chrf_tok CROSS JOIN {n} LEFT JOIN chrf_m USING ({key}, n))",
    ]


def chrf_sql(by: str) -> str:
    """Rows (by, chrf) from ``chrf_long``."""
    group, tail = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    both = "FILTER (WHERE ht > 0 AND rt > 0)"
    return f"""SELECT {group} CASE WHEN p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END AS chrf FROM (
        SELECT {group} COALESCE(avg(m / ht) {both}, 0) AS p, COALESCE(avg(m / rt) {both}, 0) AS r
        FROM (SELECT {group} n, CAST(sum(m) AS DOUBLE) AS m, CAST(sum(ht) AS DOUBLE) AS ht, CAST(sum(rt) AS DOUBLE) AS rt
              FROM chrf_long GROUP BY {group} n) {tail})"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and counts as BIGINT, so that both engines print the same."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            out[f.name] = F.round(F.col(f.name).cast("double"), digits)
        elif kind in ("integer", "short", "byte"):
            out[f.name] = F.col(f.name).cast("long")
    return df.withColumns(out) if out else df
