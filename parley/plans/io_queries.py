"""Sources and sinks: tables are written to the work folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import predict
from parley.plans.base import file_meta, manifest, query, rounded, sql, table
from parley.session import work_dir
from parley.sources import manifests, media, reports, tables

DOCS = "SELECT doc_id, text, lang, source, n_chars FROM documents"
DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@query("read_eval_table", "SELECT 'csv' AS kind, * FROM documents UNION ALL SELECT 'parquet', * FROM documents UNION ALL SELECT 'json', * FROM documents")
def _(spark, d):
    docs, out = table(spark, d, "documents"), None
    for kind in ("csv", "parquet", "json"):
        path = tables.write_table(docs, f"{work_dir(spark)}.{kind}", kind)
        back = tables.read_eval_table(spark, path, ["text", "lang"], DOC_SCHEMA).select(F.lit(kind).alias("kind"), *docs.columns)
        out = back if out is None else out.unionByName(back)
    return out


@query("first_existing", "SELECT 'second/inputs.csv' AS found, lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    root = work_dir(spark)
    docs = table(spark, d, "documents")
    tables.write_table(docs.select("doc_id", "lang"), f"{root}/second/inputs.csv", "csv")
    tables.write_table(docs.select("doc_id", "lang"), f"{root}/third/inputs.parquet")
    path = tables.first_existing(spark, [f"{root}/first", f"{root}/second", f"{root}/third"], "inputs", [".parquet", ".csv"])
    found = tables.read_eval_table(spark, path, ["lang"], "doc_id BIGINT, lang STRING")
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("found", F.lit(path.removeprefix(f"{root}/")))


@query("read_manifests", sql("manifest", "SELECT split, file, dataset, speaker_id, emotion, duration_sec FROM manifest"))
def _(spark, d):
    # dev and test hold one entry per line, holdout holds {"items": [...]} documents of bounded size
    root, m = work_dir(spark), manifest(spark, d)
    entry = ["file", "dataset", "speaker_id", "emotion", "duration_sec"]
    for s in ("dev", "test"):
        m.filter(F.col("split") == s).select(*entry).write.json(f"{root}/{s}")
    hold = m.filter("split = 'holdout'").groupBy(F.floor(F.col("doc_id") / 1000).alias("part"))
    hold.agg(F.collect_list(F.struct(*entry)).alias("items")).select("items").write.json(f"{root}/holdout")
    return manifests.read_manifests(spark, root, multiline=False).select("split", *entry)


@query("read_phrases", """SELECT 'say ' || doc_id AS source_text, lang AS source_language, 'es' AS target_language,
    CASE WHEN doc_id % 7 = 6 THEN 'a "q", ' || source ELSE source || repeat(',,x', CAST(doc_id % 24 AS INT)) END AS reference_translation,
    CASE WHEN doc_id % 7 = 6 THEN CAST(0 AS BIGINT) ELSE doc_id % 24 * 2 END AS overflow FROM documents""")
def _(spark, d):
    # rows of 4 to 50 fields with empty ones among them, quoted fields with doubled quotes, a header per file and empty rows
    more = F.concat("source", F.expr("repeat(',,x', cast(doc_id % 24 as int))"))
    tail = F.when(F.col("doc_id") % 7 == 6, F.concat(F.lit('"a ""q"", '), "source", F.lit('"'))).otherwise(more)
    line = F.concat_ws(",", F.concat(F.lit("say "), F.col("doc_id").cast("string")), "lang", F.lit("es"), tail)
    lines = table(spark, d, "documents").select(line.alias("value"))
    header = table(spark, d, "region").select(F.lit("source_text,source_language,target_language,reference_translation").alias("value"))
    empty = table(spark, d, "region").select(F.lit(",,,").alias("value"))
    path = f"{work_dir(spark)}.csv"
    header.unionByName(lines).unionByName(empty).write.text(path)
    return rounded(manifests.read_phrases(spark, path))


@query("read_glossary", "SELECT lower(trim(text)) AS term, 'bench' AS category FROM benchmark")
def _(spark, d):
    path = work_dir(spark)
    term = F.struct(F.concat(F.lit("  "), F.col("text")).alias("term"), F.lit("bench").alias("category"))
    blank = F.struct(F.lit("  ").alias("term"), F.lit("bench").alias("category"))
    docs = table(spark, d, "benchmark").select(F.to_json(F.struct(F.array(term, blank).alias("terms"))).alias("value"))
    docs.unionByName(docs.select(F.lit("{broken").alias("value"))).write.text(path)
    return manifests.read_glossary(spark, path, multiline=False).select("term", "category")


@query("write_table", "SELECT doc_id, text, lang FROM documents WHERE lang <> 'en'")
def _(spark, d):
    path = tables.write_table(table(spark, d, "documents").select("doc_id", "text", "lang"), f"{work_dir(spark)}.parquet", partition_by=["lang"])
    return tables.read_eval_table(spark, path, ["text"]).filter("lang <> 'en'").select("doc_id", "text", F.col("lang").cast("string"))


@query("write_if_absent", "SELECT 'kept' AS run, count(*) AS n FROM documents UNION ALL SELECT 'refreshed', count(*) FROM labels")
def _(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    kept, fresh = work_dir(spark), work_dir(spark)
    for path, refresh in ((kept, False), (fresh, True)):
        tables.write_if_absent(docs, path)
        tables.write_if_absent(labels, path, refresh)
    count = lambda path, run: spark.read.parquet(path).agg(F.lit(run).alias("run"), F.count(F.lit(1)).alias("n"))
    return count(kept, "kept").unionByName(count(fresh, "refreshed"))


@query("write_report", sql("manifest", "SELECT emotion, count(*) AS n FROM manifest GROUP BY 1"))
def _(spark, d):
    report = manifest(spark, d).groupBy("emotion").agg(F.count(F.lit(1)).alias("n"))
    return spark.read.schema("emotion STRING, n BIGINT").json(reports.write_report(report, work_dir(spark)))


@query("write_schema", sql("meta", """SELECT 'doc_id,path,sample_rate,channels,duration_sec,format,emotion' AS fields, CAST(0.5 AS DOUBLE) AS min_duration,
    count(*) FILTER (WHERE duration_sec < 0.5) AS under FROM meta"""))
def _(spark, d):
    path = reports.write_schema(file_meta(spark, d), work_dir(spark), min_duration=0.5, max_duration=30.0)
    doc = spark.read.text(path)
    names = F.transform(F.from_json(F.get_json_object("value", "$.schema.fields"), "array<struct<name: string, type: string>>"), lambda f: f["name"])
    low = F.get_json_object("value", "$.bounds.min_duration").cast("double")
    bounds = file_meta(spark, d).agg(F.count_if(F.col("duration_sec") < 0.5).alias("under"))
    from parley.operators.beside import beside
    return beside(doc.select(F.array_join(names, ",").alias("fields"), low.alias("min_duration")), bounds)


@query("lookup_prediction", """WITH p AS (SELECT doc_id, doc_id % 400 AS file, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS config_id, doc_id % 3 AS root_rank FROM documents)
    SELECT 'doc_' || file AS file, config_id, 'said ' || doc_id AS translated_text_model FROM p
    QUALIFY row_number() OVER (PARTITION BY file ORDER BY CASE config_id WHEN 'a' THEN 0 ELSE 1 END, root_rank, doc_id) = 1""")
def _(spark, d):
    i = F.col("doc_id")
    preds = table(spark, d, "documents").select(
        F.concat(F.lit("doc_"), (i % 400).cast("string")).alias("file"), F.when(i % 2 == 0, "a").otherwise("b").alias("config_id"),
        (i % 3).alias("root_rank"), i.alias("pos"), F.concat(F.lit(" said "), i.cast("string"), F.lit(" ")).alias("translated_text_model"))
    best = preds.agg(F.max("config_id").alias("config_id"))
    return tables.lookup_prediction(preds, config="a", best=best)


@query("scan_media", """SELECT CASE WHEN dataset = '' THEN 'none' ELSE dataset END AS dataset, CAST(sum(n) AS BIGINT) AS bytes
    FROM (SELECT COALESCE(regexp_extract(url, '//([^/]+)/', 1), '') AS dataset, strlen(COALESCE(html, '')) + 1 AS n FROM pages) GROUP BY 1""")
def _(spark, d):
    # the pages as text files, a folder per host; every row ends with one line end
    host = F.coalesce(F.regexp_extract("url", "//([^/]+)/", 1), F.lit(""))
    pages = table(spark, d, "pages").select(F.when(host == "", "none").otherwise(host).alias("dataset"), F.coalesce("html", F.lit("")).alias("value"))
    path = work_dir(spark)
    pages.write.partitionBy("dataset").text(path)
    found = media.scan_media(spark, path, media.TEXT)
    return found.groupBy(F.regexp_extract("path", "dataset=([^/]+)/", 1).alias("dataset")).agg(F.sum("length").alias("bytes"))


FILES = """files AS (SELECT page_id, regexp_extract(url, '//([^/]+)/', 1) AS dataset, CASE page_id % 5 WHEN 0 THEN 'a/b.WAV' WHEN 1 THEN 'pack.tar.gz' WHEN 2 THEN '.gitkeep' WHEN 3 THEN '._x.wav' ELSE 'notes.md' END AS path FROM pages)"""


def _files(spark, d):
    k = F.col("page_id") % 5
    path = F.when(k == 0, "a/b.WAV").when(k == 1, "pack.tar.gz").when(k == 2, ".gitkeep").when(k == 3, "._x.wav").otherwise("notes.md")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)/", 1).alias("dataset"), path.alias("path"))


@query("inventory", sql("", """SELECT dataset, CAST(COALESCE(files, 0) AS BIGINT) AS files, CAST(COALESCE(media, 0) AS BIGINT) AS media, CAST(COALESCE(archives, 0) AS BIGINT) AS archives,
    CASE WHEN COALESCE(files, 0) = 0 THEN 'empty' WHEN media > 0 THEN 'media' WHEN archives > 0 THEN 'archives' ELSE 'other' END AS status
    FROM (SELECT DISTINCT dataset FROM files UNION SELECT DISTINCT source FROM documents) e LEFT JOIN (
      SELECT dataset, count(*) FILTER (WHERE page_id % 5 IN (0, 1, 4)) AS files, count(*) FILTER (WHERE page_id % 5 IN (0, 3)) AS media, count(*) FILTER (WHERE page_id % 5 = 1) AS archives FROM files GROUP BY 1) USING (dataset)""", FILES))
def _(spark, d):
    files = _files(spark, d)
    expected = files.select("dataset").unionByName(table(spark, d, "documents").select(F.col("source").alias("dataset")))
    return media.inventory(files, expected)


@query("verify_checksums", """SELECT page_id, sha256(html) AS sha256, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN sha256(html) ELSE sha256('x' || html) END AS expected,
    CASE WHEN page_id % 3 = 0 THEN 'unchecked' WHEN page_id % 3 = 1 THEN 'ok' ELSE 'mismatch' END AS status FROM pages""")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("html").alias("content"))
    k = F.col("page_id") % 3
    known = p.filter(k != 0).select("page_id", F.sha2(F.when(k == 1, F.col("content")).otherwise(F.concat(F.lit("x"), "content")), 256).alias("sha256"))
    return media.verify_checksums(p, known, "page_id")


@query("count_by_top_dir", r"SELECT regexp_extract(url, '//[^/]+/([^/?#]+)', 1) AS top, count(*) AS n FROM pages GROUP BY 1")
def _(spark, d):
    return media.count_by_top_dir(table(spark, d, "pages").select(F.regexp_replace(F.regexp_extract("url", r"//[^/]+/(.*)", 1), r"[?#].*", "").alias("path")))


@query("select_sources", """SELECT source AS name, CASE WHEN min(doc_id) % 2 = 0 THEN 'http://' || source END AS url, min(doc_id) % 2 = 0 AS available FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY 1
    UNION ALL SELECT lang, NULL, FALSE FROM documents WHERE lang = 'en' GROUP BY 1""")
def _(spark, d):
    docs = table(spark, d, "documents")
    first = docs.groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("k"))
    a = first.select("name", F.when(F.col("k") % 2 == 0, F.concat(F.lit("http://"), "name")).alias("url"))
    b = docs.select(F.col("lang").alias("name")).distinct().withColumn("url", F.lit(None).cast("string"))
    return media.select_sources([a, b], ["src1", "src2", "src3", "en"])


@query("latest_report", "SELECT split, file, n FROM (SELECT CASE WHEN lang = 'fr' THEN 'dev' ELSE 'test' END AS split, source AS file, count(*) AS n FROM documents GROUP BY 1, 2) ORDER BY CASE split WHEN 'dev' THEN 0 ELSE 1 END, file LIMIT 1")
def _(spark, d):
    docs = table(spark, d, "documents")
    found = docs.groupBy(F.when(F.col("lang") == "fr", "dev").otherwise("test").alias("split"), F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return reports.latest_report(found, ["dev", "test", "holdout"], "split", "file")


@query("log_metrics", """WITH m AS (SELECT source, avg(n_chars) AS mean_chars, CAST(max(n_chars) AS DOUBLE) AS max_chars FROM documents GROUP BY 1)
    SELECT source, 'mean_chars' AS key, round(mean_chars, 6) AS value FROM m UNION ALL SELECT source, 'max_chars', max_chars FROM m""")
def _(spark, d):
    m = table(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean_chars"), F.max("n_chars").alias("max_chars"))
    path = reports.append_metrics(reports.log_metrics(m, ["source"], ["mean_chars", "max_chars"]), work_dir(spark))
    return rounded(spark.read.parquet(path))


@query("log_run", """WITH m AS (SELECT source, min(lang) AS lang, avg(n_chars) AS mean_chars, avg(CASE WHEN lang = 'de' THEN n_chars END) AS german_chars FROM documents GROUP BY 1)
    SELECT source, 'param' AS kind, 'lang' AS key, lang AS text, CAST(NULL AS DOUBLE) AS value FROM m UNION ALL SELECT source, 'metric', 'mean_chars', NULL, round(mean_chars, 6) FROM m
    UNION ALL SELECT source, 'metric', 'german_chars', NULL, round(german_chars, 6) FROM m""")
def _(spark, d):
    german = F.avg(F.when(F.col("lang") == "de", F.col("n_chars"))).alias("german_chars")
    m = table(spark, d, "documents").groupBy("source").agg(F.min("lang").alias("lang"), F.avg("n_chars").alias("mean_chars"), german)
    path = reports.append_metrics(reports.log_run(m, ["source"], ["lang"], ["mean_chars", "german_chars"]), work_dir(spark))
    return rounded(spark.read.parquet(path))


@query("load_configs", """SELECT source AS config_id, 'vertex-ai' AS provider, 'model-' || source AS model_name, 'base' AS prompt_template_id, CAST(NULL AS VARCHAR) AS system_prompt_id,
    round(count(*) / CAST(1000 AS DOUBLE), 6) AS temperature, CAST(0.5 AS DOUBLE) AS top_p, CAST(256 AS BIGINT) AS max_output_tokens FROM documents GROUP BY source""")
def _(spark, d):
    path = work_dir(spark)
    n = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    text = F.format_string("id: %s\nmodel_name: \"model-%s\"  # stub\nprompt_template_id: base\ntemperature: %s\n", "source", "source", (F.col("n") / 1000).cast("string"))
    # one file per config: the text sink writes a file per partition value
    n.select("source", text.alias("value")).write.partitionBy("source").option("lineSep", "\n").text(path)
    return rounded(predict.load_configs(spark, path, {"top_p": 0.5}, pattern="*.txt"))
