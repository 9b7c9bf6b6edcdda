"""Manifests, phrase books and glossaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.functions.labels import split_from_path
from parley.functions.text import norm_text

ENTRY = "file STRING, dataset STRING, speaker_id STRING, emotion STRING, label STRING, duration_sec DOUBLE"
PHRASE_COLUMNS = 4


def read_manifests(spark: SparkSession, root: str, multiline: bool = True, name: str = "*.json") -> DataFrame:
    """Manifest entries of all splits under ``root/<split>/``, as lists of entries or ``{"items": [...]}``.

    The split comes from the folder.  Folders that are not there add nothing.  ``multiline`` reads
    one JSON document per file; with JSON lines the files can be split between tasks.
    """
    docs = (
        spark.read.schema(f"{ENTRY}, items ARRAY<STRUCT<{ENTRY.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE')}>>")
        .option("multiLine", multiline).option("recursiveFileLookup", True).option("pathGlobFilter", name)
        .json(root)
        .withColumn("split", split_from_path(F.col("_metadata.file_path")))
    )
    single = F.struct(*[F.col(f.split()[0]) for f in ENTRY.split(", ")])
    entries = F.when(F.col("items").isNotNull(), F.col("items")).otherwise(F.array(single))
    return docs.select("split", F.explode(entries).alias("e")).select("split", "e.*")


PHRASE_NAMES = ("source_text", "source_language", "target_language", "reference_translation")
# One field and the comma before it; a quoted field holds commas, and doubled quotes stand for one.
_FIELD = r',("(?:[^"]++|"")*+"|[^,]*)'


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Phrase book of four columns; fields beyond the fourth are an unquoted comma in the last one and are joined back.

    Any number of fields, empty ones among them, comes back as it was.  Rows with nothing in them and the header
    row are dropped; ``overflow`` counts the extra fields of a row.
    """
    fields = F.regexp_extract_all(F.concat(F.lit(","), "value"), F.lit(_FIELD), 1)
    rows = spark.read.text(path).select(F.transform(fields, lambda f: F.when(
        f.startswith('"') & f.endswith('"') & (F.length(f) > 1), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)).alias("f"))
    head = [F.nullif(F.get("f", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(PHRASE_NAMES[:-1])]
    last = F.nullif(F.array_join(F.slice("f", PHRASE_COLUMNS, F.greatest(F.size("f"), F.lit(1))), ","), F.lit("")).alias(PHRASE_NAMES[-1])
    header = F.col("f") == F.array(*[F.lit(n) for n in PHRASE_NAMES])
    return rows.filter(~header).select(*head, last, F.greatest(F.size("f") - PHRASE_COLUMNS, F.lit(0)).alias("overflow")).dropna("all", subset=list(PHRASE_NAMES))


def read_glossary(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Terms in trimmed lower case; blanks and malformed files give nothing."""
    schema = "terms ARRAY<STRUCT<term: STRING, pronunciation: STRING, category: STRING, definition: STRING>>"
    docs = spark.read.schema(schema).option("multiLine", multiline).json(path)
    terms = docs.select(F.explode("terms").alias("t")).select(norm_text(F.col("t.term")).alias("term"), "t.category", "t.definition")
    return terms.filter(F.coalesce(F.col("term"), F.lit("")) != "")
