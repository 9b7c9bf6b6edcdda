"""Glossary terms inside texts: which occur in the reference, and which the hypothesis keeps.

Terms are matched as substrings of lower-cased text, by one way for every number of terms.  The terms are written once as small
files that Spark hands to the executors; a task builds an Aho-Corasick automaton of one shard of terms after the other, each of
bounded size, and lets its texts run past it.  What comes out are counts or hits of each row, so texts are neither
shuffled nor joined, and nothing is collected to the driver.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parley.session import work_dir

SHARD = 1 << 20  # bytes of terms in one automaton
ROWS = 2000  # rows of an Arrow batch whose texts are Python objects at a time
HITS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("kept", T.BooleanType())]))
COUNTS = T.StructType([T.StructField("terms", T.LongType()), T.StructField("kept", T.LongType())])
_built: dict[tuple, list[ahocorasick.Automaton]] = {}


def _automata(files: tuple[str, ...], shard: int) -> Iterator[ahocorasick.Automaton]:
    """The shards in turn; a glossary of one shard stays with the worker."""
    if files in _built:
        yield from _built[files]
        return
    made, found, size = 0, ahocorasick.Automaton(), 0
    for name in files:
        for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches():
            for term in batch.column("term").to_pylist():
                found.add_word(term, term)
                size += len(term.encode())
                if size >= shard:
                    found.make_automaton()
                    yield found
                    made, found, size = made + 1, ahocorasick.Automaton(), 0
    if size:
        found.make_automaton()
        if not made:
            _built.clear()
            _built[files] = [found]
        yield found


class Glossary:
    """Terms handed to the executors; ``hits`` and ``counts`` are columns over two text columns.

    ``terms`` has one lower-case column ``term``; null and empty ones are left out, repeated ones count once.  Any number of
    terms of any length will do: a task holds ``shard`` bytes of them at a time.
    """

    def __init__(self, terms: DataFrame, shard: int = SHARD):
        spark = terms.sparkSession
        path = work_dir(spark) + "-terms"
        terms.filter(F.col("term") != "").select("term").distinct().write.parquet(path)
        files = spark.read.schema("term string").parquet(path).inputFiles()
        for f in files:
            spark.sparkContext.addFile(f)
        self.files, self.shard = tuple(unquote(f.rsplit("/", 1)[1]) for f in files), shard

    def _each(self, ref: pa.Array, hyp: pa.Array) -> Iterator[tuple[int, set[str], str]]:
        """(row, terms of one shard in its reference, hypothesis), shard by shard; one row's terms are Python objects at a time."""
        for found in _automata(self.files, self.shard):
            for at in range(0, len(ref), ROWS):
                texts = zip(ref.slice(at, ROWS).to_pylist(), hyp.slice(at, ROWS).to_pylist(), strict=True)
                last, terms = None, set()
                for row, (r, h) in enumerate(texts, at):
                    if r != last:  # the texts of a grid follow each other with one reference
                        last, terms = r, {t for _, t in found.iter(r)}
                    yield row, terms, h

    def _hits(self, r: pa.Array, h: pa.Array) -> pa.Array:
        """The hits of each row; what is held of a hit is its row, the number of its term and one byte."""
        number: dict[str, int] = {}
        row, term, kept = array("i"), array("i"), bytearray()
        for i, terms, text in self._each(r, h):
            for t in terms:
                row.append(i)
                term.append(number.setdefault(t, len(number)))
                kept.append(t in text)
        rows = np.asarray(row, np.int32)
        by_row = np.argsort(rows, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(r)))]).astype(np.int32)
        hits = pa.StructArray.from_arrays([
            pa.array(list(number), pa.string()).take(pa.array(np.asarray(term, np.int32)[by_row])),
            pa.array(np.frombuffer(bytes(kept), np.bool_)[by_row])], ["term", "kept"])
        return pa.ListArray.from_arrays(pa.array(ends), hits)

    def hits(self, ref: str = "ref", hyp: str = "hyp") -> Column:
        """array<struct<term, kept>>: each distinct term of the reference, and whether the hypothesis has it."""
        hits = self._hits

        @F.arrow_udf(HITS)
        def found(r: pa.Array, h: pa.Array) -> pa.Array:
            return hits(r, h)  # the automata run once past a whole batch

        return found(_low(ref), _low(hyp))

    def counts(self, ref: str = "ref", hyp: str = "hyp") -> Column:
        """struct<terms, kept>: how many terms the reference has, and how many of them the hypothesis has."""
        each = self._each

        @F.arrow_udf(COUNTS)
        def counted(r: pa.Array, h: pa.Array) -> pa.Array:
            terms, kept = np.zeros((2, len(r)), np.int64)
            for i, some, text in each(r, h):
                terms[i] += len(some)
                kept[i] += sum(t in text for t in some)
            return pa.StructArray.from_arrays([pa.array(terms), pa.array(kept)], ["terms", "kept"])

        return counted(_low(ref), _low(hyp))


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def glossary_hits(df: DataFrame, terms: DataFrame, keys: Sequence[str], ref: str = "ref", hyp: str = "hyp", shard: int = SHARD) -> DataFrame:
    """One row per text and distinct term its reference holds, and whether the hypothesis keeps it; ``keys`` go along."""
    hits = Glossary(terms, shard).hits(ref, hyp)
    return df.select(*keys, ref, *{hyp} - {ref}).select(*keys, F.explode(hits).alias("_h")).select(*keys, "_h.*")


def glossary_counts(df: DataFrame, terms: DataFrame, ref: str = "ref", hyp: str = "hyp", shard: int = SHARD) -> DataFrame:
    """``df`` with ``terms`` in the reference and those ``kept`` by the hypothesis, per row."""
    return df.withColumn("_g", Glossary(terms, shard).counts(ref, hyp)).withColumns({"terms": F.col("_g.terms"), "kept": F.col("_g.kept")}).drop("_g")


def glossary_enforcement(df: DataFrame, terms: DataFrame, ref: str = "ref", hyp: str = "hyp", shard: int = SHARD) -> DataFrame:
    """Terms kept over terms occurring, summed over all rows; null when none occurs."""
    counts = df.select(Glossary(terms, shard).counts(ref, hyp).alias("g"))
    total = counts.agg(F.coalesce(F.sum("g.terms"), F.lit(0)).alias("terms"), F.coalesce(F.sum("g.kept"), F.lit(0)).alias("kept"))
    return total.withColumn("enforcement", F.when(F.col("terms") > 0, F.round(F.col("kept") / F.col("terms"), 4)))


def with_glossary_flag(df: DataFrame, terms: DataFrame, ref: str = "ref", shard: int = SHARD) -> DataFrame:
    """Add ``has_term``: the reference holds any term."""
    return df.withColumn("has_term", Glossary(terms, shard).counts(ref, ref)["terms"] > 0)


def glossary_guard(df: DataFrame, terms: DataFrame, keys: Sequence[str], ref: str = "ref", hyp: str = "hyp", shard: int = SHARD) -> DataFrame:
    """The terms an utterance lost in translation (a report; nothing is rewritten)."""
    return glossary_hits(df, terms, keys, ref, hyp, shard).filter(~F.col("kept")).drop("kept")
