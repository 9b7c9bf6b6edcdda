"""Ranked lexical search over an index of documents in strata of equal length normaliser.

Documents with one normaliser m form a stratum, cut into slices of bounded size.  In a slice the postings of a term lie by term
frequency, so an impact is worked out once for each frequency and stratum, not for each posting.  The highest frequency of a term
in a slice bounds what its documents can score.  Each query first goes to the slices with its highest bounds; what it
finds there is a floor for its last place, and of all slices only those whose bound reaches the floor are scored.

Normalisers follow the length of documents, so a range shuffle on length puts a stratum together and cuts a large one in parts of
equal size; no stratum, term or group of copies is one task's work.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from parley.llm.blocks import lower_ascii, pieces, raw, word_bounds
from parley.llm.store import kept, partitions

SLICE = 4096  # documents of a slice at most
SEEDS = 4  # slices that give a query its floor
BLOCK = 4 << 20  # bytes of query text that are searched for together; what is broadcast is bounded by it
NONE = -(1 << 63)  # stands for a null doc_id
PAIRS = 1 << 20  # postings in work at once
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a text column in order, A-Z lower-cased, and the first of each row with their number at the end."""
    data, offsets = raw(column)
    solid = _TERM[data]
    start, end, first = word_bounds(data, offsets, solid)
    places = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(lower_ascii(data[solid]))]), first


def impact(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def normaliser(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of each length; in whole numbers of any size, once for each length."""
    kinds, back = np.unique(n, return_inverse=True)
    return np.array([50 + 50 * int(k) * documents // total for k in kinds], np.int64)[back]


def _lists(values: np.ndarray, edge: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values, kind))


@dataclass
class Queries:
    """Some queries as numbers: the terms of query i are ``term[edge[i]:edge[i + 1]]``, numbered by ``vocabulary``."""

    ids: list
    vocabulary: pa.Array
    term: np.ndarray
    edge: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Queries:
        words, first = terms(pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(ids)), np.diff(first))
        pair = np.unique(row * (len(coded.dictionary) + 1) + code)
        row, code = pair // (len(coded.dictionary) + 1), pair % (len(coded.dictionary) + 1)
        return cls(ids, coded.dictionary, code, np.searchsorted(row, np.arange(len(ids) + 1)))

    def bounds(self, m: int, there: np.ndarray, top: np.ndarray) -> np.ndarray:
        """The most that a document with normaliser m can score for each query, given the highest frequency of each term."""
        most = np.zeros(len(self.vocabulary) + 1, np.int64)
        most[there] = self.weight[there] * impact(top, m)
        return np.diff(np.r_[0, np.cumsum(most[self.term])][self.edge])


def _bags(vocabulary: pa.Array):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                words, first = terms(part.column("text"))
                code = pc.index_in(words, value_set=vocabulary)
                known = np.flatnonzero(pc.is_valid(code).to_numpy(zero_copy_only=False))
                row = np.searchsorted(first, known, side="right") - 1
                key, tf = np.unique(row * len(vocabulary) + code.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
                edge = np.searchsorted(key, np.arange(part.num_rows + 1) * len(vocabulary))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(first).astype(np.int64)), _lists(key % max(len(vocabulary), 1), edge, pa.int32()),
                                                  _lists(tf, edge, pa.int32())], ["doc", "n", "terms", "tfs"])

    return run


def _frequencies(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            count += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(count[there])], ["term", "df"])

    return run


INDEX = "m long, docs array<bigint>, terms array<int>, top array<int>, group_term array<int>, group_tf array<int>, group_size array<int>, posting array<int>"


def _slices(documents: int, total: int, most: int):
    """Rows sorted by length as slices: runs of one normaliser, postings by term and falling frequency."""
    def one(t: pa.Table, m: int) -> pa.RecordBatch:
        lists, tfs = t.column("terms").combine_chunks(), t.column("tfs").combine_chunks()
        term, tf = lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(t.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        order = np.lexsort((doc, -tf, term))
        term, tf, doc = term[order], tf[order], doc[order]
        new = np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]
        head = np.flatnonzero(new)
        lead = head[np.r_[True, term[head][1:] != term[head][:-1]]]
        cols = [(term[lead], pa.int32()), (tf[lead], pa.int32()), (term[head], pa.int32()), (tf[head], pa.int32()),
                (np.diff(np.r_[head, len(term)]), pa.int32()), (doc, pa.int32())]
        arrays = [pa.array([m]), pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column("doc").combine_chunks())]
        return pa.RecordBatch.from_arrays([*arrays, *(_lists(v, np.array([0, len(v)]), k) for v, k in cols)], [x.split()[0] for x in INDEX.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, now = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = normaliser(batch.column("n").to_numpy(), documents, total)
            cut = np.flatnonzero(m[1:] != m[:-1]) + 1
            for a, b in zip(np.r_[0, cut], np.r_[cut, len(m)], strict=True):
                while a < b:
                    if held and (m[a] != now or rows >= most):
                        yield one(pa.Table.from_batches(held), int(now))
                        held, rows = [], 0
                    take = min(b - a, most - rows)
                    held.append(batch.slice(int(a), int(take)))
                    rows, now, a = rows + take, m[a], a + take
        if held:
            yield one(pa.Table.from_batches(held), int(now))

    return run


def _order(batch: pa.RecordBatch, q: Queries) -> list[tuple[int, np.ndarray]]:
    """Rows of a batch of the index with their bounds, highest first."""
    m, there, top = batch.column("m").to_numpy(), batch.column("terms"), batch.column("top")
    out = [(i, q.bounds(int(m[i]), there[i].values.to_numpy(), top[i].values.to_numpy().astype(np.int64))) for i in range(batch.num_rows)]
    return sorted(out, key=lambda r: -int(r[1].max(initial=0)))


def _seeds(held, top: int):
    """(query, bound, slice) of the highest bounds of a task, of slices with documents enough for a floor."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        best = np.zeros((0, len(q.ids)), np.int64)
        name = np.zeros((0, len(q.ids)), np.int64)
        for batch in batches:
            for i, bound in _order(batch, q):
                if batch.column("size")[i].as_py() < top:
                    continue
                best, name = np.vstack([best, bound]), np.vstack([name, np.full(len(bound), batch.column("slice")[i].as_py())])
                if len(best) > 4 * SEEDS:
                    first = np.argsort(-best, axis=0, kind="stable")[:SEEDS]
                    best, name = np.take_along_axis(best, first, 0), np.take_along_axis(name, first, 0)
        at, query = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(best[at, query]), pa.array(name[at, query])], ["query", "bound", "slice"])

    return run


def _scores(held, floor: np.ndarray, top: int):
    """(query, doc, score): of each task the best ``top`` for each query that reach its floor."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = held.value, np.maximum(floor, 1)
        found: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
        size = 0

        def pruned() -> np.ndarray:
            query, doc, score = np.concatenate(found, axis=1)
            order = np.lexsort((doc, -score, query))
            query, doc, score = query[order], doc[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            last = place == top - 1
            least[query[last]] = np.maximum(least[query[last]], score[last])
            return np.stack([query, doc, score])[:, place < top]

        for batch in batches:
            for i, bound in _order(batch, q):
                wanted = np.flatnonzero(bound >= least)
                if not len(wanted):
                    continue
                docs = batch.column("docs")[i].values.to_numpy(zero_copy_only=False)
                term, tf, many, posting = (batch.column(c)[i].values.to_numpy().astype(np.int64) for c in ("group_term", "group_tf", "group_size", "posting"))
                gain = q.weight[term] * impact(tf, int(batch.column("m")[i].as_py()))  # once for each term and frequency
                value = np.repeat(gain, many)
                edge = np.searchsorted(np.repeat(term, many), np.arange(len(q.vocabulary) + 1))
                length = np.diff(edge)
                work = np.r_[0, np.cumsum(length[q.term])][q.edge]
                step = max(1, PAIRS // len(docs))
                lo = 0
                while lo < len(wanted):
                    hi = lo + 1
                    cost = work[wanted[lo] + 1] - work[wanted[lo]]
                    while hi < len(wanted) and hi - lo < step and cost < PAIRS:
                        cost += work[wanted[hi] + 1] - work[wanted[hi]]
                        hi += 1
                    mine = wanted[lo:hi]
                    n = q.edge[mine + 1] - q.edge[mine]
                    t = q.term[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(q.edge[mine], n)]
                    row = np.repeat(np.arange(len(mine)), n)
                    k = length[t]
                    at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(edge[t], k)
                    score = np.zeros(len(mine) * len(docs), np.int64)
                    np.add.at(score, np.repeat(row, k) * len(docs) + posting[at], value[at])
                    hit = np.flatnonzero(score >= np.repeat(least[mine], len(docs)))
                    found.append(np.stack([mine[hit // len(docs)], docs[hit % len(docs)], score[hit]]))
                    size += len(hit)
                    lo = hi
                if size > 4 * top * len(q.ids):
                    found[:] = [pruned()]
                    size = found[0].shape[1]
        query, doc, score = pruned()
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(doc), pa.array(score)], ["query", "doc", "score"])

    return run


@dataclass
class Index:
    """Slices of all documents that have a term of the vocabulary, in the shared folder, and the counts of the whole corpus."""

    slices: DataFrame
    documents: int
    total: int
    frequency: np.ndarray


def build(docs: DataFrame, vocabulary: pa.Array, most: int = SLICE) -> Index:
    """The index of ``docs`` (doc long, text) over the terms of a vocabulary of bounded size; counts are over all documents.

    A slice has at most ``most`` documents."""
    spark = docs.sparkSession
    bags = docs.mapInArrow(_bags(vocabulary), "doc long, n long, terms array<int>, tfs array<int>").filter("n > 0")
    bags = kept(bags.withColumn("row", F.monotonically_increasing_id()), "bags")
    documents, total = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bags = bags.filter(F.size("terms") > 0)
    frequency = np.zeros(len(vocabulary), np.int64)
    for term, df in bags.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        frequency[term] = df
    by_length = bags.repartitionByRange(partitions(spark), "n", "row").sortWithinPartitions("n", "row").select("doc", "n", "terms", "tfs")
    slices = by_length.mapInArrow(_slices(documents, total, most), INDEX)
    slices = slices.withColumn("size", F.size("docs")).withColumn("slice", F.monotonically_increasing_id())
    return Index(kept(slices, "slices"), documents, total, frequency)


def _best(rows: DataFrame, top: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= top)


def search(index: Index, q: Queries, top: int = 50) -> DataFrame:
    """(query int, rank int, doc long, score long): of each query its ``top`` best documents with a score above 0."""
    spark = index.slices.sparkSession
    ratio = [(2 * index.documents + 2) / (2 * int(f) + 1) for f in index.frequency]
    q.weight = np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)
    held = spark.sparkContext.broadcast(q)
    seeds = index.slices.select("m", "terms", "top", "size", "slice").mapInArrow(_seeds(held, top), "query int, bound long, slice long")
    seeds = seeds.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "slice"))).filter(F.col("place") <= SEEDS)
    chosen = seeds.select("slice").distinct()  # at most SEEDS a query
    floor = np.zeros(len(q.ids), np.int64)
    schema = "query int, doc long, score long"
    first = index.slices.join(F.broadcast(chosen), "slice", "left_semi").mapInArrow(_scores(held, floor, top), schema)
    for query, score in _best(first, top).filter(F.col("rank") == top).select("query", "score").collect():
        floor[query] = score
    return _best(index.slices.drop("size", "slice").mapInArrow(_scores(held, floor, top), schema), top)


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[Queries]:
    """The queries in blocks of about BLOCK bytes."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    blocks = max(1, -(-(size + 64 * n) // BLOCK))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64(key, text), F.lit(blocks)) == b) if blocks > 1 else items
        rows = part.select(key, text).collect()
        yield Queries.of([r[0] for r in rows], [r[1] for r in rows])


def ranked(docs: DataFrame, items: DataFrame, top: int = 50, key: str = "item_id", doc: str = "doc_id", text: str = "text",
           most: int = SLICE) -> DataFrame:
    """(item key, rank int, doc_id, score long): of each row of ``items`` its ``top`` best rows of ``docs``, best first, ties by doc_id.

    Terms are maximal runs of ASCII letters and digits and of other letters, A-Z lower-cased, of the whole texts; null has none.
    A query's terms count once each.  Only scores above 0 are given.  The queries are searched for in blocks of ``BLOCK``
    bytes of text, each against all documents; a block's terms and queries are what is broadcast.

    Every row is a document of its own: repeated rows score alike and take a rank each.  Null doc_ids come before others in ties.
    Repeated items are answered each.  Empty tables, and items without a known term, give no rows.  Other columns are not carried
    along; ids must be integers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(NONE)).alias("doc"), F.col(text).alias("text"))
    out = None
    for q in _blocks(items, key, text):
        found = search(build(rows, q.vocabulary, most), q, top)
        names = spark.createDataFrame([(i, None if v is None else int(v)) for i, v in enumerate(q.ids)], f"query int, {key} long")
        part = found.join(F.broadcast(names), "query").select(key, "rank", F.nullif("doc", F.lit(NONE)).alias(doc), "score")
        out = part if out is None else out.union(part)
    return out

