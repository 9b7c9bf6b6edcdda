"""Near duplicates by a chosen-path similarity join.

A document is a set of word shingles, sketched by minwise tokens.  In every tree the documents of a
node branch by one token (now and then two) drawn for that node, so similar documents go down
together.  Nodes small enough are compared exhaustively on the sketches; what is still too big at
the last level goes on as a whole.  Independent trees bring the recall to its target.

The trees only nominate clusters.  Inside a cluster all pairs are held against each other on the
full sets, in blocks of bounded size whose results are links that span a block, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parley.llm.blocks import Words, lower_ascii, mix, pieces, raw, runs, shingle_sets
from parley.llm.components import components
from parley.llm.store import fewer, kept, likely, partitions

_U = np.uint64


@dataclass(frozen=True)
class Join:
    """Parameters of the join.

    percent      least similarity: 100 * |intersection| >= percent * |union|
    words        words in a shingle
    tokens       minwise tokens in a sketch
    trees        independent trees
    levels       levels of a tree
    leaf         documents in a node that is compared exhaustively
    slack        how far below the threshold the sketches' estimate may lie, in standard deviations
    block        documents in one block of a cluster, and shingles in it
    """

    percent: int = 80
    words: int = 5
    tokens: int = 128
    trees: int = 12
    levels: int = 8
    leaf: int = 4096
    slack: float = 5.0
    block: int = 1024
    block_shingles: int = 4_000_000

    @property
    def floor(self) -> int:
        """Equal tokens needed for a pair to be nominated."""
        j = self.percent / 100
        return math.floor(self.tokens * (j - self.slack * math.sqrt(j * (1 - j) / self.tokens)))

    def recall(self, depth: int = 1) -> float:
        """Chance that a pair just at the threshold meets in a node of this depth in some tree."""
        j, two = self.percent / 100, max(0.0, 100 / self.percent - 1)
        alive = 1.0
        for _ in range(depth):
            once = j * alive
            alive = (1 - two) * once + two * (1 - (1 - once) ** 2)
        return 1 - (1 - alive) ** self.trees


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)


def sketches(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sketch): size of the set, two hashes of the set, its minwise tokens (32 bits each)."""
    words, many = join.words, _multipliers(join.tokens)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = raw(part.column("text"))
                sets = shingle_sets(Words(lower_ascii(data), offsets), words)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                sketch = np.zeros((len(full), len(many)), np.uint32)
                h1, h2 = np.zeros(len(n), _U), np.zeros(len(n), _U)
                if len(full):
                    x = np.concatenate([sets[i] for i in full])
                    at = np.r_[0, np.cumsum(n[full])[:-1]]
                    h1[full], h2[full] = np.add.reduceat(mix(x + _U(1)), at), np.add.reduceat(mix(x ^ _U(0x5DEECE66D)), at)
                    for k, a in enumerate(many):
                        sketch[:, k] = np.minimum.reduceat(x * a, at) >> _U(32)
                tokens = [None] * len(n)
                for row, i in zip(sketch, full, strict=True):
                    tokens[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(tokens, pa.binary())],
                    ["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sketch binary")


def _branch(rows: DataFrame, join: Join, trees: int) -> DataFrame:
    """One level down: (node, id, sketch) to the nodes' children; ``trees`` roots where there is no node yet."""
    n, second = join.tokens, 100 / join.percent - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(raw(batch.column("sketch"))[0].tobytes(), np.uint32).reshape(-1, n)
            ids = batch.column("id")
            own = [batch.column("node").to_numpy().view(_U)] if not trees else [np.full(len(ids), mix(np.array([t + 1], _U))[0]) for t in range(trees)]
            for node in own:
                draw = mix(node ^ _U(0x2545F4914F6CDD1D))
                for turn in range(2):
                    go = np.flatnonzero((mix(draw + _U(7)) >> _U(11)).astype(float) / 2**53 < second) if turn else np.arange(len(ids))
                    if not len(go):
                        continue
                    one = (draw[go] % _U(n)).astype(np.int64)
                    pick = (one + 1 + (mix(draw[go] + _U(13)) % _U(n - 1)).astype(np.int64)) % n if turn else one
                    token = sketch[go, pick].astype(_U) | (pick.astype(_U) << _U(32))
                    child = mix(mix(token) + node[go] * _U(3))
                    take = pa.array(go)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), ids.take(take)], ["node", "id"])

    return rows.mapInArrow(run, "node long, id long")


def _same(label: np.ndarray, i: int, found: np.ndarray) -> None:
    """Give ``i`` and ``found`` one label, the smallest."""
    old = np.unique(label[np.r_[i, found]])
    if len(old) > 1:
        label[np.isin(label, old)] = old[0]


def _leaf_links(join: Join):
    floor, n = join.floor, join.tokens

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for node in runs(batches, "node"):
            ids = node.column("id").to_numpy()
            s = np.frombuffer(b"".join(node.column("sketch").to_pylist()), np.uint32).reshape(-1, n).astype(np.uint8)
            label = np.arange(len(ids))
            for i in range(len(ids) - 1):
                found = i + 1 + np.flatnonzero(np.count_nonzero(s[i + 1:] == s[i], axis=1) >= floor)
                if len(found):
                    _same(label, i, found)
            far = np.flatnonzero(label != np.arange(len(ids)))
            a.append(ids[far])
            b.append(ids[label[far]])
            if len(a) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def nominated(sets: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) of the trees: rows (id, sketch) in, pairs that span the groups of likely similar documents out."""
    leaves, whole = [], []
    level = kept(_branch(sets, join, join.trees), "level")
    for depth in range(1, join.levels + 1):
        # nodes with the same members, in whatever tree, are one
        nodes = level.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("members")).filter("n > 1")
        nodes = nodes.groupBy("n", "members").agg(F.min("node").alias("node"))
        held = kept(level.join(nodes.select("node", "n"), "node"), "nodes")
        leaves.append(held.filter(F.col("n") <= join.leaf).select("node", "id"))
        big = held.filter(F.col("n") > join.leaf)
        many = big.count()
        if not many:
            break
        if depth == join.levels:
            whole.append(big.join(big.groupBy("node").agg(F.min("id").alias("b")), "node").select(F.col("id").alias("a"), "b"))
        else:
            level = kept(_branch(fewer(big.select("node", "id").join(sets, "id"), many, 2048), join, 0), "level")
    rows = reduce(DataFrame.union, leaves).join(sets, "id").repartition(partitions(sets.sparkSession), "node").sortWithinPartitions("node")
    return reduce(DataFrame.union, whole, rows.mapInArrow(_leaf_links(join), "a long, b long"))


def _block_links(join: Join):
    percent, width = join.percent, 4096

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "part"):
            ids, side = group.column("id").to_numpy(), group.column("side").to_numpy()
            sets = [np.frombuffer(x, _U) for x in group.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            m = len(ids)
            _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            doc = np.repeat(np.arange(m), size)
            shared = np.flatnonzero(often[token] > 1)
            dense = np.cumsum(often > 1) - 1
            token, doc = dense[token[shared]], doc[shared]
            order = np.argsort(token, kind="stable")
            token, doc = token[order], doc[order]
            both = np.zeros((m, m), np.float32)
            for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
                s = slice(*np.searchsorted(token, (low, low + width)))
                has = np.zeros((m, width), np.float32)
                has[doc[s], token[s] - low] = 1
                both += has @ has.T
            both = both.astype(np.int64)
            link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            if side[0] != side[-1] or len(np.unique(side)) > 1:
                link &= side[:, None] != side[None, :]
            label = np.arange(m)
            for i in range(m):
                found = np.flatnonzero(link[i, i + 1:]) + i + 1
                if len(found):
                    _same(label, i, found)
            far = np.flatnonzero(label != np.arange(m))
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], ["a", "b"])

    return run


def _shingles(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = raw(part.column("text"))
                sets = [s.tobytes() for s in shingle_sets(Words(lower_ascii(data), offsets), words)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "part", "home", "blocks")), pa.array(sets, pa.binary())],
                                                 ["id", "part", "home", "blocks", "shingles"])

    return run


def confirmed(docs: DataFrame, clusters: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) that hold on the full sets and connect what is connected inside the clusters (id, component, n_shingles)."""
    spark = docs.sparkSession
    sizes = clusters.groupBy("component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / join.block), F.ceil(F.col("total") / join.block_shingles)).cast("int")
    members = clusters.join(sizes.select("component", blocks.alias("blocks")), "component").select(
        "id", F.col("component").alias("part"), "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("home"))
    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    # the same plan at every size: only texts that may be members are dealt by id
    texts = fewer(named.filter(likely(clusters, ["id"])).join(members.hint("merge"), "id"), clusters.count(), 512).mapInArrow(
        _shingles(join.words), "id long, part long, home int, blocks int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = texts.select("*", other.alias("away")).select(
        "id", "shingles", F.col("home").alias("side"),
        F.xxhash64("part", F.least("home", "away"), F.greatest("home", "away")).alias("part"))
    return pairs.repartition(partitions(spark), "part").sortWithinPartitions("part", "side", "id").mapInArrow(_block_links(join), "a long, b long")


def near_duplicates(docs: DataFrame, join: Join | None = None) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) for the rows of ``docs`` (doc_id, text, and any other columns).

    Words are runs without white space (0x20, 0x09-0x0D), A-Z lower-cased; a document's set holds its distinct
    shingles, or its whole word sequence where it has fewer words.  Documents without words are linked with
    nothing.  ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks that document.
    Equal sets are one node of the graph.  Rows that share a doc_id share that node's name.  A row without
    doc_id stands alone: its component is null and it is kept.  An empty table gives no rows.
    """
    join = join or Join()
    rows = kept(sketches(docs, join), "sketches")
    keys = ["n_shingles", "h1", "h2"]
    named = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = kept(named.groupBy(*keys).agg(F.min("doc_id").alias("id")), "classes")
    sets = kept(named.join(classes, [*keys]).filter("id = doc_id").select("id", "n_shingles", "sketch").dropDuplicates(["id"]), "sets")
    clusters = components(nominated(sets.select("id", "sketch"), join))
    clusters = kept(clusters.join(sets.select("id", "n_shingles"), "id"), "clusters")
    links = confirmed(docs, clusters, join)
    found = components(links)
    lead = classes.join(found, "id", "left").select(*keys, F.coalesce("component", "id").alias("component"))
    out = rows.join(lead, keys, "left")
    one = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", one.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, join: Join | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_duplicates` keeps."""
    gone = kept(near_duplicates(docs, join).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    # texts that surely stay pass by; only those that may go meet the list
    rows = docs.withColumn("_may_go", likely(gone, ["doc_id"]))
    return rows.filter(~F.col("_may_go")).union(rows.filter("_may_go").join(gone.hint("merge"), "doc_id", "left_anti").select(*rows.columns)).drop("_may_go")
