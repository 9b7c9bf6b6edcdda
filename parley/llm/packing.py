"""Best-fit packing of token pieces into sequences by a configuration linear program.

Pieces of one length are alike, so the program works on the histogram of lengths, whose size is bounded by the
sequence length and not by the data.  A configuration is a multiset of lengths that fits a sequence.  Multiplicative
weights solve the covering program; a knapsack dynamic program prices the best configuration for the current
weights.  The solution is rounded down to whole sequences, phase by phase on what is left, and the few pieces that
remain go by best fit, one group of like sequences at a time.  The plan is then dealt to the pieces by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from parley.llm.blocks import pieces
from parley.llm.store import kept

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def best_configuration(value: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """The multiset of lengths (index of ``value``) of at most ``capacity`` with the largest total value: unbounded knapsack."""
    size = np.flatnonzero(value > 0)
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        fits = size[:np.searchsorted(size, c, side="right")]
        if not len(fits):
            continue
        total = best[c - fits] + value[fits]
        k = len(total) - 1 - int(total[::-1].argmax())  # of equal values the longest piece
        if total[k] > best[c - 1]:
            best[c], pick[c] = total[k], fits[k]
        else:
            best[c], pick[c] = best[c - 1], 0
    out: Counter[int] = Counter()
    c = capacity
    while c > 0:
        if pick[c]:
            out[int(pick[c])] += 1
            c -= int(pick[c])
        else:
            c -= 1
    return dict(out), float(best[capacity])


def fractional(counts: np.ndarray, capacity: int, rounds: int, step: float = 0.15) -> list[tuple[dict[int, int], float]]:
    """Configurations and how many sequences of each: covers the histogram at nearly the least number of sequences.

    Multiplicative weights for the covering program: each round the lengths that are covered least so far, relative
    to their need, weigh most, and the configuration with the largest weight per sequence gets the round.
    """
    need = np.flatnonzero(counts)
    weight = np.zeros(len(counts))
    weight[need] = need / capacity  # a first dual solution: a piece costs the share of the sequence that it fills
    used: dict[tuple, int] = {}
    for _ in range(rounds):
        config, _ = best_configuration(weight, capacity)
        key = tuple(sorted(config.items()))
        used[key] = used.get(key, 0) + 1
        gain = np.zeros(len(counts))
        for length, often in key:
            gain[length] = often / counts[length]
        weight *= np.exp(-step * gain / max(gain.max(), 1e-300))
        weight[need] = np.maximum(weight[need], 1e-12)
    cover = np.zeros(len(counts))
    for key, often in used.items():
        for length, k in key:
            cover[length] += often * k
    # the most that the rounds can be stretched before some length is overfull
    hit = cover > 0
    stretch = (counts[hit] / cover[hit]).max()
    return [(dict(key), often * stretch) for key, often in used.items()]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing of ``counts[length]`` pieces of each length: (configuration, number of sequences).

    Sequences with equal contents are one group, and a length fills whole groups at a time, so work and result are
    bounded by the number of lengths and not by the pieces.
    """
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}  # by the room that is left

    def add(room: int, held: dict[int, int], n: int) -> None:
        if n:
            groups.setdefault(room, []).append((held, n))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        for room in sorted(r for r in groups if r >= length):
            k = room // length
            for held, n in groups.pop(room):
                full = min(n, left // k)
                left -= full * k
                add(room - k * length, {**held, length: k}, full)
                if n > full and left:  # fewer than k are left: one sequence takes them
                    add(room - left * length, {**held, length: left}, 1)
                    left, full = 0, full + 1
                add(room, held, n - full)
            if not left:
                break
        k = capacity // length
        add(capacity - k * length, {length: k}, left // k)
        if left % k:
            add(capacity - left % k * length, {length: left % k}, 1)
    return [row for rows in groups.values() for row in rows]


def plan(counts: np.ndarray, capacity: int, rounds: int = 320, phases: int = 10, least: int = 80) -> list[tuple[dict[int, int], int]]:
    """(configuration, number of sequences) that take exactly ``counts[length]`` pieces of each length.

    The solution of a phase is rounded down and the next one works on the rest.  The first phase has ``least`` rounds,
    each later one twice as many up to ``rounds``, so that the program covers broad histograms too.
    """
    left, out = counts.astype(np.int64).copy(), []
    left[0] = 0
    if left[capacity]:
        out.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    for phase in range(phases):
        placed, now = 0, min(rounds, least << phase)
        configs = fractional(left, capacity, now) if left.any() else []
        for config, x in sorted(configs, key=lambda c: -sum(k * n for k, n in c[0].items())):
            n = min(int(x), *(int(left[length] // often) for length, often in config.items()))
            if n > 0:
                out.append((config, n))
                placed += n
                for length, often in config.items():
                    left[length] -= n * often
        if not placed and now == rounds:
            break
    return out + best_fit(left, capacity)


def slots(configs: list[tuple[dict[int, int], int]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length the plan as runs of ranks: (first rank, first sequence, pieces per sequence, offset in it)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = np.zeros(size + 1, np.int64), 0
    for config, n in configs:
        offset = 0
        for length in sorted(config, reverse=True):
            runs.setdefault(length, []).append((int(taken[length]), sequence, config[length], offset))
            taken[length] += n * config[length]
            offset += length * config[length]
        sequence += n
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in runs.items()}


def cut(docs: DataFrame, ranks: dict[bytes, int], special: dict[str, int], end: int, capacity: int) -> DataFrame:
    """Pieces of the whole texts with the partition they came from and their rank there among pieces of their length."""
    held = docs.sparkSession.sparkContext.broadcast((ranks, special))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        coder = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held.value[0], special_tokens=held.value[1])
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in pieces(batch, "text"):
                rows = []
                for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids = np.array([*coder.encode(text or "", allowed_special="all", disallowed_special=()), end], "<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a])))
                        seen[b - a] += 1
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def packed(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces and their places.

    A document's tokens are those of its whole text under the byte-level BPE file ``tokenizer``, then ``end``; null
    text counts as empty and gives the end token alone.  Longer documents are cut so that all pieces but the first
    are full.  Repeated rows are packed each; a row without doc_id is packed with a null doc_id; an empty table gives no rows.
    """
    from parley.llm.bpe import Vocabulary

    vocabulary = Vocabulary.read(tokenizer)
    special = vocabulary.special
    ranks = {b: i for i, b in vocabulary.bytes.items() if i not in special.values()}
    rows = kept(cut(docs, ranks, special, end, capacity), "pieces")
    tally = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # at most one row per length
        counts[length] = n
    table = slots(plan(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = tally.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    held = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the number of lengths and phases, not by the data

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                first, base, often, at = held.value[int(n)]
                mine = np.flatnonzero(length == n)
                run = np.searchsorted(first, rank[mine], side="right") - 1
                into = rank[mine] - first[run]
                sequence[mine] = base[run] + into // often[run]
                offset[mine] = at[run] + into % often[run] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                              pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = rows.join(shift, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("shift"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
