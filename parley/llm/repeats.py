"""Removal of long strings that occur more than once, by a hash-compared suffix sort of sampled suffixes.

Every string of ``size`` bytes contains the places where a hash of ``gram`` bytes is least among its own; equal
strings have them at the same offsets.  Only these anchors are compared: those whose gram occurs elsewhere too.  A gram of
half the string's length makes groups of real repetitions, so that common lines and phrases form none.
Around an anchor, the suffix to the right and the reversed prefix to the left are sorted by mergesort; two of
them are compared by the length of their common extension, found by binary search on prefix hashes.  Neighbours
in the two orders have the longest extensions, and what is claimed there is verified byte by byte.

Three ways rest on equal 64-bit hashes alone: grams whose surroundings all have one hash, surroundings that occur more
than once, and the windows of grams with too many different surroundings for a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parley.llm.blocks import mix, pieces, prefix_hash, range_hash, raw, runs
from parley.llm.store import kept, likely, partitions

_U = np.uint64
MOST = np.iinfo(np.uint64).max


def _slide(x: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over each window of ``width`` values; one value per window."""
    n = len(x) - width + 1
    y = np.full(-(-len(x) // width) * width, fill, x.dtype)
    y[:len(x)] = x
    y = y.reshape(-1, width)
    ahead = op.accumulate(y, axis=1).ravel()
    behind = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, their gram hashes, and the prefix hashes of the bytes."""
    width = size - gram + 1
    h = prefix_hash(data)
    none = np.zeros(0, np.int64), np.zeros(0, _U), h
    if len(data) < size:
        return none
    at = np.arange(len(data) - gram + 1)
    g = mix(range_hash(h, at, at + gram)) >> _U(1)
    low = _slide(g, width, np.minimum, int(MOST))
    # windows that cross the end of a text do not count
    length = np.diff(offsets)
    end = np.repeat(offsets[1:], length)
    valid = np.arange(len(low)) + size <= end[:len(low)]
    low = np.where(valid, low, _U(0))
    reach = np.concatenate([np.zeros(width - 1, _U), low, np.zeros(width - 1, _U)])
    top = _slide(reach, width, np.maximum, 0)
    found = np.flatnonzero((top[:len(g)] == g) & (top[:len(g)] > 0))
    return found, g[found], h


def _sample(size: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                data, offsets = raw(part.column("text"))
                at, g, h = anchors(data, offsets, size, gram)
                row = np.searchsorted(offsets, at, side="right") - 1
                left = np.minimum(at - offsets[row], size - gram)
                right = np.minimum(offsets[row + 1] - at, size)
                around = mix(range_hash(h, at - left, at + right) + (left * 1024 + right).astype(_U) * _U(0xD6E8FEB86659FD93))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(take), part.column("body").take(take), pa.array(g.view(np.int64)), pa.array(around.view(np.int64)),
                     pa.array((at - offsets[row]).astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))],
                    ["doc", "body", "gram", "around", "at", "left", "right"])

    return run


class Strings:
    """Strings laid end to end, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length, self.h = data, start, length, prefix_hash(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning of strings i and j: binary search on hashes."""
        a, b = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            same = range_hash(self.h, a, a + mid) == range_hash(self.h, b, b + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether string i sorts before string j; a beginning of another sorts first."""
        n = self.common(i, j)
        ends_i, ends_j = n >= self.length[i], n >= self.length[j]
        a = self.data[np.minimum(self.start[i] + n, len(self.data) - 1)]
        b = self.data[np.minimum(self.start[j] + n, len(self.data) - 1)]
        return np.where(ends_i | ends_j, ends_i & ~ends_j, a < b)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the strings inside each run of equal ``group``: bottom-up mergesort, all merges of a round at once."""
        n = len(group)
        order = np.arange(n)
        first = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(n), 0)) if n else order
        last = n - np.maximum.accumulate(np.where(np.r_[group[1:] != group[:-1], True][::-1], np.arange(n), 0))[::-1] if n else order
        width = 1
        while n and (last - first).max() > width:
            place = np.arange(n)
            block = (place - first) // width
            lo = np.minimum(first + (block ^ 1) * width, last)
            hi = np.minimum(lo + width, last)
            rank_lo, rank_hi = lo.copy(), hi.copy()
            right = (block & 1) == 1
            while True:
                todo = np.flatnonzero(rank_lo < rank_hi)
                if not len(todo):
                    break
                mid = (rank_lo[todo] + rank_hi[todo]) // 2
                me, other = order[todo], order[mid]
                # equal strings: the left block's goes first
                less = np.where(right[todo], ~self.before(me, other), self.before(other, me))
                rank_lo[todo] = np.where(less, mid + 1, rank_lo[todo])
                rank_hi[todo] = np.where(less, rank_hi[todo], mid)
            to = first + (block // 2) * 2 * width + (place - first) % width + (rank_lo - lo)
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, 2 * width
        return order

    def verified(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``n`` where the first n bytes of strings i and j are equal, else what really is common (after a hash collision)."""
        out = n.copy()
        for lo in range(0, len(i), 4096):
            s = slice(lo, lo + 4096)
            step = np.arange(n[s].sum()) - np.repeat(np.cumsum(n[s]) - n[s], n[s])
            same = self.data[np.repeat(self.start[i[s]], n[s]) + step] == self.data[np.repeat(self.start[j[s]], n[s]) + step]
            bad = np.flatnonzero(~same)
            if len(bad):
                owner = np.repeat(np.arange(lo, lo + len(n[s])), n[s])[bad]
                np.minimum.at(out, owner, step[bad])
        return out


def _nearest(side: Strings, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string the neighbour in the order with the longest common beginning, and its length (-1: none)."""
    best, with_ = np.full(len(order), -1, np.int64), np.zeros(len(order), np.int64)
    i, j = order[:-1], order[1:]
    near = group[i] == group[j]
    i, j = i[near], j[near]
    n = side.verified(i, j, side.common(i, j))
    for a, b in ((i, j), (j, i)):
        better = n > best[a]
        best[a], with_[a] = np.where(better, n, best[a]), np.where(better, b, with_[a])
    return best, with_


def _shared_windows(ahead: Strings, left: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The fewest and the most bytes before its anchor that a window of ``size`` bytes has which another of ``rows`` has at the
    same place, each with that row (-1: none).

    One sort of the windows' hashes, some offsets at a time, so the work grows with the bytes and not with the pairs of rows.
    """
    low, low_with, top, top_with = (np.full(len(left), -1, np.int64) for _ in range(4))
    least, most = max(size - int(ahead.length[rows].max()), 0), int(left[rows].max())
    step = max((1 << 18) // len(rows), 1)
    for o in range(least, most + 1, step):
        offs = np.arange(o, min(o + step, most + 1))
        off, row = np.repeat(offs, len(rows)), np.tile(rows, len(offs))
        fits = (left[row] >= off) & (ahead.length[row] >= size - off)
        off, row = off[fits], row[fits]
        at = ahead.start[row] - off
        value = mix(range_hash(ahead.h, at, at + size) + off.astype(_U) * _U(0xD6E8FEB86659FD93))
        order = np.argsort(value, kind="stable")
        equal = value[order[1:]] == value[order[:-1]]
        a, b = order[:-1][equal], order[1:][equal]
        partner = np.full(len(row), -1, np.int64)
        partner[a], partner[b] = row[b], row[a]
        # offsets ascend, and of repeated rows the last assignment stays
        hit = np.flatnonzero(partner >= 0)
        top[row[hit]], top_with[row[hit]] = off[hit], partner[hit]
        hit = hit[low[row[hit]] < 0][::-1]
        low[row[hit]], low_with[row[hit]] = off[hit], partner[hit]
    return low, low_with, top, top_with


def extents(group: np.ndarray, bodies: list[bytes], left: np.ndarray, often: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How far to the left and right of each anchor strings of ``size`` bytes reach that occur elsewhere; 0 and 0 where none does.

    ``bodies`` hold the bytes around the anchors, ``left`` of them before it and ``size`` behind it at most; ``often`` says how many
    anchors look exactly so.
    """
    length = np.array([len(b) for b in bodies], np.int64)
    start = np.cumsum(length) - length
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ahead = Strings(data, start + left, length - left)
    back = Strings(data[::-1].copy(), len(data) - start - left, left)
    r, r_with = _nearest(ahead, ahead.sort(group), group)
    l, l_with = _nearest(back, back.sort(group), group)  # noqa: E741
    every = np.arange(len(group))
    to_left, to_right = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    hope = (r >= 0) & (l + r >= size)
    sure_r = hope & (back.verified(every, r_with, back.common(every, r_with)) + r >= size)
    sure_l = hope & (ahead.verified(every, l_with, ahead.common(every, l_with)) + l >= size)
    to_right[sure_r], to_left[sure_l] = r[sure_r], l[sure_l]
    # where the longest on one side is not long enough in all, other partners may be
    hard = np.flatnonzero(hope & ~(sure_l & sure_r))
    if len(hard):
        low, low_with, top, top_with = _shared_windows(ahead, left, np.flatnonzero(np.isin(group, group[hard])), size)
        hard = hard[top[hard] >= 0]
        to_left[hard], to_right[hard] = top[hard], size - low[hard]
        same = np.ones(len(hard), bool)
        for off, j in ((low[hard], low_with[hard]), (top[hard], top_with[hard])):
            same &= (back.verified(hard, j, off) == off) & (ahead.verified(hard, j, size - off) == size - off)
        for i in hard[~same]:  # after a hash collision: look at every partner
            j = np.flatnonzero(group == group[i])
            j = j[j != i]
            me = np.full(len(j), i)
            a, b = back.verified(me, j, back.common(me, j)), ahead.verified(me, j, ahead.common(me, j))
            fits = a + b >= size
            to_left[i], to_right[i] = (a[fits].max(), b[fits].max()) if fits.any() else (0, 0)
    whole = (often > 1) & (length >= size)
    return np.where(whole, left, to_left), np.where(whole, length - left, to_right)


def _bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            data, offsets = raw(part.column("text"))
            whole = data.tobytes()
            lists = part.column("wanted").to_pylist()
            rows = [(w["gram"], w["around"], w["often"], w["left"], whole[o + w["at"] - w["left"]:o + w["at"] + w["right"]])
                    for o, ws in zip(offsets, lists, strict=False) for w in ws]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()),
                     pa.array(cols[4], pa.binary())], ["gram", "around", "often", "left", "body"])


def _sorted_extents(size: int, task_bytes: int = 1 << 20):
    def solve(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables)
        group = t.column("gram").to_numpy()
        a, b = extents(group, t.column("body").to_pylist(), t.column("left").to_numpy().astype(np.int64), t.column("often").to_numpy(), size)
        hit = np.flatnonzero(a + b > 0)
        return pa.RecordBatch.from_arrays([pa.array(group[hit]), pa.array(t.column("around").to_numpy()[hit]), pa.array(a[hit].astype(np.int32)),
                                           pa.array(b[hit].astype(np.int32))], ["gram", "around", "to_left", "to_right"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for group in runs(batches, "gram"):
            held.append(group.select(["gram", "around", "often", "left", "body"]))
            n += group.column("body").nbytes
            if n >= task_bytes:
                yield solve(held)
                held, n = [], 0
        if held:
            yield solve(held)

    return run


def _windows(size: int, gram: int):
    """All windows of the anchors' bodies as hashes: the way for grams with too many surroundings for one task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "body", 1 << 18):
                data, offsets = raw(part.column("body"))
                h = prefix_hash(data)
                fits = np.maximum(np.diff(offsets) - size + 1, 0)
                row = np.repeat(np.arange(len(fits)), fits)
                at = np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
                start = offsets[row] + at
                value = mix(range_hash(h, start, start + size))
                off = part.column("left").to_numpy()[row] - at
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(c).take(take) for c in ("gram", "around", "often")] + [pa.array(off.astype(np.int32)), pa.array(value.view(np.int64))],
                                                 ["gram", "around", "often", "off", "window"])

    return run


def repeated(docs: DataFrame, size: int = 400, gram: int = 200, group: int = 8192) -> DataFrame:
    """(doc, body, spans): byte ranges of every text that strings of ``size`` bytes cover which start elsewhere too.

    ``docs`` has doc (long), body (hash of the text) and text; rows with equal doc and body are one.  Grams with up to
    ``group`` different surroundings are sorted in a task; for more, hashes of the windows are counted by Spark.
    """
    spark = docs.sparkSession
    found = kept(docs.mapInArrow(_sample(size, gram), "doc long, body long, gram long, around long, at int, left int, right int"), "anchors")
    often = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("around").alias("a"), F.max("around").alias("b")).filter("n > 1")
    often = kept(often.select("gram", (F.col("a") != F.col("b")).alias("varied")), "often")
    shared = kept(found.filter(likely(often, ["gram"])).join(often.hint("merge"), "gram"), "shared")
    alike = shared.filter("NOT varied AND left + right >= %d" % size).select("doc", "body", "at", F.col("left").alias("to_left"), F.col("right").alias("to_right"))
    kinds = shared.filter("varied").groupBy("gram", "around").agg(F.count("*").alias("often"), F.min(F.struct("doc", "body", "at", "left", "right")).alias("r"))
    kinds = kept(kinds, "kinds")
    wanted = kinds.groupBy("r.doc", "r.body").agg(F.collect_list(F.struct("gram", "around", "often", "r.at", "r.left", "r.right")).alias("wanted"))
    wanted = kept(wanted, "wanted")
    texts = docs.filter(likely(wanted, ["doc", "body"])).join(wanted.hint("merge"), ["doc", "body"])
    bodies = texts.select("text", "wanted").mapInArrow(_bodies, "gram long, around long, often long, left int, body binary")
    sizes = kinds.groupBy("gram").agg(F.count("*").alias("m"))
    many = kept(sizes.filter(F.col("m") > group), "many")
    verdict = "gram long, around long, to_left int, to_right int"
    if many.isEmpty():
        few, extra = bodies, None
    else:
        bodies = kept(bodies, "bodies")
        few = bodies.join(many, "gram", "left_anti")
        w = bodies.join(many, "gram", "left_semi").mapInArrow(_windows(size, gram), "gram long, around long, often long, off int, window long")
        twice = w.groupBy("gram", "off", "window").agg(F.sum("often").alias("n")).filter("n > 1").drop("n")
        extra = w.join(twice, ["gram", "off", "window"]).groupBy("gram", "around").agg(
            F.max("off").alias("to_left"), (F.lit(size) - F.min("off")).cast("int").alias("to_right"))
    found_extents = few.repartition(partitions(spark), "gram").sortWithinPartitions("gram").mapInArrow(_sorted_extents(size), verdict)
    if extra is not None:
        found_extents = found_extents.union(extra)
    varied = shared.filter("varied").join(found_extents, ["gram", "around"]).select("doc", "body", "at", "to_left", "to_right")
    spans = alike.union(varied)
    return spans.groupBy("doc", "body").agg(F.collect_set(F.struct((F.col("at") - F.col("to_left")).alias("s"), (F.col("at") + F.col("to_right")).alias("e"))).alias("spans"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            rows = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                data, gone, left, at = text.encode(), _merged(spans), [], 0
                for s, e in gone:
                    left.append(data[at:s])
                    at = e
                left.append(data[at:])
                rest = b"".join(left)
                rows.append((len(data), len(data) - len(rest), len(gone), rest))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("own"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())],
                                             ["own", "n_bytes", "n_removed", "n_spans", "rest"])


def letters(rest: Column) -> Column:
    """Text of the bytes that are left; letters that a cut went through go."""
    made = F.make_valid_utf8(rest.cast("string"))
    return F.when(F.is_valid_utf8(rest.cast("string")), rest.cast("string")).otherwise(F.replace(made, F.lit("\ufffd"), F.lit("")))


def without_repeats(docs: DataFrame, size: int = 400, gram: int = 200) -> DataFrame:
    """The columns of ``docs`` without text, and (n_bytes, n_removed, n_spans, rest): each text without the bytes that a repeated
    string of ``size`` bytes covers.

    ``rest`` is binary, as a cut may fall inside a letter.  Texts are UTF-8; null counts as empty and stays so.  Strings
    never cross texts.  Rows that repeat a doc_id and text are texts of their own and so repeat each other.  Columns of
    ``docs`` with the names of results give way to them.  An empty table gives no rows.
    """
    text, doc = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    results = ["n_bytes", "n_removed", "n_spans", "rest"]
    own = [c for c in docs.columns if c not in (*results, "text")]
    rows = docs.select(F.struct(*own).alias("own"), F.coalesce(doc, F.lit(-(1 << 62))).alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))
    spans = kept(repeated(rows.select("doc", "body", "text"), size, gram), "spans")
    may = likely(spans, ["doc", "body"])
    near = rows.filter(may).join(spans.hint("merge"), ["doc", "body"], "left").select("own", "text", "spans")
    cut = near.mapInArrow(_cut, T.StructType([near.schema["own"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, rest binary").fields]))
    zero, plain = F.lit(0).cast("long"), F.encode("text", "utf-8")
    return cut.union(rows.filter(~may).select("own", F.length(plain).cast("long"), zero, zero, plain)).select("own.*", *results)
