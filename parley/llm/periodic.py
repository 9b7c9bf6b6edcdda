"""Runs of repeating words, found in a grammar of the text.

Re-Pair replaces the most frequent pair of symbols by a new one, again and again.  Here every text has its own symbols and
its own grammar, and all texts of a piece are worked on together: in one round each pair that no more frequent pair overlaps is
replaced everywhere.  The symbols that are left over get a balanced tree, so each text is one tree in which equal
parts share a node.

A run of words with period q lies across the boundary of the smallest node that holds it.  So each node's boundary
is looked at once, in the node's first place: words q apart that agree next to the boundary give the periods worth a look, and the
common extensions to both sides the run, clipped to the node.  The runs of a node are moved to all places where its symbol
was made; of the intervals of one period those inside another one go, and what is left are the maximal runs.

Extensions are found by binary search on prefix hashes, and each run is then compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.blocks import mix, pieces, prefix_hash, range_hash, raw, word_bounds

_U = np.uint64
PIECE = 1 << 20  # bytes of text in work at once; a longer text is a piece of its own
NEAR, LONG = 16, 8  # more than NEAR words apart, LONG equal words next to a boundary make a candidate


def repair(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of texts laid end to end; ``first`` has the first word of each and the end.  No symbol may occur in two texts.

    Returns of each rule (place of its first use, words of its left part, words in all), of each use (rule, place), and the
    places where a symbol is left over.
    """
    n = len(sym)
    sym, span, live = sym.copy(), np.ones(n, np.int64), np.ones(n, bool)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    full = np.diff(first) > 0
    after[first[1:][full] - 1] = n  # place n stands for the edge of a text
    before[first[:-1][full]] = n
    rank = np.full(n + 1, n + 1, np.int64)
    names = int(sym.max()) + 1 if n else 0
    rules: list[np.ndarray] = []
    uses: list[np.ndarray] = []
    made = 0
    at = np.flatnonzero(after[:n] < n)
    while len(at):
        key = sym[at] * (names + n) + sym[after[at]]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        pair = np.cumsum(new) - 1
        count = np.bincount(pair)
        often = count[pair] > 1
        at, pair = at[order[often]], pair[often]
        if not len(at):
            break
        place = np.empty(len(count), np.int64)
        place[np.argsort(-count, kind="stable")] = np.arange(len(count))
        by_place = np.argsort(at)
        at, mine = at[by_place], place[pair[by_place]]
        rank[at] = mine
        free = (rank[before[at]] >= mine) & (rank[after[at]] >= mine)
        best, its = at[free], mine[free]
        # of a chain of one pair that overlaps itself (a a a a) every second place
        chained = np.r_[False, (after[best[:-1]] == best[1:]) & (its[1:] == its[:-1])]
        link = np.arange(len(best)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(best))))
        best, its = best[link % 2 == 0], its[link % 2 == 0]
        wins = np.bincount(its, minlength=len(count))
        blocked = np.bincount(mine[~free], minlength=len(count))
        rank[at] = n + 1
        stay = at[(wins[mine] > 1) | (blocked[mine] > 0)]
        best, its = best[wins[its] > 1], its[wins[its] > 1]
        if len(best):
            kinds, start, rule = np.unique(its, return_index=True, return_inverse=True)
            gone = after[best]
            rules.append(np.stack([best[start], span[best[start]], span[best[start]] + span[gone[start]]]))
            uses.append(np.stack([made + rule, best]))
            sym[best] = names + made + rule
            made += len(kinds)
            span[best] += span[gone]
            live[gone] = False
            follow = after[gone]
            after[best] = follow
            before[follow] = best
            before[n] = n
            stay = np.concatenate([stay, best, before[best]])
            stay = stay[stay < n]
            stay = np.unique(stay[live[stay]])
            stay = stay[after[stay] < n]
        at = stay
    none = np.zeros((3, 0), np.int64)
    rule, use = np.concatenate([none, *rules], axis=1), np.concatenate([none[:2], *uses], axis=1)
    return rule[0], rule[1], rule[2], use[0], use[1], np.flatnonzero(live)


def tree(places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(begin, boundary, end) of the nodes of a balanced binary tree over the symbols at ``places`` of each text."""
    edge = np.searchsorted(places, first)
    count = np.diff(edge)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(places)) - edge[text]
    out, width, i = [np.zeros((3, 0), np.int64)], 1, np.arange(len(places))
    while len(i):
        i = i[(at[i] % (2 * width) == 0) & (at[i] + width < count[text[i]])]
        whole = at[i] + 2 * width < count[text[i]]
        end = np.where(whole, places[np.where(whole, i + 2 * width, 0)], first[text[i] + 1])
        out.append(np.stack([places[i], places[i + width], end]))
        width *= 2
    return np.concatenate(out, axis=1)


def _grams(sym: np.ndarray, size: int) -> np.ndarray:
    n = max(len(sym) - size + 1, 0)
    out = np.zeros(n, _U)
    for k in range(size):
        out = mix(out + sym[k:k + n].astype(_U) + _U(k + 1))
    return out


def _periods(sym: np.ndarray, begin: np.ndarray, cut: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, anchor, q): where words at the anchor and q further on may agree, the anchor at the boundary or q before it.

    In a run of at least ``least`` words and 2q, at least max(q, least - q) words equal those q further on, before and behind
    the anchor together; so there is half of that on one side.
    """
    n, few = len(sym), max(-(-least // 4), 1)
    node_at = np.full(n + 1, -1, np.int64)
    node_at[cut] = np.arange(len(cut))
    nodes: list[np.ndarray] = []
    anchors: list[np.ndarray] = []
    steps: list[np.ndarray] = []

    def add(boundary: np.ndarray, anchor: np.ndarray, q: np.ndarray) -> None:
        node = node_at[boundary]
        ok = node >= 0
        node, anchor, q = node[ok], anchor[ok], q[ok]
        ok = (anchor >= begin[node]) & (anchor + q <= end[node]) & (2 * q <= end[node] - begin[node])
        nodes.append(node[ok])
        anchors.append(anchor[ok])
        steps.append(q[ok])

    short = _grams(sym, min(few, LONG))
    for q in range(1, min(NEAR, len(short) - 1) + 1):
        i = np.flatnonzero(short[q:] == short[:-q])
        for shift in (0, min(few, LONG)):  # the equal words stand behind the anchor, or before it
            x = i + shift
            x = x[x + q <= n]
            add(x, x, np.full(len(x), q))
            add(x + q, x, np.full(len(x), q))
    far = _grams(sym, LONG)
    order = np.argsort(far, kind="stable")
    value = far[order]
    same = np.r_[value[1:] == value[:-1], False] | np.r_[False, value[1:] == value[:-1]] if len(value) else np.zeros(0, bool)
    i, group = order[same], np.cumsum(np.r_[True, value[same][1:] != value[same][:-1]]) - 1 if same.any() else order[same]
    if len(i):
        key = group * (n + 1) + i
        for shift in (0, LONG):
            node = node_at[i + shift]
            mine = np.flatnonzero(node >= 0)
            low = np.searchsorted(key, group[mine] * (n + 1) + np.maximum(begin[node[mine]] - shift, 0))
            high = np.searchsorted(key, group[mine] * (n + 1) + end[node[mine]])
            many = high - low
            other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            me, you = np.repeat(i[mine], many), i[other]
            q, x = np.abs(you - me), np.minimum(me, you) + shift
            ok = (q > NEAR) & (x + q <= n)
            add((me + shift)[ok], x[ok], q[ok])
    if not nodes:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(nodes), np.concatenate(anchors), np.concatenate(steps)


def _agree(h: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
    """How many words from places a and b on (sign 1) or before them (sign -1) are equal, at most ``most``."""
    low, high = np.zeros(len(a), np.int64), np.maximum(most, 0)
    while True:
        todo = np.flatnonzero(low < high)
        if not len(todo):
            return low
        mid = (low[todo] + high[todo] + 1) // 2
        x, y = a[todo], b[todo]
        same = range_hash(h, x, x + mid) == range_hash(h, y, y + mid) if sign > 0 else range_hash(h, x - mid, x) == range_hash(h, y - mid, y)
        low[todo], high[todo] = np.where(same, mid, low[todo]), np.where(same, high[todo], mid - 1)


def _true(sym: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of the runs [start, end) really have period q, compared word by word."""
    out = np.ones(len(start), bool)
    n = end - start - q
    at = np.cumsum(n)
    lo = 0
    while lo < len(start):
        hi = max(int(np.searchsorted(at, at[lo] - n[lo] + (1 << 20), side="right")), lo + 1)
        s = slice(lo, hi)
        i = np.arange(n[s].sum()) - np.repeat(np.cumsum(n[s]) - n[s], n[s]) + np.repeat(start[s], n[s])
        differ = sym[i] != sym[i + np.repeat(q[s], n[s])]
        if differ.any():
            out[lo + np.unique(np.repeat(np.arange(hi - lo), n[s])[differ])] = False
        lo = hi
    return out


def _plain(sym: np.ndarray, x: int, q: int, begin: int, end: int) -> tuple[int, int]:
    """The run around one anchor without hashes, for when they failed."""
    ahead, back = sym[x:end - q] != sym[x + q:end], (sym[begin:x] != sym[begin + q:x + q])[::-1]
    f = int(ahead.argmax()) if ahead.any() else len(ahead)
    g = int(back.argmax()) if back.any() else len(back)
    return x - g, x + f + q


def _smallest(node: np.ndarray, x: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the periods of one stretch in one node the smallest, which is its own."""
    order = np.lexsort((q, e, s, node))
    node, x, s, e, q = node[order], x[order], s[order], e[order], q[order]
    own = np.r_[True, (node[1:] != node[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])] if len(node) else np.zeros(0, bool)
    return node[own], x[own], s[own], e[own], q[own]


def runs(sym: np.ndarray, first: np.ndarray, least: int = 12) -> np.ndarray:
    """(start, end, period) of all maximal runs of at least ``least`` words and two periods in texts laid end to end, sorted by
    start and period.  No symbol may occur in two texts."""
    place, left, size, rule, use, rest = repair(sym, first)
    top = tree(rest, first)
    begin, cut, end = (np.concatenate(x) for x in ((place, top[0]), (place + left, top[1]), (place + size, top[2])))
    node, x, q = _periods(sym, begin, cut, end, least)
    h = prefix_hash(mix(sym))
    lo, hi, all_nodes, all_x, all_q = begin[node], end[node], node, x, q
    s, e = x - _agree(h, x, x + q, x - lo, -1), x + q + _agree(h, x, x + q, hi - q - x, 1)
    long = e - s >= np.maximum(2 * q, least)
    node, x, s, e, q = _smallest(node[long], x[long], s[long], e[long], q[long])
    false = np.unique(node[~_true(sym, s, e, q)])
    if len(false):  # a collision of hashes: these nodes again without them
        kept, again = ~np.isin(node, false), np.flatnonzero(np.isin(all_nodes, false))
        plain = np.array([_plain(sym, *(int(v[i]) for v in (all_x, all_q)), int(lo[i]), int(hi[i])) for i in again], np.int64)
        ok = plain[:, 1] - plain[:, 0] >= np.maximum(2 * all_q[again], least)
        extra = all_nodes[again], all_x[again], plain[:, 0], plain[:, 1], all_q[again]
        node, x, s, e, q = _smallest(*(np.r_[v[kept], w[ok]] for v, w in zip((node, x, s, e, q), extra, strict=True)))
    # to all places where the node's symbol was made; nodes of the tree have one
    by_rule = np.argsort(rule, kind="stable")
    edge = np.searchsorted(rule[by_rule], np.arange(len(place) + 1))
    in_rule = node < len(place)
    many = np.ones(len(node), np.int64)
    many[in_rule] = (edge[1:] - edge[:-1])[node[in_rule]]
    which = np.repeat(np.arange(len(node)), many)
    turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    move = np.zeros(len(which), np.int64)
    moved = in_rule[which]
    of = node[which[moved]]
    move[moved] = use[by_rule[edge[of] + turn[moved]]] - place[of]
    s, e, q = s[which] + move, e[which] + move, q[which]
    # of one period, what lies inside another goes; periods of one text do not reach into the next
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    if len(s):
        fresh = np.r_[True, q[1:] != q[:-1]]
        part = np.cumsum(fresh) * (len(sym) + 1)
        reach = np.maximum.accumulate(e + part)
        keep = np.r_[True, (e + part)[1:] > reach[:-1]]
        s, e, q = s[keep], e[keep], q[keep]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    own = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])] if len(s) else np.zeros(0, bool)
    found = np.stack([s[own], e[own], q[own]])
    return found[:, np.lexsort((found[2], found[0]))]


def _text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Symbols of all words (equal only for equal words of one text), the first word of each text and the end, and the words."""
    data, offsets = raw(column)
    start, end, first = word_bounds(data, offsets)
    solid = np.zeros(len(data) + 1, np.int8)
    solid[start] += 1
    solid[end] -= 1
    letters = data[np.cumsum(solid[:-1], dtype=np.int8) > 0]
    places = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(letters))])
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.unique(text * (len(words) + 1) + code, return_inverse=True)[1].astype(np.int64), first, words


OUT = ("n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
       "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def _found(column: pa.Array, least: int) -> list[pa.Array]:
    sym, first, words = _text_words(column)
    s, e, q = runs(sym, first, least)
    n = len(first) - 1
    text = np.searchsorted(first, s, side="right") - 1
    edge = np.searchsorted(text, np.arange(n + 1))
    # the longest of each text: first by length, start and period
    best = np.lexsort((q, s, s - e, text))
    head = best[edge[:-1][np.diff(edge) > 0]]
    drop = np.zeros(len(sym) + 1, np.int64)
    np.add.at(drop, s + q, 1)
    np.add.at(drop, e, -1)
    keep = np.cumsum(drop[:-1]) == 0
    at = np.r_[0, np.cumsum(keep)][first].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(at), words.filter(pa.array(keep)))
    collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.binary())).cast(pa.string())

    def one(values: np.ndarray) -> pa.Array:
        out, there = np.zeros(n, np.int64), np.zeros(n, bool)
        out[text[head]], there[text[head]] = values[head], True
        return pa.array(out, mask=~there)

    where = s - first[text]
    rows = pa.StructArray.from_arrays([pa.array(where), pa.array(e - s), pa.array(q)], ["start", "length", "period"])
    return [pa.array(np.diff(first).astype(np.int64)), pa.array(np.diff(edge).astype(np.int64)), one(where), one(e - s), one(q), one(1000 * (e - s) // np.maximum(q, 1)),
            pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), rows), collapsed]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """(key, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed) of every whole text.

    A run is a stretch of words whose smallest period q fits it twice, of at least ``least`` words, that no neighbouring word
    extends; ``runs`` has all of them by start, then period, and the four numbers are those of the longest (ties: smallest
    start, then period; null where there is none).  ``collapsed`` is the text's words with one space between, without those that
    a run has after its first q words.

    White space is 0x20 and 0x09 to 0x0D.  Null and empty texts have no words, no runs and an empty ``collapsed``.  Rows are
    taken one by one: repeated keys and null keys stay rows of their own, and an empty table gives no rows.  Other columns, whatever their
    names, are not carried along.
    """
    names = [x.split()[0] for x in OUT.split(", ") if not x.startswith(("length:", "period:"))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                yield pa.RecordBatch.from_arrays([part.column("key"), *_found(part.column("text"), least)], ["key", *names])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {OUT}").withColumnRenamed("key", key)


def with_periods(text: Column, key: Column) -> Column:
    """The text, for one key in ten made to repeat from some word on: h is the checksum of the key and g its tenth; where h is a multiple of 10
    the words from a = g % n on are the first p = 1 + (n - a) / (3 + g % 8) of them over and over."""
    h = F.crc32(F.encode(key.cast("string"), "utf-8"))
    g = F.floor(h / F.lit(10))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    # each lambda binds a value once, so that no word is computed again for every other
    def shaped(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        bound = F.array(F.struct(a.alias("a"), (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int").alias("p")))
        return F.transform(bound, lambda b: F.array_join(F.transform(ws, lambda w, i: F.when(i < b["a"], w).otherwise(
            F.get(ws, b["a"] + (i - b["a"]) % b["p"]))), " "))[0]

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.transform(F.array(words), shaped)[0]).otherwise(text)
