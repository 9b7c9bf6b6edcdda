"""Row-level text metrics as Column expressions.

Every corpus metric is split in two: integer statistics per row, and one closed formula over their
sums.  The statistics need no shuffle; the sums combine before the shuffle; the formula runs once
per group.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parley.functions.text import SPACE, let, norm_text, squeeze_spaces, words

BLEU_ORDER = 4
CHRF_ORDER = 6
CHRF_BETA = 2
LONGS = T.ArrayType(T.LongType())

# The published mteval-v13a tokenisation.
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
PUNCTUATION = r"([{-~\[-` -&\(-\+:-@/])"
PERIOD_AFTER_NON_DIGIT = r"([^0-9])([\.,])"
PERIOD_BEFORE_NON_DIGIT = r"([\.,])([^0-9])"
DASH_AFTER_DIGIT = r"([0-9])(-)"
RULES = [(re.compile(p), new) for p, new in (
    (PUNCTUATION, r" \1 "), (PERIOD_AFTER_NON_DIGIT, r"\1 \2 "), (PERIOD_BEFORE_NON_DIGIT, r" \1 \2"), (DASH_AFTER_DIGIT, r"\1 \2 "))]
ROWS = 1000  # rows of an Arrow batch that are Python objects at a time
CHUNK = 1 << 17  # bytes of text whose n-grams are counted at a time
WORDS = 1 << 14  # words of texts that are left out at a time
FOLLOW = 4  # texts in a row that change little from one to the next are counted by their changes


def tokens_13a(c: Column) -> Column:
    """Tokens of the 13a scheme, separated by single spaces."""
    t = F.coalesce(c, F.lit(""))
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, PUNCTUATION, " $1 ")
    t = F.regexp_replace(t, PERIOD_AFTER_NON_DIGIT, "$1 $2 ")
    t = F.regexp_replace(t, PERIOD_BEFORE_NON_DIGIT, " $1 $2")
    t = F.regexp_replace(t, DASH_AFTER_DIGIT, "$1 $2 ")
    return squeeze_spaces(t)


def no_spaces(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, "")


def _clipped(hyp, ref, n: int) -> int:
    """n-grams of ``hyp`` also in ``ref``, each counted at most as often as ``ref`` has it."""
    have = Counter(zip(*(ref[i:] for i in range(n))))
    want = Counter(zip(*(hyp[i:] for i in range(n))))
    return sum(min(k, have[g]) for g, k in want.items() if g in have)


def _clipped_chars(hyp: str, ref: str) -> list[int]:
    """Clipped counts of the character n-grams of all orders.

    With up to 1024 distinct characters an n-gram packs into one 64-bit number, and sorting numbers
    replaces hashing tuples; other pairs take the plain way.
    """
    letters, ids = np.unique(np.frombuffer((hyp + ref).encode("utf-32-le"), dtype="<u4"), return_inverse=True)
    bits = max(1, int(len(letters) - 1).bit_length()) if len(letters) else 1
    if bits * CHRF_ORDER > 63:
        return [_clipped(hyp, ref, n) for n in range(1, CHRF_ORDER + 1)]
    h = h1 = ids[: len(hyp)].astype("int64")
    r = r1 = ids[len(hyp) :].astype("int64")
    out = []
    for n in range(1, CHRF_ORDER + 1):
        if n > 1:
            h, r = (h[:-1] << bits) | h1[n - 1 :], (r[:-1] << bits) | r1[n - 1 :]
        if len(h) == 0 or len(r) == 0:
            return out + [0] * (CHRF_ORDER + 1 - n)
        want, k = np.unique(h, return_counts=True)
        have, m = np.unique(r, return_counts=True)
        at = np.minimum(np.searchsorted(have, want), len(have) - 1)
        out.append(int(np.minimum(k, m[at])[have[at] == want].sum()))
    return out


class _Pieces(dict):
    """13a tokens of texts without spaces; the short ones are remembered."""

    def __missing__(self, piece: str) -> tuple[str, ...]:
        if piece.isalnum():  # no rule looks at letters alone
            return (piece,)
        t = piece
        for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES):
            t = t.replace(old, new)
        t = f" {t} "
        for pattern, new in RULES:
            t = pattern.sub(new, t)
        tokens = tuple(t.split())
        if len(piece) <= 32:
            if len(self) >= 1 << 16:
                self.clear()
            self[piece] = tokens
        return tokens


_pieces = _Pieces()


def tokens_of(text: str) -> list[str]:
    """The tokens of :func:`tokens_13a`.  None of its rules reaches across a space, so a text is cut there first."""
    return [t for p in text.split(" ") for t in _pieces[p]]


def _last_tokens(text: str, n: int) -> list[str]:
    cuts = n + 1
    while True:
        some = text.rsplit(" ", cuts)
        whole = len(some) <= cuts
        found = [t for p in some[0 if whole else 1:] for t in _pieces[p]]
        if whole or len(found) >= n:
            return found[-n:]
        cuts *= 4


def _first_tokens(text: str, n: int) -> list[str]:
    cuts = n + 1
    while True:
        some = text.split(" ", cuts)
        found = [t for p in some[:cuts + (len(some) <= cuts)] for t in _pieces[p]]
        if len(some) <= cuts or len(found) >= n:
            return found[:n]
        cuts *= 4


def _same_start(a: str, b: str, most: int) -> int:
    """How many of the first ``most`` characters agree."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _same_end(a: str, b: str, most: int) -> int:
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid:len(a) - low] == b[len(b) - mid:len(b) - low]:
            low = mid
        else:
            high = mid - 1
    return low


class Overlaps:
    """Row statistics of BLEU for one text after the other: clipped n-gram matches per order, tokens of both sides.

    A reference is counted once for the texts that follow each other with it (the configs of a grid, the texts of an ablation).  A text that has
    most of the one before it costs only the n-grams of what changed, taken out of and put into the counts.
    """

    def __init__(self):
        self.ref: str | None = None

    def __call__(self, hyp: str, ref: str) -> list[int]:
        if ref != self.ref:
            self.ref, self.hyp, self.ref_tokens = ref, None, tokens_of(ref)
            self.want = [Counter(_grams(self.ref_tokens, n)) for n in range(1, BLEU_ORDER + 1)]
        if hyp != self.hyp and not (self.hyp and self._changed(hyp)):
            self._whole(tokens_of(hyp))
        self.hyp = hyp
        return [*self.found, self.size, len(self.ref_tokens)]

    def _whole(self, tokens: list[str]) -> None:
        self.size, self.have, self.found = len(tokens), [], []
        for n, want in enumerate(self.want, 1):
            if self.have and not self.have[-1]:  # no shorter n-gram is in the reference
                have = Counter()
            else:
                have = Counter(filter(want.__contains__, _grams(tokens, n)))
            self.have.append(have)
            self.found.append(sum(min(k, want[g]) for g, k in have.items()))

    def _changed(self, hyp: str) -> bool:
        """The counts moved on from the text before, if half of the longer one stays; cuts are made at spaces both have."""
        old = self.hyp
        short, long = sorted((len(old), len(hyp)))
        a = max(0, hyp.rfind(" ", 0, _same_start(old, hyp, short)))
        b = hyp.find(" ", len(hyp) - _same_end(old, hyp, short - a))
        b = len(hyp) - b if b >= 0 else 0
        if 2 * (a + b) < long:
            return False
        before, after = _last_tokens(hyp[:a], BLEU_ORDER - 1), _first_tokens(hyp[len(hyp) - b:], BLEU_ORDER - 1)
        gone, new = tokens_of(old[a:len(old) - b]), tokens_of(hyp[a:len(hyp) - b])
        self.size += len(new) - len(gone)
        for n, (want, have) in enumerate(zip(self.want, self.have), 1):
            left, right, found = before[max(0, len(before) - n + 1):], after[:n - 1], self.found[n - 1]
            for g in _grams([*left, *gone, *right], n):
                if g in want:
                    found -= have[g] <= want[g]
                    have[g] -= 1
            for g in _grams([*left, *new, *right], n):
                if g in want:
                    found += have[g] < want[g]
                    have[g] += 1
            self.found[n - 1] = found
        return True


def _grams(tokens: list[str], n: int) -> Iterator[tuple[str, ...]]:
    return zip(*(tokens[i:] for i in range(n)))


def _lists_of(rows: list[list[int]] | np.ndarray) -> pa.Array:
    """list<long> of the statistics of rows, all of one width."""
    flat = np.asarray(rows, np.int64)
    width = flat.shape[1] if len(flat) else 1
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * width, pa.int32()), pa.array(flat.reshape(-1)))


def matches(ids: np.ndarray, count: np.ndarray, orders: int) -> np.ndarray:
    """Clipped n-gram matches of many rows at once: one line a row, one column an order.

    ``ids`` are the tokens of all hypotheses and then of all references, end to end, ``count`` how many each text has.  The longest n-gram
    at each place is packed into one whole number behind its row, the side as the lowest bit; these in order are in order for all
    shorter n-grams too.  Rows whose numbers need more than 63 bits are halved, and a single one takes the plain way.
    """
    rows = len(count) // 2
    text = np.repeat(np.arange(len(count)), count)
    bits = int(ids.max(initial=0) + 1).bit_length()
    if rows.bit_length() + bits * orders + 1 > 63:
        seen, ids = np.unique(ids, return_inverse=True)
        bits = len(seen).bit_length()
    if rows.bit_length() + bits * orders + 1 > 63:
        ends = np.cumsum(count)
        if rows == 1:
            return np.array([[_clipped(ids[:ends[0]].tolist(), ids[ends[0]:].tolist(), n) for n in range(1, orders + 1)]])
        first = text % rows < rows // 2
        each = np.arange(2 * rows) % rows < rows // 2
        return np.concatenate([matches(ids[f], count[e], orders) for f, e in ((first, each), (~first, ~each))])
    out = np.zeros((rows, orders), np.int64)
    if not len(ids):
        return out
    # 0 stands behind the end of a text
    key = (text % rows) << bits | (ids + 1)
    for n in range(1, orders):
        key <<= bits
        key[:-n] |= np.where(text[:-n] == text[n:], ids[n:] + 1, 0)
    key = np.sort(key << 1 | (text >= rows))
    of_ref = np.concatenate([[0], np.cumsum(key & 1)])
    last = (1 << bits) - 1
    for n in range(1, orders + 1):
        gram = key >> (1 + bits * (orders - n))
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        edge = np.append(first, len(key))
        ref = np.diff(of_ref[edge])
        both = np.minimum(ref, np.diff(edge) - ref)
        gram = gram[first]
        some = np.flatnonzero((both > 0) & (gram & last > 0))
        out[:, n - 1] = np.bincount(gram[some] >> (bits * n), both[some], rows)
    return out


def _token_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts as numbers, end to end, and how many each has; a piece between spaces is taken apart once."""
    lists = pc.split_pattern(texts, " ")
    pieces = lists.flatten().dictionary_encode()
    number: dict[str, int] = {}
    each = [[number.setdefault(t, len(number)) for t in _pieces[p]] for p in pieces.dictionary.to_pylist()]
    size = np.array([len(e) for e in each], np.int64)
    flat = np.array([t for e in each for t in e], np.int64)
    which = pieces.indices.to_numpy().astype(np.int64)
    count = size[which]
    start = (np.cumsum(size) - size)[which]
    ends = np.cumsum(count)
    ids = flat[np.arange(count.sum()) + np.repeat(start - (ends - count), count)]
    edge = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))])
    return ids, np.diff(np.concatenate([[0], ends])[edge])


def _letter_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts as numbers, end to end, and how many each has."""
    letters = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
    seen = np.zeros(int(letters.max(initial=0)) + 1, bool)
    seen[letters] = True
    return (np.cumsum(seen) - 1)[letters], pc.utf8_length(texts).to_numpy().astype(np.int64)


def _stats(hyp: pa.Array, ref: pa.Array, numbers: Callable, orders: int) -> np.ndarray:
    """Row statistics of a few rows: matches per order, lengths of both sides.  A text is taken apart once, and equal texts match in all they have."""
    rows = len(hyp)
    texts = pa.concat_arrays([hyp, ref]).dictionary_encode()
    which = texts.indices.to_numpy().astype(np.int64)
    ids, count = numbers(texts.dictionary)
    start = (np.cumsum(count) - count)[which]
    count = count[which]
    out = np.empty((rows, orders + 2), np.int64)
    out[:, orders], out[:, orders + 1] = count[:rows], count[rows:]
    out[:, :orders] = np.maximum(count[:rows, None] - np.arange(orders), 0)
    other = np.flatnonzero(which[:rows] != which[rows:])
    if len(other):
        both = np.concatenate([other, rows + other])
        count = count[both]
        place = np.arange(count.sum()) + np.repeat(start[both] - (np.cumsum(count) - count), count)
        out[other, :orders] = matches(ids[place], count, orders)
    return out


def _chunks(hyp: pa.Array, ref: pa.Array) -> Iterator[slice]:
    """Runs of rows with about ``CHUNK`` bytes of text."""
    size = sum(pc.binary_length(x).to_numpy().astype(np.int64) for x in (hyp, ref))
    run = (np.cumsum(size) - size) // CHUNK
    run = run * (len(size) // ROWS + 1) + np.arange(len(size)) // ROWS
    cut = np.flatnonzero(np.diff(run)) + 1
    return (slice(int(a), int(b)) for a, b in zip([0, *cut], [*cut, len(size)]) if a < b)


def _followers(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
    """Rows in runs of ``FOLLOW`` or more that share a reference and of which each has most of the one before."""
    like, old, old_ref = np.zeros(len(hyp) + 1, bool), "", None
    for k, (h, r) in enumerate(zip(hyp, ref)):
        new, new_ref = h.as_py(), r.as_py()
        if new_ref == old_ref and new != new_ref:
            short, long = sorted((len(old), len(new)))
            if 2 * short >= long:
                same = _same_start(old, new, short)
                like[k] = 2 * (same + _same_end(old, new, short - same)) >= long
        old, old_ref = new, new_ref
    start = np.flatnonzero(like[1:] & ~like[:-1]) + 1
    stop = np.flatnonzero(~like[1:] & like[:-1]) + 1
    out = np.zeros(len(hyp), bool)
    for a, b in zip(start, stop, strict=True):
        out[a:b] = b - a >= FOLLOW
    return out


# The clipped n-gram counts are the one place where Arrow batches beat the JVM: as a sort-and-fold
# over arrays they took 13 s for 24 million character n-grams on 8 cores, hashed in Arrow batches 2.6 s,
# and both leave the rows where they are.  An explode into (row, n-gram) would shuffle every n-gram.
@F.arrow_udf(LONGS)
def _token_overlaps(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    count, out, follows = Overlaps(), np.zeros((len(hyp), BLEU_ORDER + 2), np.int64), _followers(hyp, ref)
    for k in np.flatnonzero(follows):
        out[k] = count(hyp[k].as_py(), ref[k].as_py())
    rows = np.flatnonzero(~follows)
    h, r = hyp.take(pa.array(rows)), ref.take(pa.array(rows))
    for s in _chunks(h, r):
        out[rows[s]] = _stats(h[s], r[s], _token_numbers, BLEU_ORDER)
    return _lists_of(out)


@F.arrow_udf(LONGS)
def _char_overlaps(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    out = np.zeros((len(hyp), CHRF_ORDER + 2), np.int64)
    for s in _chunks(hyp, ref):
        out[s] = _stats(hyp[s], ref[s], _letter_numbers, CHRF_ORDER)
    return _lists_of(out)


def _left(n: Column, order: int) -> Column:
    return F.greatest(n - (order - 1), F.lit(0)).cast("long")


@F.arrow_udf(LONGS)
def _some_overlaps(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """The statistics of the rows that have texts; the others have none."""
    some = pc.is_valid(hyp)
    if not pc.any(some).as_py():
        return pa.nulls(len(hyp), pa.list_(pa.int64()))
    found = _token_overlaps.func(hyp.filter(some), ref.filter(some))
    return found.take(pc.if_else(some, pa.array(np.cumsum(some.to_numpy(zero_copy_only=False)) - 1), None))


def with_bleu_stats(df: DataFrame, ref: str, hyp: str, known: Column | None = None) -> DataFrame:
    """Add the row statistics of BLEU: matches and totals per order, both lengths.

    Rows whose statistics are ``known`` (null where not) do not send their texts to be counted.
    """
    text = [F.coalesce(F.col(c), F.lit("")) for c in (hyp, ref)]
    if known is None:
        return df.withColumn("_m", _token_overlaps(*text)).withColumns(bleu_columns(F.col("_m"))).drop("_m")
    rows = df.withColumn("_k", known)
    rows = rows.withColumn("_t", F.when(F.col("_k").isNull(), F.struct(text[0].alias("hyp"), text[1].alias("ref"))))
    rows = rows.withColumn("_m", F.coalesce(F.col("_k"), _some_overlaps(F.col("_t.hyp"), F.col("_t.ref"))))
    return rows.withColumns(bleu_columns(F.col("_m"))).drop("_m", "_k", "_t")


LEFT_OUT = T.ArrayType(T.StructType([T.StructField("removed_index", T.IntegerType()), T.StructField("stats", LONGS)]))


def left_out_matches(ids: np.ndarray, count: np.ndarray, words_: np.ndarray) -> np.ndarray:
    """For each word left out of its text: clipped n-gram matches with the reference per order, and tokens of both sides; one line a word.

    ``ids`` are the tokens of all words of all texts and then of all references, end to end, ``count`` how many each word and each reference
    has, ``words_`` how many words each text has.  Only the n-grams that hold a token of the word go, and only those across the gap
    come, so a word costs the order and not the text.  An n-gram is its first n - 1 tokens, as a number, and its last one; the row is part
    of the first.
    """
    rows, total = len(words_), int(words_.sum())
    row = np.repeat(np.arange(rows), words_)
    stop = np.cumsum(count[:total])
    start = stop - count[:total]
    size = np.bincount(row, count[:total], rows).astype(np.int64)
    last = np.cumsum(size)
    end, begin = last[row], (last - size)[row]
    hyp, ref = ids[:len(ids) - int(count[total:].sum())], ids[len(ids) - int(count[total:].sum()):]
    hyp_row, ref_row = np.repeat(row, count[:total]), np.repeat(np.arange(rows), count[total:])
    hyp_end, ref_end = last[hyp_row], np.cumsum(count[total:])[ref_row]
    most = int(ids.max(initial=0)) + 1
    some = stop > start  # a word without tokens changes nothing
    out = np.empty((total, BLEU_ORDER + 2), np.int64)
    out[:, BLEU_ORDER], out[:, BLEU_ORDER + 1] = size[row] - count[:total], count[total:][row]
    h, r, gap = hyp_row, ref_row, {}  # the first n - 1 tokens at each place; a gap's, by the tokens before it
    for n in range(1, BLEU_ORDER + 1):
        in_hyp, in_ref = np.flatnonzero(np.arange(len(hyp)) + n <= hyp_end), np.flatnonzero(np.arange(len(ref)) + n <= ref_end)
        keys = [h[in_hyp] * most + hyp[in_hyp + n - 1], r[in_ref] * most + ref[in_ref + n - 1]]
        across = [np.flatnonzero(some & (start - u >= begin) & (stop + n - u <= end)) for u in range(1, n)]
        for u, k in enumerate(across, 1):
            keys.append((gap[u][k] if n - u > 1 else h[start[k] - u]) * most + hyp[stop[k] + n - u - 1])
        grams, number = np.unique(np.concatenate(keys), return_inverse=True)
        number = np.split(number, np.cumsum([len(k) for k in keys])[:-1])
        h, r, gap = np.zeros(len(hyp), np.int64), np.zeros(len(ref), np.int64), {u: np.zeros(total, np.int64) for u in range(1, n + 1)}
        h[in_hyp], r[in_ref] = number[0], number[1]
        for u, k in enumerate(across, 1):
            gap[u][k] = number[u + 1]
        have, want = np.bincount(number[0], minlength=len(grams)), np.bincount(number[1], minlength=len(grams))
        of = np.zeros(len(grams), np.int64)
        of[number[0]] = hyp_row[in_hyp]
        both = np.minimum(have, want)
        whole = np.bincount(of, both, rows).astype(np.int64)
        # (word, n-gram): how many fewer or more there are without the word
        low = np.maximum(begin, start - n + 1)
        gone = np.where(some, np.maximum(np.minimum(stop, end - n + 1) - low, 0), 0)
        word = np.repeat(np.arange(total), gone)
        place = np.arange(len(word)) + np.repeat(low - (np.cumsum(gone) - gone), gone)
        word, gram = np.concatenate([word, *across]), np.concatenate([h[place], *number[2:]])
        by = np.where(np.arange(len(word)) < len(place), -1, 1)
        kept = np.flatnonzero(want[gram] > 0)
        pair, which = np.unique(word[kept] * len(grams) + gram[kept], return_inverse=True)
        by = np.bincount(which, by[kept], len(pair)).astype(np.int64)
        word, gram = np.divmod(pair, max(len(grams), 1))
        out[:, n - 1] = whole[row] + np.bincount(word, np.minimum(have[gram] + by, want[gram]) - both[gram], total).astype(np.int64)
    return out


@F.arrow_udf(LEFT_OUT)
def _left_out(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, refs in batches:
        for at in range(0, len(refs), ROWS):  # a word's statistics are plain numbers, and as many rows' at a time
            some, ref = texts.slice(at, ROWS), pc.fill_null(refs.slice(at, ROWS), "")
            words_ = pc.fill_null(pc.list_value_length(some), 0).to_numpy().astype(np.int64)
            flat, edge = pc.fill_null(some.flatten(), ""), np.concatenate([[0], np.cumsum(words_)])
            run = np.cumsum(words_ + pc.binary_length(ref).to_numpy() // 4) // WORDS
            cut = np.flatnonzero(np.diff(run)) + 1
            stats = np.empty((edge[-1], BLEU_ORDER + 2), np.int64)
            for a, b in zip([0, *cut], [*cut, len(words_)]):
                texts_ = pa.concat_arrays([flat.slice(edge[a], edge[b] - edge[a]), ref.slice(a, b - a)])
                stats[edge[a]:edge[b]] = left_out_matches(*_token_numbers(texts_), words_[a:b])
            index = np.arange(edge[-1]) - np.repeat(edge[:-1], words_)
            each = pa.StructArray.from_arrays([pa.array(index, pa.int32()), _lists_of(stats)], ["removed_index", "stats"])
            yield pa.ListArray.from_arrays(pa.array(edge, pa.int32()), each)


def left_out_stats(words_: Column, ref: Column) -> Column:
    """array<struct<removed_index, stats>>: the row statistics of BLEU of a text's words (an array) without each of them."""
    return _left_out(words_, ref)


def bleu_columns(stats: Column) -> dict[str, Column]:
    """The statistics columns of BLEU out of an array of matches and lengths."""
    out = {f"bleu_m{n}": stats[n - 1] for n in range(1, BLEU_ORDER + 1)}
    out |= {f"bleu_t{n}": _left(stats[BLEU_ORDER], n) for n in range(1, BLEU_ORDER + 1)}
    return out | {"bleu_hyp": stats[BLEU_ORDER], "bleu_ref": stats[BLEU_ORDER + 1]}


BLEU_STATS = [f"bleu_{k}{n}" for k in "mt" for n in range(1, BLEU_ORDER + 1)] + ["bleu_hyp", "bleu_ref"]
CHRF_STATS = [f"chrf_{k}{n}" for k in "mhr" for n in range(1, CHRF_ORDER + 1)]


def with_chrf_stats(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Add the row statistics of chrF: matches, hypothesis and reference n-grams per order."""
    m, out = F.col("_m"), {}
    for n in range(1, CHRF_ORDER + 1):
        ref_n = _left(m[CHRF_ORDER + 1], n)
        out[f"chrf_m{n}"] = m[n - 1]
        out[f"chrf_h{n}"] = F.when(ref_n > 0, _left(m[CHRF_ORDER], n)).otherwise(F.lit(0).cast("long"))
        out[f"chrf_r{n}"] = ref_n
    return df.withColumn("_m", _char_overlaps(no_spaces(F.col(hyp)), no_spaces(F.col(ref)))).withColumns(out).drop("_m")


def bleu_score(prefix: str = "bleu_", effective_order: bool = False) -> Column:
    """BLEU (0-100) from summed statistics, exponential smoothing of empty orders.

    ``effective_order`` averages only over the orders the text is long enough for, the form used
    for single sentences.
    """
    m = [F.col(f"{prefix}m{n}") for n in range(1, BLEU_ORDER + 1)]
    t = [F.col(f"{prefix}t{n}") for n in range(1, BLEU_ORDER + 1)]
    hyp, ref = F.col(f"{prefix}hyp"), F.col(f"{prefix}ref")
    zeros, logs, used = F.lit(0), F.lit(0.0), F.lit(0)
    for mn, tn in zip(m, t):
        zeros = zeros + F.when((mn == 0) & (tn > 0), 1).otherwise(0)
        smoothed = F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * tn)
        precision = F.when(mn == 0, smoothed).otherwise(F.lit(100.0) * mn / tn)
        logs = logs + F.when(tn > 0, F.log(precision)).otherwise(F.lit(0.0))
        used = used + F.when(tn > 0, 1).otherwise(0)
    orders = used if effective_order else F.lit(BLEU_ORDER)
    any_match = m[0] + m[1] + m[2] + m[3] > 0
    complete = F.lit(True) if effective_order else t[-1] > 0
    penalty = F.when(hyp < ref, F.exp(F.lit(1.0) - ref / hyp)).otherwise(F.lit(1.0))
    return F.when(any_match & complete, penalty * F.exp(logs / orders)).otherwise(F.lit(0.0))


def chrf_score(prefix: str = "chrf_") -> Column:
    """chrF (0-100): F-beta of the precision and recall averaged over the orders both sides have."""
    p, r, used = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in range(1, CHRF_ORDER + 1):
        m, h, ref = (F.col(f"{prefix}{k}{n}") for k in "mhr")
        both = (h > 0) & (ref > 0)
        p = p + F.when(both, m / h).otherwise(F.lit(0.0))
        r = r + F.when(both, m / ref).otherwise(F.lit(0.0))
        used = used + F.when(both, 1).otherwise(0)
    p, r = p / used, r / used
    b2 = float(CHRF_BETA**2)
    return F.when((used > 0) & (p + r > 0), F.lit(100.0) * (1 + b2) * p * r / (b2 * p + r)).otherwise(F.lit(0.0))


def token_f1(ref: Column, hyp: Column) -> Column:
    """F1 of the two sets of lower-case words, 1 when both are empty."""
    r = F.array_distinct(words(F.lower(ref)))
    h = F.array_distinct(words(F.lower(hyp)))
    both = F.size(F.array_intersect(r, h))
    return (
        F.when((F.size(r) == 0) & (F.size(h) == 0), F.lit(1.0))
        .when(both == 0, F.lit(0.0))
        .otherwise(F.lit(2.0) * both / (F.size(r) + F.size(h)))
    )


def is_exact_match(ref: Column, hyp: Column) -> Column:
    return norm_text(F.coalesce(ref, F.lit(""))) == norm_text(F.coalesce(hyp, F.lit("")))


def _mask(at: list[int], size: int) -> int:
    """A whole number with the bits ``at`` set."""
    bits = np.zeros(size, np.uint8)
    bits[at] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _columns(ref: list[str], hyp: list[str], keep: bool) -> tuple[int, list[tuple[int, int]]]:
    """Edit distance of two word lists, and with ``keep`` the steps down each column of the table as bits: (one more, one less).

    Bit-parallel: one whole number holds a column's steps, so a hypothesis word costs a few operations on len(ref) bits.
    """
    m = len(ref)
    if not m:
        return len(hyp), []
    where: dict[str, list[int]] = {w: [] for w in hyp}
    for i, w in enumerate(ref):
        if w in where:
            where[w].append(i)
    few = {w: sum(1 << i for i in at) for w, at in where.items()} if m <= 4096 else None  # masks of long texts are made when needed
    all_, top, distance = (1 << m) - 1, 1 << m - 1, m
    more, less = all_, 0
    out = []
    for w in hyp:
        x = (few[w] if few is not None else _mask(where[w], m)) | less
        diagonal = ((((x & more) + more) ^ more) | x) & all_
        right_more = less | (all_ & ~(diagonal | more))
        right_less = more & diagonal
        if right_more & top:
            distance += 1
        elif right_less & top:
            distance -= 1
        right_more = (right_more << 1 | 1) & all_
        right_less = right_less << 1 & all_
        more = right_less | (all_ & ~(diagonal | right_more))
        less = right_more & diagonal
        if keep:
            out.append((more, less))
    return distance, out


def _inner(ref: list[str], hyp: list[str]) -> tuple[list[str], list[str]]:
    """Without what both begin and end with."""
    n = min(len(ref), len(hyp))
    a = next((i for i in range(n) if ref[i] != hyp[i]), n)
    b = next((i for i in range(n - a) if ref[-1 - i] != hyp[-1 - i]), n - a)
    return ref[a:len(ref) - b], hyp[a:len(hyp) - b]


def split_edits(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of an alignment with the fewest edits, found backwards from the ends."""
    ref, hyp = _inner(ref, hyp)
    _, steps = _columns(ref, hyp, True)
    i, j, changed, gone, new = len(ref), len(hyp), 0, 0, 0
    while i and j:
        bit = 1 << i - 1
        if steps[j - 1][0] & bit:
            gone, i = gone + 1, i - 1
        elif j > 1 and steps[j - 2][1] & bit:
            new, j = new + 1, j - 1
        else:
            changed += ref[i - 1] != hyp[j - 1]
            i, j = i - 1, j - 1
    return changed, gone + i, new + j


def _lists(texts: pd.Series) -> list[list[str]]:
    return [t.split(" ") if t else [] for t in texts]


def _spaced(c: Column) -> Column:
    return F.array_join(words(c), " ")


@F.pandas_udf(T.LongType())
def _edit_counts(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([_columns(*_inner(r, h), False)[0] for r, h in zip(_lists(ref), _lists(hyp), strict=True)], dtype="int64")


EDITS = T.StructType([T.StructField(n, T.LongType()) for n in ("substitutions", "deletions", "insertions")])


@F.pandas_udf(EDITS)
def _edit_splits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = [split_edits(r, h) for r, h in zip(_lists(ref), _lists(hyp), strict=True)]
    return pd.DataFrame(rows, columns=EDITS.fieldNames(), dtype="int64")


def word_edits(ref: Column, hyp: Column) -> Column:
    """Insertions, deletions and substitutions that turn the words of ``ref`` into those of ``hyp``; null has no words.

    There may be any number of different words: they are bits of whole numbers, in Arrow batches.
    """
    return _edit_counts(_spaced(ref), _spaced(hyp))


def word_edit_parts(ref: Column, hyp: Column) -> Column:
    """The same edits by kind: struct<substitutions, deletions, insertions>; a row needs a quarter byte for each pair of its words."""
    return _edit_splits(_spaced(ref), _spaced(hyp))


def set_difference_errors(ref: Column, hyp: Column) -> Column:
    """Words on one side only (order and repeats ignored); every hypothesis word when there is no reference."""
    r, h = words(ref), words(hyp)
    both_ways = F.size(F.array_except(h, r)) + F.size(F.array_except(r, h))
    return F.when(F.size(r) == 0, F.size(h)).otherwise(both_ways).cast("long")
