"""Byte-level BPE over a partition at once, by an index of pair occurrences.

The distinct words of a batch lie in one array of symbols with links to their neighbours.  An index maps
each pair that has a merge to all its positions.  Active ranks are applied in ascending order: one rank
joins all its positions together, and the lists of the pairs that appear beside them are updated.  A merge
only makes pairs of higher rank, so one ascending pass is the whole encoding.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from parley.llm.blocks import pieces

# How byte-level vocabularies split a text before the merges (fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of printable ASCII and Latin letters up to U+024F, where it needs no Unicode tables.
LATIN, LATIN_DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
LATIN_SPLIT = rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[{LATIN_DIGITS}]+| ?[^\s{LATIN}{LATIN_DIGITS}]+|\s+(?!\S)|\s+"
BATCH = 2 << 20  # bytes of text whose new words are merged together
FEW = 12  # positions of a rank that are joined one by one
CACHE = 24 << 20  # bytes of words, of their ids and of the table's entries that a task remembers
ENTRY = 200  # bytes of an entry besides its word and ids


def splitter():
    """A function from a text to its words."""
    every, latin, other = regex.compile(SPLIT).findall, re.compile(LATIN_SPLIT).findall, re.compile("[^\t\n\r -~¡-ɏ]").search
    return lambda t: every(t) if other(t) else latin(t)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What encoding and decoding need of a tokenizer file: small arrays, sent once to every executor."""

    def __init__(self, text: str):
        spec = json.loads(text)
        ids, letters = spec["model"]["vocab"], byte_letters()
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(key)
        self.keys, self.made = key[self.order], made
        self.rank_of = dict(zip(key.tolist(), range(len(key)), strict=True))
        self.left, self.right = key >> 32, key & 0xFFFFFFFF
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in ids.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        return cls(Path(path).read_text(encoding="utf-8"))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has no merge; a negative symbol is an edge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits each) of each word."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        # an edge symbol before each word and one at the end
        sym = np.full(len(data) + len(words) + 1, -1, np.int64)
        inside = np.arange(len(data)) + np.repeat(np.arange(len(words)), size) + 1
        sym[inside] = self.byte_ids[data]
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(sym) - 1)]
            rank = self.ranks(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            if not len(rank):
                return
            cut = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            for lo, hi in zip(cut, [*cut[1:], len(rank)], strict=True):
                r = int(rank[lo])
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(at[lo:hi])

        def note_one(i: int) -> None:
            a, b = int(sym[i]), int(sym[after[i]])
            r = self.rank_of.get((a << 32) | b) if a >= 0 and b >= 0 else None
            if r is not None:
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(np.array([i]))

        note(inside)
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            left, right, new = int(self.left[r]), int(self.right[r]), int(self.made[r])
            if sum(map(len, held)) <= FEW:
                for i in sorted({int(i) for x in held for i in x}):
                    gone = int(after[i])
                    if sym[i] == left and sym[gone] == right:
                        sym[i], sym[gone] = new, -2
                        after[i] = end = int(after[gone])
                        before[end] = i
                        note_one(int(before[i]))
                        note_one(i)
                continue
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[(sym[at] == left) & (sym[after[at]] == right)]
            if left == right and len(at) > 1:  # of a run of equal symbols every second one starts a pair
                joined = np.r_[False, after[at[:-1]] == at[1:]]
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at], sym[gone] = new, -2
            after[at] = after[gone]
            before[after[at]] = at
            near = np.r_[before[at], at]
            near.sort()
            note(near[np.r_[True, near[1:] != near[:-1]]])
        live = inside[sym[inside] >= 0]
        word = np.searchsorted(np.cumsum(size + 1), live, side="right")
        ids = sym[live].astype("<u4")
        edge = np.searchsorted(word, np.arange(len(words) + 1))
        return [ids[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]


class _Encoder:
    """Texts to ids with a bounded memory of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.find = vocabulary, splitter()
        special = vocabulary.special
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in special) + ")") if special else None
        self.clear()

    def clear(self) -> None:
        self.cache = {t: np.array([i], "<u4").tobytes() for t, i in self.v.special.items()}
        self.used = 0

    def words(self, text: str) -> list[str]:
        if self.cut and self.cut.search(text):
            return [w for i, x in enumerate(self.cut.split(text)) for w in ([x] if i % 2 else self.find(x))]
        return self.find(text)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids (little-endian, 32 bits each) of each text."""
        split = [self.words(t or "") for t in texts]
        fresh = list(set().union(*split).difference(self.cache))
        data = [w.encode() for w in fresh]
        if self.used + sum(map(len, data)) + ENTRY * len(data) > CACHE:
            self.clear()
            fresh = list(set().union(*split).difference(self.cache))
            data = [w.encode() for w in fresh]
        if fresh:
            merged = self.v.merge(data)
            self.cache.update(zip(fresh, merged, strict=True))
            self.used += sum(map(len, data)) + sum(map(len, merged)) + ENTRY * len(data)
        return [b"".join(map(self.cache.__getitem__, words)) for words in split]


def _id_lists(ids: list[bytes]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _texts(ids: list[bytes], piece: dict[int, bytes]) -> pa.Array:
    return pa.array([b"".join(map(piece.__getitem__, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in ids], pa.string())


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids array<int>) of the whole texts, and with ``decoded`` the text that the ids stand for; null counts as empty, an empty
    text has no ids.

    Strings of special tokens inside a text become those tokens, as the tokenizer file asks.  Other columns
    are not carried along.  Repeated rows are encoded each; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["key", "ids", "text"][:3 if decoded else 2]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(held.value)
        for batch in batches:
            for part in pieces(batch, "text", BATCH):
                ids = encoder.ids(part.column("text").to_pylist())
                columns = [part.column("key"), _id_lists(ids)]
                if decoded:
                    columns.append(_texts(ids, held.value.bytes))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, ids array<int>" + (", text string" if decoded else "")
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, text): the ids of each text and what they decode to, in one pass; see ``encode`` and ``decode``."""
    return encode(docs, vocabulary, key, text, decoded=True)


def decode(rows: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, text) of id lists; special tokens are kept, bytes that are no UTF-8 become U+FFFD, null gives an empty text."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary.bytes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = held.value.__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = [b"".join(map(piece, x or ())).decode("utf-8", "replace") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("ids"), pa.array(texts, pa.string())], ["key", "ids", "text"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, ids array<int>, text string").select(
        F.col("key").alias(key), F.col("ids").alias(ids), "text")
