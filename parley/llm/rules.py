"""Quality rules of documents, and verdicts on their hosts.

Rules are measured per document; failures of each rule are summed per host; each host's rate is shrunk towards the
mean of all hosts by a beta prior fitted to the hosts themselves; the verdict is joined back to the host's documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.blocks import Words, is_space, mix, pieces, prefix_hash, range_hash, raw, windows
from parley.llm.store import kept

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_U = np.uint64


def _sums(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flag)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value how often its document has it, and whether it stands there for the first time."""
    _, first, back, often = np.unique(mix(value + mix(doc.astype(_U))), return_index=True, return_inverse=True, return_counts=True)
    new = np.zeros(len(doc), bool)
    new[first] = True
    return often[back], new


def measure_texts(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """The counts of :func:`measures` for texts laid end to end."""
    words, n = Words(data, offsets), len(offsets) - 1
    solid = ~is_space(data)
    out = {"n_words": words.counts(), "word_chars": _sums(solid & ((data & 0xC0) != 0x80), offsets),
           "n_symbols": _sums(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets)}
    # a line goes from a text's start or a line feed to the next line feed or the text's end
    feed = np.flatnonzero(data == 10)
    start = np.unique(np.r_[feed + 1, offsets[:-1]])
    start = start[start < len(data)]
    doc = np.searchsorted(offsets, start, side="right") - 1
    stop = np.minimum(np.r_[feed, len(data)][np.searchsorted(feed, start)], offsets[doc + 1])
    has = np.r_[0, np.cumsum(solid)]
    full = has[stop] > has[start]
    start, stop, doc = start[full], stop[full], doc[full]
    _, new = _repeats(doc, range_hash(prefix_hash(data), start, stop) + (stop - start).astype(_U))
    out["n_dup_lines"] = np.bincount(doc[~new], minlength=n)
    h, at = windows(words, window)
    often, _ = _repeats(words.doc[at], h)
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, at[often > 1], 1)
    np.add.at(edge, at[often > 1] + window, -1)
    out["n_repeat_words"] = np.bincount(words.doc[np.cumsum(edge)[:-1] > 0], minlength=n)
    return out


def measures(docs: DataFrame, host: str = "source", window: int = 5) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of whole texts; null text has none."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                got = measure_texts(*raw(part.column("text")), window)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)],
                                                 ["doc_id", "host", *COUNTS])

    return docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), "text").mapInArrow(
        run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Limits:
    """A document fails with fewer words, or more of its words (in percent) in repeated windows; the other rules count for its host alone.

    ``symbol_percent`` and ``line_percent`` are symbols and repeated lines for 100 words; the mean word has ``least_chars`` to
    ``most_chars`` characters.  A host fails whole if its shrunken rate under some rule is above ``host_rate``, or has more than
    ``host_odds`` times the odds of the prior mean and is still above ``host_least`` after three standard deviations are taken off.
    """

    least_words: int = 10
    repeat_percent: int = 20
    symbol_percent: int = 10
    line_percent: int = 2
    least_chars: int = 3
    most_chars: int = 10
    host_rate: float = 0.5
    host_least: float = 0.1
    host_odds: float = 4.0
    window: int = 5


def failures(limits: Limits) -> dict[str, Column]:
    """Rule name and whether a row of :func:`measures` fails it; without words only ``few_words`` fails."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {"few_words": n < limits.least_words,
            "repeated_words": 100 * F.col("n_repeat_words") > limits.repeat_percent * n,
            "symbols": 100 * F.col("n_symbols") > limits.symbol_percent * n,
            "repeated_lines": 100 * F.col("n_dup_lines") > limits.line_percent * n,
            "word_length": (chars < limits.least_chars * n) | (chars > limits.most_chars * n)}


def host_rates(rows: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(host, rule, n, failed, mean, rate, low): a host's failures of each rule and its rate shrunk by that rule's beta prior.

    Each rule has its own prior, with the pooled rate as mean.  Its strength comes from the spread between hosts that
    is left once the binomial noise within them is taken out (analysis of variance), so few documents of a host do not
    count as spread.  With no spread left, one host, or one document a host, every host gets the mean.
    ``low`` is the rate less three standard deviations of the host's posterior.
    """
    rules = failures(limits or Limits())
    sums = rows.filter("host IS NOT NULL").groupBy("host").agg(
        F.count("*").alias("n"), *(F.sum(fails.cast("long")).alias(rule) for rule, fails in rules.items()))
    hosts = sums.unpivot(["host", "n"], list(rules), "rule", "failed")
    n, failed = F.col("n"), F.col("failed")
    totals = hosts.groupBy("rule").agg(F.count("*").alias("k"), F.sum("n").alias("t"), F.sum(n.cast("double") * n).alias("q"),
                                       F.sum("failed").alias("s"), F.sum(failed.cast("double") * failed / n).alias("e"))
    mean, weight = F.lit(None).cast("double"), F.lit(None).cast("double")
    for r in totals.collect():  # one row a rule, whatever the number of hosts
        mean = F.when(F.col("rule") == r.rule, F.lit(r.s / r.t)).otherwise(mean)
        if r.k > 1 and r.t > r.k:
            between, within = (r.e - r.s * r.s / r.t) / (r.k - 1), (r.s - r.e) / (r.t - r.k)
            if between > within:
                strength = (r.t - r.q / r.t) / (r.k - 1) * within / (between - within)
                weight = F.when(F.col("rule") == r.rule, F.lit(strength)).otherwise(weight)
    hosts = hosts.withColumn("mean", mean).withColumn("weight", weight)
    rate = F.col("rate")
    return hosts.withColumn("rate", F.coalesce((failed + F.col("weight") * F.col("mean")) / (n + F.col("weight")), "mean")).withColumn(
        "low", rate - 3 * F.sqrt(rate * (1 - rate) / (n + F.coalesce("weight", F.lit(0.0)) + 1))).drop("weight")


def bad_hosts(rates: DataFrame, limits: Limits) -> DataFrame:
    """(host, bad): the hosts of :func:`host_rates` that fail under at least one rule."""
    rate, mean = F.col("rate"), F.col("mean")
    odd = (F.col("low") > limits.host_least) & (rate * (1 - mean) > limits.host_odds * mean * (1 - rate))
    return rates.filter((rate > limits.host_rate) | odd).select("host", F.lit(True).alias("bad")).distinct()


def _judged(docs: DataFrame, host: str, limits: Limits) -> tuple[DataFrame, DataFrame]:
    rules = failures(limits)
    rows = kept(measures(docs, host, limits.window).withColumn("base_failed", rules["few_words"] | rules["repeated_words"]), "measures")
    return rows, kept(bad_hosts(host_rates(rows, limits), limits), "hosts")


def judged(docs: DataFrame, host: str = "source", limits: Limits | None = None) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``.

    A document that does not fail itself is kept unless its host's shrunken rate of failures under some rule is too high.  A document
    without a host is judged alone.  Repeated rows count each; an empty table gives no rows.
    """
    rows, bad = _judged(docs, host, limits or Limits())
    return rows.join(bad, "host", "left").withColumn("kept", ~F.col("base_failed") & F.col("bad").isNull()).drop("bad")


def accepted(docs: DataFrame, host: str = "source", limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`judged` keeps."""
    limits = limits or Limits()
    _, bad = _judged(docs, host, limits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                got = measure_texts(*raw(part.column("text")), limits.window)
                n = got["n_words"]
                yield part.filter(pa.array((n >= limits.least_words) & (100 * got["n_repeat_words"] <= limits.repeat_percent * n)))

    good = docs.mapInArrow(run, docs.schema)
    return good.join(bad.select(F.col("host").alias(host)), host, "left_anti").select(*docs.columns)
