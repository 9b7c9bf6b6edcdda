"""Ordered per-key scans that do not put a whole key into one task.

``Window.partitionBy(key)`` sends every row of a key to one task.  When one session, speaker or
name holds a third of all rows, that task never ends.  An :class:`OrderedScan` cuts the *hot* keys
(more rows than one even share of the shuffle) into slabs along the order column, runs the window
inside each slab, and adds what the earlier slabs of the key carry over.

Which keys are hot is found by one count per key when the scan is set up.  There are at most
``splits`` of them and at most ``4 * splits`` slabs in all, whatever the data size, so the rows that
reach the driver and the tables that are broadcast are bounded by a setting and not by the data.
Without hot keys the plan is a plain window behind one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from parley.operators.beside import beside

SLAB = "_slab"
CUT_PER_SHARE = 2


def _splits(df: DataFrame, splits: int | None) -> int:
    return int(splits or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, keys: Sequence[str], splits: int | None = None) -> DataFrame:
    """Keys holding more than one ``splits``-th of all rows, with a piece count."""
    n = _splits(df, splits)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return (
        beside(counts, total)
        .filter(F.col("_n") * n > F.col("_total"))
        .select(*keys, F.ceil(F.col("_n") * n * CUT_PER_SHARE / F.col("_total")).alias("_pieces"))
    )


def _cuts(df: DataFrame, keys: Sequence[str], order: str, splits: int | None) -> DataFrame:
    """(_hot_<key> ..., _cuts): for each hot key the values of ``order`` that cut its rows into about equal parts.

    The cuts are approximate order statistics, an aggregate that combines before the shuffle.  A key whose order is
    null in every row has none.
    """
    hot = hot_keys(df, keys, splits)
    found = hot.collect()  # at most `splits` rows
    most = max((r["_pieces"] for r in found), default=2)
    named = df.sparkSession.createDataFrame(found, hot.schema).withColumnsRenamed({k: f"_hot_{k}" for k in keys})
    rows = df.select(*keys, F.col(order).alias("_at")).join(F.broadcast(named), _same(keys))
    marks = rows.groupBy(*[f"_hot_{k}" for k in keys], "_pieces").agg(
        F.percentile_approx("_at", [i / most for i in range(1, most)]).alias("_marks")
    )
    own = F.transform(
        F.sequence(F.lit(1), F.col("_pieces").cast("int") - 1),
        lambda i: F.element_at("_marks", F.floor(i * most / F.col("_pieces")).cast("int")),
    )
    return marks.filter(F.col("_marks").isNotNull()).select(*[f"_hot_{k}" for k in keys], F.array_distinct(own).alias("_cuts"))


def _same(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])


def with_slabs(
    df: DataFrame, keys: Sequence[str], order: str, splits: int | None = None, whole: bool = False
) -> tuple[DataFrame, bool]:
    """Add the slab number: null for ordinary keys, 0, 1, ... along ``order`` for hot ones; and are there hot ones.

    ``order`` must be numeric and close to unique inside a key (a position, a sequence number, a
    timestamp in microseconds).  Slabs hold about equal numbers of rows, however unevenly the values lie; equal
    values stay in one slab, and nulls, which come first, are in slab 0.  ``whole`` says that there is one key only.
    """
    cuts = _cuts(df, keys, order, splits)
    found = cuts.collect()  # at most `splits` rows, with about `3 * splits` values in all
    if not found:
        return df.withColumn(SLAB, F.lit(None).cast("long")), False
    slab = lambda c: F.size(F.filter(c, lambda x: x < F.col(order))).cast("long")
    if whole:
        at = F.array(*[F.lit(v) for v in found[0]["_cuts"]]).cast(cuts.schema["_cuts"].dataType)
        return df.withColumn(SLAB, slab(at)), True
    known = df.sparkSession.createDataFrame(found, cuts.schema)
    cut = df.join(F.broadcast(known), _same(keys), "left").withColumn(
        SLAB, F.when(F.col("_cuts").isNotNull(), slab(F.col("_cuts"))))
    return cut.drop(*[f"_hot_{k}" for k in keys], "_cuts"), True


class OrderedScan:
    """Running values along an order inside each key.

    >>> scan = OrderedScan(words, ["session"], ["pos"])
    >>> scan.row_number("rn").lag("prev", F.col("speaker"))
    >>> scan.result()

    The first order column must be numeric (see :func:`with_slabs`); further ones break ties.
    With no keys the whole table is one ordered sequence.  ``running_sum`` needs integer input,
    so that sums do not depend on where the slabs were cut.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], splits: int | None = None):
        self._constant = not keys
        if self._constant:
            df, keys = df.withColumn("_whole", F.lit(1)), ["_whole"]
        self.keys, self.order = list(keys), list(order)
        self.df, self.has_hot = with_slabs(df, self.keys, self.order[0], splits, self._constant)
        self._start()

    def again(self, df: DataFrame) -> OrderedScan:
        """A further scan over the same keys, order and slabs; ``df`` comes from ``result(keep_slab=True)``."""
        other = object.__new__(OrderedScan)
        other.keys, other.order, other.has_hot, other._constant, other.df = self.keys, self.order, self.has_hot, self._constant, df
        other._start()
        return other

    def _start(self):
        self._local: list[tuple[str, Column]] = []
        self._slab_aggs: list[Column] = []
        self._carry: list[tuple[str, Column]] = []
        self._final: list[tuple[str, Column]] = []
        self._inputs: list[tuple[str, Column]] = []
        self._plain: list[tuple[str, Column]] = []  # what is left to do where nothing is carried

    # windows -----------------------------------------------------------------
    def _inside(self):
        slab = [SLAB] if self.has_hot else []
        return Window.partitionBy(*slab, *self.keys).orderBy(*self.order)

    def _rows(self):
        return self._inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _earlier(self):
        return Window.partitionBy(*self.keys).orderBy(SLAB).rowsBetween(Window.unboundedPreceding, -1)

    def _order_struct(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    # operations --------------------------------------------------------------
    def running_sum(self, name: str, value: Column) -> OrderedScan:
        """Sum of ``value`` from the start of the key up to and including the row."""
        v = f"_in_{name}"
        self._inputs.append((v, value.cast("long")))
        self._local.append((name, F.sum(v).over(self._rows())))
        self._slab_aggs.append(F.sum(v).alias(f"_c_{name}"))
        self._carry.append((f"_c_{name}", F.sum(f"_c_{name}").over(self._earlier())))
        self._final.append(
            (name, F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0)))
        )
        self._plain.append((name, F.coalesce(F.col(name), F.lit(0))))
        return self

    def row_number(self, name: str) -> OrderedScan:
        """1, 2, 3 ... along the order."""
        return self.running_sum(name, F.lit(1))

    def lag(self, name: str, value: Column) -> OrderedScan:
        """``value`` of the row before, null at the start of the key."""
        v = f"_in_{name}"
        # wrapped in a struct so that a null value differs from "no row before"
        self._inputs.append((v, F.struct(value.alias("v"))))
        self._local.append((name, F.lag(v).over(self._inside())))
        self._slab_aggs.append(F.max_by(F.col(v), self._order_struct()).alias(f"_c_{name}"))
        self._carry.append((f"_c_{name}", F.last(f"_c_{name}", True).over(self._earlier())))
        self._final.append((name, F.coalesce(F.col(name), F.col(f"_c_{name}"))["v"]))
        self._plain.append((name, F.col(name)["v"]))
        return self

    def last_known(self, name: str, value: Column, before: bool = False) -> OrderedScan:
        """The latest non-null ``value`` so far; ``before`` leaves the row itself out."""
        v = f"_in_{name}"
        self._inputs.append((v, value))
        w = self._inside().rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
        self._local.append((name, F.last(v, True).over(w)))
        self._slab_aggs.append(
            F.max_by(F.col(v), F.when(F.col(v).isNotNull(), self._order_struct())).alias(f"_c_{name}")
        )
        self._carry.append((f"_c_{name}", F.last(f"_c_{name}", True).over(self._earlier())))
        self._final.append((name, F.coalesce(F.col(name), F.col(f"_c_{name}"))))
        return self

    # plan --------------------------------------------------------------------
    def result(self, keep_slab: bool = False) -> DataFrame:
        base = self.df.withColumns(dict(self._inputs))
        local = base.withColumns(dict(self._local))
        drop = [n for n, _ in self._inputs]
        if not keep_slab:
            drop += [SLAB, "_whole"] if self._constant else [SLAB]
        if not self.has_hot:
            here = {n: v for n, v in self._plain}
            return (local.withColumns(here) if here else local).drop(*drop)
        carry = (
            base.filter(F.col(SLAB).isNotNull())
            .groupBy(*self.keys, SLAB)
            .agg(*self._slab_aggs)
            .withColumns(dict(self._carry))
            .select(
                F.col(SLAB).alias("_carry_slab"),
                *[F.col(k).alias(f"_carry_{k}") for k in self.keys],
                *[n for n, _ in self._carry],
            )
        )
        cond = F.col(SLAB) == F.col("_carry_slab")
        for k in self.keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_carry_{k}"))
        out = local.join(F.broadcast(carry), cond, "left").withColumns(dict(self._final))
        drop += [n for n, _ in self._carry] + ["_carry_slab"] + [f"_carry_{k}" for k in self.keys]
        return out.drop(*drop)


def key_digest(*texts: Column) -> Column:
    """32 bytes that stand for some texts: equal for equal ones (null is a value of its own), and no two different lists of texts are known to share
    them."""
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first along ``order``: an aggregate, so it combines before the shuffle.

    Text keys are grouped, sorted and shuffled by a digest of 32 bytes; the texts themselves only go along with the rows
    that are first so far.
    """
    texts = [k for k in keys if df.schema[k].dataType.typeName() == "string"]
    by = [k for k in keys if k not in texts]
    rest = [c for c in df.columns if c not in by]
    groups = [*by, *([key_digest(*(F.col(t) for t in texts)).alias("_digest")] if texts else [])]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*groups).agg(best).select(*by, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Column, k: int) -> DataFrame:
    """The last ``k`` rows per key.

    Spark drops everything beyond rank ``k`` in each map task before the exchange (window group
    limit), so a hot key moves at most ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")
