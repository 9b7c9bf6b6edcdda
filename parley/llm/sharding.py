"""Rows dealt to shards by jump consistent hashing, with gapless places inside each shard.

A key walks through the bucket numbers by ever longer jumps, drawn from a linear congruential sequence that starts at the
key; the last bucket below the number of shards is its shard.  No table of a ring is kept, and the walk for n + 1 shards is
that for n shards or one jump more, so that appending a shard takes 1/(n+1) of the keys, all of them into the new shard.

Everything is column expressions and DataFrame operators.  Texts are read once and only measured; what is written, sorted and
numbered are rows of a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parley.llm.store import kept, partitions

# Multiplier and increment of the published jump hash: fixed values, so that shards equal those of other programs.
MULTIPLIER, INCREMENT = 2862933555777941757, 1
_LOW = 0xFFFFFFFF
SHORT_WALK = 48  # jumps that nearly every key ends in; the rest walk on


def _times(x: Column, c: int) -> Column:
    """``x * c`` modulo 2**32 for x and c below 2**32; no product leaves 48 bits."""
    high = F.shiftleft((F.shiftright(x, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (x.bitwiseAND(F.lit(0xFFFF)) * F.lit(c) + high).bitwiseAND(F.lit(_LOW))


def step(state: Column) -> Column:
    """The next 64-bit state: state * MULTIPLIER + INCREMENT modulo 2**64, put together from halves that cannot overflow."""
    low_c, high_c = MULTIPLIER & _LOW, MULTIPLIER >> 32
    low, high = state.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(state, 32)
    p, q = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(low_c), F.shiftright(low, 16) * F.lit(low_c)
    down = p + F.shiftleft(q.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(INCREMENT)
    up = F.shiftright(down, 32) + F.shiftright(q, 16) + _times(high, low_c) + _times(low, high_c)
    return F.shiftleft(up.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(down.bitwiseAND(F.lit(_LOW)))


def jump(key: Column, shards: int) -> Column:
    """Shard (int, from 0) of a 64-bit key among ``shards``; a null key goes the way of key 0.

    Walks have about ln(shards) jumps.  ``SHORT_WALK`` of them are looked at for every key; keys that are not through by
    then (there are next to none) walk on for as many as there can be, so the result is exact for any number of shards.
    """
    if shards < 1:
        raise ValueError("there must be a shard")

    def walk(w: Column, _: Column) -> Column:
        state = step(w["state"])
        draw = (F.shiftrightunsigned(state, 33) + F.lit(1)).cast("double")
        to = F.floor((w["next"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw))
        return F.when(w["next"] >= F.lit(shards), w).otherwise(
            F.struct(state.alias("state"), w["next"].alias("shard"), F.least(to, F.lit(1 << 40)).alias("next")))

    begin = F.struct(F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("state"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    short = min(shards, SHORT_WALK)
    done = F.aggregate(F.sequence(F.lit(1), F.lit(short)), begin, walk)
    if shards > short:
        rest = F.when(done["next"] < F.lit(shards), F.sequence(F.lit(1), F.lit(shards))).otherwise(F.array().cast("array<int>"))
        done = F.aggregate(rest, done, walk)
    return done["shard"].cast("int")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with slot (long): the place of each row inside its group by ``order``, from 0 without gaps.

    One range shuffle on group and order deals the rows out in runs of about equal length, whatever the sizes of groups and
    of ties: equal rows are told apart by a row number, taken once and written.  A row's place is its number inside its run,
    less that of the first row of its group there, plus the rows of the group in earlier runs.  Those counts are at most one
    row a run and group border (partitions + groups), which is what is broadcast.  Equal rows take the places of their tie in
    any order.  ``rows`` must not have
    columns _row, _at, _run, _first, _n, _before, _group, _in.
    """
    spark = rows.sparkSession
    told = kept(rows.withColumn("_row", F.monotonically_increasing_id()), "told")
    keys = [group, *order, "_row"]
    dealt = told.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    dealt = kept(dealt, "dealt").withColumn("_run", F.shiftrightunsigned("_at", 33))
    parts = dealt.groupBy(group, "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    so_far = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_run", "_first", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    parts = parts.select(F.col(group).alias("_group"), F.col("_run").alias("_in"), "_first", "_before")
    out = dealt.join(F.broadcast(parts), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_run") == F.col("_in")))
    return out.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row: its shard among ``shards`` and, with one more, its new one.

    size        long: bytes of the text in UTF-8 (null: none) plus 1
    text_crc32  long, unsigned, of the same bytes (null: 0, as for an empty text)
    law         'key': key and number of shards alone decide
    slot        long: place in the shard by key, then size and crc32; gapless from 0

    Only the key decides, so rows with one key share a shard, ties and repeated rows included; they have a slot each.  A null
    key is dealt as key 0 and comes before it.  ``key`` must be an integer column; other columns, whatever their names, are not
    carried along (see ``write_shards``).  An empty table gives no rows.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    rows = docs.select(F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                       jump(F.col(key), shards).alias("shard"), jump(F.col(key), shards + 1).alias("grown_shard"))
    rows = numbered(rows, "shard", ["_key", "size", "text_crc32"])
    return rows.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id", files: int | None = None) -> None:
    """Whole rows of ``docs`` as Parquet, one folder ``shard=i`` a shard.

    A shard is written as up to ``files`` files (default: shuffle partitions), rows dealt by hash of the key and the text's
    checksum, so that neither a shard nor a frequent key is one task's work.  A column ``shard`` of ``docs`` gives way.
    """
    n = files or partitions(docs.sparkSession)
    rows = docs.withColumn("shard", jump(F.col(key), shards))
    rows.withColumn("_deal", F.monotonically_increasing_id() % F.lit(n)).repartition(n, "shard", "_deal").drop("_deal").write.partitionBy("shard").parquet(path)


def moved(docs: DataFrame, before: int, after: int, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that change their shard between two numbers of shards, with from_shard and to_shard (int)."""
    out = docs.withColumn("from_shard", jump(F.col(key), before)).withColumn("to_shard", jump(F.col(key), after))
    return out.filter("from_shard <> to_shard")
