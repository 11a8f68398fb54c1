"""Consistent-hash sharding of traces with bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .records import whole_text

#: Bytes a record takes in a shard besides its text.
RECORD_OVERHEAD = 16


def hash_ring(traces: DataFrame, n_shards: int, vnodes: int, cells: int) -> DataFrame:
    """``n_shards * vnodes`` virtual nodes on a ring of ``cells`` places: ``place, shard``."""
    points = traces.sparkSession.range(n_shards * vnodes)
    # the first nodes are the same whatever the number of shards
    return points.select(
        F.pmod(F.xxhash64(F.lit("vnode"), "id"), F.lit(cells)).alias("place"), F.floor(F.col("id") / vnodes).cast("int").alias("shard"),
    )


def _clockwise(waiting: DataFrame, ring: DataFrame, cells: int) -> DataFrame:
    """Each waiting cell with the shard of the first virtual node at or after its place, round the ring.

    Cells and virtual nodes are bounded by parameters, not by the data, so one ordered pass over them is small.
    """
    nodes = ring.groupBy("place").agg(F.min("shard").alias("shard"))
    nodes = nodes.select(F.explode(F.array(F.col("place"), F.col("place") + cells)).alias("place"), "shard")
    both = waiting.select("cell", "bytes", "n", F.col("cell").alias("place"), F.lit(None).cast("int").alias("shard")).unionByName(
        nodes, allowMissingColumns=True)
    after = Window.orderBy(F.desc("place"), F.col("shard").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.select("cell", "bytes", "n", F.last("shard", ignorenulls=True).over(after).alias("shard"))
    return near.where("cell IS NOT NULL")


def place_cells(load: DataFrame, n_shards: int, vnodes: int, cells: int, headroom: float) -> DataFrame:
    """Bounded-load placement of cells (``cell, bytes, n``): adds ``shard`` and ``start``, the cell's first slot.

    In a round every waiting cell asks the next open shard clockwise; a shard takes its largest cells first while its
    capacity lasts and closes when it had to turn one away.  What was turned away goes on clockwise in the next round.
    If all shards have closed, capacities grow by the headroom, twice as much each time, and all open again.
    """
    spark = load.sparkSession
    total, largest, filled = load.agg(F.sum("bytes"), F.max("bytes"), F.count("*")).first()
    if total is None:
        return load.select("cell", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("start"))
    step = max(int(headroom * total / n_shards), total // (8 * filled), 1)  # little finer than the places are
    capacity = max(-(-total // n_shards) + step, largest)
    ring = settle(hash_ring(load, n_shards, vnodes, cells), "ring")
    used, open_shards, waiting, placed = dict.fromkeys(range(n_shards), 0), set(range(n_shards)), load, None
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "cell").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        room = F.create_map(*[F.lit(x) for s in sorted(open_shards) for x in (s, capacity - used[s])])
        asked = _clockwise(waiting, ring.where(F.col("shard").isin(sorted(open_shards))), cells)
        fits = F.sum("bytes").over(order) <= room[F.col("shard")]
        asked = settle(asked.withColumn("fits", fits), "asked")
        told = asked.groupBy("shard").agg(  # one row per shard
            F.coalesce(F.sum(F.when(F.col("fits"), F.col("bytes"))), F.lit(0)), F.count_if(~F.col("fits"))).collect()
        taken = asked.where("fits").select("cell", "bytes", "n", "shard")
        placed = taken if placed is None else placed.unionByName(taken)
        for shard, size, turned_away in told:
            used[shard] += size
            if turned_away:
                open_shards.discard(shard)
        if not sum(x[2] for x in told):
            break
        waiting = asked.where("NOT fits").select("cell", "bytes", "n")
        if not open_shards:
            capacity, step, open_shards = capacity + step, 2 * step, set(range(n_shards))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("cell", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def shard_traces(traces: DataFrame, n_shards: int = 40, vnodes: int = 64, cells: int = 65_536, headroom: float = 0.0005) -> DataFrame:
    """Puts every trace into one of ``n_shards`` shards of nearly equal bytes, moving little when the shards change.

    A consistent-hash ring with virtual nodes and bounded loads.  The ring has ``cells`` places; a trace's place is the
    hash of its ``trial_id``.  Only the bytes per place are gathered, a table bounded by ``cells``; shards fill up to
    ``(1 + headroom)`` times the mean (or the mean and an eighth of an average place, if that is more) and what does not fit goes on clockwise, place by place (``place_cells``).  The
    traces themselves then look up their place; no text is moved.  Places are whole: rows that repeat a ``trial_id``
    stay together, and a shard exceeds the bound only where a single place is larger than it.

    Returns one row per input row: ``trial_id, size`` (UTF-8 bytes of the text plus 16), ``text_crc32, shard, slot``
    (gapless from 0 in each shard, ordered by place and ``trial_id``).  Null text has no bytes; a null ``trial_id`` has
    a place of its own.  An empty table gives an empty result.
    """
    text = whole_text()
    rows = settle(traces.select(
        "trial_id", (F.octet_length(text).cast("bigint") + RECORD_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("trial_id"), F.lit(cells)).alias("cell"),
    ), "sizes")
    load = settle(rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "load")
    placed = place_cells(load, n_shards, vnodes, cells, headroom)
    inside = Window.partitionBy("cell").orderBy("trial_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1)
    # at most ``cells`` rows of three numbers
    return ranked.join(F.broadcast(placed), "cell").select(
        "trial_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).alias("slot"),
    )
