"""Exact deduplication of trace texts by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .records import whole_text


def digest_runs(traces: DataFrame) -> DataFrame:
    """One narrow row per trace: 64-bit sort key, verifying sha256 and number of its run.

    Every task sorts its rows into one run and writes it to shared scratch, so texts are read and hashed once and a
    lost executor costs no second pass.
    """
    text = whole_text()
    rows = traces.select(
        "trial_id", F.xxhash64(text).alias("run_key"), F.sha2(text, 256).alias("text_sha256"),
        F.spark_partition_id().cast("bigint").alias("run"),
    )
    return settle(rows.sortWithinPartitions("run_key", "text_sha256"), "digests")


RUN_ORDER = ("range", "run", "run_key", "text_sha256")


def merged_runs(runs: DataFrame, largest: bool) -> DataFrame:
    """Merges what a partition holds, runs in the order of their digests, and shrinks equal neighbours to one row.

    Neighbours are equal when sort key and sha256 are; the smallest (or largest) identifier and the sum of the rows stay.
    An unfinished neighbour is carried from batch to batch, so a task holds one batch of a run at a time.
    """
    # identifiers as the last key: the one that stays comes first, nulls behind all others
    best = F.desc_nulls_last("keep_id") if largest else F.asc_nulls_last("keep_id")
    ordered = runs.select(*RUN_ORDER, "keep_id", "group_size").sortWithinPartitions(*RUN_ORDER, best)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            changed = np.zeros(len(table) - 1, bool)
            for name in RUN_ORDER:
                column = table[name].combine_chunks()
                changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero(changed) + 1])
            sizes = np.add.reduceat(table["group_size"].to_numpy(), first)
            shrunk = table.take(pa.array(first))
            shrunk = shrunk.set_column(len(RUN_ORDER) + 1, batch.schema.field("group_size"), pa.array(sizes, pa.int64()))
            held = shrunk.slice(len(shrunk) - 1)
            yield from shrunk.slice(0, len(shrunk) - 1).combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return ordered.mapInArrow(shrink, ordered.schema)


def exact_dedup(traces: DataFrame, keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """Groups of traces with equal text; in each group one trace stays.

    Every input task makes a sorted run of (digest, identifier that stays, rows), equal neighbours shrunk to one row.  Runs
    meet in binomial rounds: in a round ``fan_in`` neighbouring runs are brought together range by range of the digest,
    merged in order and shrunk again, so a text that fills a third of the table is one row per run before it is first
    sent, and no task ever holds more than a digest range of the runs it merges.  The 64-bit sort key never decides
    alone: the sha256 of the text is compared in every merge.

    Returns one row per input row: ``trial_id, keep_id, group_size, kept, text_sha256``.  ``keep`` is ``smallest`` or
    ``largest``: the ``trial_id`` that stays.  Null text equals empty text.  A null ``trial_id`` stays only where its
    group has no other (``keep_id`` is then null).  Rows that repeat the identifier that stays are all marked kept, as
    they are the same trace.  An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    if fan_in < 2:
        raise ValueError("fan_in is 2 or more")
    spark = traces.sparkSession
    rows = digest_runs(traces)
    # equal parts of the space of sort keys, so that one merging task holds a range of the runs it merges
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.floor((F.col("run_key") / F.lit(2.0**64) + 0.5) * ranges)
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    runs = merged_runs(rows.select(
        place.alias("range"), "run", "run_key", "text_sha256", F.col("trial_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
    ), keep == "largest")
    while left > 1:
        left = -(-left // fan_in)
        together = runs.withColumn("run", F.floor(F.col("run") / fan_in)).repartition("range", "run")
        runs = merged_runs(together, keep == "largest")
    groups = runs.select("text_sha256", "keep_id", "group_size")
    joined = rows.select("trial_id", "text_sha256").join(groups, "text_sha256")
    return joined.select(
        "trial_id", "keep_id", "group_size", F.col("trial_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
