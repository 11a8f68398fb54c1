"""Mixing traces of several conditions to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .records import whole_text, word_count

#: Rows of one condition that one rounding task takes, on average.
ROUNDING_ROWS = 1_000


def condition_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: float) -> DataFrame:
    """Words the mix shall take of each condition: ``condition_id, source_size, target``.

    ``weights`` repeat over the conditions in code point order, null last; the targets add up to ``share`` of all words.
    No target exceeds ``max_repeats`` times its condition's words; what is over is shared out again by weight until none
    is above.  That end point is a water level: conditions in the order of (limit / weight) fill up as long as the
    level of the remaining ones lies above theirs.
    """
    by_source = sizes.groupBy("condition_id").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("condition_id").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    table = by_source.select("condition_id", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("limit"))
    everything = Window.partitionBy(F.lit(0))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("condition_id").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(
        "*",
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).alias("rest"),
        F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("rest_weight"),
        F.row_number().over(fill).alias("rank"),
    )
    table = table.withColumn("full", F.col("limit") * F.col("rest_weight") <= F.col("rest") * F.col("weight"))
    # the first condition that does not fill up sets the level of all after it
    level = F.first(F.when(~F.col("full"), F.col("rest") / F.col("rest_weight")), ignorenulls=True).over(
        Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.coalesce(F.least("limit", level * F.col("weight")), F.col("limit"))
    return table.select("condition_id", "source_size", target.alias("target"))


def tilts(sizes: DataFrame, targets: DataFrame, max_repeats: float, tolerance: float = 1e-7, max_rounds: int = 60) -> DataFrame:
    """Solves the dual: ``condition_id, source_size, target, scale, tilt``, so that the rates meet the word constraints.

    Among all rates between 0 and ``max_repeats``, entropy balancing takes those of largest entropy whose words meet the
    targets: ``rate = max_repeats / (1 + exp(-tilt * size / scale))`` with one multiplier ``tilt`` per condition.  The dual
    is convex; Newton's steps need, per condition, the words taken and their derivative, one aggregate over the counts of
    (condition, size).  A step that overshoots is held inside the bracket found so far.  A target at its limit takes
    everything (``tilt`` is then infinite), a target of zero nothing.
    """
    counts = sizes.groupBy("condition_id", "size").agg(F.count("*").alias("n")).where("size > 0")
    counts = settle(counts, "sizes")
    means = counts.groupBy("condition_id").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = targets.join(means, targets.condition_id.eqNullSafe(means.condition_id), "left").select(
        targets.condition_id, "source_size", "target", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.lit(0.0).alias("tilt"),
        F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(False).alias("done"),
    )
    limit = F.col("source_size") * max_repeats
    state = settle(state.withColumn("tilt", F.when(F.col("target") >= limit * (1 - 1e-12), F.lit(float("inf")))
                                    .when(F.col("target") <= 0, F.lit(float("-inf"))).otherwise(F.col("tilt")))
                   .withColumn("done", F.abs("tilt") == float("inf")), "tilts")
    for _ in range(max_rounds):
        open_ones = state.where("NOT done")
        share = 1 / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("scale")))
        met = counts.join(open_ones.withColumnRenamed("condition_id", "of"), F.col("condition_id").eqNullSafe(F.col("of")))
        moments = met.groupBy("of").agg(
            F.sum(F.col("n") * F.col("size") * max_repeats * share).alias("words"),
            F.sum(F.col("n") * F.col("size") * F.col("size") * max_repeats * share * (1 - share) / F.col("scale")).alias("slope"),
        )
        joined = state.join(moments, F.col("condition_id").eqNullSafe(F.col("of")), "left")
        miss = F.col("words") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / F.greatest("slope", F.lit(1e-300))
        held = (
            F.when((newton > low) & (newton < high), newton)
            .when(F.abs(low) == float("inf"), F.least(F.col("tilt") - 1, F.col("tilt") * 2))
            .when(high == float("inf"), F.greatest(F.col("tilt") + 1, F.col("tilt") * 2))
            .otherwise((low + high) / 2)
        )
        held = F.greatest(F.least(held, F.col("tilt") + 8), F.col("tilt") - 8)
        near = F.abs(miss) <= F.lit(tolerance) * F.col("target")
        going = ~F.col("done") & F.col("words").isNotNull()
        state = settle(joined.select(
            "condition_id", "source_size", "target", "scale",
            F.when(going & ~near, held).otherwise(F.col("tilt")).alias("tilt"),
            F.when(going, low).otherwise(F.col("low")).alias("low"), F.when(going, high).otherwise(F.col("high")).alias("high"),
            (~going | near).alias("done"),
        ), "tilts")
        if not state.where("NOT done").limit(1).count():
            break
    return state.select("condition_id", "source_size", "target", "scale", "tilt")


def round_copies(sizes: Iterable[int], rates: Iterable[float], max_repeats: int) -> list[int]:
    """Whole copies of traces, longest first; what rounding gives or takes is carried on to the next.

    The words taken follow the words wanted; what is left at the end is about half the shortest trace.
    """
    copies, owed = [], 0.0
    for size, rate in zip(sizes, rates):
        owed += rate * size
        n = min(max(int(owed / size + 0.5), 0), max_repeats) if size else 0
        owed -= n * size
        copies.append(n)
    return copies


def balance_mix(traces: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """Draws a mix of all traces whose words per condition meet given weights.

    Targets come from ``condition_targets``, the rate of each trace from entropy balancing (``tilts``), whole copies from
    ``round_copies``, which runs on parts of a condition of about ``ROUNDING_ROWS`` rows chosen by the hash of the trace,
    so a condition with a third of all rows is spread over many tasks.  Nothing is random: reruns agree.

    Returns one row per input row: ``trial_id, condition_id, size`` (words), ``source_size, target, rate, copies, taken``
    (``copies * size``).  Null text has no words and is taken zero times; null is a condition of its own, last in order.
    Equal rows may get different copies.  Conditions without words have target 0.  An empty table gives an empty result.
    """
    text = whole_text()
    sizes = settle(traces.select("trial_id", "condition_id", word_count(text).alias("size"), F.xxhash64("trial_id", text).alias("order")), "words")
    targets = condition_targets(sizes, weights, share, max_repeats)
    solved = settle(tilts(sizes, settle(targets, "targets"), max_repeats), "solved")
    rows = sizes.groupBy("condition_id").agg(F.count("*").alias("rows"))
    known = solved.join(rows.withColumnRenamed("condition_id", "of"), F.col("condition_id").eqNullSafe(F.col("of"))).drop("of")
    known = known.withColumnRenamed("condition_id", "of")
    rated = sizes.join(known, F.col("condition_id").eqNullSafe(F.col("of"))).select(
        "trial_id", "condition_id", "size", "order", "source_size", "target",
        F.when(F.col("tilt") == float("inf"), F.lit(float(max_repeats))).when(F.col("tilt") == float("-inf"), F.lit(0.0))
        .otherwise(max_repeats / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("scale")))).alias("rate"),
        F.pmod("order", F.ceil(F.col("rows") / ROUNDING_ROWS)).alias("part"),
    )
    schema = T.StructType([*rated.schema.fields, T.StructField("copies", T.LongType())])

    def rounded(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("order", "ascending")])
        copies = round_copies(group["size"].to_pylist(), group["rate"].to_pylist(), max_repeats)
        return group.append_column("copies", pa.array(copies, pa.int64()))

    mixed = rated.groupBy("condition_id", "part").applyInArrow(rounded, schema)
    return mixed.select("trial_id", "condition_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
