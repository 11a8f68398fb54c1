"""Matching two arms: trial keys, paired draws, checkpoint pairs.

Both arms are brought together by one aggregate per key with a flag or state
per arm.  That needs a single scan and no join, treats null keys as equal, and
combines map-side, so a key with very many executions does no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import count_of, join_null_safe, split_counted
from ..session import settle
from .draws import ORDER, PAIR_KEY, with_digest

#: Executions that one task sorts in memory, about 400 bytes each, where they are dealt out by task id.
PER_SORT = 200_000
TRIAL_KEY = ("presentation_id", "task_id", "condition_id", "mode", "seed", "repeat")


def side(arm: str, value: str, then: Column) -> Column:
    return F.when(F.col(arm) == value, then)


def matched_trials(records: DataFrame, key: Sequence[str] = TRIAL_KEY, arm: str = "arm",
                   arms: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Distinct trial keys that occur in both arms."""
    seen = records.groupBy(*key).agg(
        *[F.max(F.col(arm) == a).alias(f"__{i}") for i, a in enumerate(arms)]
    )
    return seen.where("__0 AND __1").select(*key)


def dedupe_last(records: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key, the last one in ``order``."""
    last = records.groupBy(*key).agg(F.max(F.struct(*order, *[F.col(c).alias(f"__k_{c}") for c in keep])).alias("__l"))
    return last.select(*key, *[F.col(f"__l.__k_{c}").alias(c) for c in keep])


def pair_records(records: DataFrame, pairs: DataFrame, run: str = "run_id") -> DataFrame:
    """Executions of every compared pair: the records with ``pair_id`` and their ``arm`` (A or B) in it.

    ``pairs`` has a row per comparison: ``pair_id, run_a, run_b, mode``; a null mode takes executions of all modes.  A run
    may be in any number of pairs and in both arms.  The records meet the list of pairs once, in one join on the run;
    operators then take ``by=["pair_id"]`` and handle all pairs in one job.

    The list is settled, so that its size is known when the join is planned: records of a few runs are then joined where
    they are read, and not first dealt out by run, a task for each.
    """
    sides = F.array(*[F.struct(F.col(f"run_{t}").alias("__run"), F.lit(a).alias("arm")) for t, a in (("a", "A"), ("b", "B"))])
    listed = settle(pairs.select("pair_id", F.col("mode").alias("__mode"), F.inline(sides)), "pairs")
    met = records.drop("arm", "pair_id").join(listed, F.col(run) == F.col("__run"))
    return met.where(F.col("__mode").isNull() | (F.col("mode") == F.col("__mode"))).drop("__run", "__mode")


def paired_draws(records: DataFrame, keep: Sequence[str], arm: str = "arm", arms: tuple[str, str] = ("A", "B"),
                 order: Sequence[str] = ORDER, tokens: str = "tokens", by: Sequence[str] = ()) -> DataFrame:
    """One row per draw over the matched trials with the state of both arms.

    ``a`` and ``b`` hold the representative's ``keep`` columns and are null when
    that arm's executions differ.
    """
    # a draw of several digests has no representative, so the digest need not travel in the state
    state = F.struct(*order, *[F.col(c).alias(f"__k_{c}") for c in keep])

    def per_arm(make) -> list[Column]:
        out = []
        for tag, value in zip("ab", arms):
            out += make(tag, value)
        return out

    trials = with_digest(records, tokens).groupBy(*by, *TRIAL_KEY).agg(*per_arm(lambda t, v: [
        F.count(side(arm, v, F.lit(1))).alias(f"n_{t}"),
        F.min(side(arm, v, F.col("__dig"))).alias(f"lo_{t}"),
        F.max(side(arm, v, F.col("__dig"))).alias(f"hi_{t}"),
        F.min(side(arm, v, state)).alias(f"first_{t}"),
    ]))
    draws = trials.where("n_a > 0 AND n_b > 0").groupBy(*by, *PAIR_KEY).agg(*per_arm(lambda t, v: [
        F.sum(f"n_{t}").alias(f"n_executions_{t}"),
        (F.min(f"lo_{t}") != F.max(f"hi_{t}")).alias(f"ambiguous_{t}"),
        F.min(f"first_{t}").alias(f"first_{t}"),
    ]))
    return draws.select(
        *by, *PAIR_KEY,
        *per_arm(lambda t, v: [F.col(f"n_executions_{t}"), F.col(f"ambiguous_{t}")]),
        *per_arm(lambda t, v: [
            F.when(~F.col(f"ambiguous_{t}"), F.struct(*[F.col(f"first_{t}.__k_{c}").alias(c) for c in keep])).alias(t)
        ]),
    )


def paired_population(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of draws, usable draws and exclusions; a draw ambiguous in one arm leaves both."""
    a, b = ~F.col("ambiguous_a"), ~F.col("ambiguous_b")
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_draws_a"),
        F.count(F.lit(1)).alias("n_draws_b"),
        count_of(a).alias("n_usable_draws_a"),
        count_of(b).alias("n_usable_draws_b"),
        count_of(a & b).alias("n_paired_draws"),
        count_of(~a).alias("n_ambiguous_a"),
        count_of(~b).alias("n_ambiguous_b"),
        count_of(a & ~b).alias("n_unpaired_a"),
        count_of(b & ~a).alias("n_unpaired_b"),
    )


def unpaired_examples(pairs: DataFrame, limit: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """First ``limit`` unpaired draws of each arm in key order (the limit is what the report shows)."""
    lone = pairs.where(F.col("ambiguous_a") != F.col("ambiguous_b")).select(
        *by, F.when(F.col("ambiguous_b"), "A").otherwise("B").alias("arm"), *PAIR_KEY
    )
    rank = F.row_number().over(Window.partitionBy(*by, "arm").orderBy(*PAIR_KEY))
    return lone.withColumn("example", rank).where(F.col("example") <= limit)


def usable_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(~F.col("ambiguous_a") & ~F.col("ambiguous_b"))


def usable_pairs_by_task(records: DataFrame, keep: Sequence[str], arm: str = "arm", arms: tuple[str, str] = ("A", "B"), order: Sequence[str] = ORDER,
                         tokens: str = "tokens", by: Sequence[str] = (), task: str = "task_id") -> tuple[DataFrame, DataFrame | None]:
    """(by, task, a, b) of the usable pairs of ``paired_draws``: those of tasks of at most ``frames.MOST_ROWS`` executions, and the others or None.

    Executions of the first part are exchanged and sorted once: every task is in one partition, so aggregates by task need no other exchange.
    What is not compared column by column travels as one struct, copied whole.
    """
    records, large, n_rows = split_counted(records, [*by, task], "large-tasks")
    rest = None if large is None else usable_pairs(paired_draws(large, keep, arm, arms, order, tokens, by)).select(*by, task, "a", "b")
    state = F.struct(*order, *[F.col(c).alias(f"__k_{c}") for c in keep])
    draw_key = [c for c in PAIR_KEY if c != task]
    rows = with_digest(records, tokens).select(
        *by, task, F.struct(*draw_key).alias("__key"), F.struct(*[c for c in TRIAL_KEY if c not in PAIR_KEY]).alias("__trial"),
        F.col(arm).alias("__arm"), "__dig", state.alias("__state"))
    # the sort begins with a number of the draw: texts that begin alike would have to be compared in full
    draw = ["__draw", *by, task, "__key"]
    rows = rows.repartition(n_rows // PER_SORT + 1, *by, task).withColumn("__draw", F.xxhash64(*by, task, "__key"))
    trial = Window.partitionBy(*draw, "__trial")
    rows = rows.select("*", *[F.max(F.col("__arm") == value).over(trial).alias(f"__has_{t}") for t, value in zip("ab", arms)])
    draws = rows.where("__has_a AND __has_b").groupBy(*draw).agg(*[
        agg for t, value in zip("ab", arms) for agg in (
            F.min(side("__arm", value, F.col("__dig"))).alias(f"lo_{t}"), F.max(side("__arm", value, F.col("__dig"))).alias(f"hi_{t}"),
            F.min(side("__arm", value, F.col("__state"))).alias(f"first_{t}"))])
    return draws.where("lo_a = hi_a AND lo_b = hi_b").select(
        *by, task, *[F.struct(*[F.col(f"first_{t}.__k_{c}").alias(c) for c in keep]).alias(t) for t in "ab"]), rest


FULL_PREFIX = "full_prefix"
FULL_PREFIX_INDEX = 2147483647  # sorts after every numeric checkpoint


def select_checkpoints(probes: DataFrame) -> DataFrame:
    """One row per probe and checkpoint selection it answers.

    A probe of the whole prefix answers ``full_prefix`` and, when its length is
    a numeric checkpoint, that one as well.  ``checkpoint_index`` orders the
    selections: numeric ascending, then the full prefix.
    """
    labels = F.array_distinct(F.array_compact(F.array(
        F.col("checkpoint_label"), F.when(F.col("is_full_prefix"), F.lit(FULL_PREFIX))
    )))
    rest = [c for c in probes.columns if c not in ("checkpoint_label", "checkpoint_index")]
    index = F.when(F.col("checkpoint_label") == FULL_PREFIX, F.lit(FULL_PREFIX_INDEX)).otherwise(
        F.try_to_number("checkpoint_label", F.lit("9999999999")).cast("bigint")
    )
    return probes.select(*rest, F.explode(labels).alias("checkpoint_label")).withColumn(
        "checkpoint_index", index.cast("bigint")
    )


def jointly_eligible(probes: DataFrame, keep: Sequence[str] = ("family",), arm: str = "arm",
                     arms: tuple[str, str] = ("A", "B"), order: Sequence[str] = ("checkpoint",),
                     only_joint: bool = True) -> DataFrame:
    """One row per (checkpoint, task, seed) with both arms' outcomes; the last record of an arm counts.

    ``order`` tells which record is the last; a ``position`` column (place in the
    evidence) decides among records that agree in it.
    """
    order = [*order, *(["position"] if "position" in probes.columns else [])]
    picks = []
    for tag, value in zip("ab", arms):
        picks += [
            F.max_by(F.struct("outcome", "native_closed"), side(arm, value, F.struct(*order))).alias(f"__{tag}"),
            F.max(F.col(arm) == value).alias(f"has_{tag}"),
        ]
    grouped = probes.groupBy("checkpoint_label", "checkpoint_index", "task_id", "seed").agg(
        *[F.min(c).alias(c) for c in keep], *picks
    )
    if only_joint:
        grouped = grouped.where("has_a AND has_b")
    return grouped.select(
        "checkpoint_label", "checkpoint_index", "task_id", "seed", *keep,
        F.col("__a.outcome").alias("outcome_a"), F.col("__b.outcome").alias("outcome_b"),
        F.col("__a.native_closed").alias("closed_a"), F.col("__b.native_closed").alias("closed_b"),
    )


def join_gold(probes: DataFrame, tasks: DataFrame, key: str, answer: str) -> DataFrame:
    """Probes with the gold answer of their task; a probe without a task fails the job.

    No join hint: adaptive execution broadcasts the task side when its measured
    size allows it and otherwise splits skewed keys.
    """
    gold = tasks.select(key, F.col(answer).alias("gold_answer"), F.lit(True).alias("__found"))
    joined = probes.join(gold, key, "left")
    missing = F.raise_error(F.concat(F.lit("no gold answer for task "), F.col(key).cast("string")))
    return joined.withColumn(
        "gold_answer", F.when(F.col("__found").isNull(), missing.cast("string")).otherwise(F.col("gold_answer"))
    ).drop("__found")


def join_natural(probes: DataFrame, records: DataFrame, status: Column, task: str = "task_id",
                 order: Sequence[str] = ("repeat", "trial_id"), run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Probes with the status of their task's first greedy record in their own run; ``censored`` when there is none.

    ``run`` names the columns that tell the runs (or arms) of a table apart.
    """
    keys = [*run, task]
    first = records.where(F.col("mode") == "greedy").withColumn("__st", status).groupBy(*keys).agg(
        F.min_by("__st", F.struct(*order)).alias("natural_final_status")
    )
    return join_null_safe(probes, first, keys, "left").withColumn(
        "natural_final_status", F.coalesce("natural_final_status", F.lit("censored"))
    )
