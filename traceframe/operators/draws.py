"""Executions to independent draws, replay agreement within draws and variation across seeds.

Equality is decided on digests.  Token arrays cross the network only where a first divergence is asked for: once, with
the executions of their draw, or for two executions of a draw where a draw may be too large for one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.frames import count_of, join_null_safe, ratio, split_large
from ..functions.identity import prefix_digest
from ..session import settle

DRAW_KEY = ("presentation_id", "condition_id", "seed")
PAIR_KEY = ("presentation_id", "task_id", "condition_id", "seed")
ORDER = ("repeat", "trial_id")


def with_digest(records: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``__dig``: the digest of a sequence as 32 bytes; its order is that of the hexadecimal text."""
    return records.withColumn("__dig", F.unhex(prefix_digest(F.col(tokens))))


def collapse_draws(records: DataFrame, key: Sequence[str] = DRAW_KEY, keep: Sequence[str] = (),
                   order: Sequence[str] = ORDER, tokens: str = "tokens", divergence: bool = True,
                   extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per draw; ``extra`` adds named aggregates over all executions of the draw.

    A draw whose executions are token-identical is represented by its lowest
    repeat (columns ``keep``); a divergent draw is ``ambiguous`` and its
    representative columns are null.  ``order`` must identify an execution.
    """
    key = list(key)
    extra = dict(extra or {})
    if not divergence:
        return _collapsed(records, key, keep, order, tokens, False, extra)
    records, large = split_large(records, key, "large-draws")
    draws = _in_order(records, key, keep, order, tokens, extra)
    return draws if large is None else draws.unionByName(_collapsed(large, key, keep, order, tokens, True, extra))


def _flags(draws: DataFrame, key: Sequence[str], keep: Sequence[str], more: Sequence[str]) -> DataFrame:
    same = F.col("__lo") == F.col("__hi")
    return draws.select(
        *key,
        "n_executions",
        same.alias("token_identical"),
        (~same).alias("ambiguous"),
        *[F.when(same, F.col(f"__first.__k_{c}")).alias(c) for c in keep],
        *more,
    )


def _in_order(records: DataFrame, key: Sequence[str], keep: Sequence[str], order: Sequence[str], tokens: str,
              extra: Mapping[str, Column]) -> DataFrame:
    """Draws by one exchange and one sort of the executions; every draw is in one task.

    The sort begins with a number of the draw: texts that begin alike would have to be compared in full.
    """
    numbered = ["__draw", *key]
    along = Window.partitionBy(*numbered).orderBy(*dict.fromkeys([*order, *keep])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = with_digest(records, tokens).withColumn("__draw", F.xxhash64(*key)).withColumn("__place", F.struct(*order)).withColumn(
        "__base", F.first(F.struct("__dig", "__place", F.col(tokens).alias("__tokens"))).over(along))
    other, told_apart = (~F.col(c).eqNullSafe(F.col(f"__base.{c}")) for c in ("__dig", "__place"))
    # where the order does not tell two sequences apart, neither is the first and there is no divergence
    rows = rows.withColumn("__at", F.when(other, F.col("__place"))).withColumn(
        "__split", F.when(other & told_apart, A.first_divergence(F.col("__base.__tokens"), F.col(tokens))))
    state = F.struct(*order, *[F.col(c).alias(f"__k_{c}") for c in keep])
    draws = rows.groupBy(*numbered).agg(
        F.count(F.lit(1)).alias("n_executions"), F.min("__dig").alias("__lo"), F.max("__dig").alias("__hi"), F.min(state).alias("__first"),
        *[c.alias(n) for n, c in extra.items()], F.min_by("__split", "__at").alias("first_token_divergence"))
    return _flags(draws, key, keep, [*extra, "first_token_divergence"])


def _collapsed(records: DataFrame, key: Sequence[str], keep: Sequence[str], order: Sequence[str], tokens: str, divergence: bool,
               extra: Mapping[str, Column]) -> DataFrame:
    """Draws by aggregates that are combined where the executions are read, so that a draw may have any number of them."""
    # the digest is a group key below, and a draw of several digests has no representative: it need not travel in the state
    state = F.struct(*order, *[F.col(c).alias(f"__k_{c}") for c in keep])
    rows = with_digest(records, tokens)
    # one row per distinct sequence of a draw: the input is read once for everything but the arrays below
    variants = rows.groupBy(*key, "__dig").agg(F.count(F.lit(1)).alias("__n"), F.min(state).alias("__first"))
    if divergence:
        variants = settle(variants, "draw-variants")
    totals = {
        "n_executions": F.sum("__n"), "__lo": F.min("__dig"), "__hi": F.max("__dig"), "__first": F.min("__first"),
    }
    if extra or (keep and not divergence):  # wide states are exchanged once, not by sequence and then by draw
        direct = {"n_executions": F.count(F.lit(1)), "__first": F.min(state)}
        grouped = rows.groupBy(*key).agg(*[c.alias(n) for n, c in {**totals, **direct, **extra}.items()])
    else:
        grouped = variants.groupBy(*key).agg(*[c.alias(n) for n, c in totals.items()])
    draws = _flags(grouped, key, keep, list(extra))
    if not divergence:
        return draws
    # The two earliest distinct sequences of a draw; the rank limit is applied before the exchange, so a
    # draw with very many executions sends at most two rows per task.
    place = F.struct(*[F.col(f"__first.{o}").alias(o) for o in order])
    ranked = variants.select(*key, place.alias("__at")).withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*key).orderBy("__at"))
    ).where(F.col("__rn") <= 2)
    both = ranked.groupBy(*key).agg(
        F.max(F.when(F.col("__rn") == 1, F.col("__at"))).alias("__one"),
        F.max(F.when(F.col("__rn") == 2, F.col("__at"))).alias("__two"),
    ).where(F.col("__two").isNotNull())
    ends = both.select(*key, F.posexplode(F.array("__one", "__two")).alias("__end", "__at")).select(
        *key, *[F.col(f"__at.{o}").alias(o) for o in order], (F.col("__end") == 0).alias("__is_first")
    )
    arrays = join_null_safe(records.select(*key, *order, tokens), ends, [*key, *order])
    pairs = arrays.groupBy(*key).agg(
        F.first(F.when(F.col("__is_first"), F.col(tokens)), ignorenulls=True).alias("__a"),
        F.first(F.when(~F.col("__is_first"), F.col(tokens)), ignorenulls=True).alias("__b"),
    )
    split = pairs.select(*key, A.first_divergence(F.col("__a"), F.col("__b")).alias("first_token_divergence"))
    return join_null_safe(draws, split, key, "left")


def draw_summary(draws: DataFrame, by: Sequence[str]) -> DataFrame:
    return draws.groupBy(*by).agg(
        F.sum("n_executions").alias("n_executions"),
        F.count(F.lit(1)).alias("n_unique_draws"),
        count_of(~F.col("ambiguous")).alias("n_primary_draws"),
        count_of(F.col("ambiguous")).alias("n_ambiguous_draws"),
    )


def ambiguous_count(records: DataFrame, by: Sequence[str], key: Sequence[str] = DRAW_KEY) -> DataFrame:
    """Draws whose repeated executions differ, per group.

    Numbers stand for the digests, 120 of their bits, so that one hashed aggregate tells whether they differ; the least and
    largest of digests themselves would be found by sorting the rows of every task.
    """
    key = [*by, *key]
    digest = prefix_digest(F.col("tokens"))
    parts = [F.conv(F.substring("__hex", 1 + 15 * i, 15), 16, 10).cast("bigint").alias(f"__p{i}") for i in range(2)]
    rows = records.select(*key, digest.alias("__hex")).select(*key, *parts)
    draws = rows.groupBy(*key).agg(*[(F.min(p) != F.max(p)).alias(p) for p in ("__p0", "__p1")])
    return draws.groupBy(*by).agg(count_of(F.col("__p0") | F.col("__p1")).alias("n_ambiguous_draws"))


def compact_draws(draws: DataFrame, identity: Sequence[str], scalars: Sequence[str]) -> DataFrame:
    """Identity, flags and scalars only; refuses array or map columns so raw evidence cannot leak."""
    wanted = [*identity, *scalars]
    kinds = {f.name: f.dataType.typeName() for f in draws.schema.fields}
    raw = [c for c in wanted if kinds[c] in ("array", "map", "struct", "variant", "binary")]
    if raw:
        raise ValueError(f"not scalar columns: {raw}")
    return draws.select(*wanted)


def _replay(records: DataFrame, key: Sequence[str], order: Sequence[str], digest_of_steps: str | None) -> DataFrame:
    """Agreement of the repeats of one execution key; keys with a single execution are left out."""
    extra = {
        "__seen": F.count("answer_normalized"),
        "__one_answer": F.min("answer_normalized") == F.max("answer_normalized"),
        "reasoning_token_std": F.stddev_pop("reasoning_tokens"),
        "wall_ms_std": F.stddev_pop("wall_ms"),
    }
    per = collapse_draws(records, key, order=order, extra=extra)
    agreement = F.when(F.col("__seen") == 0, F.lit(None).cast("boolean")).when(
        F.col("__seen") < F.col("n_executions"), F.lit(False)
    ).otherwise(F.col("__one_answer"))
    out = per.where(F.col("n_executions") > 1).select(
        *key,
        F.col("n_executions").alias("n_repeats"),
        F.col("token_identical").alias("identical_tokens"),
        "first_token_divergence",
        agreement.alias("answer_agreement"),
        (F.col("__seen") > 0).alias("answer_observed"),
        "reasoning_token_std",
        "wall_ms_std",
    )
    if digest_of_steps is None:
        return out
    # the step digests of the first two executions, compared element by element
    ranked = records.groupBy(*key).agg(F.min(F.struct(*order, digest_of_steps)).alias("__s0"),
                                       F.count(F.lit(1)).alias("__c"))
    later = join_null_safe(records.select(*key, *order, digest_of_steps), ranked, key).where(
        F.struct(*order) > F.struct(*[F.col(f"__s0.{o}") for o in order])
    )
    second = later.groupBy(*key).agg(
        F.min(F.struct(*order, digest_of_steps)).alias("__s1"), F.min("__s0").alias("__s0")
    )
    a, b = F.col(f"__s0.{digest_of_steps}"), F.col(f"__s1.{digest_of_steps}")
    steps = second.select(
        *key, F.when(F.exists(a, lambda d: d.isNotNull()), A.first_divergence(a, b)).alias("first_digest_divergence")
    )
    return join_null_safe(out, steps, key, "left")


def greedy_replay(records: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ORDER,
                  digest_of_steps: str | None = None) -> DataFrame:
    """Per (condition, task) agreement of repeated greedy executions."""
    return _replay(records.where(F.col("mode") == "greedy"), [*by, "condition_id", "task_id"], order, digest_of_steps)


def same_seed_replay(records: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ORDER) -> DataFrame:
    """Per (condition, task, seed) agreement of repeated sampled executions."""
    chosen = records.where((F.col("mode") == "sampled") & F.col("seed").isNotNull())
    return _replay(chosen, [*by, "condition_id", "task_id", "seed"], order, None)


def replay_rates(replay: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Overall rates of a replay table; agreement is among keys with an observed answer."""
    return replay.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_keys"),
        count_of(F.col("identical_tokens")).alias("token_identical_count"),
        ratio(count_of(F.col("identical_tokens")), F.count(F.lit(1))).alias("token_identical_rate"),
        count_of(~F.col("identical_tokens")).alias("ambiguous_count"),
        ratio(count_of(F.col("answer_observed") & F.col("answer_agreement")), count_of(F.col("answer_observed"))).alias(
            "answer_agreement_rate"
        ),
        F.avg("reasoning_token_std").alias("mean_reasoning_token_std"),
        F.avg("wall_ms_std").alias("mean_wall_ms_std"),
    )


def _sampled(records: DataFrame) -> DataFrame:
    return records.where((F.col("mode") == "sampled") & F.col("seed").isNotNull())


def cross_seed_tokens(records: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ORDER,
                      tokens: str = "tokens") -> DataFrame:
    """Earliest divergence of any seed's first execution from the lowest seed's, and spread of mean lengths."""
    key = [*by, "condition_id", "task_id"]
    rows = _sampled(records)
    per_seed = rows.groupBy(*key, "seed").agg(
        F.min(F.struct(*order)).alias("__at"), F.avg("reasoning_tokens").alias("__len")
    )
    spread = per_seed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.stddev_pop("__len").alias("reasoning_tokens_std_across_seeds"),
        F.min("seed").alias("__base_seed"),
    ).where(F.col("n_seeds") > 1)
    firsts = join_null_safe(
        rows.select(*key, "seed", *order, tokens),
        per_seed.select(*key, "seed", *[F.col(f"__at.{o}").alias(o) for o in order]),
        [*key, "seed", *order],
    )
    base = join_null_safe(firsts, spread.select(*key, F.col("__base_seed").alias("seed")), [*key, "seed"]).select(
        *key, F.col(tokens).alias("__base")
    )
    compared = join_null_safe(firsts.select(*key, tokens), base, key)
    divergence = compared.groupBy(*key).agg(
        F.min(A.first_divergence(F.col("__base"), F.col(tokens))).alias("first_token_divergence")
    )
    return join_null_safe(spread.drop("__base_seed"), divergence, key, "left")


def across_seed_answers(records: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ORDER) -> DataFrame:
    """Diversity and accuracy spread of observed answers over seeds; ambiguous seeds give no answer."""
    key = [*by, "condition_id", "task_id"]
    rows = _sampled(records)
    right = {"__right": F.avg(F.coalesce("correct", F.lit(False)).cast("double"))}
    seeds = collapse_draws(rows, [*key, "seed"], keep=["answer_normalized"], order=order, divergence=False, extra=right)
    answer = F.col("answer_normalized")
    observed = F.when(answer.isNotNull(), F.col("__right"))
    out = seeds.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.count(answer).alias("n_seeds_with_observed_answer"),
        count_of(F.col("ambiguous")).alias("n_ambiguous_seeds"),
        F.count_distinct(answer).alias("__distinct"),
        F.stddev_pop(observed).alias("__std"),
    ).where(F.col("n_seeds") > 1)
    seen = F.col("n_seeds_with_observed_answer")
    return out.select(
        *key, "n_seeds", "n_seeds_with_observed_answer", "n_ambiguous_seeds",
        F.when(seen > 0, F.col("__distinct")).alias("distinct_answers"),
        ratio(seen, F.col("n_seeds")).alias("answer_observation_rate"),
        F.when(seen > 1, F.col("__std")).alias("accuracy_std_across_seeds"),
    )
