"""Row-local column expressions over token arrays, vectors and checkpoint lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reasoning_tokens(ids: Column, think_end: Column) -> Column:
    """Ids strictly before the first think-end id; everything when it is absent."""
    at = F.array_position(ids, think_end)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def final_tokens(ids: Column, think_end: Column) -> Column:
    """Ids after the first think-end id; none when it is absent."""
    at = F.array_position(ids, think_end)
    rest = F.slice(ids, (at + 1).cast("int"), F.greatest(F.size(ids) - at, F.lit(0)).cast("int"))
    return F.when(at > 0, rest).otherwise(F.slice(ids, 1, 0))


def strip_trailing(ids: Column, special: Column) -> Column:
    """Drop the trailing ids that are members of ``special``."""
    last = F.aggregate(
        F.transform(ids, lambda x, i: F.when(~F.array_contains(special, x), i + 1).otherwise(F.lit(0))),
        F.lit(0),
        lambda acc, x: F.greatest(acc, x),
    )
    return F.slice(ids, F.lit(1), last)


def reasoning_only(ids: Column, think_end: Column, eos: Column) -> Column:
    """Reasoning prefix; an unclosed sequence also loses its trailing end-of-sequence ids."""
    return F.when(F.array_position(ids, think_end) > 0, reasoning_tokens(ids, think_end)).otherwise(
        strip_trailing(ids, eos)
    )


def first_divergence(a: Column, b: Column) -> Column:
    """0-based index of the first difference (a missing element differs); null when equal."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    differs = F.transform(pairs, lambda p: ~p["x"].eqNullSafe(p["y"]))
    at = F.array_position(differs, F.lit(True))
    return F.when(at > 0, at - 1)


def is_prefix(short: Column, long: Column) -> Column:
    return (F.size(short) <= F.size(long)) & (F.slice(long, F.lit(1), F.size(short)) == short)


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` (inside a lambda it would run per element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_softmax(logits: Column) -> Column:
    wide = F.transform(logits, lambda x: x.cast("double"))

    def shifted(values: Column) -> Column:
        return bind(F.array_max(values), lambda top: F.transform(values, lambda x: x - top))

    def normalized(values: Column) -> Column:
        total = F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x)))
        return bind(total, lambda norm: F.transform(values, lambda x: x - norm))

    return bind(bind(wide, shifted), normalized)


def entropy(logprobs: Column) -> Column:
    return F.aggregate(logprobs, F.lit(0.0), lambda acc, x: acc - F.exp(x) * x)


def top_k(values: Column, k: int) -> Column:
    """The k largest values with their positions, largest first, earlier position first on ties."""
    keyed = F.transform(values, lambda x, i: F.struct((-x).alias("neg"), i.alias("id")))
    return F.transform(
        F.slice(F.array_sort(keyed), 1, max(k, 0)), lambda s: F.struct(s["id"].alias("id"), (-s["neg"]).alias("value"))
    )


def explicit_checkpoints(length: Column, checkpoints: Column) -> Column:
    """Given checkpoints that fit, plus the empty and the full prefix, ascending."""
    top = F.greatest(length, F.lit(0)).cast("bigint")
    fitting = F.filter(checkpoints, lambda c: (c >= 0) & (c <= top))
    return F.array_sort(F.array_union(F.transform(fitting, lambda c: c.cast("bigint")),
                                      F.array(F.lit(0).cast("bigint"), top)))


def uniform_checkpoints(length: Column, n_probes: int, min_prefix: int = 16) -> Column:
    """0 plus ``n_probes`` evenly spaced prefix lengths, rounded half to even."""
    none = F.array().cast("array<bigint>")
    if n_probes <= 0:
        return none
    zero = F.array(F.lit(0).cast("bigint"))
    steps = max(n_probes - 1, 1)
    span = (length - min_prefix).cast("double")
    grid = F.array(*[
        (length if n_probes > 1 and i == n_probes - 1 else F.bround(F.lit(float(min_prefix)) + span / steps * i))
        .cast("bigint")
        for i in range(n_probes)
    ])
    return F.when(length > min_prefix, F.array_sort(F.array_union(zero, grid))).otherwise(zero)


def grams(tokens: Column, n: int, separator: str = " ") -> Column:
    """n-grams as text, injective while no token contains the separator; empty when too short."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(
        F.size(tokens) >= n,
        F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), separator)),
    ).otherwise(F.array().cast("array<string>"))
