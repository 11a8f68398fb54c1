"""SQL fragments the oracles share."""

# Kaplan-Meier over a relation `cells(g..., time, n, d)`; {g} is a comma list of strata.
KM = """
km AS (
  SELECT *, product(CASE WHEN at_risk > 0 THEN 1.0 - d / at_risk ELSE 1.0 END)
              OVER (PARTITION BY {g} ORDER BY time) AS survival
  FROM (SELECT *, sum(n) OVER (PARTITION BY {g} ORDER BY time DESC) AS at_risk FROM cells) x
)"""
# Area under `km` up to {tau}.
AREA = """
steps AS (
  SELECT {g}, time, survival FROM km WHERE time <= {tau}
  UNION ALL SELECT DISTINCT {g}, 0.0 AS time, 1.0 AS survival FROM km
),
area AS (
  SELECT {g}, sum(survival * (nxt - time)) AS rmst
  FROM (SELECT *, lead(time, 1, {tau}) OVER (PARTITION BY {g} ORDER BY time, survival DESC) AS nxt FROM steps) x
  GROUP BY {g}
)"""
P = 2147483647


def power5(x: str) -> str:
    sq = f"(({x}) * ({x}) % {P})"
    return f"({sq} * {sq} % {P} * ({x}) % {P})"


def _each(items: str, name: str, expression: str) -> str:
    return f"list_transform({items}, lambda {name}: {expression})"


def drawn_weights(source: str, n_resamples: int, seed: int = 0) -> str:
    """Sub-select `n, replicate, idx, w` (w > 0): how often each of n clusters is drawn, for the distinct `n` of a relation.

    Draws of a range go to its lower part (the largest power of two below its size) or the upper one, one draw after
    another in a range of uneven halves, else thirty at a time as the bits of a residue.
    """
    turns = "range(CASE WHEN size = 2 * half THEN (k + 29) // 30 ELSE k END)"
    words = _each(turns, "i", f"(replicate * 7919 + {seed * 104729 + 12345} + i * 15485863) % {P}")
    words = _each(_each(words, "y", power5("y")), "fb", f"(fa * fb % {P} + fa + fb * 31) % {P}")
    words = _each(words, "fx", power5("fx"))
    fair = f"list_sum(list_transform({words}, lambda u, i: bit_count(u & ((CAST(1 AS BIGINT) << CAST(least(30, k - 30 * (i - 1)) AS INT)) - 1))))"
    uneven = f"len(list_filter({words}, lambda u: u % size < half))"
    inner = power5(f"((lo * 64 + level) % {P} + 1)")
    return f"""(WITH RECURSIVE t AS (
  SELECT n, replicate, CAST(0 AS BIGINT) AS lo, n AS size, n AS k FROM (SELECT DISTINCT CAST(n AS BIGINT) AS n FROM {source}) s, range(0, {n_resamples}) r(replicate)
  UNION ALL
  SELECT n, replicate, lo + side * half, CASE side WHEN 0 THEN half ELSE size - half END, CASE side WHEN 0 THEN kl ELSE k - kl END
  FROM (SELECT *, CAST(CASE WHEN size = 2 * half THEN {fair} ELSE {uneven} END AS BIGINT) AS kl FROM (
    SELECT *, {power5('fl')} AS fa FROM (
    SELECT *, ({inner} + (lo * 64 + level) // {P}) % {P} AS fl FROM (
    SELECT *, CAST(1 AS BIGINT) << (level - 1) AS half FROM (
    SELECT *, CAST(floor(log2(size - 1)) AS INT) + 1 AS level FROM t WHERE size > 1 AND k > 0) a) b) c) d) e, (VALUES (0), (1)) v(side))
SELECT n, replicate, lo AS idx, k AS w FROM t WHERE size = 1 AND k > 0)"""


def resample_means(groups: str, n: int, seed: int = 0) -> str:
    """CTEs from `vals({groups}, cl, v)` to `reps({groups}, replicate, estimate)`."""
    g = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    return f"""
placed AS (
  SELECT *, row_number() OVER ({part}ORDER BY CAST('0x' || substr(md5(cl), 1, 15) AS BIGINT), cl) - 1 AS idx, count(*) OVER ({part}) AS n FROM vals
),
drawn AS (SELECT * FROM {drawn_weights('placed', n, seed)} z),
reps AS (SELECT {g}replicate, sum(w * v) / sum(w) AS estimate FROM drawn JOIN placed USING (n, idx) WHERE v IS NOT NULL GROUP BY {g}replicate)"""
