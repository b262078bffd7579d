"""Exact group quantiles that never hold a whole group in one task.

Spark's own `percentile` and `median` keep a value -> count map of a whole group
in one task's memory. That is fine for groups that are small by construction
(twelve months, the model frames); for a county that holds a third of all rows
it is not. Here the work is split, and the rows are read twice:

1. one aggregate per group: row count, minimum, maximum and a small quantile
   sketch that brackets each wanted rank from below and above; its table, one row per
   group, is written once and also tells which groups are large;
2. rows outside every bracket only count (one row per gap after the map-side
   combine); rows inside are counted per distinct value and fall into
   `GRID` equal-width cells per bracket;
3. running totals over the cells (a fixed number per group) name the few cells
   that hold a wanted rank; only their values are ordered. A cell that holds many different
   values is laid out in `GRID` finer cells first.

Box statistics come from the same second pass: the brackets of the quartiles bound the fences, so only
rows between a fence's least and greatest place are kept by value.

The result is exact: the sketch only decides which rows are looked at closely.
Its error bound puts every wanted rank inside the bracket; should a sketch break that
bound, the job ends with an error and not with a wrong value. Quantiles are interpolated
linearly between the two nearest ranks, `h = (n - 1) p`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenland.operators.group_join import join_group_table, large_groups, value_counts
from fenland.sources import scratch

# A sketch of accuracy A is off by at most n/A ranks, and the interpolated rank (n - 1) p lies
# within two ranks of n p. So a bracket edge at p -+ d is safe once d n >= n/A + 2: each
# group takes the nearest rung d of a ladder that is, whatever its size. The last rung
# is the whole group, from minimum to maximum.
ACCURACY = 1000
RUNGS = 9  # 2/A, 4/A, 8/A, ... of the rows
GRID = 1024


def small_group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], extra: Sequence[Column] = ()
) -> DataFrame:
    """Same result with the built-in aggregate, for groups of provably few rows."""
    names = list(probs)
    found = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(p) for p in probs.values()]))
    out = df.groupBy(*keys).agg(found.alias("_q"), *extra)
    return out.withColumns({name: F.col("_q")[i] for i, name in enumerate(names)}).drop("_q")


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    extra: Sequence[Column] = (),
    *,
    few_groups: bool = False,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group: the keys, the `extra` aggregates and one column per entry of `probs`.

    `extra` aggregates run in the first pass and see every row, also rows with a
    null value. `few_groups` states that the number of groups is bounded by a
    fixed domain (counties, postcode districts), so the bracket table may be
    broadcast; otherwise rows are counted per value first and the join is salted for large groups.
    """
    order = sorted(probs, key=probs.get)
    first = first_pass(df, keys, value, [probs[name] for name in order], extra, accuracy)
    bounds = first.selectExpr(*_quoted(keys), *_brackets(len(order), accuracy))
    rows = _bounded_rows(df, keys, value, bounds, first, few_groups)
    cell, close = _cell(len(order))
    counted = (
        rows.selectExpr(*_quoted(keys), f"{cell} AS _cell", f"IF({close}, _v, NULL) AS _v", "_k")
        .groupBy(*keys, "_cell", "_v")
        .agg(F.sum("_k").alias("_k"))
    )
    ranks = wanted_ranks(counted, keys, [(name, probs[name]) for name in order])
    kept = [c for c in first.columns if c not in (*keys, *_FIRST)]
    if not kept:
        return ranks
    if not keys:
        picked = ranks.select(F.struct("*")).scalar()
        return first.select(*kept).withColumn("_r", picked).select(*kept, "_r.*")
    return ranks.join(first.select(*keys, *kept), list(keys)).select(*keys, *kept, *order)


_FIRST = ("_rows", "_n", "_min", "_max", "_edges")


def first_pass(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], extra: Sequence[Column] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Per group the counts, the ends, the sketch's ladder around each share and the extra aggregates, written once."""
    rungs = [2.0**k / accuracy for k in range(1, RUNGS + 1)]
    edges = [edge for p in shares for d in rungs for edge in (max(p - d, 0.0), min(p + d, 1.0))]
    v = f"CAST(`{value}` AS DOUBLE)"
    return scratch.written(
        df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_rows"),
            F.expr(f"count({v})").alias("_n"),
            F.expr(f"min({v})").alias("_min"),
            F.expr(f"max({v})").alias("_max"),
            F.expr(f"percentile_approx({v}, array({', '.join(map(str, edges))}), {accuracy})").alias("_edges"),
            *extra,
        )
    )


def _brackets(count: int, accuracy: int) -> list[str]:
    # the first rung whose share of the rows covers the sketch's error and two ranks; past the ladder the whole group
    rung = f"greatest(0, CAST(ceil(log2(1D + 2D * {accuracy} / greatest(_n, 1))) AS INT) - 1)"
    out = []
    for i in range(count):
        for end, (side, whole) in enumerate((("low", "_min"), ("high", "_max"))):
            place = f"{2 * RUNGS * i} + 2 * ({rung}) + {end}"
            out.append(f"IF({rung} >= {RUNGS}, {whole}, _edges[{place}]) AS _{side}{i}")
    return out


def _bounded_rows(df: DataFrame, keys: Sequence[str], value: str, bounds: DataFrame, first: DataFrame, few_groups: bool) -> DataFrame:
    """Values `_v` and their counts `_k` beside the bounds of their group."""
    rows = df.selectExpr(*_quoted(keys), f"CAST(`{value}` AS DOUBLE) AS _v")
    if not keys:
        return rows.withColumn("_b", bounds.select(F.struct("*")).scalar()).selectExpr("_v", "1L AS _k", "_b.*")
    if few_groups:
        return join_group_table(rows.withColumn("_k", F.lit(1).cast("long")), bounds, keys, ["_v"], few_groups=True)
    return join_group_table(value_counts(rows, keys, "_v"), bounds, keys, ["_v"], heavy=large_groups(first, keys, "_rows"))


def box_counts(df: DataFrame, keys: Sequence[str], value: str, first: DataFrame, *, few_groups: bool, accuracy: int = ACCURACY) -> DataFrame:
    """The second pass of a box: keys, _cell, _region, _v, _k, _lo, _hi, written once.

    `first` is the first pass for the three quartiles. A fence is 2.5 q1 - 1.5 q3 below and
    2.5 q3 - 1.5 q1 above, so the quartiles' brackets bound it. Regions: 0 below every possible lower fence, 1 and 3
    where a fence may lie (values kept), 2 between, 4 above; null for null values.
    """
    slack = "1e-9D * (abs(_low0) + abs(_high0) + abs(_low2) + abs(_high2))"  # more than any rounding of the fences
    fences = [
        f"2.5D * _low0 - 1.5D * _high2 - {slack} AS _under",
        f"2.5D * _high0 - 1.5D * _low2 + {slack} AS _under_end",
        f"2.5D * _low2 - 1.5D * _high0 - {slack} AS _over",
        f"2.5D * _high2 - 1.5D * _low0 + {slack} AS _over_end",
    ]
    bounds = first.selectExpr(*_quoted(keys), *_brackets(3, accuracy)).selectExpr("*", *fences)
    rows = _bounded_rows(df, keys, value, bounds, first, few_groups)
    cell, close = _cell(3)
    region = (
        "CASE WHEN _v IS NULL THEN NULL WHEN _v < _under THEN 0 WHEN _v <= _under_end THEN 1 "
        "WHEN _v > _over_end THEN 4 WHEN _v >= _over THEN 3 ELSE 2 END"
    )
    placed = rows.selectExpr(*_quoted(keys), f"{cell} AS _cell", f"{region} AS _region", f"{close} AS _close", "_v AS _at", "_k")
    placed = placed.selectExpr("*", "IF(_close OR _region IN (1, 3), _at, NULL) AS _v")
    grouped = placed.groupBy(*keys, "_cell", "_region", "_v")
    return scratch.written(grouped.agg(F.sum("_k").alias("_k"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi")))


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{name}`" for name in names]


def _cell(count: int) -> tuple[str, str]:
    """Cell number that never falls as the value grows, and whether the row needs a close look.

    Cells run gap, bracket cells, gap, bracket cells, ..., gap; nulls are in cell -1.
    """
    cells, close = ["WHEN _v IS NULL THEN -1"], ["WHEN _v IS NULL THEN false"]
    for i in range(count):
        start = i * (GRID + 1)
        step = f"coalesce(try_divide(_v - _low{i}, _high{i} - _low{i}), 0D) * {GRID}"
        inner = f"{start + 1} + least(CAST(floor({step}) AS INT), {GRID - 1})"
        cells.append(f"WHEN _v < _low{i} THEN {start} WHEN _v <= _high{i} THEN {inner}")
        close.append(f"WHEN _v < _low{i} THEN false WHEN _v <= _high{i} THEN true")
    last = count * (GRID + 1)
    return f"CASE {' '.join(cells)} ELSE {last} END", f"CASE {' '.join(close)} ELSE false END"


def wanted_ranks(counted: DataFrame, keys: Sequence[str], probs: Sequence[tuple[str, float]]) -> DataFrame:
    """keys and one column per quantile, from counts per (keys, _cell, _v)."""
    group = ", ".join(_quoted(keys))
    by_group = f"PARTITION BY {group}" if keys else ""
    by_cell = f"PARTITION BY {group}, _cell, _fine" if keys else "PARTITION BY _cell, _fine"
    # One row per cell, at most len(probs) * (GRID + 1) + 1 of them in a group.
    totals = (
        counted.groupBy(*keys, "_cell")
        .agg(F.sum("_k").alias("_size"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        .selectExpr(
            *_quoted(keys),
            "_cell",
            "_size",
            "_from",
            "_to",
            f"coalesce(sum(IF(_cell >= 0, _size, NULL)) OVER ({by_group}), 0) AS _n",
            f"sum(IF(_cell >= 0, _size, 0)) OVER ({by_group} ORDER BY _cell) - _size AS _before",
        )
    )
    ranks = [
        rank
        for _, p in probs
        for rank in (f"floor((_n - 1) * {p}D) + 1", f"ceil((_n - 1) * {p}D) + 1")
    ]
    # a group of nulls only keeps its null cell, which holds no rank
    holds = " OR ".join(f"({rank} > _before AND {rank} <= _before + _size)" for rank in ranks)
    targets = totals.where(f"(_cell >= 0 AND ({holds})) OR (_cell < 0 AND _n = 0)").drop("_size")
    # the cells that hold a rank are laid out once more between their own least and greatest value, so a cell
    # that a third of the rows crowd into is spread as well
    fine = f"least(CAST(floor(coalesce(try_divide(_v - _from, _to - _from), 0D) * {GRID}) AS INT), {GRID - 1})"
    near = counted.join(targets, [*keys, "_cell"]).selectExpr("*", f"coalesce({fine}, 0) AS _fine")
    sums = near.groupBy(*keys, "_cell", "_fine").agg(F.sum("_k").alias("_size"), F.max("_before").alias("_before"), F.max("_n").alias("_n"))
    by_coarse = f"PARTITION BY {group}, _cell" if keys else "PARTITION BY _cell"
    inner = sums.selectExpr(*_quoted(keys), "_cell", "_fine", "_size", "_n", f"_before + sum(_size) OVER ({by_coarse} ORDER BY _fine) - _size AS _before")
    held = inner.where(f"({holds}) OR _n = 0").drop("_size", "_n")
    near = near.drop("_before", "_from", "_to").join(held, [*keys, "_cell", "_fine"])
    near = near.selectExpr(*_quoted(keys), "_n", "_v", "_k", f"_before + sum(_k) OVER ({by_cell} ORDER BY _v) AS _end")
    value = "coalesce(_v, CAST(raise_error('quantile rank outside its bracket') AS DOUBLE))"
    at = [
        F.expr(f"max(CASE WHEN _n > 0 AND {rank} <= _end AND {rank} > _end - _k THEN {value} END)").alias(f"_at{i}")
        for i, rank in enumerate(ranks)
    ]
    picked = near.groupBy(*keys).agg(F.max("_n").alias("_n"), *at)
    return picked.selectExpr(
        *_quoted(keys),
        *[
            f"_at{2 * i} + (_at{2 * i + 1} - _at{2 * i}) * ((_n - 1) * {p}D - floor((_n - 1) * {p}D)) AS `{name}`"
            for i, (name, p) in enumerate(probs)
        ],
    )
