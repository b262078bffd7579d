"""Simple linear regression from aggregates: fit, summary, residuals, confidence band."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenland.functions.student_t import critical_t, two_sided_p
from fenland.operators.group_join import join_group_table
from fenland.operators.quantiles import group_quantiles, small_group_quantiles

BAND_POINTS = 80


def fit_line(
    df: DataFrame, x: str, y: str, keys: Sequence[str] = (), extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Least-squares line of y on x, one row per group; pairs with a null are left out.

    One aggregation pass, combined map-side. Slope columns are null when x does
    not vary; error columns are null below three pairs. `extra` adds aggregates
    to the same pass.
    """
    extra = extra or {}
    yx = f"`{y}`, `{x}`"
    pair = f"`{x}` IS NOT NULL AND `{y}` IS NOT NULL"
    sums = df.groupBy(*keys).agg(
        F.expr(f"regr_count({yx})").alias("n"),
        F.expr(f"regr_slope({yx})").alias("slope"),
        F.expr(f"regr_intercept({yx})").alias("intercept"),
        F.expr(f"regr_r2({yx})").alias("r_squared"),
        F.expr(f"regr_sxx({yx})").alias("sxx"),
        F.expr(f"regr_syy({yx})").alias("syy"),
        F.expr(f"regr_sxy({yx})").alias("sxy"),
        F.expr(f"regr_avgx({yx})").alias("mean_x"),
        F.expr(f"min(IF({pair}, `{x}`, NULL))").alias("min_x"),
        F.expr(f"max(IF({pair}, `{x}`, NULL))").alias("max_x"),
        *[aggregate.alias(name) for name, aggregate in extra.items()],
    )
    return (
        sums.withColumn("df", F.expr("CAST(n - 2 AS INT)"))
        .withColumn("rss", F.expr("IF(n > 2 AND sxx > 0, greatest(0D, syy - sxy * sxy / sxx), NULL)"))
        .withColumn("sigma", F.expr("sqrt(try_divide(rss, df))"))
        .withColumn("se_slope", F.expr("try_divide(sigma, sqrt(sxx))"))
        .withColumn("se_intercept", F.expr("sigma * sqrt(1D / n + try_divide(mean_x * mean_x, sxx))"))
        .withColumn("t_slope", F.expr("try_divide(slope, se_slope)"))
        .withColumn("t_intercept", F.expr("try_divide(intercept, se_intercept)"))
        .withColumn("p_slope", F.expr(f"IF(rss = 0, 0D, {two_sided_p('t_slope', 'df')})"))
        .withColumn("p_intercept", F.expr(f"IF(rss = 0, 0D, {two_sided_p('t_intercept', 'df')})"))
        .withColumn("adj_r_squared", F.expr("1 - (1 - r_squared) * try_divide(CAST(n - 1 AS DOUBLE), CAST(df AS DOUBLE))"))
        .withColumn("f_statistic", F.expr("t_slope * t_slope"))
        .select(
            *keys,
            "n",
            "slope",
            "intercept",
            "r_squared",
            "adj_r_squared",
            "se_slope",
            "se_intercept",
            "t_slope",
            "t_intercept",
            "p_slope",
            "p_intercept",
            "f_statistic",
            "sigma",
            "df",
            "mean_x",
            "sxx",
            "min_x",
            "max_x",
            *extra,
        )
    )


def residual_quantiles(
    df: DataFrame, fit: DataFrame, x: str, y: str, keys: Sequence[str] = (), *, small_groups: bool = False
) -> DataFrame:
    """Minimum, quartiles and maximum of the residuals of a fit."""
    line = ("slope", "intercept")
    if keys:
        joined = join_group_table(df, fit.select(*keys, *line), keys, [x, y], few_groups=small_groups)
    else:
        joined = df.withColumn("_fit", fit.select(F.struct(*line)).scalar()).select(*df.columns, "_fit.*")
    residuals = joined.selectExpr(
        *[f"`{k}`" for k in keys], f"`{y}` - (intercept + slope * `{x}`) AS residual"
    ).where("residual IS NOT NULL")
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    ends = [F.min("residual").alias("minimum"), F.max("residual").alias("maximum")]
    quantiles = small_group_quantiles if small_groups else group_quantiles
    out = quantiles(residuals, list(keys), "residual", probs, ends)
    return out.select(*keys, "minimum", "q1", "median", "q3", "maximum")


def confidence_band(fit: DataFrame, keys: Sequence[str] = (), points: int = BAND_POINTS, confidence: float = 0.95) -> DataFrame:
    """Fitted line on an even x grid with its confidence band; a fixed number of rows per fit."""
    half = "crit * sigma * sqrt(1D / n + try_divide(pow(x - mean_x, 2), sxx))"
    return (
        fit.withColumn("crit", F.expr(critical_t("df", confidence)))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", F.expr(f"min_x + step * (max_x - min_x) / {points - 1}D"))
        .withColumn("fitted", F.expr("intercept + slope * x"))
        .withColumn("lower", F.expr(f"fitted - {half}"))
        .withColumn("upper", F.expr(f"fitted + {half}"))
        .select(*keys, "step", "x", "fitted", "lower", "upper")
    )
