from __future__ import annotations

import math

import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fenland.functions.student_t import critical_t, two_sided_p
from fenland.operators import aggregates, dedup, group_join, lookup, numbering, profile, quantiles, rates, regression, reshape

PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}


def rows(df):
    return [tuple(r) for r in df.collect()]


def linear_quantile(sorted_values, p):
    h = (len(sorted_values) - 1) * p
    low = int(h)
    high = min(low + 1, len(sorted_values) - 1)
    return sorted_values[low] + (sorted_values[high] - sorted_values[low]) * (h - low)


# ---- quantiles -----------------------------------------------------------


@pytest.mark.parametrize("few_groups", [True, False])
def test_group_quantiles_match_brute_force_with_a_hot_group(spark, few_groups):
    source = random.Random(7)
    data = [("hot", source.expovariate(1e-5)) for _ in range(30000)]
    data += [("steps", float(source.randint(1, 5))) for _ in range(15000)]
    data += [("same", 4.0)] * 12000 + [("pair", 1.0), ("pair", 2.0), ("one", 9.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    got = {r.k: r for r in quantiles.group_quantiles(df, ["k"], "v", PROBS, few_groups=few_groups).collect()}
    groups = {}
    for k, v in data:
        groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, members in groups.items():
        members.sort()
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(linear_quantile(members, p), rel=1e-12), (k, name)


def test_quantiles_over_all_rows_with_nulls(spark):
    df = spark.createDataFrame([(None if i % 10 == 0 else float(i),) for i in range(25000)], "v double")
    out = quantiles.group_quantiles(df, [], "v", PROBS, [F.count("*").alias("n")]).first()
    present = [float(i) for i in range(25000) if i % 10]
    assert out.n == 25000
    for name, p in PROBS.items():
        assert out[name] == pytest.approx(linear_quantile(present, p))


def test_group_with_nulls_only_has_null_quantiles(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    got = {r.k: (r.median, r.n) for r in quantiles.group_quantiles(df, ["k"], "v", {"median": 0.5}, [F.count("*").alias("n")]).collect()}
    assert got == {"a": (None, 1), "b": (1.0, 1)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantile_property(spark, members):
    df = spark.createDataFrame([(v,) for v in members], "v double")
    out = quantiles.group_quantiles(df, [], "v", PROBS).first()
    for name, p in PROBS.items():
        assert out[name] == pytest.approx(linear_quantile(sorted(members), p), rel=1e-9, abs=1e-9)


# ---- statistics ----------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"few_groups": True}, {"small_groups": True}])
def test_group_statistics(spark, options):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", 5.0)], "k string, v double")
    got = {r[0]: tuple(r)[1:] for r in aggregates.group_statistics(df, ["k"], "v", "v", **options).collect()}
    assert got["a"] == pytest.approx((7 / 3, 2.0, statistics.stdev([1, 2, 4]), 1.0, 4.0, 4))
    assert got["b"] == (5.0, 5.0, None, 5.0, 5.0, 1)


@pytest.mark.parametrize("options", [{}, {"few_groups": True}, {"small_groups": True}])
def test_box_statistics_and_outliers(spark, options):
    members = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in members] + [("b", 1.0)], "k string, v double")
    boxes = aggregates.box_statistics(df, ["k"], "v", min_rows=2, **options)
    assert rows(boxes) == [("a", 1.0, 2.25, 3.5, 4.75, 5.0, 1, 6)]
    assert rows(aggregates.box_outliers(df, ["k"], "v", boxes)) == [("a", 100.0)]


def test_trim_takes_the_quantile_before_the_sign_check(spark):
    df = spark.createDataFrame([(float(v),) for v in [-1, 0, 1, 2, 3]], "v double")
    # 75 % quantile of all five values is 2, and 2 < 2 is false
    assert sorted(r.v for r in aggregates.trim_top(df, "v", 0.75).collect()) == [1.0]


def test_rounded_statistics(spark):
    df = spark.createDataFrame([("a", 0.125), ("a", 0.125)], "k string, v double")
    assert rows(aggregates.rounded_statistics(df, ["k"], "v")) == [("a", 0.12, 0.12, 0.12, 0.12)]


def test_two_level_rate_counts_only_areas_with_events(spark):
    counts = spark.createDataFrame([("x", "d1", 4), ("y", "d1", 1), ("z", "d2", 3), ("q", "d2", 9)], "area string, d string, n long")
    people = spark.createDataFrame([("x", 1000.0), ("y", 500.0), ("z", 0.0), ("w", 5000.0)], "area string, population double")
    out = rates.two_level_rate(counts, people, "area", ["d"], "n", "total", "rate")
    assert rows(out) == [("d1", 5, 1500.0, pytest.approx(5 / 1500 * 100000))]


def test_shares_sum_to_100(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (4.0,)], "v double")
    out = sorted(r.pct for r in rates.share_of_total(df, "v", "pct").collect())
    assert out == [12.5, 37.5, 50.0]


# ---- duplicates, keys ----------------------------------------------------


def test_first_rows_is_idempotent_and_follows_the_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    once = dedup.first_rows(df, ["k"], ["o", "v"])
    assert sorted(rows(once)) == [("a", 1, "y"), ("b", 5, None)]
    assert sorted(rows(dedup.first_rows(once, ["k"], ["o", "v"]))) == sorted(rows(once))


def test_top_row_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([("t", "S", 3), ("t", "N", 3), ("u", "N", 1), ("u", "S", 2)], "town string, county string, n long")
    assert sorted(rows(dedup.top_row(df, ["town"], "n", ["county"]))) == [("t", "N", 3), ("u", "S", 2)]


def test_duplicate_and_distinct_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (1, "a")], "x int, y string")
    assert dedup.duplicate_count(df, "x", "y").first()[0] == 2
    assert dedup.distinct_count(df, "x").first()[0] == 2
    assert dedup.distinct_count(df, "x", "y", approximate=True).first()[0] == 3
    assert dedup.distinct_rows(df, "x").count() == 2


def test_numbers_are_dense_unique_and_repeatable(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 7).repartition(5)
    numbered = numbering.number_rows(df, "pk", numbering.hash_bucket("id", "v", buckets=64), ["id"])
    got = dict(rows(numbered.select("id", "pk")))
    assert sorted(got.values()) == list(range(1, 5001))
    again = numbering.number_rows(df.repartition(3), "pk", numbering.hash_bucket("id", "v", buckets=64), ["id"])
    assert dict(rows(again.select("id", "pk"))) == got


def test_numbering_reads_its_input_once(spark, tmp_path):
    spark.range(20_000).selectExpr("id", "id * 7 AS v", "cast(id AS string) AS t").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    numbered = numbering.number_rows(df, "pk", numbering.hash_bucket("id"), ["id"])
    assert sorted(r.pk for r in numbered.select("pk").collect()) == list(range(1, 20_001))
    plan = numbered.select("pk", "v")
    plan.write.format("noop").mode("overwrite").save()
    query = plan._jdf.queryExecution()
    query.executedPlan().executeCollect()
    text = query.executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("FileScan parquet") - text.count("ReusedExchange") <= 1, text


def test_repeated_rows_are_numbered_as_one_group(spark):
    df = spark.createDataFrame([("a", 1)] * 700 + [("b", k) for k in range(30)], "t string, v int")
    got = rows(numbering.number_rows(df, "pk", numbering.hash_bucket("t", "v"), ["t", "v"], repeated=True))
    assert sorted(pk for pk, *_ in got) == list(range(1, 731))
    copies = sorted(pk for pk, t, _ in got if t == "a")
    assert copies == list(range(copies[0], copies[0] + 700))
    assert numbering.number_rows(df.limit(0), "pk", numbering.hash_bucket("t"), ["t"]).count() == 0


# ---- large groups --------------------------------------------------------


def test_large_groups_are_found_and_only_they_are_copied(spark):
    few = spark.range(60_000).selectExpr("IF(id % 3 = 0, 'hot', cast(id AS string)) AS estab", "cast(id AS double) AS score")
    (hot,) = group_join.heavy_keys(few, ["estab"])
    assert hot == spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert group_join.heavy_keys(few.where("estab <> 'hot'"), ["estab"]) == []
    assert group_join.heavy_keys(few.limit(0), ["estab"]) == []
    assert len(group_join.heavy_keys(spark.range(1000).selectExpr("id % 7 AS k", "NULL AS n"), ["k", "n"])) == 7


def test_one_school_with_a_third_of_the_scores_fills_no_task(spark):
    scores = spark.range(90_000).selectExpr("IF(id % 3 = 0, 'hot', cast(id % 5000 AS string)) AS estab", "cast(id AS double) AS score").cache()
    schools = scores.select("estab").distinct().selectExpr("estab", "hash(estab) % 2 AS county_id")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = group_join.join_group_table(scores, schools, ["estab"], ["score"])
        sizes = sorted(r[1] for r in rows(joined.groupBy(F.spark_partition_id()).count()))
        assert sum(sizes) == 90_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
        plain = sorted(r[1] for r in rows(scores.join(schools, "estab").groupBy(F.spark_partition_id()).count()))
        assert plain[-1] > 5 * plain[len(plain) // 2]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        scores.unpersist()


def plain_box(values):
    import statistics

    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    at = lambda p: values[int((len(values) - 1) * p)] + (values[min(int((len(values) - 1) * p) + 1, len(values) - 1)] - values[int((len(values) - 1) * p)]) * ((len(values) - 1) * p % 1)
    q1, q3 = at(0.25), at(0.75)
    near = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    return (min(near), q1, statistics.median(values), q3, max(near), len(values) - len(near))


def box_frame(spark):
    """A third of the rows crowd into one narrow cell, others lie far out, in ties, in one value, in nulls."""
    return spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'crowd' WHEN id % 3 = 1 THEN 'ties' ELSE concat('g', id % 40) END AS g",
        "CASE WHEN id % 3 = 0 THEN CASE WHEN id % 7 = 0 THEN id * 1000D ELSE 5D + (id * 7919 % 9973) * 1e-7 END "
        "WHEN id % 3 = 1 THEN CAST(id % 5 AS DOUBLE) WHEN id % 40 = 2 THEN NULL WHEN id % 40 = 5 THEN 4D ELSE (id * 104729 % 10007) - 5000D END AS v",
    )


def test_boxes_of_crowded_cells_and_odd_groups(spark):
    df = box_frame(spark).cache()
    values = {}
    for g, v in rows(df):
        values.setdefault(g, []).append(v)
    want = {g: plain_box(v) for g, v in values.items() if plain_box(v)}
    for few in (False, True):
        got = {r[0]: r[1:7] for r in rows(aggregates.box_statistics(df, ["g"], "v", few_groups=few))}
        assert set(got) == set(want)
        for g, w in want.items():
            assert got[g] == pytest.approx(w, rel=1e-12), g
    df.unpersist()


def test_boxes_read_their_rows_twice(spark, tmp_path):
    box_frame(spark).write.parquet(str(tmp_path / "rows"))
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    df = spark.read.parquet(str(tmp_path / "rows")).select("g", counted.asNondeterministic()("v").alias("v"))
    assert aggregates.box_statistics(df, ["g"], "v").count() > 10
    assert read.value <= 2 * 30_000


# ---- joins, sets ---------------------------------------------------------


def test_semi_and_anti_cover_all_rows(spark):
    fact = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    dim = spark.createDataFrame([("a",), ("c",)], "k string")
    assert lookup.keep_known(fact, dim, "k").count() == 2
    assert lookup.orphan_count(fact, dim, "k").first()[0] == 2
    assert lookup.orphan_count(fact.where("k = 'a'"), dim, "k").first()[0] == 0


def test_attach_keeps_unmatched_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    names = spark.createDataFrame([("a", 10)], "label string, id int")
    assert sorted(rows(lookup.attach(df, names, "name", "label"))) == [("a", 1, 10), ("b", 2, None)]


def test_union_by_name_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "p int, q string")
    b = spark.createDataFrame([("y",)], "q string")
    assert sorted(rows(lookup.union_by_name(a, b)), key=str) == [(1, "x"), (None, "y")]


def test_common_values_reduces_both_sides_before_they_meet(spark):
    a = spark.range(1000).selectExpr("IF(id < 900, 1, id % 5) AS y").union(spark.sql("SELECT NULL"))
    b = spark.range(1000).selectExpr("IF(id < 900, 1, id % 3) AS y").union(spark.sql("SELECT NULL"))
    common = lookup.common_values(a, b, "y")
    assert sorted(rows(common), key=str) == [(0,), (1,), (2,), (None,)]
    plan = common._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join LeftSemi") :]
    assert below.count("Aggregate [") == 2, plan


def test_common_values_match_rate_and_preview(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "y int")
    b = spark.createDataFrame([(2,), (3,)], "y int")
    assert rows(lookup.common_values(a, b, "y")) == [(2,)]
    t = spark.createDataFrame([("x",), (None,)], "town string")
    assert rows(lookup.match_rate(t, "town")) == [(1, 2)]
    assert rows(lookup.preview(a, ["y"], 1)) == [(1,)]
    assert rows(lookup.sorted_values(a, "y")) == [(1,), (2,)]


# ---- reshape -------------------------------------------------------------


def test_wide_and_long_are_inverse(spark):
    df = spark.createDataFrame([("a", "May", 1.0), ("a", "Jun", 2.0), ("b", "May", 3.0)], "k string, m string, v double")
    wide = reshape.to_wide(df, ["k"], "m", "v", ["May", "Jun"])
    assert sorted(rows(wide)) == [("a", 1.0, 2.0), ("b", 3.0, None)]
    back = reshape.to_long(wide, ["k"], {"May": "May", "Jun": "Jun"}, "m", "v").where("v IS NOT NULL")
    assert sorted(rows(back)) == sorted(rows(df))


def test_complete_adds_the_gaps(spark):
    df = spark.createDataFrame([("a", "y1", 1.0), ("a", "y2", 2.0), ("b", "y2", 3.0)], "t string, y string, v double")
    assert sorted(rows(reshape.complete(df, "t", "y")), key=str) == [("a", "y1", 1.0), ("a", "y2", 2.0), ("b", "y1", None), ("b", "y2", 3.0)]


def test_complete_keeps_repeated_and_null_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0)] * 500 + [("a", None, 2.0), (None, 1, 3.0), ("b", 2, None)], "t string, y int, v double")
    got = rows(reshape.complete(df, "t", "y"))
    assert sorted(map(repr, got)) == sorted(map(repr, rows(df) + [("a", 2, None), (None, 2, None), (None, None, None), ("b", 1, None), ("b", None, None)]))
    wide = spark.range(300).selectExpr("id", "id % 7 AS y", "id AS v")
    assert reshape.complete(wide, "id", "y").count() == 300 * 7
    assert reshape.complete(df.limit(0), "t", "y").count() == 0


def test_reshape_gathers_no_group_in_an_array():
    import inspect

    text = inspect.getsource(reshape)
    assert "collect_list" not in text and "collect_set" not in text and ".collect(" not in text


def test_cross_tab_has_zero_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "r string, c string")
    assert sorted(rows(reshape.cross_tab(df, "r", "c", ["x", "y", "z"]))) == [("a", 2, 0, 0), ("b", 0, 1, 0)]


def test_bounds_rows(spark):
    df = spark.createDataFrame([("N", 10.0, 20.0), ("S", 5.0, None)], "k string, a double, b double")
    assert sorted(rows(reshape.with_bounds_rows(df, "k", ["a", "b"])))[:4] == [
        ("N", 10.0, 20.0), ("S", 5.0, None), ("axis_max", 22.0, 22.0), ("axis_min", 0.0, 0.0),
    ]
    twice = df.union(df).union(df.limit(0))
    assert sorted(map(repr, rows(reshape.with_bounds_rows(twice, "k", ["a", "b"])))) == sorted(
        map(repr, 2 * rows(df) + [("axis_max", 22.0, 22.0), ("axis_min", 0.0, 0.0)])
    )
    assert reshape.with_bounds_rows(df.limit(0), "k", ["a", "b"]).count() == 0


# ---- profile -------------------------------------------------------------


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, "y")], "a int, b string")
    assert sorted(rows(profile.missing_counts(df))) == [("a", 1), ("b", 1)]
    assert rows(profile.shape(df)) == [(3, 2)]
    assert rows(profile.table_counts({"t": df, "u": df.limit(1)})) == [("t", 3), ("u", 1)]
    summary = rows(profile.column_summary(df, "a"))
    assert summary == [("a", 1.0, 1.25, 1.5, 1.5, 1.75, 2.0, 1)]


def test_counters_come_with_the_job(spark):
    df, watch = profile.counted(spark.range(10), "kept", even=F.col("id") % 2 == 0)
    df.write.format("noop").mode("overwrite").save()
    assert watch.get == {"rows": 10, "even": 5}


def test_required_values_stop_the_job(spark):
    df = spark.createDataFrame([("x",), (None,)], "c string")
    with pytest.raises(Exception, match="no year"):
        profile.require_values(df, "c", "no year").collect()


# ---- regression ----------------------------------------------------------

GOLDEN = [(1.0, 2.0), (2.0, 4.5), (3.0, 5.0), (4.0, 9.0), (5.0, 9.5)]


def test_fit_golden(spark):
    df = spark.createDataFrame([*GOLDEN, (None, 1.0), (9.0, None)], "x double, y double")
    fit = regression.fit_line(df, "x", "y").first()
    assert fit.n == 5
    assert fit.slope == pytest.approx(1.95)
    assert fit.intercept == pytest.approx(0.15)
    assert fit.r_squared == pytest.approx(0.9388888889)
    assert fit.se_slope == pytest.approx(0.2872281323)
    assert fit.t_slope == pytest.approx(6.7890285823)
    assert fit.p_slope == pytest.approx(0.0065331945, rel=1e-7)
    assert fit.f_statistic == pytest.approx(fit.t_slope**2)
    assert (fit.min_x, fit.max_x, fit.df) == (1.0, 5.0, 3)


def test_fit_matches_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    source = random.Random(3)
    data = [(float(i), 2.0 * i + source.gauss(0, 40)) for i in range(40)]
    df = spark.createDataFrame(data, "x double, y double")
    fit = regression.fit_line(df, "x", "y").first()
    model = LinearRegression(solver="normal", labelCol="y", featuresCol="f").fit(
        VectorAssembler(inputCols=["x"], outputCol="f").transform(df)
    )
    assert fit.p_slope == pytest.approx(model.summary.pValues[0], rel=1e-6, abs=1e-15)
    assert fit.p_intercept == pytest.approx(model.summary.pValues[1], rel=1e-6)
    assert fit.se_intercept == pytest.approx(model.summary.coefficientStandardErrors[1])
    assert fit.adj_r_squared == pytest.approx(model.summary.r2adj)


def test_exact_line_and_constant_x(spark):
    df = spark.createDataFrame([("line", float(i), 3.0 + 2 * i) for i in range(6)] + [("flat", 1.0, float(i)) for i in range(4)], "k string, x double, y double")
    fits = {r.k: r for r in regression.fit_line(df, "x", "y", ["k"]).collect()}
    line, flat = fits["line"], fits["flat"]
    assert (line.slope, line.intercept, line.r_squared) == pytest.approx((2, 3, 1))
    assert line.p_slope == pytest.approx(0.0, abs=1e-12)
    assert (flat.slope, flat.se_slope, flat.p_slope) == (None, None, None)


def test_residuals_and_band(spark):
    df = spark.createDataFrame(GOLDEN, "x double, y double")
    fit = regression.fit_line(df, "x", "y")
    want = pytest.approx((-1.0, -0.4, -0.1, 0.45, 1.05))
    assert rows(regression.residual_quantiles(df, fit, "x", "y"))[0] == want
    assert rows(regression.residual_quantiles(df, fit, "x", "y", small_groups=True))[0] == want
    band = sorted(rows(regression.confidence_band(fit)))
    assert len(band) == 80 and band[0][1] == 1.0 and band[-1][1] == pytest.approx(5.0)
    centre = regression.confidence_band(fit, points=3).where("step = 1").first()
    assert centre.upper - centre.fitted == pytest.approx(3.1824463 * 0.9082951 / 5**0.5, rel=1e-6)


@pytest.mark.parametrize(
    ("nu", "t"), [(1, 12.706204736), (2, 4.30265273), (9, 2.262157163), (10, 2.228138852), (30, 2.042272456)]
)
def test_t_tail_and_critical_value(spark, nu, t):
    df = spark.createDataFrame([(t, nu)], "t double, nu int")
    p, crit = df.selectExpr(two_sided_p("t", "nu"), critical_t("nu")).first()
    assert p == pytest.approx(0.05, abs=1e-9)
    assert crit == pytest.approx(t, rel=1e-9)


def test_t_tail_and_critical_value_at_the_ends(spark):
    assert spark.range(1).selectExpr(critical_t("1", 0.9999)).first()[0] == pytest.approx(6366.19767131205, rel=1e-9)
    assert spark.range(1).selectExpr(critical_t("1000000", 0.95)).first()[0] == pytest.approx(1.95996636, rel=1e-7)
    # one and two degrees of freedom have closed forms, a million is a normal tail up to 1e-6
    for t in (0.3, 1.0, 1.5, 3.0, 200.0):
        tails = spark.createDataFrame([(t, nu) for nu in (1, 2, 10**6)], "t double, nu int").selectExpr(two_sided_p("t", "nu")).collect()
        assert tails[0][0] == pytest.approx(2 / math.pi * math.atan(1 / t), rel=1e-11)
        assert tails[1][0] == pytest.approx(2 / (2 + t * t + t * math.sqrt(2 + t * t)), rel=1e-11)
        assert tails[2][0] == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-4)


def test_t_tail_has_no_steps(spark):
    df = spark.createDataFrame([(2.5, nu) for nu in (9999, 10000, 10001, 10002)], "t double, nu int")
    ps = [r[0] for r in df.selectExpr(two_sided_p("t", "nu")).collect()]
    assert all(1.5e-9 < a - b < 1.6e-9 for a, b in zip(ps, ps[1:], strict=False))
    # the fraction takes over from the series at x = (a + 1) / (a + 5/2)
    for nu in (1, 20, 5000):
        a = nu / 2
        t = math.sqrt(nu * ((a + 2.5) / (a + 1) - 1))
        around = spark.createDataFrame([(t * (1 - 1e-12), nu), (t * (1 + 1e-12), nu)], "t double, nu int")
        low, high = [r[0] for r in around.selectExpr(two_sided_p("t", "nu")).collect()]
        assert low == pytest.approx(high, rel=1e-10)
