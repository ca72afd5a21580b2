"""Dense time series: counts, rolling means, regression, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.functions import fixed_values as V
from loreline.functions.dates import days_before, month_grid, month_key, week_grid, week_key
from loreline.functions.stats import round_metric, safe_ratio, slope_p_value


def densify(counts: DataFrame, grid: Column, key: str, by: str, make_key) -> DataFrame:
    """Every series gets every entry of the calendar grid; missing counts are 0.

    `grid` is one array of times (a scalar subquery), the same for all series. The
    counts of a series fold into a map as long as the calendar, so the dense rows
    come from one shuffle by series, without a join of grid and series; `x` is the
    place in the grid. `make_key` turns a grid entry into its count key.
    """
    known = counts.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct(key, "count"))).alias("_known")
    )
    dense = known.select(by, "_known", F.posexplode(grid).alias("x", "date"))
    dense = dense.withColumn(key, make_key(F.col("date")))
    count = F.coalesce(F.try_element_at("_known", key), F.lit(0))
    return dense.select(key, "date", by, "x", count.alias("count"))


def month_cells(items: DataFrame, topic: str = "topic", ts: str = "ts") -> DataFrame:
    """Items per month and topic with their first and last time; items without a time are in no month."""
    keyed = items.filter(F.col(ts).isNotNull()).select(
        F.col(topic).cast("int").alias("topic"), month_key(F.col(ts)).alias("year_month"), F.col(ts).alias("_ts")
    )
    return keyed.groupBy("year_month", "topic").agg(
        F.count(F.lit(1)).alias("count"), F.min("_ts").alias("lo"), F.max("_ts").alias("hi")
    )


def calendar(items: DataFrame, topic: str = "topic", ts: str = "ts", complete: bool = False) -> Column:
    """Month grid and last time of all items as one scalar.

    It comes out of the month cells, so that Spark reuses their shuffle where the
    counts are needed too, and items are read once.
    """
    cells = month_cells(items, topic, ts)
    return cells.agg(
        F.struct(month_grid(F.min("lo"), F.max("hi"), complete).alias("grid"), F.max("hi").alias("last"))
    ).scalar()


def month_topic_counts(items: DataFrame, topic: str = "topic", ts: str = "ts") -> DataFrame:
    """Items per month and topic, and per month in total as topic -1."""
    cells = month_cells(items, topic, ts)
    total = cells.groupBy("year_month").agg(F.lit(V.NOISE_TOPIC).alias("topic"), F.sum("count").alias("count"))
    own = cells.filter(F.col("topic") != V.NOISE_TOPIC).select("year_month", "topic", "count")
    return total.unionByName(own)


def monthly_counts(
    items: DataFrame, topic: str = "topic", ts: str = "ts", complete: bool = False
) -> DataFrame:
    """Items per month, in total and per topic, over the whole month grid.

    The grid runs from the first to the last item; a partial first month is not in
    it (unless `complete`). `x` is the place in the series. Everything after the
    first aggregate is months x topics. Items without a time are left out.
    """
    counts = month_topic_counts(items, topic, ts)
    grid = calendar(items, topic, ts, complete)["grid"]
    return densify(counts, grid, "year_month", "topic", month_key)


def rolling_mean(
    series: DataFrame, n: int = V.SMOOTHING_MONTHS, by=("topic",), order: str = "date"
) -> DataFrame:
    """Mean of the last `n` rows of a series, fewer at its start."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(1 - n, 0)
    return series.withColumn("smoothed", F.avg("count").over(w))


def topic_trends(items: DataFrame, topic: str = "topic", ts: str = "ts") -> DataFrame:
    """D6 with E2: dense monthly counts and their rolling mean."""
    return rolling_mean(monthly_counts(items, topic, ts))


def weekly_counts(items: DataFrame, ts: str = "ts") -> DataFrame:
    """Items per Monday-based week of the year over the grid of Mondays.

    Days before the first Monday of a year belong to week 00, which has no Monday
    and so no row. Items without a time are in no week.
    """
    counts = items.filter(F.col(ts).isNotNull()).groupBy(week_key(F.col(ts)).alias("year_week")).agg(
        F.count(F.lit(1)).alias("count"), F.min(ts).alias("lo"), F.max(ts).alias("hi")
    )
    # One map as long as the calendar; the span comes out of the same pass.
    folded = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("year_week", "count"))).alias("_known"),
        week_grid(F.min("lo"), F.max("hi")).alias("_grid"),
    )
    dense = folded.select("_known", F.explode("_grid").alias("date"))
    dense = dense.withColumn("year_week", week_key(F.col("date")))
    count = F.coalesce(F.try_element_at("_known", "year_week"), F.lit(0))
    return dense.select("year_week", "date", count.alias("count"))


def rolling_mean_weekly(series: DataFrame, n: int = V.SMOOTHING_WEEKS) -> DataFrame:
    """Rolling mean of one series; its rows are weeks, so one task holds it."""
    w = W.orderBy("date").rowsBetween(1 - n, 0)
    return series.withColumn("smoothed", F.avg("count").over(w))


def _histogram(items: DataFrame, value: Column, size: int, name: str) -> DataFrame:
    slots = items.sparkSession.range(size).select(F.col("id").cast("int").alias(name))
    counts = items.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("count"))
    return slots.join(counts, name, "left").select(name, F.coalesce("count", F.lit(0)).alias("count"))


def weekday_histogram(items: DataFrame, ts: str = "ts") -> DataFrame:
    """Items per week day, Monday 0 to Sunday 6, all seven rows."""
    return _histogram(items, F.weekday(ts), 7, "weekday")


def hour_histogram(items: DataFrame, ts: str = "ts") -> DataFrame:
    """Items per UTC hour, all 24 rows."""
    return _histogram(items, F.hour(ts), 24, "hour")


def regression(series: DataFrame, last_item: Column, days: int = V.RECENT_DAYS) -> DataFrame:
    """Per topic the slope of the smoothed series, over all and recent months.

    One aggregate with filtered least-squares sums. The slope does not depend on
    where x starts, so recent months keep their place in the whole series.
    """
    x = F.col("x").cast("double")
    since = days_before(last_item, days)
    series = series.withColumn("recent", F.when(F.col("date") >= since, F.col("smoothed")))

    def sums(name: str, value: Column):
        return [
            F.regr_slope(value, x).alias(f"slope{name}"),
            F.regr_sxx(value, x).alias(f"sxx{name}"),
            F.regr_sxy(value, x).alias(f"sxy{name}"),
            F.regr_syy(value, x).alias(f"syy{name}"),
            F.count(value).alias(f"n{name}"),
            F.avg(value).alias(f"mean{name}"),
        ]

    stats = series.groupBy("topic").agg(
        F.sum("count").alias("total_papers"), *sums("", F.col("smoothed")), *sums("3", F.col("recent"))
    )
    enough = F.col("n3") >= 3
    growth = safe_ratio(F.col("slope"), F.col("mean"))
    p = slope_p_value(F.col("n"), F.col("sxx"), F.col("sxy"), F.col("syy"))
    p3 = slope_p_value(F.col("n3"), F.col("sxx3"), F.col("sxy3"), F.col("syy3"))
    recent_mean = F.when(enough, F.col("mean3")).otherwise(F.col("mean"))
    return stats.select(
        "topic",
        "total_papers",
        F.col("n").alias("points"),
        F.col("mean").alias("mean_count"),
        F.col("slope"),
        growth.alias("growth_rate"),
        F.when(enough, safe_ratio(F.col("slope3"), F.col("mean3"), 0.0))
        .otherwise(growth)
        .alias("growth_rate_3mo"),
        safe_ratio(recent_mean, F.col("mean"), 1.0).alias("surge_ratio"),
        p.alias("p_value"),
        F.when(enough, p3).otherwise(p).alias("p_value_3mo"),
    )


def exclude_noise(df: DataFrame, topic: str = "topic", noise: int = V.NOISE_TOPIC) -> DataFrame:
    """Rows of the reserved topic dropped."""
    return df.filter(F.col(topic) != noise)


def min_signal(
    stats: DataFrame, points: int = V.MIN_POINTS, mean: float = V.MIN_MEAN
) -> DataFrame:
    """Series with too few points or too small a mean dropped."""
    return stats.filter((F.col("points") >= points) & (F.col("mean_count") >= mean))


def significant_or_all(
    growth: DataFrame,
    p_value: str = "p_value",
    p: float = V.SIGNIFICANT_P,
    keep: int = V.MIN_SIGNIFICANT,
) -> DataFrame:
    """Rows with p below the bound if at least `keep` have it, else all rows.

    The growth table has one short row per topic, so counting over all of it in one
    window is cheaper than computing it twice.
    """
    marked = growth.withColumn("_good", F.coalesce(F.col(p_value) < p, F.lit(False)))
    marked = marked.withColumn("_n", F.count_if("_good").over(W.partitionBy()))
    return marked.filter(F.col("_good") | (F.col("_n") < keep)).drop("_good", "_n")


def growth_table(trends: DataFrame, last_item: Column) -> DataFrame:
    """Rounded growth figures of every topic with enough signal.

    `total_papers` sums the grid, so items of a lost first month are not in it.
    """
    stats = min_signal(regression(exclude_noise(trends), last_item))
    return stats.select(
        "topic",
        "total_papers",
        round_metric(F.col("growth_rate"), 4).alias("growth_rate"),
        round_metric(F.col("growth_rate_3mo"), 4).alias("growth_rate_3mo"),
        round_metric(F.col("surge_ratio"), 4).alias("surge_ratio"),
        round_metric(F.col("p_value"), 6).alias("p_value"),
        round_metric(F.col("p_value_3mo"), 6).alias("p_value_3mo"),
    )


def flag_hot_cold(growth: DataFrame) -> DataFrame:
    """Hot and cold by the rounded recent growth, both bounds exclusive."""
    g = F.col("growth_rate_3mo")
    return growth.withColumn("hot", g > V.HOT_ABOVE).withColumn("cold", g < V.COLD_BELOW)


def topic_growth(items: DataFrame, topic: str = "topic", ts: str = "ts") -> DataFrame:
    """D13, B11 and I12 from items: the growth report; empty when no topic survives."""
    trends = topic_trends(items, topic, ts)
    last_item = calendar(items, topic, ts)["last"]
    return flag_hot_cold(significant_or_all(growth_table(trends, last_item)))


def top_topics_by_total(trends: DataFrame, growth: DataFrame, n: int = 10) -> DataFrame:
    """the series of the `n` largest topics of the growth report."""
    top = growth.orderBy(F.desc("total_papers"), "topic").limit(n).select("topic")
    return trends.join(top, "topic", "left_semi")


def top_growth(growth: DataFrame, n: int | None = 15) -> DataFrame:
    """topics by growth rate, highest first, with their status."""
    status = F.when(F.col("hot"), "hot").when(F.col("cold"), "cold").otherwise("stable")
    ranked = growth.withColumn("status", status).orderBy(F.desc("growth_rate"), "topic")
    return ranked if n is None else ranked.limit(n)
