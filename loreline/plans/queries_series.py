"""Queries on time series, growth and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreline.functions import dates
from loreline.functions.text import percent_text
from loreline.operators import marts, series
from loreline.plans.registry import clock, query, six

CLOCK = "'%Y-%m-%d %H:%M:%S'"


def trend_sql(view: str) -> str:
    return f"""
, span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM {view}),
grid AS (SELECT unnest(generate_series(
    CASE WHEN day(lo) = 1 THEN lo ELSE date_trunc('month', lo) + INTERVAL 1 MONTH + (lo - date_trunc('day', lo)) END,
    hi, INTERVAL 1 MONTH)) AS date FROM span),
cnt AS (SELECT strftime(ts, '%Y-%m') AS ym, topic, count(*) AS c FROM {view} WHERE topic <> -1 GROUP BY ALL
        UNION ALL SELECT strftime(ts, '%Y-%m'), -1, count(*) FROM {view} GROUP BY ALL),
kinds AS (SELECT DISTINCT topic FROM cnt),
dense AS (SELECT strftime(g.date, '%Y-%m') AS year_month, g.date, k.topic, coalesce(c.c, 0) AS count
          FROM grid g CROSS JOIN kinds k
          LEFT JOIN cnt c ON c.ym = strftime(g.date, '%Y-%m') AND c.topic = k.topic),
trend AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY date) - 1 AS x,
          avg(count) OVER (PARTITION BY topic ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smoothed
          FROM dense)"""


def p_sql(n: str, xx: str, xy: str, yy: str) -> str:
    """Two-sided p with gamma functions in place of the running product."""
    r2 = f"({xy} * {xy} / nullif({xx} * {yy}, 0))"
    nu = f"({n} - 2)"
    even = (
        f"sqrt({r2}) * list_sum([exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4)) * pow(1 - {r2}, j)"
        f" FOR j IN range(0, {nu} // 2)])"
    )
    odd = (
        f"2 / pi() * (asin(sqrt({r2})) + coalesce(sqrt({r2}) * list_sum([exp(j * ln(4) + 2 * lgamma(j + 1)"
        f" - lgamma(2 * j + 2)) * pow(1 - {r2}, j + 0.5) FOR j IN range(0, ({nu} - 1) // 2)]), 0))"
    )
    return (
        f"CASE WHEN {r2} IS NULL THEN NULL WHEN {r2} >= 1 THEN 0.0"
        f" WHEN {nu} % 2 = 1 THEN greatest(1 - {odd}, 0) ELSE greatest(1 - {even}, 0) END"
    )


def growth_sql(view: str) -> str:
    """Regression figures, raw (`reg`), rounded (`growth`) and reported (`report`)."""
    recent = "FILTER (WHERE date >= hi - INTERVAL 90 DAY)"
    return (
        trend_sql(view)
        + f"""
, sums AS (SELECT topic, sum(count) AS total, count(*) AS n, avg(smoothed) AS mean,
    regr_slope(smoothed, x) AS slope, regr_sxx(smoothed, x) AS xx, regr_sxy(smoothed, x) AS xy, regr_syy(smoothed, x) AS yy,
    count(*) {recent} AS n3, avg(smoothed) {recent} AS mean3, regr_slope(smoothed, x) {recent} AS slope3,
    regr_sxx(smoothed, x) {recent} AS xx3, regr_sxy(smoothed, x) {recent} AS xy3, regr_syy(smoothed, x) {recent} AS yy3
  FROM trend, span WHERE topic <> -1 GROUP BY topic),
reg AS (SELECT topic, total AS total_papers, n AS points, mean AS mean_count, slope,
    slope / nullif(mean, 0) AS growth_rate,
    CASE WHEN n3 >= 3 THEN coalesce(slope3 / nullif(mean3, 0), 0) ELSE slope / nullif(mean, 0) END AS growth_rate_3mo,
    coalesce(CASE WHEN n3 >= 3 THEN mean3 ELSE mean END / nullif(mean, 0), 1) AS surge_ratio,
    {p_sql('n', 'xx', 'xy', 'yy')} AS p_value,
    CASE WHEN n3 >= 3 THEN {p_sql('n3', 'xx3', 'xy3', 'yy3')} ELSE {p_sql('n', 'xx', 'xy', 'yy')} END AS p_value_3mo
  FROM sums),
growth AS (SELECT topic, total_papers, round(growth_rate, 4) + 0 AS growth_rate, round(growth_rate_3mo, 4) + 0 AS growth_rate_3mo,
    round(surge_ratio, 4) + 0 AS surge_ratio, round(p_value, 6) + 0 AS p_value, round(p_value_3mo, 6) + 0 AS p_value_3mo
  FROM reg WHERE points >= 4 AND mean_count >= 0.1),
report AS (SELECT *, growth_rate_3mo > 0.1 AS hot, growth_rate_3mo < -0.1 AS cold FROM growth
  WHERE coalesce(p_value < 0.1, false) OR (SELECT count(*) FROM growth WHERE p_value < 0.1) < 3)
"""
    )


TREND = trend_sql("v_trend_orders")
GROWTH = growth_sql("v_trend_orders")


def _growth(i):
    items = i.view("v_trend_orders")
    return series.growth_table(series.topic_trends(items), series.calendar(items)["last"])


@query("monthly_counts", "v_trend_orders", sql=TREND + f"""
SELECT year_month, strftime(date, {CLOCK}) AS date, topic, x, count FROM trend""")
def monthly_counts(i):
    s = series.monthly_counts(i.view("v_trend_orders"))
    return s.select("year_month", clock("date").alias("date"), "topic", "x", "count")


@query("monthly_counts_of_documents", "v_topics", sql=trend_sql("v_topics") + f"""
SELECT year_month, strftime(date, {CLOCK}) AS date, topic, count, round(smoothed, 6) AS smoothed FROM trend""")
def monthly_counts_of_documents(i):
    s = series.topic_trends(i.view("v_topics"))
    return s.select("year_month", clock("date").alias("date"), "topic", "count", six("smoothed").alias("smoothed"))


@query("densify", "v_trend_orders", sql=TREND + """
SELECT topic, count(*) AS months, count(*) FILTER (WHERE count = 0) AS empty_months, sum(count) AS items
FROM trend GROUP BY topic""")
def densify(i):
    s = series.monthly_counts(i.view("v_trend_orders"))
    return s.groupBy("topic").agg(
        F.count(F.lit(1)).alias("months"), F.count_if(F.col("count") == 0).alias("empty_months"), F.sum("count").alias("items")
    )


@query("rolling_mean", "v_trend_orders", sql=TREND + """
SELECT year_month, topic, count, round(smoothed, 6) AS smoothed FROM trend""")
def rolling_mean(i):
    s = series.rolling_mean(series.monthly_counts(i.view("v_trend_orders")))
    return s.select("year_month", "topic", "count", six("smoothed").alias("smoothed"))


WEEKS = f"""
, span AS (SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem),
grid AS (SELECT unnest(generate_series(lo + INTERVAL 1 DAY * ((8 - isodow(lo)) % 7), hi, INTERVAL 7 DAY)) AS date FROM span),
cnt AS (SELECT strftime(l_shipdate, '%Y-%W') AS k, count(*) AS c FROM lineitem GROUP BY ALL),
weeks AS (SELECT strftime(date, '%Y-%W') AS year_week, date, coalesce(c, 0) AS count
  FROM grid LEFT JOIN cnt ON k = strftime(date, '%Y-%W'))
"""


@query("weekly_counts", sql=WEEKS + f"SELECT year_week, strftime(date, {CLOCK}) AS date, count FROM weeks")
def weekly_counts(i):
    s = series.weekly_counts(i.table("lineitem"), "l_shipdate")
    return s.select("year_week", clock("date").alias("date"), "count")


@query("rolling_mean_weekly", sql=WEEKS + """
SELECT year_week, count, round(avg(count) OVER (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS smoothed
FROM weeks""")
def rolling_mean_weekly(i):
    s = series.rolling_mean_weekly(series.weekly_counts(i.table("lineitem"), "l_shipdate"))
    return s.select("year_week", "count", six("smoothed").alias("smoothed"))


@query("month_grid", sql=f"""
, span AS (SELECT l_suppkey, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, strftime(unnest(generate_series(
    CASE WHEN day(lo) = 1 THEN lo ELSE date_trunc('month', lo) + INTERVAL 1 MONTH END, hi, INTERVAL 1 MONTH)), {CLOCK}) AS month
FROM span""")
def month_grid(i):
    span = i.table("lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    grid = dates.month_grid(F.col("lo"), F.col("hi"))
    return span.select("l_suppkey", F.explode(grid).alias("m")).select("l_suppkey", clock("m").alias("month"))


@query("month_grid_complete", sql=f"""
, span AS (SELECT l_suppkey, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, strftime(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)), {CLOCK}) AS month
FROM span""")
def month_grid_complete(i):
    span = i.table("lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    grid = dates.month_grid(F.col("lo"), F.col("hi"), complete=True)
    return span.select("l_suppkey", F.explode(grid).alias("m")).select("l_suppkey", clock("m").alias("month"))


@query("week_grid", sql=f"""
, span AS (SELECT l_suppkey, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, strftime(unnest(generate_series(lo + INTERVAL 1 DAY * ((8 - isodow(lo)) % 7), hi, INTERVAL 7 DAY)), {CLOCK}) AS week
FROM span""")
def week_grid(i):
    span = i.table("lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    grid = dates.week_grid(F.col("lo"), F.col("hi"))
    return span.select("l_suppkey", F.explode(grid).alias("w")).select("l_suppkey", clock("w").alias("week"))


@query("weekday_histogram", sql="""
SELECT r.i AS weekday, count(e.ts) AS count FROM range(7) r(i) LEFT JOIN events e ON isodow(e.ts) - 1 = r.i GROUP BY r.i""")
def weekday_histogram(i):
    return series.weekday_histogram(i.table("events"))


@query("hour_histogram", sql="""
SELECT r.i AS hour, count(e.ts) AS count FROM range(24) r(i) LEFT JOIN events e ON hour(e.ts) = r.i GROUP BY r.i""")
def hour_histogram(i):
    return series.hour_histogram(i.table("events"))


def _regression(i):
    items = i.view("v_trend_orders")
    return series.regression(series.exclude_noise(series.topic_trends(items)), series.calendar(items)["last"])


@query("trend_regression", "v_trend_orders", sql=GROWTH + """
SELECT topic, points, round(slope, 6) + 0 AS slope, round(p_value, 6) + 0 AS p_value, round(growth_rate, 6) + 0 AS growth_rate FROM reg""")
def trend_regression(i):
    return _regression(i).select("topic", "points", six("slope").alias("slope"), six("p_value").alias("p_value"), six("growth_rate").alias("growth_rate"))


@query("recent_regression", "v_trend_orders", sql=GROWTH + """
SELECT topic, round(growth_rate_3mo, 6) + 0 AS growth_rate_3mo, round(p_value_3mo, 6) + 0 AS p_value_3mo FROM reg""")
def recent_regression(i):
    return _regression(i).select("topic", six("growth_rate_3mo").alias("growth_rate_3mo"), six("p_value_3mo").alias("p_value_3mo"))


@query("surge_ratio", "v_trend_orders", sql=GROWTH + """
SELECT topic, round(mean_count, 6) AS mean_count, round(surge_ratio, 6) AS surge_ratio FROM reg""")
def surge_ratio(i):
    return _regression(i).select("topic", six("mean_count").alias("mean_count"), six("surge_ratio").alias("surge_ratio"))


@query("series_index", "v_trend_orders", sql=TREND + """
SELECT topic, year_month, x FROM trend WHERE topic <> -1""")
def series_index(i):
    return series.exclude_noise(series.monthly_counts(i.view("v_trend_orders"))).select("topic", "year_month", "x")


@query("min_signal", "v_topics", sql=growth_sql("v_topics") + """
SELECT topic, points, round(mean_count, 6) AS mean_count FROM reg WHERE points >= 4 AND mean_count >= 0.1""")
def min_signal(i):
    items = i.view("v_topics")
    stats = series.regression(series.exclude_noise(series.topic_trends(items)), series.calendar(items)["last"])
    return series.min_signal(stats).select("topic", "points", six("mean_count").alias("mean_count"))


@query("growth_table", "v_trend_orders", sql=GROWTH + "SELECT * FROM growth")
def growth_table(i):
    return _growth(i)


@query("significant_or_all", "v_trend_orders", sql=GROWTH + """
SELECT topic, p_value FROM growth
WHERE coalesce(p_value < 0.1, false) OR (SELECT count(*) FROM growth WHERE p_value < 0.1) < 3""")
def significant_or_all(i):
    return series.significant_or_all(_growth(i)).select("topic", "p_value")


@query("topic_growth", "v_trend_orders", sql=GROWTH + "SELECT * FROM report")
def topic_growth(i):
    return series.topic_growth(i.view("v_trend_orders"))


@query("topic_growth_of_documents", "v_topics", sql=growth_sql("v_topics") + "SELECT * FROM report")
def topic_growth_of_documents(i):
    return series.topic_growth(i.view("v_topics"))


@query("top_topics_by_total", "v_trend_orders", sql=GROWTH + """
SELECT year_month, topic, count FROM trend
WHERE topic IN (SELECT topic FROM report ORDER BY total_papers DESC, topic LIMIT 10)""")
def top_topics_by_total(i):
    items = i.view("v_trend_orders")
    return series.top_topics_by_total(series.topic_trends(items), series.topic_growth(items)).select("year_month", "topic", "count")


@query("top_growth", "v_trend_orders", sql=GROWTH + """
SELECT topic, growth_rate, CASE WHEN hot THEN 'hot' WHEN cold THEN 'cold' ELSE 'stable' END AS status
FROM report ORDER BY growth_rate DESC, topic LIMIT 15""")
def top_growth(i):
    return series.top_growth(series.topic_growth(i.view("v_trend_orders"))).select("topic", "growth_rate", "status")


def percent_sql(c: str) -> str:
    return f"coalesce(printf('%.2f%%', {c} * 100), '')"


@query("percent_text", "v_trend_orders", sql=GROWTH + f"SELECT topic, {percent_sql('growth_rate')} AS growth FROM growth")
def percent(i):
    return _growth(i).select("topic", percent_text(F.col("growth_rate")).alias("growth"))


@query("attach_growth", "v_topics", sql=growth_sql("v_topics") + f"""
SELECT t.topic, t.papers, {percent_sql('r.growth_rate')} AS growth, {percent_sql('r.growth_rate_3mo')} AS growth_3mo,
  coalesce(r.hot, false) AS hot, coalesce(r.cold, false) AS cold
FROM (SELECT topic, count(*) AS papers FROM v_topics GROUP BY topic) t LEFT JOIN report r USING (topic)""")
def attach_growth(i):
    items = i.view("v_topics")
    return marts.attach_growth(marts.topic_counts(items), series.topic_growth(items))


@query("topic_report", "v_topics", sql=growth_sql("v_topics") + f"""
SELECT t.topic, t.label, t.papers, {percent_sql('r.growth_rate')} AS growth, {percent_sql('r.growth_rate_3mo')} AS growth_3mo,
  coalesce(r.hot, false) AS hot, coalesce(r.cold, false) AS cold
FROM (SELECT topic, arg_min(topic_label, item_id) AS label, count(*) AS papers FROM v_topics WHERE topic <> -1 GROUP BY topic) t
LEFT JOIN report r USING (topic)""")
def topic_report(i):
    items = i.view("v_topics")
    return marts.topic_report(items, series.topic_growth(items), marts.topic_label_first(items, "item_id"))


@query("corpus_stats", "v_topics", sql=growth_sql("v_topics") + """
SELECT count(*) AS total_papers, count(DISTINCT topic) FILTER (WHERE topic <> -1) AS topics,
  (SELECT count(*) FROM report WHERE hot) AS topics_hot,
  CASE WHEN min(year(ts)) = max(year(ts)) THEN cast(min(year(ts)) AS varchar)
       ELSE concat(min(year(ts)), '&ndash;', max(year(ts))) END AS years_span
FROM v_topics""")
def corpus_stats(i):
    items = i.view("v_topics")
    return marts.corpus_stats(items.withColumn("date", clock("ts")), series.topic_growth(items))


@query("calendar_keys", sql="""
SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%W') AS week, isodow(ts) - 1 AS weekday,
  hour(ts) AS hour, strftime(ts, '%Y') AS year FROM events""")
def calendar_keys(i):
    ts = F.col("ts")
    return i.table("events").select(
        "event_id", dates.month_key(ts).alias("month"), dates.week_key(ts).alias("week"), F.weekday(ts).alias("weekday"),
        F.hour(ts).alias("hour"), dates.year_of(clock(ts)).alias("year"),
    )


@query("week_key", sql="SELECT o_orderkey, strftime(o_orderdate, '%Y-%W') AS week FROM orders")
def week_key(i):
    return i.table("orders").select("o_orderkey", dates.week_key(F.col("o_orderdate")).alias("week"))


@query("days_before", sql=f"""
SELECT o_orderkey, strftime(o_orderdate - INTERVAL 90 DAY, {CLOCK}) AS since FROM orders""")
def days_before(i):
    return i.table("orders").select("o_orderkey", clock(dates.days_before(F.col("o_orderdate"), 90)).alias("since"))


@query("to_utc", sql="""
SELECT event_id, epoch_us(ts) AS micros FROM events""")
def to_utc(i):
    return i.table("events").select("event_id", F.unix_micros(dates.to_utc(F.col("ts"))).alias("micros"))


@query("commit_date", sql=f"""
SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 1 HOUR * CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'click' THEN 1 ELSE 2 END, {CLOCK}) AS committed
FROM events""")
def commit_date(i):
    zone = F.when(F.col("event_type") == "view", "Z").when(F.col("event_type") == "click", " +0100").otherwise(" +0200")
    text = F.concat(clock("ts"), zone)
    return i.table("events").select("event_id", clock(dates.commit_date(text)).alias("committed"))
