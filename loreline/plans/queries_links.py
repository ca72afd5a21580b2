"""Queries on DOI, journal and address rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreline.functions import fixed_values as V
from loreline.functions import identifiers, text
from loreline.operators import enrich as ops
from loreline.operators import lookup
from loreline.plans.registry import clock, query

# ---- DuckDB side -------------------------------------------------------------------


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_sql(c: str) -> str:
    return f"split_part(split_part(regexp_replace({c}, '[.,;:/?#]+$', ''), '#', 1), '?', 1)"


def doi_sql(url: str) -> str:
    arms = []
    for pattern, group, prefix, tidy in V.DOI_PATTERNS:
        hit = f"regexp_extract({url}, {quote(pattern)}, {group})" if group else "NULL"
        if tidy == "clean":
            hit = clean_sql(hit)
        elif tidy == "cut":
            hit = f"rtrim(split_part(split_part({hit}, '?', 1), '#', 1), '.')"
        arms.append(f"WHEN regexp_matches({url}, {quote(pattern)}) THEN {quote(prefix)} || {hit}")
    late = clean_sql(f"nullif(regexp_extract({url}, '/(10\\.\\d+/\\S+)', 1), '')")
    arms.append(f"WHEN regexp_matches({url}, '(?i)genome(?:medicine|biology)\\.') THEN {late}")
    return f"CASE WHEN NOT starts_with({url}, 'http') THEN NULL {' '.join(arms)} END"


def table_sql(c: str, table) -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, {quote(s)}) THEN {quote(n)}" for s, n in table) + " END"


def host_sql(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"


def path_sql(url: str) -> str:
    return f"lower(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1))"


def capital_sql(c: str) -> str:
    return f"upper(substr({c}, 1, 1)) || lower(substr({c}, 2))"


def trends_sql(path: str) -> str:
    name = f"regexp_extract({path}, '/trends/([^/]+)/', 1)"
    return f"CASE WHEN {name} = '' THEN 'Trends' ELSE 'Trends in ' || {capital_sql(name)} END"


def journal_sql(host: str, path: str) -> str:
    skip = " OR ".join(f"contains({host}, {quote(h)})" for h in V.NON_JOURNAL_HOSTS)
    families = []
    for domain, table, default in V.HOST_FAMILIES:
        trends = f"CASE WHEN contains({host}, 'cell.com') AND contains({path}, '/trends/') THEN {trends_sql(path)} END"
        families.append(f"WHEN contains({host}, {quote(domain)}) THEN coalesce({table_sql(path, table)}, {trends}, {quote(default)})")
    return f"CASE WHEN {skip} THEN NULL ELSE coalesce({table_sql(host, V.SIMPLE_HOSTS)}, CASE {' '.join(families)} END) END"


PLACES = f"""
, places AS (SELECT *, {host_sql('url')} AS host, {path_sql('url')} AS path, {doi_sql('url')} AS doi,
    {host_sql('lower(resolved_url)')} AS rhost, {path_sql('lower(resolved_url)')} AS rpath FROM v_urls),
named AS (SELECT *, {journal_sql('host', 'path')} AS by_host,
    CASE WHEN contains(rhost, 'biorxiv.org') THEN 'bioRxiv' WHEN contains(rhost, 'medrxiv.org') THEN 'medRxiv'
      WHEN contains(rhost, 'cell.com') OR contains(rhost, 'sciencedirect.com') THEN 'Cell Press'
      WHEN contains(rhost, 'nature.com') THEN 'Nature Group' WHEN contains(rhost, 'science.org') THEN 'Science'
      WHEN contains(rhost, 'pnas.org') THEN 'PNAS'
      ELSE coalesce({journal_sql('rhost', 'rpath')}, {capital_sql("split_part(rhost, '.', 1)")}) END AS by_address FROM places),
dim AS (SELECT doi, min(CASE WHEN page_id % 2 = 0 THEN 'Journal ' || (page_id % 5) END) AS title FROM places WHERE doi IS NOT NULL GROUP BY doi),
steps AS (SELECT n.*, CASE WHEN n.journal = '' THEN d.title END AS looked FROM named n LEFT JOIN dim d ON n.doi = d.doi),
enriched AS (SELECT page_id, coalesce(doi, '') AS doi, CASE
    WHEN journal <> '' THEN journal WHEN looked IS NOT NULL THEN looked
    WHEN starts_with(url, 'http') AND by_host IS NOT NULL THEN by_host
    WHEN starts_with(doi, '10.48550/arXiv.') THEN 'arXiv'
    WHEN doi IS NOT NULL AND starts_with(url, 'https://doi.org/') THEN by_address ELSE '' END AS journal, CASE
    WHEN journal <> '' THEN 'kept' WHEN looked IS NOT NULL THEN 'lookup'
    WHEN starts_with(url, 'http') AND by_host IS NOT NULL THEN 'domain'
    WHEN starts_with(doi, '10.48550/arXiv.') THEN 'prefix'
    WHEN doi IS NOT NULL AND starts_with(url, 'https://doi.org/') THEN 'resolved' ELSE 'none' END AS source FROM steps)
"""


def doi_dim(i):
    """DOI dimension over all pages; half of its entries have no container title."""
    v = i.view("v_urls")
    title = F.when(F.col("page_id") % 2 == 0, F.array(F.concat(F.lit("Journal "), F.col("page_id") % 5)))
    return v.select(
        identifiers.doi_from_url(F.col("url")).alias("doi"),
        F.coalesce(title, F.array().cast("array<string>")).alias("container_titles"),
    ).filter("doi IS NOT NULL")


@query("doi_from_url", "v_urls", sql=PLACES + "SELECT page_id, doi FROM places")
def doi_from_url(i):
    return i.view("v_urls").select("page_id", identifiers.doi_from_url(F.col("url")).alias("doi"))


@query("clean_doi", "v_urls", sql=f"SELECT page_id, {clean_sql('url')} AS doi FROM v_urls")
def clean_doi(i):
    return i.view("v_urls").select("page_id", identifiers.clean_doi(F.col("url")).alias("doi"))


@query("build_doi", "v_urls", sql="""
SELECT page_id, '10.1038/' || page_id AS nature, '10.1016/j.' || page_id AS pii, '10.7554/eLife.' || page_id AS elife,
  '10.1016/' || rtrim(split_part(split_part(url, '?', 1), '#', 1), '.') AS lancet FROM v_urls""")
def build_doi(i):
    n = F.col("page_id").cast("string")
    return i.view("v_urls").select(
        "page_id",
        *[identifiers.build_doi(k, n).alias(k) for k in ("nature", "pii", "elife")],
        identifiers.build_doi("lancet", F.col("url")).alias("lancet"),
    )


@query("journal_by_domain", "v_urls", sql=PLACES + "SELECT page_id, by_host AS journal FROM named")
def journal_by_domain(i):
    return i.view("v_urls").select("page_id", identifiers.journal_by_domain(F.col("url")).alias("journal"))


@query("trends_journal", "v_urls", sql=f"""
SELECT page_id, {trends_sql("lower(replace(url, '/content/', '/trends/'))")} AS journal FROM v_urls""")
def trends_journal(i):
    path = F.lower(F.replace("url", F.lit("/content/"), F.lit("/trends/")))
    return i.view("v_urls").select("page_id", identifiers.trends_journal(path).alias("journal"))


@query("journal_by_doi_prefix", "v_urls", sql=PLACES + """
SELECT page_id, CASE WHEN starts_with(doi, '10.48550/arXiv.') THEN 'arXiv' END AS journal FROM places""")
def journal_by_doi_prefix(i):
    doi = identifiers.doi_from_url(F.col("url"))
    return i.view("v_urls").select("page_id", identifiers.journal_by_doi_prefix(doi).alias("journal"))


@query("journal_by_doi", "v_urls", sql=PLACES + """
SELECT page_id, title AS journal_lookup FROM places LEFT JOIN dim USING (doi)""")
def journal_by_doi(i):
    v = i.view("v_urls").withColumn("doi", identifiers.doi_from_url(F.col("url")))
    return ops.journal_by_doi(v, doi_dim(i), "page_id").select("page_id", "journal_lookup")


@query("journal_by_resolved_domain", "v_urls", sql=PLACES + "SELECT page_id, by_address AS journal FROM named")
def journal_by_resolved_domain(i):
    return i.view("v_urls").select("page_id", identifiers.journal_by_resolved_domain(F.col("resolved_url")).alias("journal"))


@query("enrich", "v_urls", sql=PLACES + "SELECT * FROM enriched")
def enrich(i):
    return ops.enrich(i.view("v_urls"), doi_dim(i), "page_id").select("page_id", "doi", "journal", "source")


@query("run_counters", "v_urls", sql=PLACES + """
SELECT count(*) AS total, count(*) FILTER (WHERE doi <> '') AS doi_found, count(*) FILTER (WHERE source = 'lookup') AS journal_lookup,
  count(*) FILTER (WHERE source IN ('domain', 'prefix', 'resolved')) AS journal_domain, count(*) FILTER (WHERE source = 'none') AS no_journal
FROM enriched""")
def run_counters(i):
    return ops.run_counters(ops.enrich(i.view("v_urls"), doi_dim(i), "page_id"))


RULES = ", ".join(f"({n}, {quote(s)}, {quote(v)})" for n, (s, v) in enumerate(V.NATURE_PATHS))


def _rules(i):
    return i.spark.sql(f"SELECT * FROM VALUES {RULES} AS t(ord, segment, value)")


FIRST_RULE = f"""
, rules(ord, segment, value) AS (VALUES {RULES})
SELECT page_id, arg_min(value, ord) AS match FROM v_urls LEFT JOIN rules ON contains(lower(url), segment) GROUP BY page_id"""


@query("match_first_rule", "v_urls", sql=FIRST_RULE)
def match_first_rule(i):
    v = i.view("v_urls").withColumn("path", F.lower("url"))
    return lookup.match_first_rule(v, _rules(i), "path", "page_id").select("page_id", "match")


@query("match_first_rule_by_stem", "v_urls", sql=FIRST_RULE)
def match_first_rule_by_stem(i):
    v = i.view("v_urls").withColumn("path", F.lower("url"))
    return lookup.match_first_rule(v, _rules(i), "path", "page_id").select("page_id", "match")


@query("feed_guid", "v_urls", sql=PLACES + """
SELECT page_id, coalesce(nullif(url, ''), nullif(doi, ''), journal, '') AS guid, journal || cast(page_id AS varchar) AS news_guid FROM places""")
def feed_guid(i):
    v = i.view("v_urls").withColumn("doi", identifiers.doi_from_url(F.col("url")))
    return v.select(
        "page_id",
        text.feed_guid(F.col("url"), F.col("doi"), F.col("journal")).alias("guid"),
        text.news_guid(F.col("journal"), F.col("page_id").cast("string")).alias("news_guid"),
    )


@query("feed_description", "v_urls", sql="""
SELECT page_id, CASE WHEN journal = '' THEN c WHEN c = '' THEN '[' || journal || ']' ELSE '[' || journal || '] ' || c END AS description
FROM (SELECT v.page_id, v.journal, substr(ltrim(CASE WHEN v.page_id % 3 = 0 THEN '' ELSE p.html END, '^ '), 1, 500) AS c
  FROM v_urls v JOIN pages p USING (page_id))""")
def feed_description(i):
    both = i.view("v_urls").drop("url").join(i.table("pages"), "page_id")
    comment = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.col("html"))
    return both.select("page_id", text.feed_description(comment, F.col("journal")).alias("description"))


# ---- pages and their addresses ----------------------------------------------------

FRAGMENTS = ["news/year-", "shared/year-"], ["shared/insights.html", "news/insights.html"]


@query("filter_standalone", "v_paths", sql="""
SELECT page_id, path FROM v_paths WHERE NOT starts_with(path, 'news/year-') AND NOT starts_with(path, 'shared/year-')
  AND path NOT IN ('shared/insights.html', 'news/insights.html')""")
def filter_standalone(i):
    return lookup.filter_standalone(i.view("v_paths"), *FRAGMENTS)


@query("page_slug", "v_paths", sql="""
SELECT page_id, CASE WHEN path = 'index.html' THEN 'index' ELSE lower(replace(path, 'section', '')) END AS slug FROM v_paths""")
def page_slug(i):
    return i.view("v_paths").select("page_id", text.page_slug(F.col("path"), "section", "index.html").alias("slug"))


INVENTORY = """
, registry AS (SELECT DISTINCT path AS file, 'page-' || (page_id % 6) AS page FROM v_paths WHERE path = 'index.html' OR starts_with(path, 'section')),
moddates AS (SELECT CASE WHEN page_id % 6 = 1 THEN 'post:post-' || page_id WHEN page_id % 6 = 2 THEN 'lab-manual:page-' || page_id
    ELSE 'page-' || (page_id % 6) END AS page_key, max(CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) AS VARCHAR)) AS lastmod
  FROM v_paths GROUP BY 1),
kept AS (SELECT * FROM v_paths WHERE NOT starts_with(path, 'news/year-') AND path <> 'shared/insights.html'),
keyed AS (SELECT k.*, CASE WHEN r.page IS NOT NULL THEN r.page
    WHEN regexp_matches(path, '^p/[^/]*/[^/]*$') THEN 'post:' || split_part(path, '/', 2)
    WHEN starts_with(path, 'lab-manual/') THEN 'lab-manual:' || regexp_extract(path, 'lab-manual/(.*)/index.html', 1) END AS page_key
  FROM kept k LEFT JOIN registry r ON r.file = k.path),
located AS (SELECT page_id, 'https://site.example.org/' || replace(path, 'index.html', '') AS loc, coalesce(lastmod, '2026-01-01') AS lastmod
  FROM keyed LEFT JOIN moddates USING (page_key))
"""


def located(i):
    v = i.view("v_paths")
    n = F.col("page_id") % 6
    registry = v.filter((F.col("path") == "index.html") | F.startswith("path", F.lit("section"))).select(
        F.col("path").alias("file"), F.concat(F.lit("page-"), n).alias("page")
    ).distinct()
    key = (
        F.when(n == 1, F.concat(F.lit("post:post-"), "page_id"))
        .when(n == 2, F.concat(F.lit("lab-manual:page-"), "page_id"))
        .otherwise(F.concat(F.lit("page-"), n))
    )
    changed = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")).cast("string")
    moddates = v.select(key.alias("page_key"), changed.alias("d")).groupBy("page_key").agg(F.max("d").alias("lastmod"))
    kept = lookup.filter_standalone(v, *FRAGMENTS)
    return lookup.attach_lastmod(kept, registry, moddates, "https://site.example.org/", F.lit("2026-01-01"))


@query("attach_lastmod", "v_paths", sql=INVENTORY + "SELECT page_id, loc, lastmod FROM located")
def attach_lastmod(i):
    return located(i).select("page_id", "loc", "lastmod")


@query("union_inventory", "v_paths", sql=INVENTORY + """
SELECT loc, lastmod FROM located UNION ALL SELECT DISTINCT 'https://site.example.org/' || split_part(path, '/', 1) || '/feed.xml', '2026-01-01'
FROM v_paths""")
def union_inventory(i):
    feeds = i.view("v_paths").select(
        F.concat(F.lit("https://site.example.org/"), F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/feed.xml")).alias("loc"),
        F.lit("2026-01-01").alias("lastmod"),
    ).distinct()
    return lookup.union_inventory(located(i), feeds)


@query("merge_right_wins", sql="""
SELECT coalesce(b.r_regionkey, a.n_nationkey) AS key, CASE WHEN b.r_regionkey IS NOT NULL THEN b.r_name ELSE a.n_name END AS value
FROM nation a FULL JOIN region b ON a.n_nationkey = b.r_regionkey""")
def merge_right_wins(i):
    a = i.table("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    b = i.table("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return lookup.merge_right_wins(a, b, "key", "value")


@query("latest_by_key", sql="""
SELECT CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id END AS key, event_type AS "group", 'key' AS level, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS lastmod
FROM events GROUP BY ALL
UNION ALL SELECT NULL, event_type, 'group', strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events GROUP BY ALL""")
def latest_by_key(i):
    e = i.table("events").select(F.expr("CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id END").alias("key"), F.col("event_type").alias("group"), "ts")
    return lookup.latest_by_key(e).select("key", "group", "level", clock("lastmod").alias("lastmod"))


@query("asof_locate", sql="""
, b AS (SELECT user_id, ts, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id
  FROM events WHERE event_type = 'signup')
SELECT p.event_id, b.event_id AS start_id, b.next_id AS end_id
FROM (SELECT * FROM events WHERE event_type <> 'signup') p ASOF JOIN b ON p.user_id = b.user_id AND p.ts >= b.ts""")
def asof_locate(i):
    e = i.table("events").select("user_id", "ts", "event_id", "event_type")
    points = e.filter("event_type <> 'signup'").drop("event_type")
    bounds = e.filter("event_type = 'signup'").drop("event_type")
    found = lookup.asof_locate(points, bounds, ["user_id"], ["ts", "event_id"], F.to_date("ts"))
    return found.select("event_id", F.col("start.event_id").alias("start_id"), F.col("end.event_id").alias("end_id"))
