"""Queries on pages, terms, labels and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreline.functions import html, titles
from loreline.functions.stopwords import ENGLISH
from loreline.operators import text as ops
from loreline.operators import vectors
from loreline.plans.queries_items import NO_LINKS, collapse_sql, title_sql
from loreline.plans.registry import in_list, query, six

# ---- pages ------------------------------------------------------------------------

STRIPPED = "regexp_replace(regexp_replace({}, '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g')"
WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)"


# The references that stand in the tables, for the SQL check.
SHOWN = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\xa0",
    "&copy;": "©", "&reg;": "®", "&middot;": "·", "&bull;": "•", "&hellip;": "…",
    "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
}


def unescape_sql(c: str) -> str:
    for name, char in SHOWN.items():
        c = f"replace({c}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"replace({c}, '&amp;', '&')"


@query("strip_style_script", sql=f"SELECT page_id, {STRIPPED.format('html')} AS html FROM pages")
def strip_style_script(i):
    return i.table("pages").select("page_id", html.strip_style_script(F.col("html")).alias("html"))


@query("html_to_text", sql=f"""
SELECT page_id, trim({unescape_sql("regexp_replace(html, '<[^>]+>', chr(10), 'g')")}, {WS}) AS text FROM pages""")
def html_to_text(i):
    return i.table("pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


@query("text_summary", sql=f"""
SELECT page_id, substr(array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '<[^>]+>', chr(1), 'g'), chr(1)),
  lambda s: trim({unescape_sql('s')}, {WS})), lambda s: s <> ''), ' '), 1, 500) AS summary FROM pages""")
def text_summary(i):
    return i.table("pages").select("page_id", html.text_summary(F.col("html")).alias("summary"))


# Every third page with hrefs in single quotes, every third with bare ones.
QUOTED = """CASE page_id % 3 WHEN 1 THEN regexp_replace(html, 'href="([^"]*)"', 'HREF = ''\\1''', 'g')
  WHEN 2 THEN regexp_replace(html, 'href="([^" ]*)"', 'title="a > b" href=\\1', 'g') ELSE html END"""


@query("read_html_pages", sql=f"""
WITH quoted AS (SELECT page_id, {QUOTED} AS html FROM pages)
SELECT page_id, {unescape_sql("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')")} AS title,
  array_to_string(list_transform(list_transform(regexp_extract_all(html, '(?i)<a\\s(?:[^>"'']|"[^"]*"|''[^'']*'')*?\\bhref\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1),
    lambda v: trim(v, '"''')), lambda u: {unescape_sql('u')}), ' ') AS links,
  md5(trim({unescape_sql("regexp_replace(html, '<[^>]+>', chr(10), 'g')")}, {WS})) AS text_md5 FROM quoted""")
def read_html_pages(i):
    from loreline.sources.tables import read_html_pages as read

    pages = i.table("pages")
    third = F.col("page_id") % 3
    single = F.regexp_replace("html", 'href="([^"]*)"', "HREF = '$1'")
    bare = F.regexp_replace("html", 'href="([^" ]*)"', 'title="a > b" href=$1')
    pages = pages.withColumn("html", F.when(third == 1, single).when(third == 2, bare).otherwise(F.col("html")))
    p = read(pages, "html", "page_id")
    return p.select("page_id", "title", F.array_join("links", " ").alias("links"), F.md5("text").alias("text_md5"))


@query("drop_heading", sql="SELECT page_id, regexp_replace(html, '(?is)<h1[^>]*>.*?</h1>', '') AS html FROM pages")
def drop_heading(i):
    return i.table("pages").select("page_id", html.drop_heading(F.col("html")).alias("html"))


@query("rewrite_links", sql="""
SELECT page_id, regexp_replace(regexp_replace(html, 'href="/([A-Za-z]+)"', 'href="\\1.md"', 'g'), 'href="([^"]*)\\.md"', 'href="/lab-manual/\\1"', 'g') AS html
FROM pages""")
def rewrite_links(i):
    md = F.regexp_replace("html", r'href="/([A-Za-z]+)"', 'href="$1.md"')
    return i.table("pages").select("page_id", html.rewrite_links(md, "/lab-manual/").alias("html"))


PLAIN_TEXT = "trim(regexp_replace({}, '(\\s|\\x{{A0}})+', ' ', 'g'))"


@query("strip_signature", sql=f"""
, bare AS (SELECT page_id, regexp_replace({STRIPPED.format('html')}, '(?s)<nav>.*?</nav>', '', 'g') AS kept FROM pages)
SELECT page_id, false AS nav_left, md5({PLAIN_TEXT.format(unescape_sql("regexp_replace(kept, '<[^>]+>', chr(10), 'g')"))}) AS text_md5,
  len(regexp_extract_all(kept, '(?i)<(p|div|a|article)[ >]')) AS opened FROM bare""")
def strip_signature(i):
    # Every navigation list, lists of links inside, plays the signature.
    marked = F.regexp_replace("html", "<nav>", '<nav class="my-Signature">')
    kept = html.strip_signature(html.strip_style_script(marked))
    text = F.trim(F.regexp_replace(html.html_to_text(F.col("kept")), r"[\s\xA0]+", " "))
    return i.table("pages").select("page_id", kept.alias("kept")).select(
        "page_id", F.contains("kept", F.lit("<nav")).alias("nav_left"), F.md5(text).alias("text_md5"),
        F.size(F.regexp_extract_all("kept", F.lit("(?i)<(p|div|a|article)[ >]"), F.lit(1))).alias("opened"),
    )


@query("title_from_blocks", sql=f"""
, clean AS (SELECT page_id, {STRIPPED.format('html')} AS html FROM pages),
parts AS (SELECT page_id, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad, regexp_extract(html, '(?s)</h1>(.*)</article>', 1) AS article FROM clean),
blocks AS (SELECT page_id, [ad, array_to_string(list_transform(string_split(regexp_replace(article, '<[^>]+>', chr(1), 'g'), chr(1)), lambda s: trim(s, {WS})), '')]
  || regexp_extract_all(article, '<p>([^<]*)</p>', 1) AS b FROM parts),
texts AS (SELECT page_id, list_filter(list_transform(b, lambda s: {NO_LINKS.format(unescape_sql('s'))}), lambda s: trim(s, {WS}) <> '') AS b FROM blocks)
SELECT page_id, list_filter(list_transform(b, lambda s: {collapse_sql('s')}), lambda s: {title_sql('s')})[1] AS title FROM texts""")
def title_from_blocks(i):
    """The element form of the title search: elements in page order, each with all the text inside it, closed or not."""
    blocks = html.dom_view(html.strip_style_script(F.col("html")))["blocks"]
    return i.table("pages").select("page_id", titles.title_from_blocks(blocks).alias("title"))


# ---- terms ------------------------------------------------------------------------

STOP = in_list(ENGLISH)
CLEAN = f"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'), {WS})"


def terms_sql(source: str, text: str, *extra_stop: str) -> str:
    stop = f"{STOP}, {in_list(extra_stop)}" if extra_stop else STOP
    return f"""
, words AS (SELECT item_id, topic, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({stop})) AS t FROM {source}),
grams AS (SELECT item_id, topic, unnest(t || [t[j] || ' ' || t[j + 1] FOR j IN range(1, len(t))]) AS term FROM words),
tf AS (SELECT item_id, topic, term, count(*) AS tf FROM grams GROUP BY ALL),
stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term)"""


def weights_sql(source: str, k: int, where: str = "true") -> str:
    return f"""
, total AS (SELECT count(*) AS n FROM {source}),
vocabulary AS (SELECT term, cf, df FROM stats, total WHERE {where} ORDER BY cf DESC, term LIMIT {k}),
raw AS (SELECT item_id, topic, term, tf, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN vocabulary USING (term), total),
weights AS (SELECT item_id, topic, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM raw),
sizes AS (SELECT topic, count(*) AS n FROM {source} GROUP BY topic),
centroids AS (SELECT topic, term, sum(weight) / any_value(n) AS weight FROM weights JOIN sizes USING (topic) GROUP BY topic, term),
ranked AS (SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, term DESC) AS rank FROM centroids)"""


DOCS = ", docs AS (SELECT d.doc_id AS item_id, t.topic, d.text FROM documents d JOIN v_topics t ON d.doc_id = t.item_id)"
RAW_TERMS = DOCS + terms_sql("docs", "text")
CLEAN_TERMS = DOCS + terms_sql("docs", CLEAN)


def _docs(i):
    topics = i.view("v_topics").select("item_id", "topic")
    docs = i.table("documents").select(F.col("doc_id").alias("item_id"), "text")
    return docs.join(topics, "item_id")


def _terms(i):
    return ops.doc_terms(i.table("documents"), F.col("text"), "doc_id")


def _counted(i):
    return ops.counted_terms(i.table("documents"), F.col("text"), "doc_id")


@query("normalise_title", sql=f"SELECT doc_id, {CLEAN} AS clean FROM documents")
def normalise_title(i):
    return i.table("documents").select("doc_id", ops.normalise_title(F.col("text")).alias("clean"))


@query("ngrams_1_2", "v_topics", sql=RAW_TERMS + """
SELECT item_id AS doc_id, count(*) AS grams, count(DISTINCT term) AS terms, md5(string_agg(term, '|' ORDER BY term)) AS grams_md5
FROM grams GROUP BY item_id""")
def ngrams_1_2(i):
    g = i.table("documents").select("doc_id", ops.ngrams_1_2(F.col("text")).alias("g"))
    return g.filter(F.size("g") > 0).select(
        "doc_id",
        F.size("g").alias("grams"),
        F.size(F.array_distinct("g")).alias("terms"),
        F.md5(F.array_join(F.array_sort("g"), "|")).alias("grams_md5"),
    )


@query("term_counts", "v_topics", sql=RAW_TERMS + "SELECT item_id AS doc_id, term, tf FROM tf")
def term_counts(i):
    return _terms(i)


@query("term_statistics", "v_topics", sql=RAW_TERMS + "SELECT term, cf, df FROM stats")
def term_statistics(i):
    return ops.term_statistics(ops.batch_terms(i.table("documents"), F.col("text")))


@query("top_vocabulary", "v_topics", sql=RAW_TERMS + weights_sql("docs", 500) + "SELECT term, cf, df FROM vocabulary")
def top_vocabulary(i):
    return ops.frequent_terms(ops.unfolded(_counted(i)), 500)


@query("top_vocabulary_bounded", "v_topics", sql=RAW_TERMS + weights_sql("docs", 1000, "df >= 2 AND df <= n * 0.85") + """
SELECT term, cf, df FROM vocabulary""")
def top_vocabulary_bounded(i):
    counted = _counted(i)
    return ops.frequent_terms(ops.unfolded(counted), 1000, counted.agg(F.count(F.lit(1))).scalar(), 2, 0.85)


@query("tfidf", "v_topics", sql=CLEAN_TERMS + weights_sql("docs", 500) + """
SELECT item_id, term, tf, round(weight, 6) AS weight FROM weights""")
def tfidf(i):
    w = ops.tfidf(_docs(i), ops.normalise_title(F.col("text")), "item_id", k=500)
    return w.select("item_id", "term", "tf", six("weight").alias("weight"))


def _centroids(i):
    counted = ops.counted_terms(_docs(i), ops.normalise_title(F.col("text")), "item_id", "topic", k=500)
    w = ops.weighed_terms(counted, "item_id", "topic", k=500)
    return ops.cluster_centroids(w, counted.groupBy("topic").agg(F.count(F.lit(1)).alias("n")))


@query("cluster_centroids", "v_topics", sql=CLEAN_TERMS + weights_sql("docs", 500) + """
SELECT topic, term, round(weight, 6) AS weight FROM centroids""")
def cluster_centroids(i):
    return _centroids(i).select("topic", "term", six("weight").alias("weight"))


@query("top_terms_per_topic", "v_topics", sql=CLEAN_TERMS + weights_sql("docs", 500) + """
SELECT topic, term, rank, round(weight, 6) AS weight FROM ranked WHERE rank <= 5""")
def top_terms_per_topic(i):
    return ops.top_terms_per_topic(_centroids(i)).select("topic", "term", "rank", six("weight").alias("weight"))


CAPITAL = "upper(substr(term, 1, 1)) || lower(substr(term, 2))"


@query("label_text", "v_topics", sql=CLEAN_TERMS + weights_sql("docs", 500) + """
SELECT topic, string_agg(term, ', ' ORDER BY rank) AS topic_label FROM ranked WHERE rank <= 3 GROUP BY topic""")
def label_text(i):
    return ops.label_text(ops.top_terms_per_topic(_centroids(i)), capital=False)


@query("label_topics_papers", "v_topics", sql=CLEAN_TERMS + weights_sql("docs", 500) + f"""
SELECT topic, string_agg({CAPITAL}, ', ' ORDER BY rank) AS topic_label FROM ranked WHERE rank <= 3 AND topic <> -1 GROUP BY topic""")
def label_topics_papers(i):
    return ops.label_topics(_docs(i), "text")


@query("label_topics_news", "v_topics", sql=DOCS + terms_sql("docs", "text", "lorem", "the1") + weights_sql("docs", 1000, "df >= 2 AND df <= n * 0.85") + """
SELECT topic, string_agg(term, ', ' ORDER BY rank) AS topic_label FROM ranked WHERE rank <= 3 GROUP BY topic""")
def label_topics_news(i):
    return ops.label_topics(_docs(i), "text", variant="news", names=("lorem", "the1"))


# ---- vectors ----------------------------------------------------------------------

MEANS = """
, cells AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
means AS (SELECT label AS topic, d, avg(v::DOUBLE) AS m FROM cells GROUP BY label, d)"""


def _vectors(i):
    e = i.table("embeddings")
    centroids = vectors.dense_centroids(e.withColumnRenamed("label", "topic"))
    return e, centroids


@query("l2_normalise", sql="""
, doubled AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings),
unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM doubled)
SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm, round(u[1], 6) AS first, round(u[64], 6) AS last FROM unit""")
def l2_normalise(i):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    u = i.table("embeddings").select("vec_id", vectors.l2_normalise(tripled).alias("u"))
    norm = F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)
    return u.select("vec_id", six(norm).alias("norm"), six(F.col("u")[0]).alias("first"), six(F.col("u")[63]).alias("last"))


@query("dense_centroids", sql=MEANS + "SELECT topic, d, round(m, 6) + 0 AS mean FROM means")
def dense_centroids(i):
    _, c = _vectors(i)
    return c.select("topic", F.posexplode("centroid").alias("d", "m")).select("topic", (F.col("d") + 1).alias("d"), six("m").alias("mean"))


@query("assign_topics", sql=MEANS + """
, far AS (SELECT vec_id, topic, sum((v::DOUBLE - m) * (v::DOUBLE - m)) AS d2 FROM cells JOIN means USING (d) GROUP BY vec_id, topic)
SELECT vec_id, arg_min(topic, d2) AS topic, round(min(d2), 6) AS distance2 FROM far GROUP BY vec_id""")
def assign_topics(i):
    e, c = _vectors(i)
    return vectors.assign_topics(e, c).select("vec_id", "topic", six("distance2").alias("distance2"))


@query("map_points", sql="""
, height AS (SELECT max(embedding[2]::DOUBLE) - min(embedding[2]::DOUBLE) AS h FROM embeddings)
SELECT label AS topic, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) + 0 AS centroid_x, round(avg(embedding[2]::DOUBLE), 6) + 0 AS centroid_y,
  round(avg(embedding[2]::DOUBLE) - any_value(h) * 0.04, 6) + 0 AS label_y FROM embeddings, height GROUP BY label""")
def map_points(i):
    p = i.table("embeddings").select(
        F.col("label").alias("topic"),
        F.col("embedding")[0].cast("double").alias("embedding_x"),
        F.col("embedding")[1].cast("double").alias("embedding_y"),
    )
    m = vectors.map_points(p)
    return m.select("topic", "n", *[six(c).alias(c) for c in ("centroid_x", "centroid_y", "label_y")])


@query("topic_items", "v_items", "v_topics", sql="""
, names AS (SELECT topic, max(topic_label) AS name FROM v_topics WHERE topic_label IS NOT NULL GROUP BY topic)
SELECT v.item_id, v.title, t.topic, coalesce(name, 'Other') AS topic_label, round(e.embedding[1]::DOUBLE, 6) + 0 AS x, round(e.embedding[2]::DOUBLE, 6) + 0 AS y
FROM v_items v LEFT JOIN v_topics t USING (item_id) LEFT JOIN embeddings e ON e.vec_id = v.item_id LEFT JOIN names n ON n.topic = t.topic""")
def topic_items(i):
    from loreline.operators import marts

    coords = i.table("embeddings").select(
        F.col("vec_id").alias("item_id"), six(F.col("embedding")[0]).alias("x"), six(F.col("embedding")[1]).alias("y")
    )
    topics = i.view("v_topics")
    names = topics.filter("topic_label IS NOT NULL").groupBy("topic").agg(F.max("topic_label").alias("topic_label"))
    items = i.view("v_items").select("item_id", "title")
    return marts.topic_items(items, topics, names, coords).select("item_id", "title", "topic", "topic_label", "x", "y")


@query("embed", "v_items", sql=f"""
, words AS (SELECT item_id, len(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOP}))) AS n FROM v_items)
SELECT item_id, 384 AS width, (n + greatest(n - 1, 0))::DOUBLE AS grams FROM words""")
def embed(i):
    """Each word and each pair of words adds one to some place of the vector."""
    e = vectors.embed(i.view("v_items").select("item_id", "title"))
    return e.select("item_id", F.size("embedding").alias("width"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("grams"))


@query("fit_topics")
def fit_topics(i):
    e = i.table("embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    topics, _ = vectors.fit_topics(e)
    return topics


@query("fit_topics_checked", sql="""
SELECT count(*) AS items, 20 AS topics, 0 AS misplaced, 0 AS disordered, 0 AS costlier FROM embeddings""")
def fit_topics_checked(i):
    """Ten runs: rows not at their nearest centre, topics not numbered by size, and single runs that cost less."""
    e = i.table("embeddings").select(F.col("vec_id").alias("item_id"), vectors.l2_normalise(vectors.whole_vector(F.col("embedding"))).alias("embedding"))
    topics, centroids = vectors.fit_topics(e)
    own = e.join(topics.withColumnRenamed("topic", "own"), "item_id")
    near = vectors.assign_topics(own.filter("embedding IS NOT NULL"), centroids)
    near = near.unionByName(own.filter("embedding IS NULL"), allowMissingColumns=True)
    cost = near.agg(F.sum("distance2")).first()[0]
    unit = e.select(vectors.l2_normalise(F.col("embedding")).alias("unit"))
    single = [vectors.fit_runs(unit, 20, [42 + r]).costs[0] for r in (0, 4, 9)]
    sizes = near.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("topic") != F.col("own")).alias("wrong"))
    lists = sizes.agg(F.sum("n").alias("items"), F.count("own").alias("topics"), F.sum("wrong").alias("misplaced"), F.array_sort(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("own", "n")))).alias("l"))
    falls = F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda x: (F.get("l", x)["n"] > F.get("l", x - 1)["n"]).cast("int"))
    return lists.select("items", "topics", "misplaced", F.aggregate(falls, F.lit(0), lambda a, x: a + x).alias("disordered"), F.lit(sum(c < cost - 1e-6 for c in single)).alias("costlier"))


@query("project_2d")
def project_2d(i):
    e = i.table("embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return vectors.project_2d(e)


@query("project_2d_checked", sql="""
, wide AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
variances AS (SELECT d, var_samp(v) AS s FROM wide GROUP BY d)
SELECT (SELECT count(*) FROM embeddings) AS items, (SELECT round(sum(s), 6) FROM variances) AS variance, true AS in_order, true AS apart, true AS beats_any_two""")
def project_2d_checked(i):
    """Variance of the vectors, and whether the two axes hold more of it than any two places, the first the most, uncorrelated."""
    e = i.table("embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    x, y = F.var_samp("embedding_x"), F.var_samp("embedding_y")
    axes = vectors.project_2d(e).agg(F.count(F.lit(1)).alias("items"), x.alias("x"), y.alias("y"), F.covar_samp("embedding_x", "embedding_y").alias("c"))
    places = e.select(F.posexplode("embedding").alias("d", "v")).groupBy("d").agg(F.var_samp(F.col("v").cast("double")).alias("s"))
    whole = places.agg(F.struct(F.sum("s").alias("s"), F.slice(F.sort_array(F.collect_list("s"), False), 1, 2).alias("top"))).scalar()
    axes = axes.withColumn("w", whole)
    return axes.select(
        "items", six("w.s").alias("variance"), (F.col("x") >= F.col("y")).alias("in_order"),
        (F.abs("c") < 1e-6).alias("apart"), (F.col("x") + F.col("y") >= F.col("w.top")[0] + F.col("w.top")[1]).alias("beats_any_two"),
    )
