"""Queries on messages, bodies and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreline.functions import fixed_values as V
from loreline.functions import links, mail, text, titles
from loreline.functions.dates import mail_date
from loreline.operators import items as ops
from loreline.operators import lookup, vectors
from loreline.plans.registry import clock, in_list, query
from loreline.sources.tables import post_title

# ---- messages: DuckDB side -----------------------------------------------------


def header_sql(headers: str, name: str) -> str:
    unfolded = f"regexp_replace({headers}, '[ \\t]*\\n[ \\t]+', ' ', 'g')"
    return f"trim(regexp_extract({unfolded}, '(?im)^{name}:(.*)$', 1))"


MESSAGES = f"""
, parts AS (SELECT item_id, folder_rank, ord, raw,
    substr(raw, strpos(raw, chr(10)) + 1, strpos(raw, chr(10) || chr(10)) - strpos(raw, chr(10)) - 1) AS headers,
    substr(raw, strpos(raw, chr(10) || chr(10)) + 2) AS body FROM v_messages),
fields AS (SELECT *, {header_sql('headers', 'Subject')} AS subject, {header_sql('headers', 'From')} AS sender_field,
    {header_sql('headers', 'Date')} AS date_field, {header_sql('headers', 'Content-Type')} AS ctype,
    {header_sql('headers', 'Content-Transfer-Encoding')} AS cte FROM parts),
tagged AS (SELECT * FROM fields WHERE regexp_matches(raw, '(?m)^Subject: \\[paper\\]') AND starts_with(subject, '[paper]')
    AND trim(substr(subject, 8)) <> ''),
pieces AS (SELECT *, regexp_extract(ctype, 'boundary="([^"]+)"', 1) AS boundary FROM tagged),
chosen AS (SELECT *, CASE WHEN boundary <> '' THEN
    list_filter(string_split(body, '--' || boundary),
      lambda p: strpos(p, chr(10) || chr(10)) > 0 AND regexp_matches(p, 'Content-Type: text/(html|plain)'))[1] END AS part FROM pieces),
split AS (SELECT *, substr(part, strpos(part, chr(10) || chr(10)) + 2) AS part_text FROM chosen),
clean AS (SELECT *, trim(rtrim(trim(part_text, chr(10) || ' '), '-'), chr(10) || ' ') AS part_body FROM split),
decoded AS (SELECT item_id, folder_rank, ord, trim(substr(subject, 8)) AS title,
    CASE WHEN sender_field LIKE '%<%>%' THEN regexp_extract(sender_field, '<([^>]+)>', 1) ELSE sender_field END AS sender,
    date_field AS date,
    CASE WHEN boundary <> '' AND contains(part, 'base64') THEN decode(from_base64(part_body))
         WHEN boundary <> '' THEN part_body
         WHEN cte = 'quoted-printable' THEN trim(regexp_replace(url_decode(regexp_replace(replace(
           regexp_replace(replace(regexp_replace(body, '[^\\x00-\\x7F]', '?', 'g'), '%', '%25'), '=([0-9A-F][0-9A-F])', '%\\1', 'g'),
           '=' || chr(10), ''), '[+]', '%2B', 'g')), '\\nFrom[ -][^\\n]*', chr(10)), chr(10) || ' ')
         ELSE trim(regexp_replace(body, '\\nFrom[ -][^\\n]*', chr(10)), chr(10) || ' ') END AS body FROM clean)
"""


@query("split_message", "v_messages", sql=MESSAGES + "SELECT item_id, headers, body FROM parts")
def split_message(i):
    m = i.view("v_messages").withColumn("m", mail.split_message(F.col("raw")))
    return m.filter("m IS NOT NULL").select("item_id", "m.headers", "m.body")


@query("header", "v_messages", sql=MESSAGES + "SELECT item_id, subject, sender_field, date_field, ctype FROM fields")
def header(i):
    h = mail.split_message(F.col("raw"))["headers"]
    return i.view("v_messages").select("item_id", h.alias("h")).select(
        "item_id",
        mail.header(F.col("h"), "Subject").alias("subject"),
        mail.header(F.col("h"), "From").alias("sender_field"),
        mail.header(F.col("h"), "Date").alias("date_field"),
        mail.header(F.col("h"), "Content-Type").alias("ctype"),
    )


@query("filter_tagged", "v_messages", sql=MESSAGES + "SELECT item_id, title FROM decoded")
def filter_tagged(i):
    m = ops.prefilter_tagged(i.view("v_messages"))
    m = m.withColumn("subject", mail.header(mail.split_message(F.col("raw"))["headers"], "Subject"))
    return ops.filter_tagged(m).select("item_id", "title")


@query("sender_address", "v_messages", sql=MESSAGES + """
SELECT item_id, CASE WHEN sender_field LIKE '%<%>%' THEN regexp_extract(sender_field, '<([^>]+)>', 1) ELSE sender_field END AS sender
FROM fields""")
def sender_address(i):
    h = mail.split_message(F.col("raw"))["headers"]
    return i.view("v_messages").select("item_id", mail.sender_address(mail.header(h, "From")).alias("sender"))


@query("mail_date", "v_messages", sql=MESSAGES + """
SELECT item_id, CASE item_id % 4 WHEN 3 THEN 'yesterday' WHEN 1 THEN '2024-02-05T10:11:12+00:00' ELSE '2024-02-05T10:11:12+01:00' END AS date_parsed,
  CASE WHEN date_field = 'yesterday' THEN NULL ELSE strftime(strptime(
    regexp_replace(regexp_replace(date_field, '^[A-Za-z]{3}, ', ''), ' \\([A-Z]+\\)$', ''), '%-d %b %Y %H:%M:%S %z') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS date_utc
FROM fields""")
def parse_mail_date(i):
    h = mail.split_message(F.col("raw"))["headers"]
    d = i.view("v_messages").select("item_id", mail_date(mail.header(h, "Date")).alias("d"))
    return d.select("item_id", F.col("d.text").alias("date_parsed"), clock("d.ts").alias("date_utc"))


@query("select_body", "v_messages", sql=MESSAGES + "SELECT item_id, md5(body) AS body_md5, length(body) AS n FROM decoded")
def select_body(i):
    m = ops.parse_messages(i.view("v_messages"))
    return m.select("item_id", F.md5("body").alias("body_md5"), F.length("body").alias("n"))


@query("decode_b64", sql="""
SELECT doc_id, md5(decode(from_base64(to_base64(encode(text))))) AS back FROM documents""")
def decode_b64(i):
    lines = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{76})", "$1\r\n")
    return i.table("documents").select("doc_id", F.md5(mail.decode_b64(lines)).alias("back"))


@query("decode_qp", sql="SELECT doc_id, md5(text) AS back FROM documents")
def decode_qp(i):
    coded = F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(..)", "=$1")
    soft = F.regexp_replace(coded, "((?:=..){20})", "$1=\r\n")
    return i.table("documents").select("doc_id", F.md5(mail.decode_qp(soft)).alias("back"))


@query("union_folders", "v_messages", sql=MESSAGES + """
SELECT folder_rank, count(*) AS items, min(ord) AS first_ord, max(ord) AS last_ord FROM decoded GROUP BY folder_rank""")
def union_folders(i):
    m = ops.parse_messages(i.view("v_messages"))
    both = ops.union_folders(m.filter("folder_rank = 0"), m.filter("folder_rank = 1"))
    return both.groupBy("folder_rank").agg(
        F.count(F.lit(1)).alias("items"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")
    )


# ---- links of bodies -------------------------------------------------------------

UNESCAPE = "replace({}, '&amp;', '&')"
SRC = UNESCAPE.format("regexp_extract(body, 'originalsrc=\"([^\"]+)\"', 1)")
FIRST = {
    "url_from_originalsrc": f"""CASE WHEN strpos(trim(regexp_replace({SRC}, 'https?://[^/]+', '', 'g'), '/'), '/') > 0 THEN {SRC} END""",
    "url_from_text": UNESCAPE.format(
        "list_filter(regexp_extract_all(body, 'https?://[^\\s<>\"'']{10,}'), lambda u: NOT contains(u, 'safelinks.protection.outlook.com'))[1]"),
    "url_from_href": UNESCAPE.format("nullif(regexp_extract(body, '<a\\s[^>]*href=\"(https?://[^\"]+)\"', 1), '')"),
    "url_from_safelink": "url_decode(nullif(regexp_extract(body, 'https?://eur\\d*\\.safelinks\\.protection\\.outlook\\.com/\\?url=([^&\"\\s]+)', 1), ''))",
}
BEST = f"coalesce({', '.join(FIRST.values())}, '')"


def _link_query(name: str) -> None:
    @query(name, "v_bodies", sql=f"SELECT item_id, {FIRST[name]} AS url FROM v_bodies")
    def run(i):
        return i.view("v_bodies").select("item_id", getattr(links, name)(F.col("body")).alias("url"))


for _name in FIRST:
    _link_query(_name)


@query("best_url", "v_bodies", sql=f"SELECT item_id, {BEST} AS url FROM v_bodies")
def best_url(i):
    return i.view("v_bodies").select("item_id", links.best_url(F.col("body")).alias("url"))


# ---- titles and comments ------------------------------------------------------------


def letters_sql(c: str) -> str:
    return f"length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g'))"


def any_prefix(c: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)"


def boilerplate_sql(c: str) -> str:
    t = f"trim(lower({c}), {WS})"
    return (
        f"(length({t}) < 3 OR {t} IN ({in_list(V.BOILERPLATE_LINES)}) OR {any_prefix(t, V.BOILERPLATE_STARTS)}"
        f" OR {letters_sql(t)} < 3)"
    )


def comment_subject_sql(c: str) -> str:
    t = f"lower(trim({c}))"
    return f"({any_prefix(t, V.COMMENT_MARKS)} OR {any_prefix(t, V.COMMENT_PREFIXES)} OR regexp_matches({t}, '^(paper|here)\\b'))"


def title_sql(c: str) -> str:
    t = f"lower({c})"
    return (
        f"(length({c}) BETWEEN 20 AND 300 AND regexp_matches({c}, '^\\p{{Lu}}') AND NOT {any_prefix(t, V.COMMENT_PREFIXES)}"
        f" AND NOT {any_prefix(t, V.GREETING_STARTS)} AND regexp_matches({t}, '\\S+(?:\\s+\\S+){{3}}')"
        f" AND NOT regexp_matches({t}, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_-]+\\.')"
        f" AND NOT regexp_matches({t}, '\\.(pdf|docx?|pptx?|xlsx?)$') AND {letters_sql(t)} >= length({t}) * 0.4)"
    )


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'), {WS})"


LINE = "string_split(text, chr(10))"


@query("is_boilerplate", sql=f"""
, lines AS (SELECT doc_id, unnest(range(1, len({LINE}) + 1)) AS n, unnest({LINE}) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {boilerplate_sql('line')}) AS boilerplate FROM lines GROUP BY doc_id""")
def is_boilerplate(i):
    lines = F.split("text", "\n")
    return i.table("documents").select(
        "doc_id", F.size(lines).alias("lines"), F.size(F.filter(lines, titles.is_boilerplate)).alias("boilerplate")
    )


@query("is_comment_subject", "v_bodies", sql=f"SELECT item_id, {comment_subject_sql('subject')} AS remark FROM v_bodies")
def is_comment_subject(i):
    return i.view("v_bodies").select("item_id", titles.is_comment_subject(F.col("subject")).alias("remark"))


@query("looks_like_title", sql=f"""
, lines AS (SELECT doc_id, unnest({LINE}) AS line FROM documents)
SELECT doc_id, count(*) FILTER (WHERE {title_sql('line')}) AS title_lines FROM lines GROUP BY doc_id""")
def looks_like_title(i):
    found = F.filter(F.split("text", "\n"), titles.looks_like_title)
    return i.table("documents").select("doc_id", F.size(found).alias("title_lines"))


STRIPPED = "regexp_replace(regexp_replace(body, '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g')"
PLAIN = "string_split(regexp_replace(clean, '<[^>]+>', chr(10), 'g'), chr(10))"
NO_LINKS = (
    "regexp_replace(regexp_replace(regexp_replace({}, 'https?://\\S+', '', 'g'), '\\bwww\\.\\S+', '', 'g'), 'mailto:\\S+', '', 'g')"
)
ENT = "replace(replace({}, '&lt;', '<'), '&amp;', '&')"
TITLES = f"""
, cleaned AS (SELECT *, {STRIPPED} AS clean, {BEST} AS url FROM v_bodies),
lined AS (SELECT *, list_transform({PLAIN}, lambda s: {NO_LINKS.format(ENT.format(f'trim(s, {WS})'))}) AS title_lines FROM cleaned),
titled AS (SELECT *, list_filter(list_transform(list_filter(title_lines, lambda s: trim(s, {WS}) <> '' AND NOT {boilerplate_sql('s')}),
    lambda s: {collapse_sql('s')}), lambda s: {title_sql('s')})[1] AS body_title FROM lined),
cases AS (SELECT *, {comment_subject_sql('subject')} AS remark,
    (ends_with(subject, '=') OR contains(subject, '= ')) AND body_title IS NOT NULL
      AND (starts_with(lower(body_title), rtrim(rtrim({collapse_sql('lower(subject)')}, '='), ' '))
        OR starts_with(lower(body_title), lower(substr(trim(regexp_replace(subject, '\\s*=\\s*', ' ', 'g')), 1, 40)))) AS completed FROM titled),
picked AS (SELECT *, CASE WHEN body = '' THEN subject WHEN remark THEN coalesce(body_title, subject) WHEN completed THEN body_title ELSE subject END AS title FROM cases),
commented AS (SELECT *, {collapse_sql(f"array_to_string(list_filter(list_transform(list_filter(list_transform(string_split({ENT.format(f'array_to_string({PLAIN}, chr(10))')}, chr(10)), lambda s: trim(s, {WS})), lambda s: s <> '' AND NOT {boilerplate_sql('s')} AND {collapse_sql('s')} <> {collapse_sql('title')} AND rtrim(s, '/') <> rtrim(url, '/') AND s <> url), lambda s: trim(regexp_replace(s, 'https?://[^ ]+', '', 'g'), {WS})), lambda s: length(s) >= 3), ' ')")} AS left_over FROM picked)
"""


@query("title_from_body", "v_bodies", sql=TITLES + "SELECT item_id, body_title FROM titled")
def title_from_body(i):
    from loreline.functions.html import strip_style_script

    clean = strip_style_script(F.col("body"))
    return i.view("v_bodies").select("item_id", titles.title_from_lines(clean).alias("body_title"))


@query("comment_from_body", "v_bodies", sql=TITLES.replace("CASE WHEN body = ''", "CASE WHEN true") + """
SELECT item_id, md5(left_over) AS comment_md5, length(left_over) AS n FROM commented""")
def comment_from_body(i):
    b = i.view("v_bodies").withColumn("url", links.best_url(F.col("body")))
    comment = titles.comment_from_body(F.col("body"), F.col("subject"), F.col("url"))
    return b.select("item_id", comment.alias("c")).select("item_id", F.md5("c").alias("comment_md5"), F.length("c").alias("n"))


@query("resolve_title_comment", "v_bodies", sql=TITLES + """
SELECT item_id, url, title, md5(CASE WHEN body = '' THEN '' WHEN remark THEN subject ELSE left_over END) AS comment_md5 FROM commented""")
def resolve_title_comment(i):
    b = i.view("v_bodies").withColumnRenamed("subject", "title")
    done = ops.with_title_and_comment(b, dom=False)
    return done.select("item_id", "url", "title", F.md5("comment").alias("comment_md5"))


MARKS = "ltrim(CASE WHEN strpos(body, '^^') > 0 THEN substr(body, strpos(body, '^^') + 2) ELSE body END, '^ ')"


@query("display_comment", "v_bodies", sql=f"""
SELECT item_id, substr({MARKS}, 1, 500) AS feed_comment,
  CASE WHEN length({MARKS}) > 300 THEN substr({MARKS}, 1, 300) || '…' ELSE {MARKS} END AS page_comment FROM v_bodies""")
def display_comment(i):
    c = F.col("body")
    return i.view("v_bodies").select(
        "item_id", text.display_comment(c, 500).alias("feed_comment"), text.display_comment(c, 300, True).alias("page_comment")
    )


# ---- items ------------------------------------------------------------------------------

KEY = f"lower(trim(title, {WS}))"


@query("drop_blank_titles", "v_items", sql=f"SELECT item_id, trim(title, {WS}) AS title FROM v_items WHERE trim(title, {WS}) <> ''")
def drop_blank_titles(i):
    return ops.drop_blank_titles(i.view("v_items")).select("item_id", "title")


@query("fallback", "v_items", sql="""
SELECT item_id, coalesce(img, 'none') AS absent, coalesce(nullif(sender, ''), 'nobody') AS empty FROM v_items""")
def fallback(i):
    return i.view("v_items").select(
        "item_id",
        text.fallback(F.col("img"), F.lit("none")).alias("absent"),
        text.fallback(F.col("sender"), F.lit("nobody"), "empty").alias("empty"),
    )


@query("resolve_asset", "v_items", sql="""
SELECT item_id, CASE WHEN img LIKE 'http%' THEN img ELSE 'https://static.example.org/img/' || img END AS img FROM v_items""")
def resolve_asset(i):
    return i.view("v_items").select("item_id", text.resolve_asset(F.col("img"), "https://static.example.org").alias("img"))


@query("post_title", "v_items", sql="""
SELECT item_id, coalesce(img, 'Post ' || item_id || ' Of ' || upper(substr(folder, 1, 1)) || substr(folder, 2)) AS title FROM v_items""")
def post_titles(i):
    slug = F.concat(F.lit("post-"), "item_id", F.lit("-of-"), "folder")
    return i.view("v_items").select("item_id", post_title(F.col("img"), slug).alias("title"))


@query("dedupe_first", "v_items", sql=f"""
SELECT item_id, folder, title FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY folder_rank, ord) AS rn
  FROM v_items WHERE {KEY} <> '') WHERE rn = 1""")
def dedupe_first(i):
    return ops.dedupe_first(i.view("v_items").select("item_id", "folder", "title", "folder_rank", "ord"),
                            F.struct("folder_rank", "ord")).select("item_id", "folder", "title")


@query("carry_enrichment", "v_items", sql=f"""
, old AS (SELECT {KEY} AS k, arg_max(struct_pack(doi := doi, journal := journal), ord) AS o FROM v_items
  WHERE {KEY} <> '' AND (doi <> '' OR journal <> '') GROUP BY 1)
SELECT v.item_id, coalesce(o.doi, '') AS doi, coalesce(o.journal, '') AS journal
FROM v_items v LEFT JOIN old ON k = {KEY}""")
def carry_enrichment(i):
    v = i.view("v_items")
    new = v.select("item_id", "title")
    return ops.carry_enrichment(new, v.select("title", "doi", "journal", "ord")).select("item_id", "doi", "journal")


PEOPLE = "lower(c_name || '@lab.example.org')"


@query("with_sender_name", "v_items", sql=f"""
, people AS (SELECT {PEOPLE} AS email, max(c_name || ' of ' || c_mktsegment) AS name FROM customer GROUP BY 1)
SELECT item_id, coalesce(name, split_part(sender, '@', 1)) AS from_name FROM v_items LEFT JOIN people ON lower(sender) = email""")
def with_sender_name(i):
    people = i.table("customer").select(
        F.concat("c_name", F.lit("@lab.example.org")).alias("email"),
        F.concat("c_name", F.lit(" of "), "c_mktsegment").alias("name"),
    )
    return ops.with_sender_name(i.view("v_items"), people).select("item_id", "from_name")


@query("item_key", sql=f"SELECT doc_id, md5(lower(trim(text, {WS}))) AS item_key FROM documents")
def item_key(i):
    return i.table("documents").select("doc_id", text.item_key(F.col("text")).alias("item_key"))


@query("new_items", "v_items", sql=f"""
, stored AS (SELECT md5(lower(trim(title, {WS}))) AS k FROM v_items JOIN embeddings ON vec_id = item_id)
SELECT DISTINCT md5({KEY}) AS item_key FROM v_items WHERE md5({KEY}) NOT IN (SELECT k FROM stored)""")
def new_items(i):
    v = i.view("v_items")
    stored = v.join(i.table("embeddings"), F.col("vec_id") == F.col("item_id")).select(text.item_key(F.col("title")).alias("item_key"))
    return vectors.new_items(v, stored).select("item_key")


@query("exclude_noise", "v_topics", sql="SELECT item_id, topic FROM v_topics WHERE topic <> -1")
def exclude_noise(i):
    from loreline.operators.series import exclude_noise as drop

    return drop(i.view("v_topics")).select("item_id", "topic")


@query("attach_label", "v_topics", sql="""
, names AS (SELECT topic, max(topic_label) AS name FROM v_topics WHERE topic_label IS NOT NULL GROUP BY topic)
SELECT item_id, topic, coalesce(name, 'Other') AS topic_label FROM v_topics LEFT JOIN names USING (topic)""")
def attach_label(i):
    v = i.view("v_topics")
    names = v.filter("topic_label IS NOT NULL").groupBy("topic").agg(F.max("topic_label").alias("topic_label"))
    return lookup.attach_label(v.select("item_id", "topic"), names).select("item_id", "topic", "topic_label")
