"""One registered query for each operator, on its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.llm import (
    conversations, exact_dedup, exact_search, hnsw, lexical_search, licenses, lm_score, mixing, pii, sentencepiece, simhash, toxicity, warc,
)
from loreline.llm.common import stored, table, text_or_empty, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def piece_model() -> str:
    """The public tokenizer file; other models are passed to the operator by path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


LM_SQL = r"""
WITH listed AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT row_no, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed),
lined AS (SELECT row_no, i, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM placed WINDOW d AS (PARTITION BY row_no ORDER BY i)),
one AS (SELECT w, count(*) AS n FROM lined GROUP BY w),
two AS (SELECT v, w, count(*) AS n FROM lined WHERE v IS NOT NULL GROUP BY v, w),
three AS (SELECT u, v, w, count(*) AS n FROM lined WHERE u IS NOT NULL GROUP BY u, v, w),
scored AS (
  SELECT l.row_no, CASE
    WHEN l.u IS NOT NULL AND t3.n >= 2 THEN ln(t3.n / c3.n)
    WHEN l.v IS NOT NULL AND t2.n >= 2 THEN ln(t2.n / c2.n) + CASE WHEN l.u IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END
    ELSE ln(t1.n / (SELECT count(*) FROM lined)) + CASE WHEN l.v IS NULL THEN 0 WHEN l.u IS NULL THEN ln(0.4::DOUBLE) ELSE 2 * ln(0.4::DOUBLE) END END AS s
  FROM lined l JOIN one t1 ON l.w = t1.w LEFT JOIN two t2 ON l.v = t2.v AND l.w = t2.w LEFT JOIN one c2 ON l.v = c2.w
    LEFT JOIN three t3 ON l.u = t3.u AND l.v = t3.v AND l.w = t3.w LEFT JOIN two c3 ON l.u = c3.v AND l.v = c3.w)
SELECT any_value(d.doc_id) AS doc_id, count(s.s) AS n_words, round(coalesce(sum(s.s), 0), 4) + 0.0 AS score
FROM listed d LEFT JOIN scored s ON d.row_no = s.row_no GROUP BY d.row_no
"""


@query(LM_SQL)
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.lm_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", (F.round("score", 4) + F.lit(0.0)).alias("score"))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


EXACT_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW same AS (PARTITION BY coalesce(text, '')))
"""


@query(EXACT_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long"), "kept", "text_sha256")


@query()
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", sentencepiece.round_trip("text", piece_model()).alias("coded"))
    return coded.select("doc_id", "coded.*").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = warc.write_warc(pages, warc.archive_folder(spark))
    read = warc.read_warc(manifest).select("page", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("bytes"))
    read = stored(read, "warc-read")
    # A revisit's payload is that of the response it names.
    full = stored(read.where("record_type = 'response'").select(F.col("page").alias("of"), F.col("payload_digest").alias("same"), F.col("bytes").alias("full")).distinct(), "warc-full")
    sized = read.join(full, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("same")), "left")
    return sized.select(
        F.col("page").try_cast("long").alias("page_id"),
        F.coalesce("bytes", "full").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS n FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370497.0)
    / CASE WHEN size > 0 THEN greatest(0.25, 1 / (1 + abs(n / size - 6.5::DOUBLE) / 6.5::DOUBLE)) ELSE 0.25::DOUBLE END AS key
  FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS top FROM sources),
lined AS (
  SELECT *, top / weight AS reach,
    (sum(source_size) OVER ()::DOUBLE - coalesce(sum(top) OVER below, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS held
  FROM weighed WINDOW below AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT held AS level FROM lined WHERE reach > held ORDER BY reach, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR reach <= level THEN top ELSE level * weight END AS target
  FROM lined LEFT JOIN level ON true),
drawn AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS running
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * (epochs + CASE WHEN 2 * running - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""


@query(MIX_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The texts are read once; what the mix sorts and sums is a narrow table.
    text = text_or_empty("text")
    sized = docs.select("doc_id", "source", word_count(text).alias("words"), text.alias("text"))
    narrow = stored(sized.select("doc_id", "source", "words", mixing.prose_quality(F.col("text"), F.col("words")).alias("prose")), "mix-sizes")
    drawn = mixing.mix(narrow.withColumn("text", F.lit(None).cast("string")), size=F.col("words"), quality=F.col("prose"))
    return drawn.select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def licence_sql() -> str:
    """The scan in SQL; templates are given as rows."""
    rows = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(licenses.TEMPLATES))
    return rf"""
WITH templates AS (SELECT tno, licence, regexp_extract_all(lower(t), '[a-z0-9]+(?:\.[0-9]+)*') AS ts FROM (VALUES {rows}) AS v(tno, licence, t)),
files AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:\.[0-9]+)*') AS words,
    source || '/' || (doc_id // 1000) || '/' || (doc_id // 50) || CASE WHEN doc_id % 10 = 0 THEN '/LICENSE' ELSE '/' || doc_id || '.txt' END AS path,
    doc_id % 10 = 0 AS is_file FROM documents),
tplaces AS (SELECT tno, licence, generate_subscripts(ts, 1) - 1 AS place, unnest(ts) AS term, len(ts) AS size FROM templates),
vocabulary AS (SELECT DISTINCT term FROM tplaces),
total AS (SELECT count(*) AS n FROM files),
shown AS (SELECT row_no, unnest(list_distinct(words)) AS term FROM files),
idf AS (SELECT term, ln((n + 1) / (count(row_no) + 1)) + 1 AS w FROM vocabulary LEFT JOIN shown USING (term), total GROUP BY term, n),
tweights AS (SELECT tno, any_value(licence) AS licence, any_value(size) AS size, term, count(*) * any_value(w) AS weight FROM tplaces JOIN idf USING (term) GROUP BY tno, term),
tnorms AS (SELECT tno, sqrt(sum(weight * weight)) AS norm FROM tweights GROUP BY tno),
anchored AS (
  SELECT tno, term FROM (SELECT tno, term, sum(weight * weight) OVER (PARTITION BY tno ORDER BY weight DESC, term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    sum(weight * weight) OVER (PARTITION BY tno) AS whole FROM tweights) WHERE rest >= {licenses.LEAST} * {licenses.LEAST} * whole),
worded AS (SELECT row_no, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS at_word FROM files),
begun AS (SELECT row_no, tno, at_word - place AS start, w * w AS mass FROM worded JOIN tplaces USING (term) JOIN anchored USING (tno, term) JOIN idf USING (term)),
lined AS (SELECT row_no, tno, start, round(sum(mass), 6) AS mass FROM begun GROUP BY ALL),
best AS (SELECT row_no, tno, start FROM lined QUALIFY row_number() OVER (PARTITION BY row_no, tno ORDER BY mass DESC, start) = 1),
sizes AS (SELECT DISTINCT tno, size FROM tweights),
passages AS (
  SELECT row_no, tno, term, count(*) AS tf FROM best JOIN sizes USING (tno) JOIN worded USING (row_no) WHERE at_word >= start AND at_word < start + size GROUP BY ALL),
norms AS (SELECT row_no, tno, sqrt(sum(pow(tf * coalesce(w, ln(n + 1) + 1), 2))) AS norm FROM passages LEFT JOIN idf USING (term), total GROUP BY ALL),
dots AS (SELECT row_no, tno, any_value(licence) AS licence, sum(tf * w * weight) AS dot FROM passages JOIN tweights USING (tno, term) JOIN idf USING (term) GROUP BY row_no, tno),
marked AS (SELECT DISTINCT row_no FROM begun JOIN files USING (row_no) WHERE is_file),
whole AS (SELECT row_no, term, count(*) AS tf FROM worded JOIN marked USING (row_no) GROUP BY ALL),
wnorms AS (SELECT row_no, sqrt(sum(pow(tf * coalesce(w, ln(n + 1) + 1), 2))) AS norm FROM whole LEFT JOIN idf USING (term), total GROUP BY ALL),
wdots AS (SELECT row_no, tno, any_value(licence) AS licence, sum(tf * w * weight) AS dot FROM whole JOIN tweights USING (term) JOIN idf USING (term) GROUP BY row_no, tno),
cosines AS (
  SELECT row_no, licence, round(dot / (norms.norm * tnorms.norm), 6) AS score FROM dots JOIN norms USING (row_no, tno) JOIN tnorms USING (tno)
  UNION ALL SELECT row_no, licence, round(dot / (wnorms.norm * tnorms.norm), 6) FROM wdots JOIN wnorms USING (row_no) JOIN tnorms USING (tno)),
own AS (SELECT row_no, licence, score FROM cosines WHERE score >= {licenses.LEAST} QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY score DESC, licence) = 1),
placed AS (
  SELECT f.row_no, doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS folder, is_file, licence, score FROM files f LEFT JOIN own o ON f.row_no = o.row_no),
granted AS (SELECT folder AS above, licence, score FROM placed WHERE is_file AND licence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, licence) = 1),
inherited AS (
  SELECT f.folder, g.licence, g.score FROM (SELECT DISTINCT folder FROM placed) f JOIN granted g ON f.folder = g.above OR starts_with(f.folder, g.above || '/')
  QUALIFY row_number() OVER (PARTITION BY f.folder ORDER BY length(g.above) DESC) = 1)
SELECT doc_id, path, coalesce(p.licence, i.licence) AS licence, coalesce(p.score, i.score) AS score,
  CASE WHEN p.licence IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN i.licence IS NOT NULL THEN 'inherited' END AS origin
FROM placed p LEFT JOIN inherited i ON p.folder = i.folder
"""


@query(licence_sql())
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no paths: a document's source is a repository, its number gives directory and file.
    name = F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    folder = [F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 50)]
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", *folder, name))
    return licenses.license_scan(docs)


@query()
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "fingerprint", "component_id")


@query()
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))

    def count(i: int, kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{kind}")

    counts = [count(i, kind) for i, kind in enumerate(pii.KINDS)]
    everything = F.array_sort(F.concat("base", "more"))
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(everything).alias("spans"))


REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE kind <> 0),
lined AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare FROM damaged),
marked AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM lined),
counted AS (
  SELECT conv_id, count(*) AS turns, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
moves(state, x, next) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u'), ('', '-', ''), ('s', '-', 's'), ('u', '-', 'u'), ('a', '-', 'a')),
puts(state, mid, price, letters, lines) AS (
  VALUES ('', '', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''), ('', 'u', 5, 'I', chr(10) || 'user:'), ('s', 'u', 5, 'I', chr(10) || 'user:'),
    ('a', 'u', 5, 'I', chr(10) || 'user:'), ('u', 'a', 5, 'I', chr(10) || 'assistant:'),
    ('', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
acts AS (
  SELECT conv_id, i, 'D' AS letter, '-' AS x, 2 AS price, '' AS line FROM marked
  UNION ALL SELECT conv_id, i, 'K', left(role, 1), CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, chr(10) || role || ':' || text FROM marked WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, 'R', r[1], CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, chr(10) || r || ':' || text FROM marked, (VALUES ('user'), ('assistant')) AS v(r)
    WHERE fault IN ('', 'truncated')),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, struct_pack(cost := 0, audit := '', lines := '') AS best FROM counted
  UNION ALL
  SELECT s.conv_id, a.i, m.next AS state,
    min(struct_pack(cost := s.best.cost + p.price + a.price, audit := s.best.audit || p.letters || a.letter, lines := s.best.lines || p.lines || a.line)) AS best
  FROM steps s JOIN puts p ON p.state = s.state JOIN acts a ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND a.i = s.i + 1 JOIN moves m ON m.state = p.mid AND m.x = a.x
  GROUP BY s.conv_id, a.i, m.next),
ended AS (
  SELECT s.conv_id, min(struct_pack(cost := s.best.cost + p.price, audit := s.best.audit || p.letters, lines := s.best.lines || p.lines)) AS best
  FROM steps s JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.turns = s.i JOIN puts p ON p.state = s.state AND p.mid IN ('', 'a') GROUP BY s.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(substr(coalesce(e.best.lines, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


@query(REPAIR_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    fixed = conversations.repaired(conversations.damaged(rows))
    reports = stored(fixed.reports.join(conversations.digests(fixed.turns), "key", "left").withColumnRenamed("key", "r_key"), "repair-reports")
    ids = rows.select("conv_id").distinct()
    empty = hashlib.sha256().hexdigest()
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(reports, conversations.key_of(F.col("conv_id")) == F.col("r_key"), "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(empty)).alias("repaired_sha256")
    )


LEXICAL_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
placed AS (SELECT row_no, unnest(ts) AS t FROM cut),
total AS (SELECT count(*) AS l, count(DISTINCT row_no) AS n FROM placed),
freq AS (SELECT row_no, t, count(*) AS tf FROM placed GROUP BY row_no, t),
weights AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM freq, total GROUP BY t, n),
sizes AS (SELECT row_no, 75 + (25 * len(ts) * n) // l AS m FROM cut, total),
asked AS (SELECT item_no, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS item_no, * FROM benchmark)),
scored AS (
  SELECT item_no, any_value(item_id) AS item_id, f.row_no, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN freq f USING (t) JOIN weights USING (t) JOIN sizes s ON f.row_no = s.row_no GROUP BY item_no, f.row_no),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scored JOIN cut USING (row_no) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query(LEXICAL_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TOP_K_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.row_no ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id NULLS LAST) AS rank
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.row_no <> c.row_no AND len(q.v) = len(c.v))
WHERE rank <= 20
"""


@query(TOP_K_SQL)
def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
