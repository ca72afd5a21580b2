"""Hand vectors: small literals whose results are known."""

import base64
import math
import quopri

import pytest
from pyspark.sql import functions as F

from loreline.functions import dates, html, identifiers, links, mail, rules, stats, text, titles
from loreline.operators import items as ops
from loreline.operators import lookup, series
from loreline.operators import text as terms
from loreline.plans.extract import collect_items, extract_items
from loreline.sources.archives import read_mail_archive

MBOX = """From a@b Mon
Subject: [paper] A study of
  folded things
From: "X Y" <x@lab.org>

body one
From c@d Tue
Subject: RE: [paper] A study

reply
From e@f Wed
subject: [paper] lower-case header

never selected
"""


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def many(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize("y, slope, p", [
    ([1, 1, 1], 0.0, None),
    ([3, 2, 1], -1.0, 0.0),
    ([1, 1, 2], 0.5, 0.333333),
    ([1, 3, 2], 0.5, 0.666667),
])
def test_regression(spark, y, slope, p):
    rows = [(float(v), float(x)) for x, v in enumerate(y)]
    r = spark.createDataFrame(rows, "y double, x double").agg(
        F.count("y").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_sxx("y", "x").alias("xx"), F.regr_sxy("y", "x").alias("xy"), F.regr_syy("y", "x").alias("yy"),
    ).select("slope", stats.slope_p_value(F.col("n"), F.col("xx"), F.col("xy"), F.col("yy")).alias("p")).first()
    assert r["slope"] == pytest.approx(slope)
    assert r["p"] is None if p is None else r["p"] == pytest.approx(p, abs=1e-6)


def student_two_sided(t: float, nu: int) -> float:
    """Brute force: the density of Student's t summed by the midpoint rule."""
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    steps = 40_000
    h = t / steps
    inside = sum((1 + ((k + 0.5) * h) ** 2 / nu) ** (-(nu + 1) / 2) for k in range(steps)) * h * c
    return 1 - 2 * inside


def test_p_value_against_integration(spark):
    cases = [(n, r2) for n in (3, 4, 5, 6, 9, 46, 80) for r2 in (0.01, 0.2, 0.7)]
    df = spark.createDataFrame([(n, r2) for n, r2 in cases], "n int, r2 double")
    one_ = F.lit(1.0)
    got = df.select("n", "r2", stats.slope_p_value(F.col("n"), one_, F.sqrt("r2"), one_).alias("p")).collect()
    for row in got:
        nu = row["n"] - 2
        t = math.sqrt(row["r2"] * nu / (1 - row["r2"]))
        assert row["p"] == pytest.approx(student_two_sided(t, nu), abs=1e-6)


def test_series_start(spark):
    days = ["2022-09-19", "2022-10-05", "2022-10-20", "2022-11-02", "2023-03-10"]
    items = spark.createDataFrame([(d + " 05:30:00", 1) for d in days], "ts string, topic int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = series.topic_trends(items).filter("topic = -1").orderBy("date").collect()
    assert [r["count"] for r in got] == [2, 1, 0, 0, 0, 1]
    assert [round(r["smoothed"], 6) for r in got] == [2.0, 1.5, 1.0, 0.333333, 0.0, 0.333333]
    assert got[0]["year_month"] == "2022-10"
    assert [r["x"] for r in got] == list(range(6))


def test_month_grid(spark):
    df = spark.sql("SELECT timestamp'2022-09-19 05:30:00' lo, timestamp'2022-12-01 04:00:00' hi")
    got = df.select(dates.month_grid(F.col("lo"), F.col("hi")).alias("g")).first()["g"]
    assert [str(t) for t in got] == ["2022-10-01 05:30:00", "2022-11-01 05:30:00"]
    same = spark.sql("SELECT timestamp'2022-09-19 05:30:00' lo").select(dates.month_grid(F.col("lo"), F.col("lo")).alias("g"))
    assert same.first()["g"] == []


def test_week_key(spark):
    days = ["2024-01-01", "2023-01-01", "2026-12-01", "2026-01-03"]
    got = many(spark, days, lambda c: dates.week_key(c.cast("timestamp")))
    assert got == ["2024-01", "2023-00", "2026-48", "2026-00"]


def test_significance_switch(spark):
    few = spark.createDataFrame([(1, 0.05), (2, 0.5), (3, None)], "topic int, p_value double")
    assert series.significant_or_all(few).count() == 3
    some = spark.createDataFrame([(1, 0.05), (2, 0.01), (3, 0.0), (4, 0.5), (5, None)], "topic int, p_value double")
    assert sorted(r["topic"] for r in series.significant_or_all(some).collect()) == [1, 2, 3]


def test_empty_growth_has_columns(spark):
    none = spark.createDataFrame([], "topic int, ts timestamp")
    got = series.topic_growth(none)
    assert got.count() == 0 and "hot" in got.columns


def test_hot_is_decided_on_rounded_growth(spark):
    g = spark.createDataFrame([(1, 0.10004), (2, 0.1001), (3, -0.2)], "topic int, growth_rate_3mo double")
    g = g.withColumn("growth_rate_3mo", stats.round_metric(F.col("growth_rate_3mo"), 4))
    got = {r["topic"]: (r["hot"], r["cold"]) for r in series.flag_hot_cold(g).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, True)}


def test_archive_to_items(spark, tmp_path):
    (tmp_path / "inbox.mbox").write_text(MBOX)
    (tmp_path / "sent.mbox").write_text("From z@z Thu\nSubject: [paper] a STUDY of folded things\nFrom: z@lab.org\n\nsecond copy\n")
    paths = [str(tmp_path / "inbox.mbox"), str(tmp_path / "sent.mbox")]
    raw = read_mail_archive(spark, [("inbox", 0, paths[0]), ("sent", 1, paths[1])])
    assert raw.filter("folder = 'inbox'").count() == 3
    assert not raw.filter("raw LIKE 'From %'").count()
    items = extract_items(raw).collect()
    assert [(r["title"], r["sender"], r["folder_rank"]) for r in items] == [("A study of folded things", "x@lab.org", 0)]
    assert items[0]["comment"] == "body one"


def test_archive_blocks_do_not_lose_messages(spark, tmp_path):
    """Small splits: separators fall on block borders too."""
    mails = [f"From a@b Mon\nSubject: [paper] Item {n}\n\nbody {n} {'x' * (n % 97)}\n" for n in range(3000)]
    (tmp_path / "big.mbox").write_text("".join(mails))
    path = str(tmp_path / "big.mbox")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        raw = read_mail_archive(spark, [("inbox", 0, path)])
        assert raw.rdd.getNumPartitions() > 8
        order = [r["n"] for r in raw.orderBy("ord").select(F.regexp_extract("raw", r"Item (\d+)", 1).cast("int").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert order == list(range(3000))


def test_collect_items_writes_the_item_table(spark, tmp_path):
    (tmp_path / "inbox.mbox").write_text(MBOX.replace("body one", "see https://doi.org/10.1101/2024.1 now"))
    path = str(tmp_path / "inbox.mbox")
    raw = read_mail_archive(spark, [("inbox", 0, path)])
    dim = spark.createDataFrame([("10.1101/2024.1", ["Journal of Tests"])], "doi string, container_titles array<string>")
    out = str(tmp_path / "items")
    collect_items(raw, dim, out)
    rows = spark.read.parquet(out).collect()
    assert [(r["from"], r["url"], r["doi"], r["journal"]) for r in rows] == [
        ("x@lab.org", "https://doi.org/10.1101/2024.1", "10.1101/2024.1", "Journal of Tests")
    ]


def test_two_tagged_lines_are_two_hits(spark):
    raw = "a@b Mon\nSubject: [paper] One\n\nquoted\nSubject: [paper] One again\n"
    df = spark.createDataFrame([(0, 0, raw)], "folder_rank int, ord int, raw string")
    assert ops.parse_messages(df).first()["hits"] == 2


def test_adjoining_headers_last_one_counts(spark):
    h = "X: a\nSubject: first\nSubject: second\nY: b\nSubject: third"
    assert one(spark, h, lambda c: mail.header(c, "Subject")) == "second"
    assert one(spark, h, lambda c: mail.header(c, "Missing")) == ""


def test_base64(spark):
    assert one(spark, "PHA+aGVs\nbG88L3A+", mail.decode_b64) == "<p>hello</p>"
    assert one(spark, "not*base64!", mail.decode_b64) == "not*base64!"
    assert one(spark, base64.b64encode(b"caf\xe9").decode(), mail.decode_b64) == "caf�"


@pytest.mark.parametrize("coded", [
    "plain", "a=3Db", "caf=C3=A9", "soft=\nbreak", "soft=\r\nbreak", "==41", "=4=\n1", "100% + 2", "=C3=\n=A9", "end=", "x=ZZ=3d",
])
def test_quoted_printable_like_the_standard_library(spark, coded):
    want = quopri.decodestring(coded.encode("ascii", errors="replace")).decode("utf-8", errors="replace")
    assert one(spark, coded, mail.decode_qp) == want


def test_multipart_boundary_with_metacharacters(spark):
    body = "--a+b.(c)\nContent-Type: text/plain\n\nplain text\n--a+b.(c)\nContent-Type: text/html\n\n<p>rich</p>\n--a+b.(c)--\n"
    got = one(spark, body, lambda c: mail.select_body(c, F.lit('multipart/mixed; boundary="a+b.(c)"'), F.lit("")))
    assert got == "plain text"
    assert one(spark, "no parts\nFrom here cut\nleft", lambda c: mail.select_body(c, F.lit(""), F.lit(""))) == "no parts\n\nleft"


def test_links(spark):
    safe = "https://eur03.safelinks.protection.outlook.com/?url=https%3A%2F%2Fx.org%2Fp%2F3&data=05"
    assert one(spark, safe, links.url_from_safelink) == "https://x.org/p/3"
    assert one(spark, safe.replace("%2F3", "%2Fa+b%zz"), links.url_from_safelink) == "https://x.org/p/a+b%zz"
    assert one(spark, 'originalsrc="https://home.example.org/"', links.url_from_originalsrc) is None
    assert one(spark, "nothing", links.best_url) == ""
    assert one(spark, '<A class="x" HREF="https://a.io/1">t</A>', links.url_from_href) == "https://a.io/1"


def test_comment_display(spark):
    assert one(spark, "header ^^ ^ tail ^^ rest", text.strip_marks) == "tail ^^ rest"
    assert one(spark, "abcdef", lambda c: text.display_comment(c, 3, True)) == "abc…"


def test_doi_edges(spark):
    assert one(spark, "10.1/abc.?x", identifiers.clean_doi) == "10.1/abc."
    # A known host without DOI ends the search, although a later pattern would match.
    url = "https://www.cell.com/cell/fulltext/S0092-8674?x=science.org/doi/10.1126/x"
    assert one(spark, url, identifiers.doi_from_url) == "10.1126/x"
    assert one(spark, "https://www.cell.com/cell/fulltext/S0092-8674(24)1", identifiers.doi_from_url) is None


HAND = {
    0: ("10.1016/j.cell.2024.0", None), 1: ("10.1101/2024.11.14.1v1", "bioRxiv"), 2: ("10.1038/s41586-024-2", "Nature"),
    3: ("10.1038/s41592-026-3", "Nature Group"), 4: ("10.1126/sciadv.4", "Science"), 5: ("10.1073/pnas.5", "PNAS"),
    6: ("10.1371/journal.pone.6", "PLOS"), 7: ("10.1111/acel.7", "Wiley"), 8: ("10.1007/s008", "Springer"),
    9: ("10.1186/s13059-9", None), 10: (None, "Cell Reports Medicine"), 11: (None, "Trends in Genetics"),
    12: ("10.1016/j.S0092867412", "Cell"), 13: ("10.1016/PIIS0140-13/fulltext", "The Lancet"), 14: ("10.7554/eLife.90014", "eLife"),
    15: (None, "Oxford University Press"), 16: ("10.1093/nar/gk16", "Oxford University Press"), 17: (None, "arXiv"), 18: (None, None),
    19: ("10.48550/arXiv.2401.19", "arXiv"), 20: ("10.1186/s13073-20", None), 21: ("10.1038/S41467-21", "Nature Communications"),
    22: (None, None), 23: (None, None), 24: ("10.1212/WNL.24", None),
}


def test_doi_and_journal_of_hand_links(spark):
    from loreline.plans.bindings import VIEWS, dialect

    spark.range(25).selectExpr("id AS page_id", "'' AS url").createOrReplaceTempView("hand_pages")
    v = spark.sql(dialect(VIEWS["v_urls"], "spark").rsplit("FROM pages", 1)[0] + "FROM hand_pages")
    doi = identifiers.doi_from_url(F.col("url"))
    journal = F.coalesce(identifiers.journal_by_domain(F.col("url")), identifiers.journal_by_doi_prefix(doi))
    got = {r["page_id"]: (r["doi"], r["journal"]) for r in v.select("page_id", doi.alias("doi"), journal.alias("journal")).collect()}
    assert got == HAND


def test_own_hosts_are_no_journal(spark):
    url = "https://www.nature.com.proxy.example.org/articles/s41586-1"
    assert one(spark, url, identifiers.journal_by_domain) == "Nature"
    assert one(spark, url, lambda c: identifiers.journal_by_domain(c, own_hosts=("example.org",))) is None


def test_rule_forms_agree(spark):
    from loreline.functions import fixed_values as V

    paths = [s for s, _ in V.NATURE_PATHS] + ["/articles/s41586-1/nbt", "/none", ""]
    a = many(spark, paths, lambda c: rules.first_segment(c, V.NATURE_PATHS))
    b = many(spark, paths, lambda c: rules.first_segment_chain(c, V.NATURE_PATHS))
    table = spark.createDataFrame([(n, s, v) for n, (s, v) in enumerate(V.NATURE_PATHS)], "ord int, segment string, value string")
    df = spark.createDataFrame(list(enumerate(paths)), "i int, v string")
    c = [r["match"] for r in lookup.match_first_rule(df, table, "v", "i").orderBy("i").collect()]
    assert a == b == c


def test_rules_of_all_lengths(spark):
    table = spark.createDataFrame([(3, "", "ALL"), (1, "abc/x", "X"), (2, "abd/y", "Y"), (0, "q", "Q")], "ord int, segment string, value string")
    df = spark.createDataFrame([(1, "abc/x"), (1, "abd/y"), (2, None), (3, ""), (4, "-q-abc/x")], "i int, v string")
    got = sorted((r["i"], r["v"], r["match"]) for r in lookup.match_first_rule(df, table, "v", "i").filter("v IS NOT NULL").collect())
    assert got == [(1, "abc/x", "X"), (1, "abd/y", "Y"), (3, "", "ALL"), (4, "-q-abc/x", "Q")]
    assert [r["match"] for r in lookup.match_first_rule(df, table, "v", "i").filter("v IS NULL").collect()] == [None]


def test_items_without_a_time(spark):
    from loreline.operators import series

    rows = [(1, "2024-01-01 00:00:00"), (1, None), (2, "2024-03-05 10:00:00"), (None, "2024-02-01 00:00:00")]
    items = spark.createDataFrame(rows, "topic int, t string").selectExpr("topic", "to_timestamp(t) AS ts")
    months = {(r["year_month"], r["topic"]): r["count"] for r in series.monthly_counts(items).collect()}
    assert months["2024-01", -1] == months["2024-02", -1] == months["2024-03", -1] == 1
    assert months["2024-01", 1] == 1 and months["2024-02", 1] == 0
    assert sum(r["count"] for r in series.weekly_counts(items).collect()) == 3
    assert series.topic_growth(items).collect() == []


def test_keys_and_groups_stay_apart(spark):
    rows = [(None, "g", 5), ("k", "g", 3), ("k", None, 4)]
    got = lookup.latest_by_key(spark.createDataFrame(rows, "key string, `group` string, ts int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(None, "g", "key", 5), ("k", "g", "key", 3), ("k", None, "key", 4), (None, "g", "group", 5), (None, None, "group", 4)], key=str
    )


def test_page_keys(spark):
    paths = ["lab-manual/collab-notes/index.html", "lab-manual/index.html", "lab-manual/a/b/index.html", "p/post-1/index.html", "p/a/b/c.html", "x.html"]
    got = many(spark, paths, lambda c: lookup.page_key(c, F.lit(None).cast("string"), "lab-manual"))
    assert got == ["lab-manual:collab-notes", "lab-manual:index", "lab-manual:a/b", "post:post-1", None, None]


def test_feed_dates_keep_their_offset(spark):
    got = many(spark, ["2024-02-05T10:11:12+01:00", "2024-02-05 10:11:12 -0530", "2024-02-05T10:11:12Z", "2024-02-05T10:11:12", "yesterday"], dates.feed_pubdate_text)
    assert got == ["Mon, 05 Feb 2024 10:11:12 +0100", "Mon, 05 Feb 2024 10:11:12 -0530", *["Mon, 05 Feb 2024 10:11:12 +0000"] * 2, None]

def test_mail_dates(spark):
    got = many(spark, [
        "Mon, 05 Feb 2024 10:11:12 +0100 (CET)", "yesterday", "5 Feb 2024 10:11:12 GMT", "31 Feb 2024 10:11:12 +0000",
    ], dates.mail_date)
    assert [str(r["ts"]) for r in got] == ["2024-02-05 09:11:12", "None", "2024-02-05 10:11:12", "None"]
    assert [r["text"] for r in got] == ["2024-02-05T10:11:12+01:00", "yesterday", "2024-02-05T10:11:12", "31 Feb 2024 10:11:12 +0000"]


def test_commit_dates(spark):
    got = many(spark, ["2024-02-05 10:11:12 +0100", "2024-02-05T10:11:12Z", "2024-02-05 10:11:12 +02:00"], dates.commit_date)
    assert [str(t) for t in got] == ["2024-02-05 09:11:12", "2024-02-05 10:11:12", "2024-02-05 08:11:12"]


def test_item_key(spark):
    assert one(spark, " Ab ", text.item_key) == "187ef4436122d1cc2f40dc2b92f0eba0"


def test_entities(spark):
    cases = [
        "a &amp;lt; b", "&#233;&#xE9; &#x1F600;", "&copy; &#; &unknown;", "plain", "x &#8211; y &nbsp;z", "&alpha;&ge;&rarr;&aacute;&Auml;",
        "&#146;&#150;&#128;&#129;", "&lt &ltx &notit; &amp &", "&#38;lt;b&#38;gt;", "&#0;&#13;&#xD800;&#x110000;&#99999999999999999999;", "&#1;&#xFFFE;x", "&#65&#66", "&NotEqualTilde;&",
    ]
    import html as std

    assert many(spark, cases, html.unescape) == [std.unescape(c) for c in cases]


def test_signature_elements_go_with_all_they_hold(spark):
    page = '<div>Keep <b>this</b><div id="x-Signature"><p>Name<br>Lab</p><div>deep</div></div> and this</div><p class="ms signature1">no</p>'
    assert one(spark, page, html.strip_signature) == "<div>Keep <b>this</b> and this</div>"
    assert one(spark, "1 &lt; 2 &amp; <br/>3", html.strip_signature) == "1 &lt; 2 &amp; <br/>3"


def test_block_texts(spark):
    page = "<div> a <span>b</span><p>c<p>d</div><p></p>e"
    got = one(spark, page, html.dom_view)
    assert got["blocks"] == ["abcd", "b", "cd", "d"]


def resolve(spark, subject, body):
    df = spark.createDataFrame([(1, subject, body)], "item_id int, title string, body string")
    return [(r["title"], r["comment"]) for r in ops.with_title_and_comment(df).collect()][0]


def test_title_and_comment(spark):
    title = "Cells of many tissues age at different rates"
    body = f"<div>{title}</div><p>Nice figures in this one</p><a href='https://x.org/paper/123456'>link</a>"
    # a remark changes places with the title found in the body
    assert resolve(spark, "Here is a nice one", body) == (title, "Here is a nice one")
    assert resolve(spark, "check this", "short") == ("check this", "check this")
    # a broken subject is completed
    got = resolve(spark, "Cells of many tissues =", body)
    assert got[0] == title and got[1].startswith("Nice figures in this one")
    # any other subject stays
    assert resolve(spark, "My title", body)[0] == "My title"
    assert resolve(spark, "My title", "") == ("My title", "")


def test_title_rules(spark):
    got = many(spark, [
        "Cells of many tissues age", "cells of many tissues age well", "Only three longwordshere", "Thanks for the nice paper there",
        "Report of the annual meeting.pdf", "Write to me at someone@example.org", "1234 5678 9012 3456 A b c d",
    ], titles.looks_like_title)
    assert got == [True, False, False, False, False, False, False]


def test_dedupe_is_idempotent(spark):
    rows = [(0, 1, " Same "), (1, 1, "same"), (0, 2, "other"), (0, 3, "  ")]
    df = spark.createDataFrame(rows, "folder_rank int, ord int, title string")
    order = F.struct("folder_rank", "ord")
    once = ops.dedupe_first(df, order)
    assert sorted((r["folder_rank"], r["ord"]) for r in once.collect()) == [(0, 1), (0, 2)]
    assert ops.dedupe_first(once, order).count() == 2


def test_asof_against_brute_force(spark):
    import random

    rnd = random.Random(7)
    # One hot key holds most rows; ties between points and bounds occur.
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(4)}", rnd.randrange(200), n) for n in range(600)]
    bounds, points = rows[:150], rows[150:]
    bounds = list({(k, p): (k, p, n) for k, p, n in bounds}.values())
    schema = "k string, p int, id int"
    got = lookup.asof_locate(
        spark.createDataFrame(points, schema), spark.createDataFrame([(k, p) for k, p, _ in bounds], "k string, p int"),
        ["k"], ["p"], F.floor(F.col("p") / 16),
    ).collect()
    want = {}
    for k, p, n in points:
        line = sorted(b for kk, b, _ in bounds if kk == k)
        before = [b for b in line if b <= p]
        if before:
            after = [b for b in line if b > p]
            want[n] = (before[-1], after[0] if after else None)
    assert {r["id"]: (r["start"]["p"], r["end"]["p"] if r["end"] else None) for r in got} == want


def test_terms(spark):
    got = one(spark, "The Deep deep learning of cells, a deep learning", lambda c: terms.term_counts(terms.ngrams_1_2(c)))
    assert {r["term"]: r["tf"] for r in got} == {
        "deep": 3, "learning": 2, "cells": 1, "deep deep": 1, "deep learning": 2, "learning cells": 1, "cells deep": 1,
    }
    assert one(spark, "été on é", lambda c: terms.tokens(c, ())) == ["été", "on"]
    assert one(spark, "a", lambda c: terms.term_counts(terms.ngrams_1_2(c))) == []


def test_tfidf_lengths_are_one(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "")], "id int, t string")
    w = terms.tfidf(df, F.col("t"), "id", k=None)
    norms = w.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1.0) for r in norms) and len(norms) == 2
    # n counts the empty item too
    row = {r["term"]: r["weight"] for r in w.filter("id = 2").collect()}
    a, g = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    assert row["alpha"] == pytest.approx(a / math.sqrt(a * a + 2 * g * g))
