"""Files, vectors and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.operators import lookup, marts, nested, series, vectors
from loreline.operators import text as ops
from loreline.schemas import ART, ITEM_COLUMNS, NEWS, PUBLICATION
from loreline.sources import sinks, tables
from loreline.sources.keyed_store import KeyedStore
from loreline.streaming import jobs


def test_items_csv_keeps_long_quoted_fields(spark, tmp_path):
    path = str(tmp_path / "items")
    text = 'line one\nline "two", with comma\n' + "x" * 200_000
    row = ("T", "u", "f", "d", "p", text, "", "10.1/x", " J ")
    df = spark.createDataFrame([row], ", ".join(f"`{c}` string" for c in ITEM_COLUMNS))
    sinks.write_items_csv(df, path)
    back = tables.read_items_csv(spark, path).first()
    assert back["comment"] == text and back["journal"] == " J " and back["doi"] == "10.1/x"
    sinks.write_items_parquet(df, str(tmp_path / "twin"))
    assert spark.read.parquet(str(tmp_path / "twin")).columns == ITEM_COLUMNS


@pytest.mark.parametrize("split", [64, 300, 5000])
def test_items_csv_in_splits(spark, tmp_path, split):
    import csv as plain
    import random

    draw = random.Random(split)
    bits = ["a", ",", '"', "\n", "\r\n", " ", "é", '""', "\n\n", "x" * 40, "word"]
    header = ["title", "text", "n"]
    for name in ("one", "two"):
        rows = [[f"{name}{i}", "".join(draw.choices(bits, k=draw.choice([0, 1, 5, 60]))), str(i)] for i in range(150)]
        rows[40][1] = "y\n" * 400  # a field longer than a split
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            plain.writer(f, lineterminator="\r\n" if name == "two" else "\n").writerows([header, *rows])
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = tables.read_items_csv(spark, str(tmp_path / "*.csv"), schema)
        got = sorted((r["title"], r["text"] or "", r["n"]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = []
    for name in ("one", "two"):
        with open(tmp_path / f"{name}.csv", newline="") as f:
            want += [(t, x, int(n)) for t, x, n in list(plain.reader(f))[1:]]
    assert got == sorted(want)


def test_items_csv_with_another_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("title,other\na,b\n")
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
    with pytest.raises(Exception, match="header"):
        tables.read_items_csv(spark, str(tmp_path / "x.csv"), schema).collect()


def test_a_large_cell_is_cut(spark, monkeypatch):
    monkeypatch.setattr(lookup, "CELL_ROWS", 200)
    points = spark.range(4000).select(F.lit("k").alias("key"), (F.col("id") * 7 % 4001).alias("at"), F.lit(1).alias("day"))
    rows = points.select("key", F.struct("at").alias("_pos"), F.col("day").alias("_bucket"))
    sizes = [r["count"] for r in lookup.split_cells(rows, ["key"]).groupBy("_bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 800 and sum(sizes) == 4000
    bounds = spark.createDataFrame([("k", n) for n in range(5, 4001, 93)], "key string, at long")
    cut = lookup.asof_locate(points.drop("day"), bounds, ["key"], ["at"], F.lit(1))
    got = sorted((r["at"], r["start"]["at"], r["end"] and r["end"]["at"]) for r in cut.collect())
    marks = list(range(5, 4001, 93))
    want = [(a, max(m for m in marks if m <= a), min((m for m in marks if m > a), default=None)) for a in range(4001) if a >= 5]
    there = {r["at"] for r in points.collect()}
    assert got == [w for w in want if w[0] in there]


def test_years_are_laid_out_newest_first(spark, tmp_path):
    path = str(tmp_path / "years")
    # One year holds most rows; its files must be in order and hold all of them.
    df = spark.range(3000).select(
        F.col("id").alias("item_id"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(
            F.date_format(F.date_add(F.lit("2023-12-01").cast("date"), (F.col("id") % 300).cast("int")), "yyyy-MM-dd")
        ).alias("date"),
    )
    sinks.write_by_year(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 3000
    assert {r["year"] for r in back.select("year").distinct().collect()} == {"2023", "2024", "none"}
    ordered = spark.read.parquet(f"{path}/year=2024").select(
        F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("n"), "date"
    ).orderBy("f", "n").collect()
    dates = [r["date"] for r in ordered]
    assert dates == sorted(dates, reverse=True)


def test_nested_records(spark, tmp_path):
    (tmp_path / "news.json").write_text('''{"news": {"title": "x", "news": [{"date": "2024-05-01", "title": "One", "description": null, "img": "a.webp"}, {"date": "2023-01-02", "title": "Two"}]}}''')
    news = tables.read_nested_records(spark, str(tmp_path / "news.json"), "news.news", NEWS).orderBy("date").collect()
    assert [(str(r["date"]), r["title"], r["img"]) for r in news] == [("2023-01-02", "Two", None), ("2024-05-01", "One", "a.webp")]
    (tmp_path / "pubs.json").write_text('''{"publications": {"10.1/a": {"title": "A", "year": 2020, "type": "journal", "highlight": true, "resources": [{"code": "http://c"}, {"data": "http://d"}]}, "10.1/b": {"title": "B", "year": 2021, "resources": null}}}''')
    pubs = tables.read_nested_records(spark, str(tmp_path / "pubs.json"), "publications", PUBLICATION, key="doi")
    assert sorted(r["doi"] for r in pubs.collect()) == ["10.1/a", "10.1/b"]
    links = nested.explode_resources(pubs, "resources", "doi").collect()
    assert sorted(tuple(r) for r in links) == [("10.1/a", "code", "http://c"), ("10.1/a", "data", "http://d")]
    assert [r["doi"] for r in marts.highlighted(pubs).collect()] == ["10.1/a"]
    (tmp_path / "art.json").write_text('''{"art": [{"title": "one", "img": "x.png", "img_alt": "alt"}, {"title": "two", "img": ["a", "b"], "img_alt": ["c"]}]}''')
    art = tables.read_nested_records(spark, str(tmp_path / "art.json"), "art", ART)
    got = nested.align_images(art, "title").orderBy("title", "pos").collect()
    assert [tuple(r) for r in got] == [("one", 0, "x.png", "alt"), ("two", 0, "a", "c"), ("two", 1, "b", None)]


def test_posts(spark, tmp_path):
    (tmp_path / "first-post.md").write_text('---\ntitle: "A title"\nsubtitle: Sub\ndate: 2024-01-02\n---\n# Body\n')
    (tmp_path / "no-front-matter.md").write_text("# Only text\n")
    got = {r["slug"]: r for r in tables.read_posts(spark, str(tmp_path / "*.md")).collect()}
    assert (got["first-post"]["title"], got["first-post"]["subtitle"], got["first-post"]["date"]) == ("A title", "Sub", "2024-01-02")
    assert got["first-post"]["body"].strip() == "# Body"
    assert got["no-front-matter"]["title"] == "No Front Matter" and got["no-front-matter"]["date"] is None


def test_feed_file(spark, tmp_path):
    import glob
    from xml.etree import ElementTree

    df = spark.createDataFrame([(1, "a <b> & c", "g", None), (2, "two", "h", "someone"), (3, "three", None, "")], "item_id int, title string, guid string, author string")
    sinks.write_feed(df.repartition(3), str(tmp_path / "feed"), title="T", link="http://l", description="D", address="http://l/feed.xml", built="now", order=[F.desc("item_id")], n=2)
    (file,) = glob.glob(str(tmp_path / "feed/part-*"))
    rss = ElementTree.parse(file).getroot()
    assert rss.tag == "rss" and rss.get("version") == "2.0"
    (channel,) = rss
    assert [channel.find(t).text for t in ("title", "link", "description", "language", "lastBuildDate")] == ["T", "http://l", "D", "en-us", "now"]
    assert channel.find("{http://www.w3.org/2005/Atom}link").get("href") == "http://l/feed.xml"
    three, two = channel.findall("item")
    assert three.find("title").text == "three" and three.find("guid") is None
    assert two.find("guid").text == "h" and two.find("guid").get("isPermaLink") == "false" and two.find("author").text == "someone"
    assert [e.tag for e in two] == ["title", "guid", "author"]


def test_store_embeds_each_key_once(spark, tmp_path):
    path = str(tmp_path / "store")
    calls = spark.sparkContext.accumulator(0)

    def model():
        def encode(titles):
            calls.add(len(titles))
            return np.array([[float(len(t)), 1.0] for t in titles])

        return encode

    items = spark.createDataFrame([(1, "One"), (2, "two"), (3, " ONE ")], "item_id int, title string")
    first = vectors.incremental_embed(items, path, model=model)
    assert first.filter("embedding IS NULL").count() == 0
    assert vectors.read_store(spark, path).count() == 2
    before = calls.value
    again = vectors.incremental_embed(items, path, model=model)
    assert again.count() == 3 and calls.value == before
    assert vectors.read_store(spark, path).count() == 2


def test_default_embedding_depends_on_the_title_alone(spark):
    items = spark.createDataFrame([(1, "deep cells"), (2, "other things here")], "item_id int, title string")
    both = {r["item_id"]: r["embedding"] for r in vectors.embed(items).collect()}
    alone = vectors.embed(items.filter("item_id = 1")).first()["embedding"]
    assert both[1] == alone and len(alone) == 384


def test_topics(spark):
    rng = np.random.default_rng(3)
    centers = np.eye(3) * 5
    rows = [(n, [float(x) for x in centers[n % 3 if n % 7 else 0] + rng.normal(0, 0.1, 3)]) for n in range(210)]
    df = spark.createDataFrame(rows, "item_id int, embedding array<float>")
    topics, centroids = vectors.fit_topics(df, k=3, restarts=3)
    sizes = [r["papers"] for r in marts.topic_counts(topics).orderBy("topic").collect()]
    assert sum(sizes) == 210 and sizes == sorted(sizes, reverse=True)
    unit = df.withColumn("embedding", vectors.l2_normalise(F.col("embedding")))
    nearest = vectors.assign_topics(unit, centroids).select("item_id", F.col("topic").alias("near"))
    assert topics.join(nearest, "item_id").filter("topic != near").count() == 0


def test_topics_of_empty_tasks_and_of_items_without_a_vector(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "item_id int, embedding array<float>").repartition(8, "item_id")
    topics, centroids = vectors.fit_topics(df, k=2, restarts=2)
    found = {r["item_id"]: r["topic"] for r in topics.collect()}
    assert found == {1: 0, 2: 0, 3: 1, 4: None, 5: None, 6: None} and centroids.count() == 2
    few = df.select(vectors.l2_normalise(F.col("embedding")).alias("unit")).filter("item_id < 4").repartition(8)
    assert len(vectors.fit_runs(few, 2, [1], 3).costs) == 1


def test_projection_orders_axes_by_variance(spark):
    rng = np.random.default_rng(5)
    rows = [(n, [float(v) for v in rng.normal(0, [1, 9, 3])]) for n in range(200)]
    df = spark.createDataFrame(rows, "item_id int, embedding array<float>")
    v = vectors.project_2d(df).agg(F.variance("embedding_x").alias("x"), F.variance("embedding_y").alias("y")).first()
    assert v["x"] > v["y"] > 1


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert sorted(r["u"] for r in df.select(vectors.l2_normalise(F.col("v")).alias("u")).collect()) == [[0.0, 0.0], [0.6, 0.8]]


def test_archive_stream_reads_each_file_once(spark, tmp_path):
    inbox, sink, offsets = tmp_path / "inbox", str(tmp_path / "sink"), str(tmp_path / "offsets")
    inbox.mkdir()
    (inbox / "a.mbox").write_text("From a@b Mon\nSubject: [paper] One item\n\nbody\nFrom a@b Mon\nSubject: [paper] Two items\n\nbody\n")
    run = lambda: jobs.ingest_archive_stream(spark, str(inbox), sink, offsets).awaitTermination()
    run()
    assert spark.read.parquet(sink).count() == 2
    run()
    assert spark.read.parquet(sink).count() == 2
    (inbox / "b.mbox").write_text("From a@b Mon\nSubject: [paper] Three items\n\nbody\n")
    run()
    assert sorted(r["title"] for r in spark.read.parquet(sink).collect()) == ["One item", "Three items", "Two items"]


def test_merge_stream_equals_batch(spark, tmp_path):
    source, store, offsets = (str(tmp_path / n) for n in ("source", "store", "offsets"))
    schema = "item_id int, title string, ord int"
    old = spark.createDataFrame([("ONE", "10.1/x", "", 1)], "title string, doi string, journal string, ord int")
    for batch in ([(1, "One", 1), (2, "one ", 2)], [(3, "ONE", 3), (4, "Two", 4)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.dedupe_and_merge_stream(stream, store, offsets, "ord", old).awaitTermination()
    got = sorted((r["item_id"], r["doi"]) for r in spark.read.parquet(store).collect())
    assert got == [(1, "10.1/x"), (4, "")]


def keyed(spark, path, buckets=64):
    return KeyedStore(spark, path, T.StructType([T.StructField("item_key", T.StringType()), T.StructField("n", T.IntegerType())]), "item_key", buckets)


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, "item_key string, n int")


def test_store_reads_only_the_buckets_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "store")
    store = keyed(spark, path)
    store.add(spark.range(2000).select(F.col("id").cast("string").alias("item_key"), F.col("id").cast("int").alias("n")))
    assert len(store.batches()) == 64
    new = rows_of(spark, ("7", 70), ("8", 80), ("x", 1))
    buckets = store.touched(new)
    assert 1 < len(buckets) <= 3
    read = {f.split("bucket=")[1].split("/")[0] for f in store.read(buckets).inputFiles()}
    assert read == {str(b) for b in buckets}
    plan = store.unseen(new)._jdf.queryExecution().executedPlan().toString()
    assert "n#" not in plan.split("FileScan")[1].split("ReadSchema")[0].split("Batched")[0]
    assert [r["item_key"] for r in store.unseen(new).collect()] == ["x"]
    store.add(new)
    assert sorted(store.batches()[b] for b in store.batches() if 1 in store.batches()[b]) == [[0, 1]]
    back = {r["item_key"]: r["n"] for r in store.read().collect()}
    assert len(back) == 2001 and back["7"] == 7 and back["x"] == 1
    # The number of buckets is that of the store, whatever is asked for later.
    assert keyed(spark, path, 5).buckets == 64


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    store = keyed(spark, str(tmp_path / "store"), 4)
    for _ in range(2):
        store.add(rows_of(spark, ("a", 1), ("b", 2)), 0)
        store.add(rows_of(spark, ("b", 3), ("c", 4)), 1)
    assert sorted((r["item_key"], r["n"]) for r in store.read().collect()) == [("a", 1), ("b", 2), ("c", 4)]
    store.compact(1)
    store.add(rows_of(spark, ("b", 3), ("c", 4)), 1)
    assert sorted((r["item_key"], r["n"]) for r in store.read().collect()) == [("a", 1), ("b", 2), ("c", 4)]


def test_compaction_that_is_broken_off(spark, tmp_path, monkeypatch):
    path = tmp_path / "store"
    store = keyed(spark, str(path), 2)
    for n in range(5):
        store.add(rows_of(spark, *[(f"{n}-{k}", n) for k in range(20)]))
    whole = sorted(tuple(r) for r in store.read().select("item_key", "n").collect())
    # Nothing was moved yet: the next one to open the store ends it.
    monkeypatch.setattr(KeyedStore, "_recover", lambda self: None)
    assert store.compact(3) == [0, 1]
    monkeypatch.undo()
    assert (path / "_compacting/_marked").exists()
    # Half of it was moved: one bucket's old files are gone.
    import shutil

    for old in (path / "bucket=0").iterdir():
        shutil.rmtree(old)
    again = keyed(spark, str(path))
    assert again.batches() == {0: [-1], 1: [-1]} and not (path / "_compacting").exists()
    assert sorted(tuple(r) for r in again.read().select("item_key", "n").collect()) == whole
    # What was not marked is dropped.
    (path / "_compacting/bucket=0").mkdir(parents=True)
    assert sorted(tuple(r) for r in keyed(spark, str(path)).read().select("item_key", "n").collect()) == whole
    for n in range(3):
        again.add(rows_of(spark, *[(f"more-{n}-{k}", n) for k in range(20)]))
    again.compact(2)
    assert again.batches() == {0: [-1], 1: [-1]} and again.read().count() == len(whole) + 60


def test_weekly_totals_with_late_items(spark, tmp_path):
    source, weeks, closed, offsets = (str(tmp_path / n) for n in ("source", "weeks", "closed", "offsets"))
    batches = [["2024-01-02", "2024-01-03", "2024-01-30", None], ["2024-01-01", "2024-01-28", "2024-02-20"], ["2024-01-29", "2024-02-21"]]
    for days in batches:
        spark.createDataFrame([(d,) for d in days], "d string").select(F.to_timestamp("d").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp").parquet(source)
        jobs.weekly_totals_stream(stream, weeks, closed, offsets).awaitTermination()
    got = {str(r["week_start"])[:10]: (r["count"], r["late"]) for r in jobs.weekly_totals(spark, weeks, closed).collect()}
    # 7 days behind the 30th no week later than the 15th has ended, so the 28th is in time.
    assert got == {"2024-01-01": (2, 1), "2024-01-22": (1, 0), "2024-01-29": (1, 1), "2024-02-19": (2, 0)}
    given = sorted((str(r["week_start"])[:10], r["count"], r["late"], r["batch"]) for r in spark.read.parquet(closed).collect())
    assert given == [("2024-01-01", 1, True, 1), ("2024-01-01", 2, False, 0), ("2024-01-22", 1, False, 1), ("2024-01-29", 1, False, 1), ("2024-01-29", 1, True, 2)]


def test_weekly_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "events")
    e = spark.range(500).select((F.lit(1704067200) + F.col("id") * 5000).cast("timestamp").alias("ts"))
    e.write.parquet(source)
    q = jobs.weekly_counts_stream(spark.readStream.schema(e.schema).parquet(source)).writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    q.processAllAvailable()
    q.stop()
    got = {str(r["week_start"])[:10]: r["count"] for r in spark.sql("SELECT * FROM weeks").collect()}
    batch = {str(r["date"])[:10]: r["count"] for r in series.weekly_counts(e).collect()}
    assert got == batch


def test_all_series_cover_the_grid(spark):
    items = spark.range(400).select(
        (F.col("id") % 5).cast("int").alias("topic"),
        (F.lit(1700000000) + F.col("id") * F.col("id") * 900).cast("timestamp").alias("ts"),
    )
    s = series.monthly_counts(items)
    per = s.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("c")).collect()
    assert len({r["n"] for r in per}) == 1
    by = {r["topic"]: r["c"] for r in per}
    assert by[-1] == sum(c for t, c in by.items() if t != -1)


def test_many_centroids_as_a_table(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, c = rng.normal(0, 1, (500, 6)), rng.normal(0, 1, (700, 6)) * rng.uniform(0.2, 3, (700, 1))
    points = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id int, embedding array<float>").repartition(4)
    model = spark.createDataFrame([(i * 3, [float(a) for a in v]) for i, v in enumerate(c)], "topic int, centroid array<double>").repartition(5)
    held = {r["id"]: (r["topic"], r["distance2"]) for r in vectors.assign_topics(points, model).collect()}
    for name, n in (("BLOCK_FLOATS", 100), ("ROW_FLOATS", 300), ("MODEL_FLOATS", 120)):
        monkeypatch.setattr(vectors, name, n)
    monkeypatch.setattr(vectors, "_nearest", None)
    apart = vectors.assign_topics(points, model)
    assert apart.columns == ["id", "embedding", "topic", "distance2"]
    got = {r["id"]: (r["topic"], r["distance2"]) for r in apart.collect()}
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in held.items()}
    assert all(abs(got[i][1] - held[i][1]) < 1e-9 for i in got)


def test_runs_share_passes_and_match_single_ones(spark):
    rng = np.random.default_rng(8)
    unit = spark.createDataFrame([([float(a) for a in v],) for v in rng.normal(0, 1, (400, 5))], "unit array<double>").repartition(3).cache()
    both = vectors.fit_runs(unit, 6, [1, 2, 3], iterations=50)
    for n, seed in enumerate((1, 2, 3)):
        alone = vectors.fit_runs(unit, 6, [seed], iterations=50)
        assert abs(alone.costs[0] - both.costs[n]) < 1e-6 and np.allclose(alone.centers[0], both.centers[n])
    x = np.array([r["unit"] for r in unit.collect()])
    d = ((x[:, None] - both.centers[0]) ** 2).sum(axis=2)
    assert abs(d.min(axis=1).sum() - both.costs[0]) < 1e-6
    means = np.stack([x[d.argmin(axis=1) == c].mean(axis=0) for c in range(6)])
    assert np.abs(means - both.centers[0]).max() < 1e-3
    assert vectors.fit_runs(unit.limit(0), 6, [1, 2]).costs == [0.0, 0.0]


def test_frequent_terms_whatever_the_sample(spark, monkeypatch):
    import random

    draw = random.Random(6)
    rows = [(f"t{int(draw.paretovariate(0.6)) % 900}", draw.choice([1, 1, 3])) for _ in range(6000)] + [("rare", 40000)]
    terms = spark.createDataFrame(rows, "term string, tf long").repartition(4)
    stats = ops.term_statistics(terms)
    for sampled, buckets in ((1, 1 << 18), (50, 64), (3000, 7), (10**9, 64)):
        monkeypatch.setattr(ops, "SAMPLED", sampled)
        monkeypatch.setattr(ops, "TERM_BUCKETS", buckets)
        for k, low, high in ((5, 1, 1.0), (40, 2, 0.02), (5000, 1, 1.0)):
            n = F.lit(6001)
            want = [tuple(r) for r in ops.top_vocabulary(stats, k, n, low, high).collect()]
            assert [tuple(r) for r in ops.frequent_terms(terms, k, n, low, high).collect()] == want


def test_centroids_in_blocks(spark, monkeypatch):
    import random

    draw = random.Random(2)
    rows = [(i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    points = spark.createDataFrame(rows, "id int, embedding array<double>")
    model = spark.createDataFrame([(i, v) for i, v in rows[:11]] + [(99, rows[3][1])], "topic int, centroid array<double>")
    whole = {r["id"]: r["topic"] for r in vectors.assign_topics(points, model).collect()}
    monkeypatch.setattr(vectors, "BLOCK_FLOATS", 10)
    assert {r["id"]: r["topic"] for r in vectors.assign_topics(points, model).collect()} == whole
    assert [whole[i] for i in range(11)] == list(range(11))
    assert vectors.assign_topics(points, model.limit(0)).first()["topic"] is None


@pytest.mark.parametrize("limits", [{}, {"min_df": 2, "max_df": 0.5}])
def test_terms_out_of_reach_of_the_vocabulary_are_not_counted(spark, limits):
    words = [f"word{n}" for n in range(60)]
    rows = [(n, " ".join(words[(n * m) % (1 + n % 60)] for m in range(1, 40))) for n in range(200)] + [(-1, ""), (-2, None), (-2, "word0 word0 word1")]
    df = spark.createDataFrame(rows, "item_id int, t string")
    whole = ops.counted_terms(df, F.col("t"), "item_id")
    found = ops.tfidf(df, F.col("t"), "item_id", k=6, **limits)
    expected = ops.weighed_terms(whole, "item_id", k=6, **limits)
    six = lambda t: sorted((r["item_id"], r["term"], r["tf"], round(r["weight"], 9)) for r in t.collect())
    assert six(found) == six(expected) and len({r["term"] for r in found.collect()}) == 6
    few = ops.counted_terms(df, F.col("t"), "item_id", k=6, **limits)
    assert few.count() == 203 and ops.unfolded(few).select("term").distinct().count() < ops.unfolded(whole).select("term").distinct().count() / 4


@pytest.mark.parametrize("words", [1, 5, 1 << 22])
def test_batches_of_texts_give_the_same_statistics(spark, monkeypatch, words):
    import pyarrow as pa

    monkeypatch.setattr(ops, "BATCH_WORDS", words)
    texts = [["ab", "cd", "ab", "cd"], [], None, ["ab"], ["cd", "ab", "cd"], ["ef", "ef", "ef"]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.list_(pa.string()))], ["words"])
    found = {}
    for part in ops._sums_of_batches([batch]):
        for r in part.to_pylist():
            cf, df = found.get(r["term"], (0, 0))
            found[r["term"]] = (cf + r["tf"], df + r["df"])
    assert found == {"ab": (4, 3), "cd": (4, 2), "ef": (3, 1), "ab cd": (3, 2), "cd ab": (2, 2), "ef ef": (2, 1)}
    rows = [(n, None if t is None else " ".join(t)) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string")
    assert {r["term"]: (r["cf"], r["df"]) for r in ops.term_statistics(ops.batch_terms(df, F.col("t"))).collect()} == found


def test_long_pages_are_handed_on_in_pieces(spark, monkeypatch):
    import pandas as pd

    from loreline.functions import html

    monkeypatch.setattr(html, "HANDED_ON", 40)
    pages = ["<p>one two</p>" * 4, None, "<p>three</p>", "", "<div>four</div>" * 3, "x"]
    pieces = list(html.dom_view.func(iter([pd.Series(pages)])))
    assert len(pieces) == 3 and sum(len(p) for p in pieces) == len(pages)
    assert [b for p in pieces for b in p["body"]] == pages
