"""Tables with nulls, ties, repeated rows, long texts and columns whose names clash with those of operators."""

LONG = "word " * 20_000 + "Licensed under CC BY-NC 4.0.\n" + "x" * 50_000

DOCUMENTS = [
    (1, "plain words stand here", "en", "a"),
    (2, "plain words stand here", "en", "b"),
    (2, "plain words stand here", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (None, "a text without an id", "en", "a"),
    (None, "a text without an id", "en", None),
    (5, LONG, "en", "a"),
    (6, " \t\n ", "en", "é"),
    (7, "mail me@host.org or +1 (415) 555-0100", "en", "a"),
    (8, "ÀÉÎ 🦙 你好 ▁ \u0000", "zh", "z"),
    (9, "one", "en", "z"),
    (10, "Released under the MIT License.", "en", "a"),
]

VECTORS = [
    (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.99, 0.05]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0]),
]

PAGES = [(1, "http://a", "<p>x"), (2, "http://b\r\nX: y", "<p>x"), (2, None, "<p>x"), (3, "c", None), (4, "d", ""), (None, "e", "<p>x"), (5, "f", "é" * 100_000)]

ITEMS = [(1, "plain words stand here plain words"), (1, "one"), (None, "word ÀÉÎ mail"), (2, None), (3, ""), (4, " .,; "), (5, LONG), (6, "nowhere")]

TURNS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, None, "system", "Be kind."),
    (2, 0, None, None), (2, 1, "user", LONG), (None, 0, "user", "Who?"), (None, 5, "assistant", "I."), (3, 2, "", "x."), (4, 7, "user", ""), (5, 7, "é", "é."),
    (6, None, "user", "a."), (6, None, "assistant", "b."), (6, 9223372036854775807, "user", "c"), (6, -9223372036854775808, "tool", "d!"),
]

LABELS = [(1, 1, 0), (2, 1, 1), (2, 1, 0), (None, 1, 1), (9, None, None), (77, 1, 1)]


def write_tables(spark, folder, documents, empty=False):
    # Names that operators give to their own columns stand in the input too.
    clash = ", size long, key long, bucket long, row long, fp long, kept boolean, target long, score double"
    extra = (1, 2, 3, 4, 5, True, 7, 0.5)
    schema = "doc_id long, text string, lang string, source string" + clash
    frames = {
        "documents": spark.createDataFrame([(*d, *extra) for d in documents], schema),
        "embeddings": spark.createDataFrame([] if empty else [(*v, 9) for v in VECTORS], "vec_id long, embedding array<float>, node long"),
        "pages": spark.createDataFrame([] if empty else [(*p, "z") for p in PAGES], "page_id long, url string, html string, payload string"),
        "benchmark": spark.createDataFrame([] if empty else [(*i, 5) for i in ITEMS], "item_id long, text string, rank int"),
        "conversations": spark.createDataFrame([] if empty else [(*t, "k") for t in TURNS], "conv_id long, turn long, role string, text string, key string"),
        "labels": spark.createDataFrame([] if empty else LABELS, "doc_id long, quality int, toxic int"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
