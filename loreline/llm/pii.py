"""Personal data: fixed patterns give seeds, their contexts induce patterns that find further identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import packed, stored, text_or_empty

# What each kind looks like. Lookbehinds and possessive quantifiers change no match; they keep
# the search linear and free of recursion in long runs of one class of characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
#: A text without a match of these has none of the kind.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Words that may be identifiers: they hold a digit or an at sign.
WORDS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What a found word must show to be of a kind.
LIKELY = {"email": r"[A-Za-z].*@|@.*[A-Za-z]", "ip": r"[0-9A-Fa-f]+[.:][0-9A-Fa-f]*[.:]", "card": r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$", "phone": r"^(?:[^0-9]*[0-9]){7,15}[^0-9]*$"}

#: Characters before a span in which its context words are sought.
CONTEXT = 80
#: A pattern counts with so many different known identifiers, and this share of all words it stands before.
LEAST_KNOWN, CONFIDENT = 5, 0.8
#: A word is an identifier from this score on; 1 - the product of the patterns' doubts.
ACCEPTED = 0.9
ROUNDS = 3

SPAN = "array<struct<start:int,end:int,value:string,before:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches with their place in code points and the characters before them since the last match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(hits, gaps, lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["gap"])
        end = begin + F.length(s["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), s["hit"].alias("value"), F.right(s["gap"], F.lit(CONTEXT)).alias("before"))
        return F.when(s["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    return F.aggregate(steps, start, add, lambda acc: acc["out"])


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "ip":
        return value.rlike(IP)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of all kinds, by start, then kind as listed; matches that fail their kind's test are dropped."""

    def of(i: int, kind: str) -> Column:
        gate = text.contains(GATES[kind]) if kind == "email" else text.rlike(GATES[kind])
        spans = F.when(gate, matches(text, PATTERNS[kind])).otherwise(F.array().cast(SPAN))
        kept = F.filter(spans, lambda s: valid(kind, s["value"]))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), s["before"].alias("before")))

    return F.array_sort(F.concat(*[of(i, kind) for i, kind in enumerate(KINDS)]))


def contexts(before: Column) -> Column:
    """Lexical patterns of a span: the word before it, and the two words before it."""
    words = F.regexp_extract_all(F.lower(before), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    one = F.when(n > 0, F.element_at(words, -1))
    two = F.when(n > 1, F.concat_ws(" ", F.element_at(words, -2), F.element_at(words, -1)))
    return F.filter(F.array(one, two), lambda p: p.isNotNull())


def discover(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind) of words that confident patterns single out.

    `edges` (pattern, value, kind) links each pattern to the values it stands before; kind is null for
    words not yet known. Each round scores patterns by the share of known values among all they stand
    before, then words by the patterns before them; accepted words are known in the next round. Values
    count once for each pattern, so copies of a document lend a pattern no weight.
    """
    edges = stored(edges, "pii-edges")
    words = stored(edges.where("kind IS NULL").select("pattern", "value"), "pii-words")
    total = stored(edges.groupBy("pattern").agg(F.count("*").alias("total")), "pii-total")
    known = stored(edges.where("false").select("value", "kind"), "pii-known")
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(LIKELY[k]).alias("likely")) for i, k in enumerate(KINDS)])
    for _ in range(rounds):
        sure = edges.where("kind IS NOT NULL").select("pattern", "value", "kind").union(words.join(known, "value").select("pattern", "value", "kind"))
        counted = sure.groupBy("pattern", "kind").agg(F.count("*").alias("sure")).where(F.col("sure") >= LEAST_KNOWN)
        patterns = counted.join(total, "pattern").withColumn("share", F.col("sure") / F.col("total")).where(F.col("share") >= CONFIDENT)
        patterns = stored(patterns.select("pattern", "kind", "share"), "pii-patterns")
        scored = words.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("share", F.lit(0.99)))))).alias("score"))
        fits = F.exists(kinds, lambda k: (k["kind"] == F.col("kind")) & F.rlike(F.col("value"), k["likely"]))
        best = scored.where((F.col("score") >= ACCEPTED) & fits).groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        known = stored(best, "pii-known")
    return known


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, more) of each row: arrays of spans (start, kind, end), kind a place in KINDS.

    Places are code points, ends exclusive. `base` are the leftmost non-overlapping matches of each kind
    that pass its test. `more` are words that hold a digit or an at sign, overlap no base span and were
    singled out by contexts of known identifiers in the whole table; white space ends a word, closing
    punctuation counts to it. Both are sorted by start, then kind.

    Texts are read once and never shuffled; spans and contexts are. Work inside a row grows with the square
    of its number of spans. Null text counts as empty, ids may be null or repeat: rows stay apart. Empty
    tables give no rows.
    """
    text = text_or_empty(F.col("text"))
    rows = packed(docs).select(F.col(f"row.`{id_col}`").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"))
    seen = rows.select(
        "doc_id",
        base_spans(text).alias("base"),
        F.when(text.rlike("[0-9@]"), matches(text, WORDS)).otherwise(F.array().cast(SPAN)).alias("words"),
    )
    apart = F.filter("words", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"])))
    seen = stored(seen.select(F.monotonically_increasing_id().alias("at"), "doc_id", "base", apart.alias("words")), "pii-seen")

    known = seen.select(F.explode("base").alias("s")).select(F.explode(contexts(F.col("s.before"))).alias("pattern"), "s.value", "s.kind")
    open_ = seen.select(F.explode("words").alias("s")).select(F.explode(contexts(F.col("s.before"))).alias("pattern"), "s.value", F.lit(None).cast("int").alias("kind"))
    found = discover(known.union(open_).distinct())

    placed = stored(seen.select("at", F.explode("words").alias("s")).select("at", "s.value", "s.start", "s.end"), "pii-placed")
    more = placed.join(found, "value").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("more"))
    more = stored(more, "pii-more")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return seen.join(more, "at", "left").select("doc_id", plain.alias("base"), F.coalesce("more", empty).alias("more"))


def written(spans: Column) -> Column:
    """Spans as `kind:start:end`, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
