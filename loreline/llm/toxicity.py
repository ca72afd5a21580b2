"""Toxicity scores by weak supervision: many voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched, chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import packed, stored, text_or_empty

# Insults by what they attack, one voter each.
LEXICONS = {
    "mind": "stupid idiot moron dumb imbecile fool idiotic moronic",
    "worth": "worthless pathetic loser trash scum garbage filth vermin",
    "disgust": "disgusting vile clown freak creep ugly repulsive",
    "threat": "kill murder hurt hang shoot hate",
    "profanity": "damn crap bastard shit fuck bitch ass",
}

#: Labelled rows of each class that words are learned from, and rows of each class the classifier is fitted on.
FIT_ROWS = 20_000
#: Words and word beginnings learned from the labels at most, and the fewest toxic documents one must stand in.
LEARNED_WORDS, LEAST_DOCS = 800, 4
#: Log odds from which a learned word is a feature, and from which it is a strong one.
ODDS, STRONG_ODDS = 2.0, 4.5
#: Bytes of word beginnings that count as features; the shortest also names a family of words.
BEGINNINGS = range(4, 9)
#: Lexicons the strong learned words are dealt to by family, one voter each.
LEARNED_VOTERS = 3
#: Distinct words counted in a task before the counts are passed on, and words passed on at once.
COUNTED_WORDS, PASSED_WORDS = 100_000, 10_000

FIXED = list(LEXICONS)
VOTERS = [*FIXED, *[f"learned{i}" for i in range(LEARNED_VOTERS)], "weak", "several", "shouting", "exclaiming", "nothing"]
#: The only voter that speaks for a clean text.
CLEAN = VOTERS.index("nothing")

# ASCII letters are lower-cased; everything in ASCII that is neither letter nor digit separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SHOUT = re.compile(r"\b[A-Z]{3,}\b(?:\W+[A-Z]{3,}\b){2}")


def words_of(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").translate(FOLD).split())


def marks_of(text: str) -> set[bytes]:
    """Distinct words, each closed by a space, and beginnings of longer words."""
    words = words_of(text)
    return {w + b" " for w in words} | {w[:k] for w in words for k in BEGINNINGS if len(w) > k}


def is_held_out(id_col: str):
    """The fold whose labels are never used."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic) of documents outside the held-out fold; repeated labels are averaged, nulls left out."""
    known = labels.where(~is_held_out(id_col)).groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("toxic"))
    return known.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", (F.col("toxic") >= 0.5).cast("int").alias("toxic"))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        clean, toxic = counts
        for words in batched(chain(clean, (w for w in toxic if w not in clean)), PASSED_WORDS):
            yield pd.DataFrame({"word": words, "clean": [clean[w] for w in words], "toxic": [toxic[w] for w in words]})
        clean.clear()
        toxic.clear()

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            counts[toxic].update(marks_of(text))
            if len(counts[0]) + len(counts[1]) > COUNTED_WORDS:
                yield from flush()
    yield from flush()


def learn_words(docs: DataFrame, labels: DataFrame, fit_rows: int) -> list[tuple[bytes, float]]:
    """Words and word beginnings, with their log odds, that mark toxic documents in at most `fit_rows` labelled documents of each class, best first."""
    by_hash = F.xxhash64("doc_id", F.lit("fit"))
    sample = labels.where("toxic = 1").orderBy(by_hash, "doc_id").limit(fit_rows).unionByName(labels.where("toxic = 0").orderBy(by_hash, "doc_id").limit(fit_rows))
    # At most 2 * fit_rows pairs of numbers.
    picked = stored(sample, "tox-sample")
    totals = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    if 0 not in totals or 1 not in totals:
        return []
    texts = docs.join(F.broadcast(picked), "doc_id").select("text", "toxic")
    counted = texts.mapInPandas(_count_words, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1))
    share = F.col("toxic") / totals[1]
    best = (
        counted.withColumn("odds", odds).where((F.col("toxic") >= LEAST_DOCS) & (F.col("odds") > ODDS) & (F.length("word") > 2))
        .orderBy(F.desc(share * F.col("odds")), "word").limit(LEARNED_WORDS)
    )
    return [(bytes(r["word"]), r["odds"]) for r in best.collect()]


def vocabulary(learned: list[tuple[bytes, float]]) -> dict[bytes, tuple[int, int]]:
    """Feature number and voters (a bit mask) of each word or word beginning."""
    words: dict[bytes, int] = {}
    for k, name in enumerate(FIXED):
        for w in LEXICONS[name].split():
            words[w.encode() + b" "] = 1 << k
    for w, odds in learned:
        voter = crc32(w[: BEGINNINGS[0]]) % LEARNED_VOTERS if odds >= STRONG_ODDS else LEARNED_VOTERS
        words[w] = words.get(w, 0) | 1 << (len(FIXED) + voter)
    return {w: (i, mask) for i, (w, mask) in enumerate(sorted(words.items()))}


def evidence(docs: DataFrame, words: dict[bytes, tuple[int, int]]) -> DataFrame:
    """(doc_id, held_out, votes, active): the voters that speak, as bits, and the features a whole text shows."""
    several, shout, exclaim = map(VOTERS.index, ("several", "shouting", "exclaiming"))
    families = {w[: BEGINNINGS[0]] for w in words}
    weak = 1 << VOTERS.index("weak")
    n = len(words)

    def look(text: str) -> tuple[int, list[int]]:
        votes, active, speakers = 0, set(), 0
        for w in words_of(text):
            w += b" "
            if w[: BEGINNINGS[0]] in families:
                found = [words[m] for m in (w, *[w[:k] for k in BEGINNINGS if len(w) > k + 1]) if m in words]
                speakers += any(mask & ~weak for _, mask in found)
                for i, mask in found:
                    active.add(i)
                    votes |= mask
        active = sorted(active)
        if not active:
            votes |= 1 << CLEAN
        if speakers > 1:
            votes |= 1 << several
            active.append(n + 2)
        if speakers > 2:
            active.append(n + 3)
        if SHOUT.search(text):
            votes |= 1 << shout
            active.append(n)
        if "!!" in text:
            votes |= 1 << exclaim
            active.append(n + 1)
        return votes, active

    @F.pandas_udf("struct<votes int, active array<int>>")
    def seen(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            votes, active = zip(*map(look, batch), strict=True) if len(batch) else ((), ())
            yield pd.DataFrame({"votes": list(votes), "active": list(active)})

    looked = docs.select("doc_id", is_held_out("doc_id").alias("held_out"), seen("text").alias("seen"))
    return stored(looked.select("doc_id", "held_out", "seen.votes", "seen.active"), "tox-evidence")


@dataclass
class LabelModel:
    """Two classes; voters speak independently but for pairwise correlations, which lower their weight."""

    prior: float
    speaks: np.ndarray  # chance that a voter speaks, by voter and class
    weight: np.ndarray = field(default_factory=lambda: np.ones(len(VOTERS)))  # 1 / (1 + correlations with others)

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.speaks), np.log1p(-self.speaks)
        each = bits @ (self.weight[:, None] * yes) + (1 - bits) @ (self.weight[:, None] * no)
        odds = each[:, 1] - each[:, 0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_label_model(votes: np.ndarray, label: np.ndarray, count: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation-maximisation over counted vote patterns; `label` is 1, 0 or -1 where unknown.

    Chances get a weak prior that a voter of a toxic lexicon speaks in toxic texts, so that the classes
    keep their meaning with few labels or none. Correlations are those of two voters' deviations within
    a class; a voter whose company repeats it counts for less.
    """
    k = len(VOTERS)
    bits = (votes[:, None] >> np.arange(k) & 1).astype(float)
    start = np.tile([0.02, 0.4], (k, 1))
    start[CLEAN] = [0.9, 0.1]
    known = label >= 0
    if known.any():
        # Labelled and unlabelled documents come from the same mix of classes.
        prior = float(np.clip((count * (label == 1)).sum() / (count * known).sum(), 0.001, 0.9))
    else:
        prior = 0.1
    model = LabelModel(prior, start)
    for _ in range(rounds if len(votes) else 0):
        p = np.where(known, label, model.posterior(bits))
        mass = np.stack([count * (1 - p), count * p])
        held = mass.sum(axis=1)
        speaks = ((mass @ bits) + 10 * start.T) / (held[:, None] + 10)
        off = bits[None] - speaks[:, None]
        cov = np.einsum("cn,cni,cnj->ij", mass, off, off)
        scale = np.sqrt(np.diag(cov)) + 1e-9
        corr = np.abs(cov / scale[:, None] / scale[None])
        np.fill_diagonal(corr, 0)
        model = LabelModel(prior if known.any() else float(np.clip(held[1] / held.sum(), 0.001, 0.9)), np.clip(speaks.T, 1e-4, 1 - 1e-4), 1 / (1 + corr.sum(axis=1)))
    return model


def fit_linear(active: list[list[int]], target: np.ndarray, weight: np.ndarray, n: int, l2: float = 0.5, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on soft labels, by accelerated gradient steps."""
    # Documents that show the same features are one row: most show none.
    rows: dict[tuple[int, ...], list[float]] = {}
    for features, y, mass in zip(active, target, weight / weight.sum() * len(active), strict=True):
        held = rows.setdefault(tuple(features), [0.0, 0.0])
        held[0] += mass * y
        held[1] += mass
    x = np.zeros((len(rows), n + 1), dtype=np.float32)
    for i, features in enumerate(rows):
        x[i, list(features)] = 1
    x[:, n] = 1
    hits, weight = np.array(list(rows.values()), dtype=np.float32).T
    target = hits / weight
    # The curvature is a quarter of the largest eigenvalue at most.
    v = np.ones(n + 1, dtype=np.float32)
    for _ in range(20):
        v = x.T @ (weight * (x @ v))
        top = float(np.linalg.norm(v))
        v /= top
    step = 1 / (0.3 * top + l2)
    w, ahead = np.zeros(n + 1, dtype=np.float32), np.zeros(n + 1, dtype=np.float32)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        grad = x.T @ (weight * (p - target)) + l2 * np.append(ahead[:-1], 0)
        new = ahead - step * grad
        ahead = new + (t / (t + 3)) * (new - w)
        w = new
    return w.astype(float)


def toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted, votes) of each row of `docs`.

    Voters are lexicons and patterns: fixed lists of insults, words and word beginnings learned from labels
    (strong ones by family, weak ones, several at once), shouting, repeated exclamation marks; one voter
    speaks for clean texts, when nothing listed stands in it. A label model
    estimates how often each speaks in toxic and clean texts, and which repeat each other, from the vote
    patterns of all documents (at most 2 ** 13 patterns reach the driver). Its posteriors, certain where a
    training label is known, are the labels of a logistic regression on single words, whose value is the score.

    Labels are read for rows with crc32(id as text) mod 5 other than 0 only. Bounded samples: words are
    learned from `fit_rows` labelled documents of each class, the regression is fitted on `fit_rows`
    documents of each class, both the smallest by a hash of the id. Everything else covers all rows.

    Null and empty texts get the score of a text without evidence; a null id counts as the empty text for
    the fold. Repeated rows are scored each. Without labels the label model works from the fixed lists
    alone. Empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = packed(docs).select(F.col(f"row.`{id_col}`").alias("doc_id"), text_or_empty(F.col(f"row.`{text_col}`")).alias("text"))
    known = stored(training_labels(labels, id_col, label_col), "tox-labels")
    words = vocabulary(learn_words(texts, known, fit_rows))
    seen = evidence(texts, words)

    patterns = seen.join(known, "doc_id", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("label")).count().toPandas()
    votes = patterns["votes"].to_numpy(dtype=np.int64)
    model = fit_label_model(votes, patterns["label"].to_numpy(), patterns["count"].to_numpy(dtype=float))
    distinct = np.unique(votes)
    belief = model.posterior((distinct[:, None] >> np.arange(len(VOTERS)) & 1).astype(float))
    held = {int(v): float(p) for v, p in zip(distinct, belief, strict=True)}

    # Bounded by the number of vote patterns.
    likely = [v for v, p in held.items() if p >= 0.5]
    train = seen.where(~F.col("held_out")).join(known, "doc_id", "left")
    by_hash = F.xxhash64("doc_id", F.lit("train"))
    active, target, weight = [], [], []
    for side in (True, False):
        rows = train.where(F.col("votes").isin(likely) == side)
        picked = rows.orderBy(by_hash, "doc_id").limit(fit_rows).select("votes", "active", "toxic").collect()
        mass = rows.count() / len(picked) if picked else 0
        active += [r["active"] for r in picked]
        target += [held[r["votes"]] if r["toxic"] is None else r["toxic"] for r in picked]
        weight += [mass] * len(picked)
    n = len(words) + 4  # shouting, exclaiming, two and three strong words
    w = fit_linear(active, np.array(target), np.array(weight), n) if active else np.zeros(n + 1)
    weights = F.array(*[F.lit(float(x)) for x in w[:-1]])
    logit = F.aggregate("active", F.lit(float(w[-1])), lambda total, i: total + F.get(weights, i))
    scored = seen.withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "votes")


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` whose text is not predicted toxic; found again by id, rows without one stay."""
    scored = toxicity(docs, labels, id_col=id_col, **options)
    drop = stored(scored.where("predicted = 1").select(F.col("doc_id").alias("__dropped")).distinct(), "tox-dropped")
    return docs.join(drop, F.col(f"`{id_col}`") == F.col("__dropped"), "left_anti")
