"""Toxicity by weak supervision.

Many voters look at a text: one per word of an insult lexicon, one per word
stem that is typical of toxic rows in the labelled sample, and patterns
(several insults, shouting, an insult aimed at the reader).  In a generative
label model the class is latent: it estimates how often each voter fires on
toxic and on clean texts and which voters fire together beyond that (those
count for less); the label given to a sample row is one more voter of known
accuracy.  Its posterior labels train a linear classifier, which scores every
whole text.

The model is fitted on at most ``FIT_ROWS`` labelled rows; everything else runs
over all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rows import sliced
from tickloom.session import settle

FIT_ROWS = 8_192        # labelled rows the voters and the classifier are fitted on
STEMS = 256             # mined stems that vote
STEM_SIZES = (4, 5)     # leading letters of a word
CHANCE = 1e-4           # stems of toxic rows only count if chance gives one of all stems seen less often
LEAST_SHARE = 0.01      # a mined stem occurs in at least this share of the toxic sample rows
GIVEN_ACCURACY = 0.97   # of the labels given
MOST_COUNT = 4          # occurrences of a feature beyond this count no more

# Insults of everyday English.
LEXICON = (
    "clown", "coward", "creep", "disgrace", "disgusting", "dumb", "fool", "freak", "garbage", "idiot", "imbecile",
    "jerk", "liar", "loser", "lunatic", "maggot", "moron", "parasite", "pathetic", "scum", "stupid", "trash", "ugly",
    "useless", "vermin", "worthless",
)

WORD = re.compile(r"[^\W\d_]+").findall
AIMED = re.compile(r"\byou(?:'re| are| r)?\s+(?:an?\s+|such\s+an?\s+|all\s+)?(?:" + "|".join(LEXICON) + r")\b").search
SHOUT = re.compile(r"\b[A-Z]{4,}\b").findall


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a null id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass(frozen=True)
class Model:
    stems: tuple[str, ...]
    weights: tuple[float, ...]      # of the lexicon, the stems and the patterns
    bias: float

    def voters(self) -> Voters:
        return Voters(self.stems)


class Voters:
    """What the voters see in a text, as counts."""

    def __init__(self, stems: tuple[str, ...]):
        self.words = {w: i for i, w in enumerate(LEXICON)}
        self.stems = {s: len(LEXICON) + i for i, s in enumerate(stems)}
        self.patterns = len(LEXICON) + len(stems)
        self.size = self.patterns + 3

    def counts(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.size, np.int32)
        if not text:
            return out
        low = text.lower()
        insults = 0
        words, stems = self.words, self.stems
        for word in WORD(low):
            if (at := words.get(word)) is not None:
                out[at] += 1
                insults += 1
            for size in STEM_SIZES:
                if (at := stems.get(word[:size])) is not None:
                    out[at] += 1
        out[self.patterns] = insults >= 2
        out[self.patterns + 1] = insults and bool(AIMED(low))
        out[self.patterns + 2] = insults and len(SHOUT(text)) >= 3
        return np.minimum(out, MOST_COUNT)


def label_model(fired: np.ndarray, given: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
    """Posterior of the toxic class for each row of 0/1 votes and its given 0/1 label.

    Expectation maximisation over a latent class; rates are smoothed by one
    row.  Correlations of two voters within the classes, estimated from the
    posterior, divide the evidence of voters that fire together.
    """
    n, voters = fired.shape
    votes, given = fired.astype(float), given.astype(float)
    told = (2 * given - 1) * np.log(GIVEN_ACCURACY / (1 - GIVEN_ACCURACY))
    posterior = np.where(given + (votes.sum(1) > 0) > 1, 0.95, np.where(given > 0, 0.6, 0.05))
    for _ in range(rounds):
        rates = [(w @ votes + k) / (w.sum() + 2 * k) for w, k in ((posterior, 0.5), (1 - posterior, 0.05))]
        centred = votes - np.outer(posterior, rates[0]) - np.outer(1 - posterior, rates[1])
        spread = np.sqrt(np.maximum((centred**2).mean(0), 1e-9))
        together = np.clip((centred.T @ centred) / n / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(together, 0)
        share = 1 / (1 + np.where(together > 0.1, together, 0).sum(1))
        for_, against = share * np.log(rates[0] / rates[1]), share * np.log((1 - rates[0]) / (1 - rates[1]))
        odds = votes @ for_ + (1 - votes) @ against + np.log(prior / (1 - prior)) + told
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior


def features(counts: np.ndarray) -> np.ndarray:
    """That a voter fires counts most, how often a little."""
    return (counts > 0) + 0.3 * np.log1p(counts)


def linear_classifier(counts: np.ndarray, posterior: np.ndarray, rounds: int = 600, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient descent; both classes weigh the same."""
    x = features(counts)
    mass = np.where(posterior > 0.5, 0.5 / max((posterior > 0.5).sum(), 1), 0.5 / max((posterior <= 0.5).sum(), 1))
    weights, bias = np.zeros(x.shape[1]), 0.0
    speed, bias_speed = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        gap = (1 / (1 + np.exp(-(x @ weights + bias))) - posterior) * mass
        speed = 0.9 * speed - rate * (x.T @ gap + decay * weights)
        bias_speed = 0.9 * bias_speed - rate * gap.sum()
        weights, bias = weights + speed, bias + bias_speed
    # where the classes part, half of the gap to either side
    odds = x @ weights + bias
    clean, toxic = np.quantile(odds[posterior <= 0.5], 0.999) if (posterior <= 0.5).any() else -1.0, np.quantile(odds[posterior > 0.5], 0.005)
    return weights, bias - (clean + toxic) / 2 if toxic > clean else bias


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fits on labelled rows that are not held out, at most ``fit_rows`` of them by hash of their id.

    Without labelled rows of both classes no stem is mined and the lexicon
    and patterns decide with equal weights.
    """
    chosen = (
        labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .filter(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    texts = docs.select(docs[f"`{id_column}`"].alias("doc_id"), F.coalesce(docs[f"`{text_column}`"], F.lit("")).alias("text"))
    sample = settle(texts.join(F.broadcast(chosen), "doc_id"))        # at most fit_rows ids
    by_class = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = by_class.get(1, 0), by_class.get(0, 0)
    if not toxic or not clean:
        return _unfitted()
    stems = _mine(sample, toxic, clean)
    voters = Voters(stems)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            seen = [voters.counts(t).astype("u1").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), batch.column("toxic").cast(pa.int32())], ["counts", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(look, "counts binary, toxic int").toPandas()       # at most fit_rows short rows
    counts = np.stack([np.frombuffer(r, "u1") for r in rows["counts"]])
    posterior = label_model(counts > 0, rows["toxic"].to_numpy() > 0, toxic / (toxic + clean))
    if not (posterior > 0.5).any():
        return _unfitted()
    weights, bias = linear_classifier(counts, posterior)
    return Model(stems, tuple(map(float, weights)), float(bias))


def _unfitted() -> Model:
    return Model((), tuple([2.0] * (len(LEXICON) + 3)), -2.5)


def _mine(sample: DataFrame, toxic: int, clean: int) -> tuple[str, ...]:
    """Stems that occur in many toxic and few clean sample rows."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))).alias("word")
    words = sample.select(F.monotonically_increasing_id().alias("row"), "toxic", word)
    stems = words.select("row", "toxic", F.explode(F.array(*[F.substring("word", 1, k) for k in STEM_SIZES])).alias("stem"))
    rows = stems.filter(F.length("stem") >= min(STEM_SIZES)).distinct()
    n = settle(rows.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    odds = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1)))
    by_chance = math.log(CHANCE / max(1, n.count())) / math.log(toxic / (toxic + clean))       # so many toxic rows and no clean one
    good = n.filter((F.col("t") >= max(by_chance, LEAST_SHARE * toxic)) & (F.col("c") <= 0.002 * clean) & (odds > 3))
    return tuple(r["stem"] for r in good.orderBy(F.desc(F.col("t") * odds), "stem").limit(STEMS).collect())


def score_column(model: Model, text: Column) -> Column:
    """Score from 0 to 1 of a text column."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        voters, weights = model.voters(), np.array(model.weights)
        for column in texts:
            out = np.array([features(voters.counts(t)) @ weights for t in column.to_pylist()], float) + model.bias
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))), pa.float64())

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts get the score of a text without any vote."""
    model = fit(docs, labels, fit_rows, id_column, text_column)
    rows = docs.select(docs[f"`{id_column}`"].alias("doc_id"), docs[f"`{text_column}`"].alias("text"))
    return (
        rows.withColumn("score", score_column(model, F.col("text")))
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; columns as they were."""
    model = fit(docs, labels, fit_rows)
    return docs.filter(score_column(model, docs["text"]) < 0.5)
