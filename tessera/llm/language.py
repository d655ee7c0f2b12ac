"""Language identification by averaged embeddings of hashed letter n-grams and a linear softmax.

The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled rows; its scores are
calibrated on rows of that sample that training leaves out, with a threshold below which a prediction is marked as
rejected. Averaging and the linear layer commute, so that a prediction only needs the mean of each n-gram's scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the model is fitted to: for each language at most, and at most so many in all, of which every
#: language gets an equal share, but always LEAST_PER_LANGUAGE.
SAMPLE_PER_LANGUAGE, SAMPLE = 400, 25_600
LEAST_PER_LANGUAGE = 10
BUCKETS = 1 << 15
DIMENSIONS = 16
#: Rounds over the sample, at least, and the steps that they make together, at least.
EPOCHS, STEPS = 12, 20_000
RATE = 0.5
#: Every so manieth sampled row calibrates and doesn't train.
CALIBRATE_EVERY = 5
#: Share of wrong predictions that the calibration rows may have above the threshold.
ACCEPTED_ERROR = 0.01
UNKNOWN = "und"
#: Characters looked at in one go, and as many more as end a word.
SLICE = 1 << 20

_letters: list[np.ndarray] = []


def letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0][codes]


def slices(text: str) -> Iterator[str]:
    """The text in parts of SLICE characters and as many more as end a word, so that no word is cut."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams of two to four letters, word ends included. Nothing without a letter."""
    for part in slices(text):
        codes = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.concatenate(([0], np.where(letters(codes), codes, 0), [0])).astype(np.uint32)
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
        if len(codes) < 3:
            continue
        inner = codes != 0
        two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) + codes[2:]
        four = three[:-1] * np.uint32(0xC2B2AE35) + codes[3:]
        found = np.concatenate((two, three[inner[1:-1]], four[inner[1:-2] & inner[2:-1]]))
        found = found * np.uint32(0x27D4EB2F)
        yield (found ^ (found >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for found in ngrams(text):
        total += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """languages, the scores of every bucket for each of them, the temperature and the threshold of acceptance."""

    def __init__(self, languages: list[str], scores: np.ndarray, heat: float = 1.0, threshold: float = 0.0):
        self.languages, self.scores, self.heat, self.threshold = languages, scores.astype(np.float32), heat, threshold

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.languages)), 0
        for found in ngrams(text or ""):
            total += self.scores[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        if not n or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(total / n / self.heat)
        return self.languages[int(p.argmax())], float(p.max())


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """A model from (language, buckets, counts)."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    rng, number = np.random.default_rng(seed), {x: k for k, x in enumerate(languages)}
    train = [r for k, r in enumerate(rows) if k % CALIBRATE_EVERY or len(rows) < 2 * CALIBRATE_EVERY]
    apart = [r for k, r in enumerate(rows) if not k % CALIBRATE_EVERY] or train
    embedding = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32)
    epochs = max(EPOCHS, STEPS // len(train))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(len(train)):
            language, at, n = train[k]
            if rng.random() < 0.5:  # short texts are to be recognised too
                pick = rng.choice(len(at), size=min(len(at), int(rng.integers(4, 120))), replace=False)
                at, n = at[pick], n[pick]
            share = n / n.sum()
            hidden = share @ embedding[at]
            error = softmax(hidden @ weights)
            error[number[language]] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            embedding[at] -= rate * np.outer(np.minimum(share * 30, 1), back)
    scores = embedding @ weights
    means = np.array([n / n.sum() @ scores[at] for _, at, n in apart])
    truth = np.array([number[x] for x, _, _ in apart])
    heats = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(softmax(means / h)[np.arange(len(truth)), truth], 1e-12)).mean() for h in heats]
    heat = float(heats[int(np.argmin(losses))])
    p = softmax(means / heat)
    order = np.argsort(-p.max(axis=1), kind="stable")
    wrong = np.cumsum(p.argmax(axis=1)[order] != truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(wrong <= ACCEPTED_ERROR)
    return Model(languages, scores, heat, float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id's decimal text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """Fits a model to text and lang of a bounded sample: rows that aren't held out and have both, spread by a hash of doc_id.

    Every language is learned. Rows reach the driver as n-gram counts in BUCKETS buckets, so that long texts don't weigh
    more than that.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = common.written(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max(LEAST_PER_LANGUAGE, min(SAMPLE_PER_LANGUAGE, SAMPLE // max(1, sizes.count())))
    # Only hashes low enough for four times the sample are ranked, so that a frequent language doesn't fill one task.
    spread = F.xxhash64(F.col("doc_id").cast("long"))
    low = spread.cast("double") <= -(2.0**63) + 2.0**64 * F.least(F.lit(1.0), F.lit(4.0 * each) / F.col("n"))
    rows = known.select("doc_id", "lang", "text").join(sizes, "lang").where(low)
    order = Window.partitionBy("lang").orderBy(spread, "doc_id", F.xxhash64("text"))
    sample = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each).select("lang", "doc_id", "nth", "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counts(t) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "nth": batch["nth"], "at": [a for a, _ in found], "n": [n for _, n in found]})

    with common.batches_of(docs.sparkSession, common.TEXT_ROWS):
        rows = sample.mapInPandas(counted, "lang string, nth int, at array<int>, n array<float>").toPandas().sort_values(["nth", "lang"])
    return fit([(r.lang, np.asarray(r.at, dtype=np.int64), np.asarray(r.n, dtype=np.float32)) for r in rows.itertuples()])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs.

    lang_pred is `und`, with score 0, where the text is null or has no letter, and everywhere if there was nothing to
    learn from. Ties go to the language that sorts first. Long texts are read whole. Rows are kept one by one, repeated
    ones too; other columns are ignored; an empty table gives no row. rejected marks scores below the calibrated threshold.
    """
    model = learn(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch["text"]]
            out = pd.DataFrame(found, columns=["lang_pred", "score"])
            out["rejected"] = (out["score"] < shared.value.threshold) | (out["lang_pred"] == UNKNOWN)
            yield pd.concat([batch[["doc_id", "held_out"]].reset_index(drop=True), out], axis=1).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), common.whole_text().alias("text"))
    out = rows.mapInPandas(predicted, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
    return common.written(out, "languages", common.TEXT_ROWS)
