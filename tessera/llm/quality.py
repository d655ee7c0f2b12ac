"""Quality classification by hierarchical empirical Bayes.

A logistic regression over shape features of the whole text, trained on a bounded sample of labelled documents, gives
each document's own evidence. Grouped aggregation adds up that evidence for every host and path; hosts shrink towards
the global prior and paths towards their host, the more the fewer documents they have, with strengths estimated from the
spread between hosts and between paths. The site's posterior then takes the place of the global prior in the document's
odds. A document's own evidence is left out of its site's, and a path's out of its host's, so that none counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents that the classifier is fitted to, at most, spread by a hash of doc_id.
SAMPLE = 20_000
#: A document goes if its posterior of good quality is below this.
THRESHOLD = 0.5
#: Bounds of the estimated strengths, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0
SIGNS = "|!?%$&#*<>{}[]=/\\_@;:\"'().,-"
FEATURES = 20 + len(SIGNS)


def features(text: str) -> np.ndarray:
    """Shape of a text: lengths, kinds of characters, repetition of words, word pairs and lines."""
    out = np.zeros(FEATURES)
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return out
    inner = chars - text.count(" ") - text.count("\n")
    lines = [x for x in text.split("\n") if x]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=n)
    top = sorted(counts.values(), reverse=True)[:3]
    starts = sum(w[0].isupper() for w in words)
    ends = sum(w[-1] in ".!?" for w in words)
    letters = sum(map(str.isalpha, words))
    runs = sum(a == b for a, b in zip(words, words[1:]))
    doubled = sum(len(w) > 1 and not w[-1].isalnum() and w[-1] == w[-2] for w in words)
    marked = sum(not w[-1].isalnum() for w in words)
    bare = sum(not any(map(str.isalnum, w)) for w in words)
    out[:20] = [
        1.0, np.log1p(n), sizes.mean() / 10, sizes.std() / 10, len(counts) / n, top[0] / n, sum(top) / n,
        pairs / max(1, n - 1), runs / max(1, n - 1), starts / n, ends / n, letters / n, doubled / n, marked / n, bare / n,
        np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(c.isdigit() for c in text) / inner,
        sum(c.isupper() for c in text) / inner, float(n < 8),
    ]
    out[20:] = [text.count(c) / inner * 10 for c in SIGNS]
    return out


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights, -12, 12)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Model:
    """Logistic regression by Newton's method, with products of features for what one of them doesn't show alone."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale = 0.0, np.where(scale > 1e-9, scale, 1.0)
    scale[0] = 1.0
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w)


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The classifier, from at most SAMPLE labelled documents; None without both good and bad ones."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    # Of rows with one doc_id the text of least hash counts: no more rows than SAMPLE reach the driver.
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [features(t) for t in batch["text"]]})

    with common.batches_of(docs.sparkSession, common.TEXT_ROWS):
        found = rows.mapInPandas(measured, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    if found["quality"].nunique() < 2:
        return None
    return fit(np.stack(found["x"].to_numpy()), found["quality"].to_numpy(dtype=np.float64))


def host_of(source: Column) -> Column:
    """The host of `host/path`, with or without a scheme; null for null."""
    return F.regexp_extract(F.lower(source), r"^(?:[a-z]+://)?([^/?#]*)", 1)


def path_of(source: Column) -> Column:
    """The host and the first part of the path."""
    return F.regexp_extract(F.lower(source), r"^(?:[a-z]+://)?([^/?#]*(?:/[^/?#]*)?)", 1)


def mark() -> Column:
    return F.xxhash64(common.whole_text())


def evidence(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, mark, host, path, own (logit of the text alone) for each row of docs. Without a model every logit is 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("text")
            if shared.value is None:
                own = np.zeros(len(batch))
            else:
                own = shared.value.logits(np.stack([features(t) for t in texts])) if len(texts) else np.zeros(0)
            yield batch.assign(own=own).astype({"doc_id": "Int64"})

    source = F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), host_of(source).alias("host"), path_of(source).alias("path"), common.whole_text().alias("text"))
    return rows.mapInPandas(judged, "doc_id long, mark long, host string, path string, own double")


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(groups: DataFrame, total: str, n: str, centre: Column) -> float:
    """How many documents the prior of a level weighs, by the method of moments from the spread of its groups' means."""
    m = F.col(total) / F.col(n)
    row = groups.select(F.col(n).cast("double").alias("n"), m.alias("m"), centre.alias("c")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("m") - F.col("c")) ** 2), F.sum(F.col("c") * (1 - F.col("c"))), F.count("*"), F.sum(F.col("n") ** 2)).first()
    if not row[0] or row[3] < 2:
        return MOST_STRENGTH
    inner = row[2] / row[3]
    # Expected: between the groups, sum n (m - c)^2 = groups * inner + (sum n - sum n^2 / sum n) * spread
    spread = (row[1] - row[3] * inner) / max(row[0] - row[4] / row[0], 1e-9)
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, inner / spread - 1))) if spread > 0 else MOST_STRENGTH


def posteriors(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, mark, own, site, posterior for each row of docs."""
    rows = common.written(evidence(docs, model), "evidence", common.TEXT_ROWS).withColumn("p", 1 / (1 + F.exp(-F.col("own"))))
    paths = rows.where("host is not null").groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("p").alias("s_path"))
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"), F.count("*").alias("paths"))
    paths = common.written(paths.join(hosts, "host"), "paths")
    hosts = paths.groupBy("host").agg(F.first("n_host").alias("n_host"), F.first("s_host").alias("s_host"))
    whole = hosts.agg(F.sum("s_host"), F.sum("n_host")).first()
    prior = min(0.999, max(0.001, (whole[0] or 0.5) / (whole[1] or 1)))
    k_host = strength(hosts, "s_host", "n_host", F.lit(prior))
    # The host's posterior from its other paths, the path's from its other documents.
    above = (F.lit(prior * k_host) + F.col("s_host") - F.col("s_path")) / (k_host + F.col("n_host") - F.col("n_path"))
    k_path = strength(paths.where("paths > 1"), "s_path", "n_path", above)
    sites = paths.select("host", "path", "paths", "n_path", "s_path", above.alias("above"))
    joined = rows.join(sites, ["host", "path"], "left")
    # A host with a single path has no level between: its posterior is the site's, from its other documents.
    strong, centre = F.when(F.col("paths") > 1, k_path).otherwise(k_host), F.when(F.col("paths") > 1, F.col("above")).otherwise(prior)
    site = (centre * strong + F.col("s_path") - F.col("p")) / (strong + F.col("n_path") - 1)
    site = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.coalesce(site, F.lit(prior))))
    joined = joined.withColumn("site", site)
    both = F.col("own") + logit(F.col("site")) - float(np.log(prior / (1 - prior)))
    return joined.select("doc_id", "mark", "own", "site", (1 / (1 + F.exp(-both))).alias("posterior"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, own (probability of good quality by the text alone), site, posterior, kept for each row of docs.

    Documents without a source have the global prior as their site. Texts that are null or have no word are not kept,
    whatever their site; long texts are read whole; a posterior of just THRESHOLD is kept. Repeated rows are judged one by
    one, each as evidence on its site. A doc_id with two labels counts as good. Without labels of both kinds every text
    says nothing and all with words are kept. Other columns are ignored; an empty table gives no row.
    """
    rows = posteriors(docs, learn(docs, labels))
    empty = F.col("mark") == F.xxhash64(F.lit(""))
    kept = (F.col("posterior") >= THRESHOLD) & ~empty
    return rows.select("doc_id", "mark", (1 / (1 + F.exp(-F.col("own")))).alias("own"), "site", "posterior", kept.alias("kept"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classified() keeps; columns as in docs."""
    key, own = common.fresh(docs, "key"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"))
    gone = classified(docs, labels).where("not kept").select(F.struct("doc_id", "mark").alias("gone")).distinct()
    rows = docs.withColumn(key, own).alias("docs")
    return rows.join(gone.alias("rejected"), F.col(f"docs.{key}").eqNullSafe(F.col("rejected.gone")), "left_anti").drop(key)
