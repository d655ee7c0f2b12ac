import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality

from .data import SCHEMA, odd, prose

LABELS = "doc_id long, quality int, toxic int"


def junk(rng, n):
    return " ".join(w + "%%%" for w in prose(rng, n).split())


def test_good_stay_and_bad_go(spark):
    rng = random.Random(14)
    table, labels = [], []
    for k in range(200):
        bad = rng.random() < 0.3
        table.append((k, junk(rng, 80) if bad else prose(rng, 80) + ".", "en", f"host{k % 4}/a{k % 3}", 0, 0.0, "x"))
        if k % 2:
            labels.append((k, int(not bad), 0))
    extra = [(1000 + k, t, None, None if k % 2 else "", 0, 0.0, None) for k, t in enumerate(odd(rng))]
    docs = spark.createDataFrame(table + extra + table[:1], SCHEMA)
    out = quality.classified(docs, spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], LABELS)).collect()
    assert len(out) == len(table) + len(extra) + 1
    truth = {d: "%%%" not in t for d, t, *_ in table}
    assert all(r.kept == truth[r.doc_id] for r in out if r.doc_id in truth)
    empty = {d for d, t, *_ in extra if not t}
    assert not any(r.kept for r in out if r.doc_id in empty)
    assert all(0 <= r.posterior <= 1 and 0 < r.site < 1 for r in out)
    left = quality.good(docs, spark.createDataFrame(labels, LABELS))
    assert left.columns == docs.columns and left.where(F.col("doc_id") < 200).count() == sum(truth[d] for d, *_ in table) + truth[0]


def judged(spark, monkeypatch, rows):
    """doc_id -> (site, posterior) for (doc_id, source, logit)."""
    own = quality.evidence
    logits = spark.createDataFrame([(d, x) for d, _, x in rows], "doc_id long, x double")
    monkeypatch.setattr(quality, "evidence", lambda docs, model: own(docs, None).drop("own").join(logits, "doc_id").withColumnRenamed("x", "own"))
    docs = spark.createDataFrame([(d, f"t{d}", None, s, 0, 0.0, None) for d, s, _ in rows], SCHEMA)
    return {r.doc_id: (r.site, r.posterior) for r in quality.posteriors(docs, None).collect()}


def brute(rows):
    """The same with plain loops."""
    p = {d: 1 / (1 + math.exp(-x)) for d, _, x in rows}
    paths, hosts = {}, {}
    for d, source, _ in rows:
        if source is not None:
            path = "/".join(source.split("/")[:2])
            paths.setdefault(path, []).append(p[d])
            hosts.setdefault(path.split("/")[0], {}).setdefault(path, []).append(p[d])
    everything = [x for v in paths.values() for x in v]
    prior = sum(everything) / len(everything)

    def strength(groups):
        if len(groups) < 2:
            return quality.MOST_STRENGTH
        n = [len(v) for v, _ in groups]
        inner = sum(c * (1 - c) for _, c in groups) / len(groups)
        between = sum(len(v) * (sum(v) / len(v) - c) ** 2 for v, c in groups)
        spread = (between - len(groups) * inner) / max(sum(n) - sum(k * k for k in n) / sum(n), 1e-9)
        return min(quality.MOST_STRENGTH, max(quality.LEAST_STRENGTH, inner / spread - 1)) if spread > 0 else quality.MOST_STRENGTH

    k_host = strength([([x for v in own.values() for x in v], prior) for own in hosts.values()])

    def above(host, path):
        rest = [x for k, v in hosts[host].items() if k != path for x in v]
        return (prior * k_host + sum(rest)) / (k_host + len(rest))

    k_path = strength([(v, above(h, path)) for h, own in hosts.items() if len(own) > 1 for path, v in own.items()])
    out = {}
    for d, source, x in rows:
        site = prior
        if source is not None:
            path = "/".join(source.split("/")[:2])
            host = path.split("/")[0]
            k, centre = (k_path, above(host, path)) if len(hosts[host]) > 1 else (k_host, prior)
            rest = sum(paths[path]) - p[d]
            site = min(0.999, max(0.001, (centre * k + rest) / (k + len(paths[path]) - 1)))
        out[d] = site, 1 / (1 + math.exp(-(x + math.log(site / (1 - site)) - math.log(prior / (1 - prior)))))
    return out


@pytest.mark.parametrize("paths", [0, 1, 4])
def test_posteriors_against_brute_force(spark, monkeypatch, paths):
    rng = random.Random(paths)
    rows = []
    for d in range(400):
        host = int(rng.random() ** 2 * 12)
        path = rng.randrange(paths) if paths else 0
        source = None if d % 50 == 0 else f"host{host}" + (f"/p{path}/x{d}" if paths else "")
        rows.append((d, source, rng.gauss((host - 5) / 2 + path / 3, 1.0)))
    got, want = judged(spark, monkeypatch, rows), brute(rows)
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-9 for d in got for a, b in zip(got[d], want[d]))


def test_hosts_without_paths_keep_their_means_and_sparse_ones_shrink(spark, monkeypatch):
    rows = [(k, f"host{k % 3}", (-2.0, 0.0, 2.0)[k % 3] + (k % 7 - 3) / 10) for k in range(900)] + [(1000, "few", 2.0), (1001, "few", 2.1)]
    site = {d: s for d, (s, _) in judged(spark, monkeypatch, rows).items()}
    assert abs(site[0] - 0.12) < 0.03 and abs(site[1] - 0.5) < 0.03 and abs(site[2] - 0.88) < 0.03
    assert 0.5 < site[1000] < site[2]


def test_paths_of_few_documents_are_near_their_host(spark, monkeypatch):
    rows = []
    for h in range(8):
        for path in range(6):
            n = 2 if path == 0 else 40
            rows += [(len(rows) + k, f"h{h}/p{path}", (h - 4) / 2 + (path - 2) / 2 + (k % 5 - 2) / 10) for k in range(n)]
    out = judged(spark, monkeypatch, rows)
    mean = lambda keep: sum(1 / (1 + math.exp(-x)) for _, s, x in rows if keep(s)) / sum(keep(s) for _, s, _ in rows)
    for h in range(8):
        own, host = mean(lambda s: s == f"h{h}/p0"), mean(lambda s: s.startswith(f"h{h}/"))
        few = next(out[d][0] for d, s, _ in rows if s == f"h{h}/p0")
        many, mine = next(out[d][0] for d, s, _ in rows if s == f"h{h}/p5"), mean(lambda s: s == f"h{h}/p5")
        assert own < few and abs(few - host) < abs(few - own) and abs(many - mine) < abs(many - host)


def test_repeated_ids_do_not_swell_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "features", lambda t, own=quality.features: own(t))
    monkeypatch.setattr(quality, "fit", lambda x, y, own=quality.fit: seen.append(len(x)) or own(x, y))
    table = [(k % 4, f"some words {k}", None, "a", 0, 0.0, None) for k in range(400)]
    quality.learn(spark.createDataFrame(table, SCHEMA), spark.createDataFrame([(k, k % 2, 0) for k in range(4)], LABELS))
    assert seen == [4]


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a/b", 0, 0.0, None)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert [r.kept for r in quality.classified(docs, none).collect()] == [True]
    assert quality.classified(docs.limit(0), none).count() == 0
