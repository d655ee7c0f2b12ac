import random

import corpus_pipeline
from tessera.llm import common

from .data import SCHEMA, odd, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(16)
    shared = prose(rng, 60) + "."
    good = [prose(rng, 120) + ".\n" + prose(rng, 80) + "." for _ in range(30)]
    texts = good + [good[0]] + [g + " end." for g in good[1:3]] + [prose(rng, 50) + ".\n" + shared for _ in range(4)] + [prose(rng, 40) + " write to a.b@c.com now."]
    junk = [" ".join(w + "%%%" for w in prose(rng, 90).split()) for _ in range(20)]
    table = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts + junk + odd(rng))]
    docs = spark.createDataFrame(table, COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    n = len(texts)
    labels = [(k, int(k < n), 0) for k in range(0, n + len(junk), 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "order_minhash", "pii", "best_fit_packing"]
    kept, out = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = common.written(stage(spark, kept, str(tmp_path)), f"test-{name}")
        out[name] = kept
        if name != "best_fit_packing":
            assert kept.columns == docs.columns
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").distinct().collect()) for name, df in out.items()}
    assert set(range(n)) <= set(ids["quality_classifier"]) and not set(range(n, n + len(junk))) & set(ids["quality_classifier"])
    texts_now = {r.doc_id: r.text for r in out["line_dedup"].collect()}
    assert texts_now[30] == "" and texts_now[0] == good[0] and sum(shared in (t or "") for t in texts_now.values()) == 1
    assert ids["line_dedup"] == ids["quality_classifier"]
    assert any("<email>" in (r.text or "") for r in out["pii"].collect()) and all((r.n_chars or 0) == len(r.text or "") for r in out["pii"].collect())
    assert ids["best_fit_packing"] == ids["pii"] == ids["order_minhash"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(run.select("doc_id", "length").collect()) == sorted(out["best_fit_packing"].select("doc_id", "length").collect())
