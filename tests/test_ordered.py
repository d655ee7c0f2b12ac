"""Searches and pages of ordered tables against sorting everything; and how many files they open."""

import random

from pyspark.sql import functions as F

from tessera.sources.ordered import OrderedTable


def test_searches_and_pages(spark, tmp_path):
    rng = random.Random(1)
    names = [rng.choice(("ANN", "BO", "É", "日本", "")) + rng.choice(("", " X", "Z")) + str(rng.randrange(40)) for _ in range(500)]
    rows = spark.createDataFrame([(n, f"e{k:03d}", k) for k, n in enumerate(names)] + [(None, "e999", 1)], "canonical string, entity_id string, n int")
    table = OrderedTable.write(rows, f"{tmp_path}/t", ["canonical", "entity_id"], 25)
    all_rows = sorted(((n, f"e{k:03d}", k) for k, n in enumerate(names)), key=lambda r: (r[0].encode(), r[1]))
    after, seen = None, []
    while True:
        page = table.page(30, after)
        assert len(page.inputFiles()) <= 4
        got = [tuple(r) for r in page.collect()]
        if not got:
            break
        seen += got
        after = got[-1][:2]
    assert seen == all_rows
    for prefix in ("ANN", "ANN X", "BO1", "É", "日", "none", "", "Z"):
        want = [r for r in all_rows if r[0].startswith(prefix)]
        first = [tuple(r) for r in table.search(prefix, 20).collect()]
        assert first == want[:20]
        if len(want) > 20:
            second = table.search(prefix, 20, first[-1][:2])
            assert [tuple(r) for r in second.collect()] == want[20:40] and len(second.inputFiles()) <= 4
    assert spark.read.parquet(f"{tmp_path}/t/index").agg(F.sum("n")).first()[0] == 500


def test_empty_table(spark, tmp_path):
    table = OrderedTable.write(spark.createDataFrame([], "a string, b long"), f"{tmp_path}/t", ["a", "b"])
    assert table.page(5).count() == 0 and table.search("x", 5).columns == ["a", "b"]
