"""Dictionaries, decoys and the cache of lookups."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.operators import detect, entities, graph, lookups, rewrite
from tessera.plans.anonymize import Options, anonymize, found_entities

NOW = dt.datetime(2024, 1, 2)
CACHE = "term string, results array<struct<dict:string,type:string,jurisdiction:string>>, expires_at timestamp"


def names(spark, *rows):
    return spark.createDataFrame([(t, d, True, k, j, "high", {}, n) for n, (t, d, k, j) in enumerate(rows)], lookups.DICTIONARY)


def test_lookup_and_dictionaries(spark):
    table = names(spark, ("Lyon", "cities", "city", "fr"), ("Lyon", "names", "surname", "uk"), ("Leeds", "cities", "city", "uk"))
    terms = spark.createDataFrame([("Lyon",), ("none",)], "term string")
    assert lookups.lookup(terms, table).count() == 2
    assert [r.dict for r in lookups.lookup(terms, table, ["fr"]).collect()] == ["cities"]
    assert lookups.lookup(terms, table, []).count() == 2
    rows = {(r.dict, r.jurisdiction): (r.entry_count, r.updated_at) for r in lookups.dictionaries(table.withColumn("updated_at", F.lit(NOW))).collect()}
    assert rows == {("cities", "fr"): (1, NOW), ("names", "uk"): (1, NOW), ("cities", "uk"): (1, NOW)}
    assert {r.updated_at for r in lookups.dictionaries(table).collect()} == {None}


def test_decoys(spark):
    terms = spark.createDataFrame([(f"t{k}", 0, k // 74) for k in range(100)], "term string, shard int, batch int")
    once, again = (lookups.with_decoys(terms, 3).orderBy("batch", "place").collect() for _ in range(2))
    assert once == again and [r.term for r in once] != [r.term for r in lookups.with_decoys(terms, 4).orderBy("batch", "place").collect()]
    real = [r.term for r in once if r.real]
    assert sorted(real) == sorted(f"t{k}" for k in range(100)) and sum(not r.real for r in once) == 26 + 10
    pools = (L.FIRST_NAMES + " " + L.NEUTRAL_NAMES + " " + L.SURNAMES + " " + L.COMPANY_NAMES).split()
    assert all(r.term in pools for r in once if not r.real)
    results = spark.createDataFrame([("t1",), ("Renaud",)], "term string")
    assert [r.term for r in lookups.real_results(results, terms).collect()] == ["t1"]


def test_cache(spark):
    rows = spark.createDataFrame([("a", 1, NOW), ("a", 2, NOW + dt.timedelta(hours=1)), ("b", 3, NOW - dt.timedelta(hours=30))], "term string, results int, at timestamp")
    cache = lookups.cache_put(spark.createDataFrame([("b", 9, NOW), ("c", 4, NOW)], "term string, results int, expires_at timestamp"), rows)
    assert {(r.term, r.results) for r in cache.collect()} == {("a", 2), ("b", 3), ("c", 4)}
    probes = spark.createDataFrame([("a", NOW + dt.timedelta(hours=25)), ("a", NOW + dt.timedelta(hours=25, seconds=1)), ("c", NOW)], "term string, at timestamp")
    assert sorted((r.term, r.at > NOW + dt.timedelta(hours=25), r.results) for r in lookups.cache_get(cache, probes).collect()) == [("a", False, 2), ("a", True, None), ("c", False, 4)]
    assert {r.term for r in lookups.cache_sweep(cache, F.lit(NOW)).collect()} == {"a"}


def test_cached_answers_come_before_the_dictionary(spark):
    """A cached term isn't looked up; a cached text of several words keeps its words from being looked up, even without entries."""
    docs = spark.createDataFrame([(1, "on voit Dupont Lyon et Martin puis Jean Petit ici")], "doc_id long, text string")
    table = names(spark, ("Dupont", "surnames", "surname", "fr"), ("Martin", "surnames", "surname", "fr"), ("Petit", "surnames", "surname", "fr"))
    later = NOW + dt.timedelta(hours=1)
    cache = spark.createDataFrame([("Martin", [("cities", "city", "fr")], NOW), ("Dupont Lyon", [], later), ("Jean Petit", [("firms", "company", "fr")], later), ("Petit", [("old", "city", "fr")], NOW - dt.timedelta(hours=1))], CACHE)
    plain = {r.text: (r.type, r.sources) for r in found_entities(docs, table, Options(jurisdictions=[]))[1].collect()}
    assert plain == {"Dupont Lyon": ("person", ["surnames"]), "Martin": ("person", ["surnames"] * 2), "Jean Petit": ("person", ["surnames"])}
    found = {r.text: (r.type, r.sources) for r in found_entities(docs, table, Options(jurisdictions=[]), cache=cache, now=F.lit(NOW))[1].collect()}
    assert found == {"Dupont Lyon": ("unknown", ["local:candidate"]), "Martin": ("city", ["cities"] * 2), "Jean Petit": ("company", ["firms"])}
    misses = lookups.cache_misses(detect.groups(detect.analysed(docs)), cache, F.lit(NOW))
    assert {r.term for r in misses.collect()} == set()
    assert anonymize(docs, table, Options(jurisdictions=[]), cache=cache, now=F.lit(NOW)).texts.first().anonymized == "on voit Entité 1 et Ville 1 puis Société 1 ici"


def test_without_a_dictionary(spark):
    docs = spark.createDataFrame([(1, "on voit Dupont ici"), (2, "rien"), (3, None)], "doc_id long, text string")
    out = anonymize(docs)
    assert {r.doc_id: r.anonymized for r in out.texts.collect()} == {1: "on voit Entité 1 ici", 2: "rien", 3: None}
    assert [(r.type, r.confidence) for r in out.entities.collect()] == [("unknown", "low")]


def test_batches(spark):
    terms = spark.createDataFrame([(f"t{k}",) for k in range(200)], "term string")
    sizes = [r["count"] for r in entities.lookup_batches(terms).groupBy("shard", "batch").count().collect()]
    assert sorted(sizes) == [52, 74, 74]


def test_graph_lookups(spark):
    known = spark.createDataFrame([("e1", "DUPONT", "person"), ("e2", "DUPONT", "company"), ("e3", "LYON", "city")], "entity_id string, canonical string, type string")
    assert {r.entity_id for r in graph.by_canonical(known, "Dupont").collect()} == {"e1", "e2"}
    assert [r.entity_id for r in graph.by_type(known, "city").collect()] == ["e3"]
    occurrences = spark.createDataFrame([("e1", "d1", False), ("e1", "d2", False), ("e2", "d1", True)], "entity_id string, document_id string, confirmed boolean")
    pairs = spark.createDataFrame([("e1", "d2"), ("e1", "d2"), ("e9", "d1")], "entity_id string, document_id string")
    assert {(r.entity_id, r.document_id): r.confirmed for r in graph.confirmed(occurrences, pairs).collect()} == {("e1", "d1"): False, ("e1", "d2"): True, ("e2", "d1"): True}
    assert {r.document_id for r in graph.occurrences_of(occurrences, "e1").collect()} == {"d1", "d2"}
    assert graph.document_occurrences(occurrences, spark.createDataFrame([("d1",)], "document_id string")).count() == 2


def test_review(spark):
    schema = "doc_id long, text string, start int, `end` int, type string, confidence string, alias string, pass int, ord int"
    found = spark.createDataFrame([(1, "Dupont", 0, 6, "person", "high", "Renaud", 4, 0), (1, "dupont", 7, 13, "unknown", "low", "Entité 1", 5, 7)], schema)
    choices = spark.createDataFrame([("dupont", "X")], "key string, alias string")
    assert {r.accepted for r in rewrite.chosen(found, choices).collect()} == {"X"}
    docs = spark.createDataFrame([(1, "Dupont dupont <b>"), (2, "a & b")], "doc_id long, text string")
    assert {r.doc_id: r.rendered for r in rewrite.review_rendered(docs, found).collect()} == {1: '<span class="person">Dupont</span> <span class="unknown">dupont</span> &lt;b&gt;', 2: "a &amp; b"}
    final = rewrite.skip_unconfirmed(rewrite.accept_all(found.withColumn("accepted", F.lit(None).cast("string"))))
    assert {r.doc_id: r.anonymized for r in rewrite.review_output(docs, final).collect()}[1] == "Renaud dupont <b>"


def test_frequent_words_are_no_hot_keys(spark, monkeypatch):
    rng = random.Random(3)
    words = rng.choices([f"w{k}" for k in range(400)], weights=[1 / (k + 1) for k in range(400)], k=6000)
    each = spark.createDataFrame([(k, None if k % 10 == 0 else w) for k, w in enumerate(words)], "doc_id long, word string")
    entries = spark.createDataFrame([(f"w{k}", f"d{n}") for k in range(0, 400, 2) for n in range(1 + k % 3)] + [("never", "d")], "word string, dict string")
    plain = sorted(map(repr, each.join(entries, "word", "left").collect()))
    assert sorted(map(repr, entities.looked_up(each, entries).collect())) == plain
    monkeypatch.setattr(entities, "MOST_ENTRIES", 100)
    key = "spark.sql.adaptive.enabled"
    before = (spark.conf.get(key), spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    try:
        spark.conf.set(key, False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        out = entities.looked_up(each, entries)
        assert sorted(map(repr, out.collect())) == plain
        # The rows that were shuffled by word come last in the union: its last partitions.
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()][-4:]
        assert max(sizes) <= 2 * sorted(sizes)[1]
    finally:
        spark.conf.set(key, before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])


def test_a_document_of_many_entities(spark):
    """Matches whose last document holds 200,000 entities: its entities aren't gathered for each of them."""
    n = 200_000
    known = spark.range(n).select(F.format_string("e%06d", "id").alias("entity_id"), F.format_string("NAME %d", "id").alias("canonical"), F.lit("person").alias("type"), F.lit(None).cast("timestamp").alias("last_seen"))
    seen = spark.range(n).select(F.format_string("e%06d", "id").alias("entity_id"), F.lit("big").alias("document_id"), F.format_string("Name %d", "id").alias("original"), F.lit("x").alias("alias"))
    documents = spark.createDataFrame([("big",)], "document_id string")
    asked = spark.range(3000).select(F.lit("a").alias("batch"), F.format_string("name %d", F.col("id") * 60).alias("text"), F.lit("person").alias("type")).unionByName(spark.createDataFrame([("b", "Name 3", "person")], "batch string, text string, type string"))
    rows = graph.matches(asked, known, seen, documents).collect()
    assert len(rows) == 3001 and {r.confidence for r in rows if r.batch == "a"} == {"exact"}
    assert [(r.confidence, r.co_entities) for r in rows if r.batch == "b"] == [("likely", ["Name 0", "Name 1", "Name 2", "Name 4", "Name 5"])]


def test_what_matches_show_moves_for_names_not_for_batches(spark, monkeypatch):
    """Rows of batches move as numbers; large batches and documents, whose rows aren't held together, match alike."""
    rng = random.Random(4)
    known = [(f"e{k:02d}", f"NAME {k % 40}", "person" if k < 40 else "city", None) for k in range(60)]
    seen = [(f"e{rng.randrange(62):02d}", f"d{rng.randrange(30):02d}") for _ in range(200)]
    seen = [(e, d, f"name {(int(e[1:]) + (k % 9 == 0)) % 40}", f"{e} in {d}") for k, (e, d) in enumerate(sorted(set(seen)))]
    asked = [(b, rng.choice(("Name {}", "name  {}")).format(rng.randrange(45)), rng.choice(("person", "city", "company"))) for b in "abc" for _ in range(3 + 20 * (b == "c"))]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (
        (asked, "batch string, text string, type string"), (known, "entity_id string, canonical string, type string, last_seen timestamp"),
        (seen, "entity_id string, document_id string, original string, alias string"), ([(f"d{k:02d}",) for k in range(28)], "document_id string"),
    )]
    by_id = {e: (c, t) for e, c, t, _ in known}
    want = []
    for batch, text, kind in sorted(set(asked)):
        canonical = " ".join(text.upper().split())
        best = min(((t != kind, e) for e, (c, t) in by_id.items() if c == canonical), default=None)
        places = sorted((d, a) for e, d, _, a in seen if best and e == best[1])
        if places and places[-1][0] < "d28":
            others = sorted((e, o) for e, d, o, _ in seen if d == places[-1][0] and e != best[1])
            here = {" ".join(t.upper().split()) for b, t, _ in asked if b == batch}
            confidence = "possible" if best[0] else "exact" if any(o.upper() in here for _, o in others) else "likely"
            want.append((batch, text, kind, best[1], confidence, places[-1][1], places[-1][0], [o for _, o in others[: graph.CO_ENTITIES]]))
    assert {w[4] for w in want} == {"possible", "exact", "likely"}
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for crowd in (1000, 10, 7, 1):
            monkeypatch.setattr(graph, "CROWD", crowd, raising=False)
            out = graph.matches(*frames)
            assert sorted(map(tuple, out.collect())) == want
            assert "hashpartitioning(batch" not in out._jdf.queryExecution().executedPlan().toString() or crowd < 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lookups_reach_every_entity(spark, tmp_path):
    from tessera import queries

    spark.createDataFrame([(k, k % 4) for k in range(9)], "o_orderkey long, o_custkey long").withColumn("o_orderdate", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k % 9, k % 12) for k in range(36)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = queries.graph_lookups(spark, str(tmp_path)).collect()
    assert {r.canonical for r in rows} == {f"CUSTOMER {k}" for k in range(4)} | {f"SUPPLIER {k}" for k in range(12)} and len(rows) == 16
    assert all(r.document_count == r.confirmed == {"C": 2 + (r.canonical == "CUSTOMER 0"), "S": 3}[r.canonical[0]] for r in rows)
