import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import entities, graph
from tessera.streaming import sessions, state

REQUEST = "session_id string, text string, type string, seq long"
PROBE = "term string, at timestamp"
DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, sessions.ROCKSDB)
    yield
    spark.conf.set(key, before)


class Stream:
    """A stream over a folder of files, run to its end again and again, each time from its checkpoint."""

    def __init__(self, spark, tmp_path, schema, plan, **trigger):
        self.spark, self.at, self.schema, self.plan, self.files = spark, str(tmp_path), schema, plan, 0
        self.trigger = trigger or {"availableNow": True}

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.at}/in/k={self.files}")
        self.files += 1
        return self

    def run(self):
        """The state operator's figures of each batch."""
        stream = sessions.file_stream(self.spark, f"{self.at}/in/*", self.schema)
        q = self.plan(stream).writeStream.format("parquet").option("path", f"{self.at}/out").option("checkpointLocation", f"{self.at}/log").trigger(**self.trigger).start()
        assert q.awaitTermination(180) and q.exception() is None
        return [p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]]

    def rows(self):
        return self.spark.read.parquet(f"{self.at}/out").collect()


def test_aliases_hold_across_restarts(spark, tmp_path):
    s = Stream(spark, tmp_path, REQUEST, lambda x: sessions.with_alias(sessions.numbered(x)))
    s.add([("s", "Dupont", "person", 0), ("s", "Lyon", "city", 1), ("t", "Dupont", "person", 0), ("t", None, "person", 1)]).run()
    s.add([("s", "Martin", "person", 3), ("s", "Dupont", "person", 2), ("s", "Durand", "person", 4), ("s", "Martin", "city", 5)]).run()
    assert {(r.session_id, r.original): r.alias for r in s.rows()} == {("s", "Dupont"): "Personne 1", ("s", "Lyon"): "Ville 1", ("t", "Dupont"): "Personne 1", ("s", "Martin"): "Personne 2", ("s", "Durand"): "Personne 3"}


def test_state_written_follows_new_texts(spark, tmp_path):
    s = Stream(spark, tmp_path, REQUEST, sessions.numbered)
    first = s.add([("s", f"name {k}", "person", k) for k in range(3000)]).run()[-1]
    again = s.add([("s", f"name {k}", "person", k) for k in range(2000)] + [("s", "new", "person", 9), ("s", "Lyon", "city", 9)]).run()[-1]
    assert first["numRowsUpdated"] >= 3000 and again["numRowsUpdated"] == 2 + 2
    assert [r.n for r in s.rows() if r.original == "new"] == [3001]


def test_numbers_are_those_of_a_batch_run(spark, tmp_path):
    rng = random.Random(4)
    asked = [(rng.choice("st"), f"text {rng.randrange(60)}", rng.choice(("person", "city")), k) for k in range(300)]
    s = Stream(spark, tmp_path, REQUEST, sessions.numbered)
    for k in range(0, 300, 100):
        s.add(asked[k : k + 100])
    s.run()
    batch = spark.createDataFrame(asked, REQUEST).withColumn("seq", F.struct(F.col("seq").alias("doc_ord"), F.lit(0).alias("pass")))
    assert sorted(map(tuple, s.rows())) == sorted(map(tuple, entities.numbered(batch).select("session_id", "original", "type", "n").collect()))


def names(spark, rows):
    return spark.createDataFrame([(t, d, True, k, "fr", "high", {}, n) for n, (t, d, k) in enumerate(rows)], "term string, dict string, match boolean, type string, jurisdiction string, confidence string, metadata map<string,string>, ord int")


def test_cache_answers_until_it_expires(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    dictionary = names(spark, [("a", "old", "city"), ("a", "more", "surname")])
    held = {"now": dictionary}
    s = Stream(spark, tmp_path, PROBE, lambda x: sessions.cached_lookups(x.withWatermark("at", "1 hour"), held["now"]))
    s.add([("a", DAY), ("b", DAY), ("a", DAY + 24 * hour), ("a", DAY + 24 * hour + dt.timedelta(milliseconds=1)), (None, DAY)]).run()
    got = sorted((r.term, r.at, r.hit, [x.dict for x in r.results]) for r in s.rows())
    assert got == [("a", DAY, False, ["old", "more"]), ("a", DAY + 24 * hour, True, ["old", "more"]), ("a", DAY + 24 * hour + dt.timedelta(milliseconds=1), False, ["old", "more"]), ("b", DAY, False, [])]
    # A hit has what was cached, though the dictionary has changed and the stream was started anew.
    held["now"] = names(spark, [("a", "new", "city")])
    s.add([("a", DAY + 30 * hour)]).run()
    s.add([("a", DAY + 80 * hour)]).run()
    assert [(r.hit, [x.dict for x in r.results]) for r in sorted(s.rows(), key=lambda r: r.at) if r.at >= DAY + 30 * hour] == [(True, ["old", "more"]), (False, ["new"])]


def test_expired_answers_leave_the_state(spark, tmp_path):
    s = Stream(spark, tmp_path, PROBE, lambda x: sessions.cached_lookups(x.withWatermark("at", "0 seconds")))
    full = s.add([(f"t{k}", DAY) for k in range(50)]).run()[-1]["numRowsTotal"]
    s.add([("late", DAY + dt.timedelta(days=3))]).run()
    left = s.add([("later", DAY + dt.timedelta(days=3, seconds=1))]).run()[-1]["numRowsTotal"]
    assert full >= 50 and left < full / 2


def test_the_store_forgets_by_its_own_clock(spark, tmp_path):
    s = Stream(spark, tmp_path, PROBE, lambda x: sessions.cached_lookups(x, hours=20 / 3600, clock="processing"), once=True)  # by that clock there is always another batch
    began = time.time()
    s.add([("a", DAY), ("a", DAY + dt.timedelta(days=9))]).run()
    s.add([("a", DAY + dt.timedelta(days=10))]).run()
    soon = time.time() - began < 19
    time.sleep(21)
    s.add([("a", DAY + dt.timedelta(days=11))]).run()
    hits = [r.hit for r in sorted(s.rows(), key=lambda r: r.at)]
    assert hits[0] is False and hits[1] is True and hits[3] is False and (hits[2] or not soon)
    with pytest.raises(ValueError):
        state.cached_lookups(spark.createDataFrame([], PROBE), clock="none")


def test_copies_go(spark, tmp_path):
    rows = [(1, "same", DAY), (2, "same", DAY), (3, "other", DAY)]
    s = Stream(spark, tmp_path, "doc_id long, text string, at timestamp", lambda x: sessions.without_copies(x, "at"))
    s.add(rows).run()
    assert len(s.rows()) == 2


# The graph ------------------------------------------------------------------------------------------------------------

DOC = "document_id string, label string, text string, processed_at timestamp"
FOUND = "document_id string, text string, type string, alias string, ord int"


def bytes_in(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def batch(spark, names, found, day):
    docs = spark.createDataFrame([(n, n, f"text {n}", DAY + dt.timedelta(days=day)) for n in names], DOC)
    return docs, spark.createDataFrame(found, FOUND)


def as_rows(tables):
    return [sorted(map(repr, t.select(*sorted(t.columns)).collect())) for t in tables]


def test_graph_grows_and_reruns_count_once(spark, tmp_path):
    store = sessions.GraphStore(spark, f"{tmp_path}/graph")
    for version, name in ((0, "doc_1"), (1, "doc_2"), (1, "doc_2")):
        store.record(version, *batch(spark, [name], [(name, "Dupont", "person", "Renaud", 0)], version))
    known, occurrences, documents = store.read()
    row = known.first()
    assert known.count() == 1 and row.document_count == 2 and row.first_seen < row.last_seen
    assert occurrences.count() == 2 and documents.select(F.countDistinct("fingerprint")).first()[0] == 2


def test_store_is_what_plain_recording_gives(spark, tmp_path):
    rng, store = random.Random(6), sessions.GraphStore(spark, f"{tmp_path}/graph", buckets=5, most_deltas=2)
    plain = tuple(spark.createDataFrame([], s) for s in store.SCHEMAS.values())
    for version in range(5):
        docs = sorted({f"doc_{rng.randrange(6)}" for _ in range(3)})
        found = [(rng.choice(docs), f"Name  {rng.randrange(7)}", rng.choice(("person", "city")), f"alias {version}", k) for k in range(8)]
        args = batch(spark, docs, found, version)
        store.record(version, *args)
        plain = tuple(spark.createDataFrame(t.collect(), t.schema) for t in graph.recorded(*plain, *args))
        assert as_rows(store.read()) == as_rows(plain), version
    manifest = store.manifest()
    assert all(len(x) <= 2 for x in manifest.deltas.values()) and manifest.base["entities"]
    asked = spark.createDataFrame([("NAME 1",), ("NAME 99",)], "canonical string")
    assert {r.entity_id for r in store.entities_named(asked).collect()} == {r.entity_id for r in plain[0].where("canonical = 'NAME 1'").collect()}
    before = as_rows(store.read())
    assert store.expire(keep=1) > 0 and as_rows(store.read()) == before and store.versions() == [4]


def test_bytes_written_follow_the_batch(spark, tmp_path):
    path = f"{tmp_path}/graph"
    store = sessions.GraphStore(spark, path, buckets=16, most_deltas=3)
    many = [(f"doc_{k % 40}", f"Name {k} {random.Random(k).random()}", "person", f"alias {k}", k) for k in range(4000)]
    store.record(0, *batch(spark, [f"doc_{k}" for k in range(40)], many, 0))
    whole, reader = bytes_in(path), store.manifest()
    seen = as_rows([store.table("entities", reader)])
    for version in (1, 2):
        store.record(version, *batch(spark, [f"new_{version}"], [(f"new_{version}", many[5][1], "person", "x", 0)], version))
    assert bytes_in(path) - whole < whole / 4
    store.record(3, *batch(spark, ["new_3"], [("new_3", many[5][1], "person", "x", 0)], 3))  # merged
    assert not store.manifest().deltas["entities"] and len(store.manifest().base["entities"]) == 16
    size = bytes_in(path)
    for version in (4, 5, 6, 7):  # and again: one bucket of entities is written anew
        store.record(version, *batch(spark, ["again"], [("again", many[5][1], "person", "x", 0)], version))
    assert not store.manifest().deltas["entities"] and bytes_in(path) - size < whole / 4
    assert len({x.rsplit("/", 2)[1] for x in store.manifest().base["entities"].values()}) == 2
    assert as_rows([store.table("entities", reader)]) == seen  # a reader keeps its version
    assert store.read()[0].where("document_count = 5").count() == 1


def test_recording_into_an_empty_graph_shuffles_nothing_for_it(spark):
    from tessera import queries
    from tessera.operators import graph

    entities, occurrences = spark.createDataFrame([], queries.ENTITY), spark.createDataFrame([], queries.OCCURRENCE)
    new = spark.createDataFrame([("d", "d", "d")], "document_id string, label string, text string").selectExpr("*", "timestamp'2024-01-01' AS processed_at")
    found = spark.createDataFrame([("d", "Ann", "person", "A", 0)], "document_id string, text string, type string, alias string, ord int")
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    rows = graph.resolved(entities, new, graph.with_canonical(found))
    assert joins(rows) == 1 and rows.count() == 1
    assert joins(graph.upserted(occurrences, rows.select("entity_id", "document_id").selectExpr("*", "'Ann' AS original", "'A' AS alias", "false AS confirmed"), ["entity_id", "document_id"])) == 1


def test_recording_joins_only_entities_with_ids_of_their_own(spark):
    """Rows found in documents don't move to meet entities whose id follows from their text."""
    from tessera.operators import graph

    schema = "entity_id string, canonical string, type string, first_seen timestamp, last_seen timestamp, document_count int"
    new = spark.createDataFrame([("d", "d", "d")], "document_id string, label string, text string").selectExpr("*", "timestamp'2024-01-01' AS processed_at")
    found = spark.createDataFrame([("d", "Ann", "person", "A", 0), ("d", "ann", "person", "B", 1)], "document_id string, text string, type string, alias string, ord int")
    found = graph.with_canonical(found)
    own = spark.range(1).select(graph.entity_id(F.lit("person"), F.lit("ANN"))).first()[0]
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    for ids, join_count in (([own], 1), (["given"], 2), (["zz", own], 1)):
        entities = spark.createDataFrame([(i, "ANN", "person", None, None, 1) for i in ids], schema)
        rows = graph.resolved(entities, new, found)
        assert joins(rows) == join_count and [(r.entity_id, r["last"].alias, r.times) for r in rows.collect()] == [(min(ids), "B", 2)]


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    from tessera.sources import tables

    monkeypatch.setattr(tables, "SORTED", 100)
    assert tables.dealt(spark.range(1000), "id").rdd.getNumPartitions() == 10
    assert tables.dealt(spark.range(10), "id", rows=10).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
