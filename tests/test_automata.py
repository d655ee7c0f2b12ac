"""Tables of many terms against one replacement after another, and against one alternation."""

import random
import re
import time

from pyspark.sql import functions as F

from tessera.operators import automata, rewrite


def one_after_another(text, rows):
    pairs = {}
    for original, alias in rows:
        if alias:
            pairs[alias] = original
    for alias, original in sorted(pairs.items(), key=lambda p: -len(p[0])):
        text = text.replace(alias, original)
    return text


def test_chained_restoration():
    rng = random.Random(1)
    for n in range(3000):
        letters = "ab " if n % 2 else "abcdefgh "
        word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
        rows = [(word(4), word(rng.choice((2, 3, 5)))) for _ in range(rng.randint(0, 8))]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + "-" * rng.choice((0, 3, 40)) + word(30)
        got = automata.Restorer([{"original": o, "alias": a} for o, a in rows])(text)
        assert got == one_after_another(text, rows), (rows, text)


def test_chained_restoration_by_an_automaton(monkeypatch):
    monkeypatch.setattr(automata, "FEW", 0)
    monkeypatch.setattr(automata, "SHORT", 0, raising=False)
    test_chained_restoration()


def test_terms_are_an_alternation():
    rng = random.Random(2)
    for _ in range(1500):
        word = lambda most: "".join(rng.choice("abÀà.*É") for _ in range(rng.randint(1, most)))
        rows = [{"text": word(4), "alias": word(3), "type": rng.choice(("person", None))} for _ in range(rng.randint(0, 7))]
        text = "".join(rng.choice("abABÀàéÉ.* ") for _ in range(rng.randint(0, 80)))
        for make, kept, said in (
            (automata.replacer, [r for r in rows if r["alias"] != r["text"]], lambda m, r: r["alias"]),
            (automata.highlighter, rows, lambda m, r: f'<mark class="entity entity-{r["type"] or "unknown"}" title="Type: {r["type"] or "unknown"}">{m}</mark>'),
        ):
            by = {r["text"].lower(): r for r in kept}
            pattern = "|".join(re.escape(t) for t in sorted({r["text"] for r in kept}, key=lambda t: -len(t)))
            expected = re.sub(pattern, lambda m: said(m[0], by[m[0].lower()]), text, flags=re.I) if kept else text
            assert make(rows)(text) == expected


def test_ten_thousand_aliases_take_one_pass():
    rows = [{"original": f"Customer#{k:09d}", "alias": f"Person {k}"} for k in range(10_000)]
    use = automata.Restorer(rows)
    text = " ".join(f"Person {k % 10_000} and others, " + "some more words of the same kind " * 3 for k in range(10_000))
    began = time.time()
    assert use(text) == re.sub(r"Person (\d+)", lambda m: f"Customer#{int(m[1]):09d}", text) and time.time() - began < 20


def test_tables_by_key(spark, monkeypatch):
    docs = spark.createDataFrame([(k, ["a", "b", None, "none"][k % 4], None if k == 8 else f"P1 met P2 and P12 on {k}", k / 3) for k in range(60)], "doc_id long, session string, text string, score double")
    table = [("a", "Ann", "P1", 0), ("a", "Bob P2", "P12", 1), ("a", "Cy", "P2", 2), ("b", "Di", "P1", 1), ("b", "Al", "P1", 0), ("b", "x", "", 3), (None, "y", "P2", 0)]
    pairs = spark.createDataFrame(table, "session string, original string, alias string, ord int")
    for most in (20_000, 4):
        monkeypatch.setattr(automata, "TEXTS", most)
        out = automata.restore(docs, pairs, "session")
        assert out.columns == [*docs.columns, "restored"]
        rows = out.collect()
        assert len(rows) == 60
        for r in rows:
            own = [(o, a) for s, o, a, n in sorted(table, key=lambda t: t[3]) if s is not None and s == r.session]
            assert r.restored == (None if r.text is None else one_after_another(r.text, own)) and r.score == r.doc_id / 3
        plain = {r.doc_id: r.restored for r in rewrite.restore(docs.drop("score"), pairs, "session").collect()}
        assert {r.doc_id: r.restored for r in rows} == plain
    marked = automata.highlight(docs.where("session = 'a'"), pairs.select("session", F.col("alias").alias("text"), F.lit("person").alias("type"), "ord"), "session").first().marked
    assert marked.count('<mark class="entity entity-person" title="Type: person">') == 3 and rewrite.unhighlighted(F.lit(marked)) is not None
    assert automata.replace(docs.limit(0), pairs.select("session", F.col("alias").alias("text"), F.col("original").alias("alias"), "ord"), "session").count() == 0


def random_tables(rng, n):
    """Texts and tables of two sessions; originals that hold aliases, or make some with what is around them."""
    word = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    docs = [(k, rng.choice(["a", "b", None]), None if k % 17 == 0 else word("abcABÀàµμſß ", 90) + "é" * (k % 3)) for k in range(n)]
    rows = [(rng.choice(["a", "b", None]), word("abcA", 3), rng.choice([word("abcBÀàµΜß", 4), None]), k % 25) for k in range(60)]
    return docs + docs[:9], rows


def test_large_tables_meet_texts_by_what_occurs_in_them(spark, monkeypatch):
    """No task gets a table of more than HELD rows; results are those of whole tables."""
    docs, table = random_tables(random.Random(5), 160)
    docs = spark.createDataFrame(docs, "doc_id long, session string, text string").repartition(3)
    terms = spark.createDataFrame([(s, a, o, o, n) for s, o, a, n in table], "session string, text string, alias string, type string, ord int")
    pairs = spark.createDataFrame(table, "session string, original string, alias string, ord int")
    get = lambda df: sorted(df.collect(), key=str)
    ways = ((automata.restore, pairs), (automata.replace, terms), (automata.highlight, terms))
    expected = [get(f(docs, of, "session")) for f, of in ways]
    monkeypatch.setattr(automata, "HELD", 5)
    monkeypatch.setattr(automata, "HASHED", 40)

    def refused(*_):
        raise AssertionError("a whole table in a task")

    monkeypatch.setattr(automata, "by_whole_table", refused)
    for (f, of), rows in zip(ways, expected):
        assert get(f(docs, of, "session")) == rows and len(rows) == 169


def test_texts_are_restored_where_they_are_asked_for_more(spark, monkeypatch):
    """Restoring and finding what it makes is one pass: texts don't move again, nor are they restored twice, for a round in
    which nothing comes up; those that do get more take a round for each level."""
    monkeypatch.setattr(automata, "HELD", 5)
    chain = [("s", f"<{k + 1}>", f"<{k}>", 9 - k) for k in range(9)]
    pairs = spark.createDataFrame(chain, "session string, original string, alias string, ord int")
    docs = spark.createDataFrame([(1, "s", "to <8> and <3>"), (2, "s", "none"), (3, "s", None), (4, None, "<1>"), (5, "t", "<1>")], "doc_id long, session string, text string")
    rounds, written = [], automata.tables.written
    monkeypatch.setattr(automata.tables, "written", lambda df, name, *more: rounds.append(name) or written(df, name, *more))
    plain = docs.where("text IS NULL OR NOT contains(text, '<3>')")
    assert "MapInArrow" not in automata.restore(plain, pairs, "session")._jdf.queryExecution().optimizedPlan().toString() and rounds.count("restored") == 1
    got = {r.doc_id: r.restored for r in automata.restore(docs, pairs, "session").collect()}
    own = [(o, a) for _, o, a, n in sorted(chain, key=lambda t: t[3])]
    assert got == {1: one_after_another("to <8> and <3>", own), 2: "none", 3: None, 4: "<1>", 5: "<1>"}
