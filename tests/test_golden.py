"""Whole documents through the plan: entities, rewritten and restored texts."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import rewrite
from tessera.plans.anonymize import Options, anonymize

DICTIONARY = [
    ("Dupont", "surnames", "surname", "fr"), ("Lyon", "communes", "city", "fr"), ("Bellevue", "company_names", "company", "fr"),
    ("Dumont", "surnames", "surname", "fr"), ("Jean", "firstnames", "first_name", "fr"), ("Marie-Claire", "firstnames", "first_name", "fr"),
    ("Martin", "surnames", "surname", "fr"), ("Smith", "surnames", "surname", "en"), ("Acme Corporation", "company_names", "company", "en"),
    ("Acme", "company_names", "company", "en"),
]
TEXTS = {
    1: "M. Dupont habite à Lyon depuis dix ans.",
    2: "La SCI Bellevue et la SARL Dumont Frères sont co-propriétaires.",
    3: "Contacter jean.dupont@gmail.com au 06 12 34 56 78 ou virer sur FR76 3000 6000 0112 3456 7890 189.",
    4: "Jean Dupont et Marie-Claire Martin signent le bail.",
    5: "Mr. Smith from Acme Corporation Ltd confirmed the deal.",
    6: "Le NIR est 1 85 12 75 108 042 36 et le site est https://www.example.com/dossier.",
    8: "Mme Durand habite au 15 rue de la Paix à Marseille.",
    9: "Dr. Smith confirmed the deal",
    10: "le contrat entre sa Mère et Dupont, Martin à Lyon",
    11: "",
    12: None,
    13: "de la et les",
}
ENTITIES = {
    1: [("M Dupont", 0, 9, "person", "high", "Personne 1", ["surnames"]), ("Lyon", 19, 23, "city", "medium", "Ville 1", ["communes", "communes"])],
    2: [("SCI Bellevue", 3, 15, "company", "high", "Société 1", ["company_names"]), ("SARL Dumont Frères", 22, 40, "company", "high", "Société 2", ["surnames"])],
    3: [
        ("jean.dupont@gmail.com", 10, 31, "email", "high", "personne1@exemple.fr", ["local:email"]),
        ("06 12 34 56 78", 35, 49, "phone", "high", "+33 X XX XX XX X1", ["local:phone"]),
        ("FR76 3000 6000 0112 3456 7890 189", 63, 96, "iban", "high", "FRXX XXXX XXXX XXXX XXXX XXX1", ["local:iban"]),
    ],
    4: [("Dupont", 5, 11, "person", "medium", "Personne 1", ["surnames", "surnames"]), ("Marie-Claire Martin", 15, 34, "person", "medium", "Personne 2", ["firstnames", "surnames"])],
    5: [
        ("Mr Smith", 0, 9, "person", "high", "Personne 1", ["surnames"]),
        ("Acme", 15, 19, "company", "medium", "Société 2", ["company_names", "company_names"]),
        ("Corporation Ltd", 20, 35, "company", "medium", "Société 1", ["local:candidate"]),
    ],
    6: [
        ("NIR", 3, 6, "unknown", "low", "Entité 1", ["local:candidate"]),
        ("1 85 12 75 108 042 36", 11, 32, "ssn", "high", "X XX XX XX XXX XXX X1", ["local:ssn"]),
        ("https://www.example.com/dossier.", 48, 80, "url", "high", "https://exemple.fr/page1", ["local:url"]),
    ],
    8: [("Mme Durand", 0, 10, "person", "medium", "Personne 1", ["local:candidate"]), ("15 rue de la Paix à Marseille", 21, 50, "address", "medium", "Adresse 1", ["local:candidate"])],
    9: [("Dr Smith confirmed the deal", 0, 28, "address", "high", "Adresse 1", ["surnames"])],
}
OUTPUT = {
    1: "Personne 1 habite à Ville 1 depuis dix ans.",
    2: "La Société 1 et la Société 2 sont co-propriétaires.",
    3: "Contacter personne1@exemple.fr au +33 X XX XX XX X1 ou virer sur FRXX XXXX XXXX XXXX XXXX XXX1.",
    4: "Jean Personne 1 et Personne 2 signent le bail.",
    5: "Personne 1 from Société 2 Société 1 confirmed the deal.",
    6: "Le Entité 1 est X XX XX XX XXX XXX X1 et le site est https://exemple.fr/page1",
    8: "Personne 1 habite au Adresse 1.",
    11: "",
    12: None,
    13: "de la et les",
}
LANGUAGES = {1: "fr", 2: "fr", 3: "fr", 4: "fr", 5: "en", 6: "fr", 8: "fr", 9: "en", 11: "fr"}


@pytest.fixture(scope="module")
def dictionary(spark):
    rows = [(t, d, True, k, j, "high", {}, n) for n, (t, d, k, j) in enumerate(DICTIONARY)]
    from tessera.operators.lookups import DICTIONARY as schema

    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def result(spark, dictionary):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    out = anonymize(docs, dictionary)
    texts = {r.doc_id: r for r in out.texts.collect()}
    found = {}
    for r in out.entities.orderBy("doc_id", "start").collect():
        found.setdefault(r.doc_id, []).append((r.text, r.start, r.end, r.type, r.confidence, r.alias, r.sources))
    return texts, found


@pytest.mark.parametrize("doc", sorted(ENTITIES))
def test_entities(result, doc):
    assert result[1][doc] == ENTITIES[doc]


@pytest.mark.parametrize("doc", sorted(OUTPUT))
def test_output(result, doc):
    assert result[0][doc].anonymized == OUTPUT[doc]


@pytest.mark.parametrize("doc", sorted(LANGUAGES))
def test_language(result, doc):
    assert result[0][doc].language == LANGUAGES[doc]


def test_company_words_and_chains(result):
    texts = [e[0] for e in result[1][10]]
    assert texts == ["sa Mère", "Dupont Martin", "Lyon"]


def test_session_keeps_aliases(spark, dictionary):
    docs = spark.createDataFrame([(1, "s", 0, "M. Dupont signe le contrat."), (2, "s", 1, "M. Dupont confirme la vente. Il voit Martin.")], "doc_id long, session_id string, doc_ord long, text string")
    out = {r.doc_id: r.anonymized for r in anonymize(docs, dictionary).texts.collect()}
    assert out == {1: "Personne 1 signe le contrat.", 2: "Personne 1 confirme la vente. Il voit Personne 2."}


def test_known_aliases_win(spark, dictionary):
    docs = spark.createDataFrame([(1, "s", 0, "il voit Dupont puis Martin")], "doc_id long, session_id string, doc_ord long, text string")
    known = spark.createDataFrame([("s", "Dupont", "Renaud")], "session_id string, original string, alias string")
    assert anonymize(docs, dictionary, known=known).texts.first().anonymized == "il voit Renaud puis Personne 1"


def test_realistic_aliases_repeat(spark, dictionary):
    docs = spark.createDataFrame([(1, TEXTS[5]), (2, TEXTS[3])], "doc_id long, text string")
    once, again = ({r.original: r.alias for r in anonymize(docs.repartition(n), dictionary, Options(style="realistic")).aliases.collect()} for n in (1, 3))
    assert once == again and once["FR76 3000 6000 0112 3456 7890 189"] == "FR76 XXXX XXXX XXXX XXXX XXXX XXX"


def test_restore(spark):
    docs = spark.createDataFrame([(1, "Marc Renaud habite à Bordeaux.")], "doc_id long, text string")
    table = spark.createDataFrame([(1, "Jean", "Marc", 0), (1, "Dupont", "Renaud", 1), (1, "Lyon", "Bordeaux", 2)], "doc_id long, original string, alias string, ord int")
    assert rewrite.restore(docs, table, "doc_id").first().restored == "Jean Dupont habite à Lyon."


def test_round_trip(spark, result):
    table = [(8, e[0], e[5], k) for k, e in enumerate(ENTITIES[8])]
    docs = spark.createDataFrame([(8, OUTPUT[8])], "doc_id long, text string")
    table = spark.createDataFrame(table, "doc_id long, original string, alias string, ord int")
    assert rewrite.restore(docs, table, "doc_id").first().restored == TEXTS[8]


def test_nested_spans_are_spliced_in_order(spark):
    docs = spark.createDataFrame([(1, "AB CD EF", [(0, 2, "XXXX"), (6, 8, "Y")]), (2, "AB CD EF", [(0, 8, "long"), (3, 5, "in")])], "doc_id long, text string, e array<struct<start:int,end:int,alias:string>>")
    out = {r.doc_id: r.o for r in docs.select("doc_id", rewrite.spliced(F.col("text"), F.col("e")).alias("o")).collect()}
    assert out == {1: "XXXX CD Y", 2: "long"}


def test_restore_takes_time_with_the_length_of_its_table(spark):
    """Pairs of an alias that comes twice: the last original, in the place of the first; 12,000 rows aren't held against one another."""
    import time

    n = 6_000
    docs = spark.range(1).selectExpr("id AS doc_id", f"array_join(transform(sequence(0, {n - 1}), k -> concat('<', k, '>')), ' ') AS text")
    table = spark.range(2 * n).selectExpr("0L AS doc_id", f"concat(if(id < {n}, 'old ', 'new '), id % {n}) AS original", f"concat('<', id % {n}, '>') AS alias", "id AS ord")
    began = time.time()
    assert rewrite.restore(docs, table, "doc_id").first().restored == " ".join(f"new {k}" for k in range(n))
    assert time.time() - began < 20
