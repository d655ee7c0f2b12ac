"""Files in and out: texts, alias tables, pages, summaries."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import files

PAGES = [
    ("<html><head><title>x</title></head><body><p>hello  world</p></body></html>", "hello world"),
    ("<html><head><title>x</title><body>hello</body></html>", "hello"),
    ("<title>x</title><body>hello", "hello"),
    ("<body>a<script>var x = '<p>no</p>';</script>b<style>p {}</style>c<noscript>d</noscript>e</body>", "abce"),
    ("<body>a<svg><text>no</text></svg>b<canvas>no</canvas>c</body>", "abc"),
    ("<body>a<div aria-hidden='true'>no <b>no</b></div>b<div aria-hidden='false'>c</div></body>", "abc"),
    ("<body>one\n\n\n\n\ntwo \t three</body>", "one\n\ntwo three"),
    ("<body>1 &lt; 2 &amp; 3<br>4<img src='x' aria-hidden='true'>5</body>", "1 < 2 & 345"),
    ("plain text", "plain text"),
    # End tags that are left out.
    ('<p aria-hidden="true">x<p>shown', "shown"),
    ('<ul><li aria-hidden="true">a<li>b</ul><p>c', "bc"),
    ('<ul><li aria-hidden="true">a<ul><li>b</ul>c<li>d</ul>', "d"),
    ("<table><tr><td aria-hidden=true>q<td>r</table>z", "rz"),
    ("<table><tr aria-hidden=true><td>q<tr><td>r<tbody><tr><td>s</table>", "rs"),
    ("<td aria-hidden=true>q<td>r</table>z", "qrz"),
    ("<head><title>x</title><p>hello", "hello"),
    ("<body>one<body>two", "onetwo"),
    ("<body aria-hidden='true'>one", "one"),
    ("<dl><dt aria-hidden=true>a<dd>b<dt>c</dl>", "bc"),
    ("<select><option aria-hidden=true>a<option>b</select>", "b"),
    ("<h1 aria-hidden=true>a<h2>b</h2>", "b"),
    # Elements that close in another order.
    ("<p><b aria-hidden=true>a</p>b</b>c", "c"),
    ("<div aria-hidden=true><p>a</div>b</p>c", "bc"),
    ("<b>a<p>b</b>c</p>d", "abcd"),
    ("a</div></p></li>b", "ab"),
    ("<a aria-hidden=true>a<a>b</a>c", "bc"),
    # Text where a table holds none, drawings, heads, ends.
    ("<table>a<tr><td>b</td></tr>c</table>d", "acbd"),
    ("<table><tr><td><b aria-hidden=true>a</td><td>b</td></tr></table>", "b"),
    ("<svg><path/><text>no</text><p>yes", "yes"),
    ("<svg/>a<canvas/>b", "a"),
    ("<title>t</title>\n <style>s</style> a <title>b</title>", "a b"),
    ("<noscript><p>x</p></noscript><p>y", "y"),
    ("<body>a</body></html>b", "ab"),
    ("<button>a<button aria-hidden=true>b</button>c", "ac"),
    ("<p>Visible text.</p><script>var secret = 1;</script><style>.hidden{}</style>", "Visible text."),
    ("<p>Mot   un     deux</p><p>\n\n\n\n\n</p><p>Trois</p>", "Mot un deux\n\nTrois"),
    ('<p>Visible.</p><div aria-hidden="true">Hidden content</div>', "Visible."),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_visible(html, text):
    assert files.visible(html) == text


def test_page_texts(spark):
    pages = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(PAGES)], "page_id long, html string")
    assert {r.page_id: r.text for r in files.page_texts(pages).collect()} == {k: t for k, (_, t) in enumerate(PAGES)}


def test_texts_go_out_and_come_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("première ligne\nline two", encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_text("", encoding="utf-8")
    rows = {r.doc_id.rsplit("/", 1)[1]: r.text for r in files.read_texts(spark, f"{tmp_path}/in").collect()}
    assert rows["a.txt"] == "première ligne\nline two" and rows.get("b.txt", "") == ""
    files.write_texts(spark.createDataFrame([("one",), (None,), ("two",)], "anonymized string").coalesce(1), f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["one", "two"]


def test_alias_tables_go_out_and_come_back(spark, tmp_path):
    rows = [("Du\"pont", "Re,naud", "person", "high"), ("two\nlines", "x", "unknown", "low"), ("Lyon", "Nantes", "city", "medium")]
    table = spark.createDataFrame(rows, "original string, alias string, type string, confidence string")
    files.write_aliases(table.coalesce(1), f"{tmp_path}/out")
    assert {(r.original, r.alias) for r in files.read_aliases(spark, f"{tmp_path}/out").collect()} == {x[:2] for x in rows}
    lines = files.alias_lines(table).collect()
    assert lines[0].line == '"Du""pont","Re,naud","person","high"'
    back = files.alias_lines(table).select(files.parsed_alias(F.col("line")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in back] == [x[:2] for x in rows]


def test_last_alias_of_an_original_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "Original,Alias,Type,Confidence\n\"a\",\"1\",\"person\",\"high\"\n\"b\",\"2\",\"person\",\"high\"\n\n\"a\",\"3\",\"person\",\"high\"\n"
    (tmp_path / "in" / "1.csv").write_text(text)
    (tmp_path / "in" / "2.csv").write_text("Original,Alias,Type,Confidence\n\"b\",\"4\",\"person\",\"high\"\n")
    assert {r.original: r.alias for r in files.read_aliases(spark, f"{tmp_path}/in").collect()} == {"a": "3", "b": "4"}


@pytest.mark.parametrize("size", [17, 64, 1 << 20])
def test_alias_files_are_read_in_splits(spark, tmp_path, size):
    rng, rows = random.Random(size), {}
    (tmp_path / "in").mkdir()
    value = lambda: "".join(rng.choice(["a", "é", " ", ",", '"', "\n", "\n\n", "b c", "'", "\r\n"]) for _ in range(rng.randint(1, 12))) + "."
    for name in ("1.csv", "2.csv"):
        with open(tmp_path / "in" / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n" if name == "1.csv" else "\r\n")
            out.writerow(files.ALIAS_HEADER)
            for k in range(60):
                original, alias = rng.choice((value(), f"name {rng.randrange(9)}")), value()
                rows[original] = alias
                out.writerow([original, alias, "person", "high"])
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, size)
        assert size > 100 or files.csv_records(spark, f"{tmp_path}/in").select("block").distinct().count() > 30
        assert {r.original: r.alias for r in files.read_aliases(spark, f"{tmp_path}/in").collect()} == rows
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_lines_that_are_no_aliases(spark):
    rows = spark.createDataFrame([('"a","b"',), ("a,b",), ("",), (None,)], "line string")
    assert [r.x is not None for r in rows.select(files.parsed_alias(F.col("line")).alias("x")).collect()] == [True, False, False, False]


def test_summary(spark):
    entities = spark.createDataFrame([(1,), (1,)], "doc_id long")
    texts = spark.createDataFrame([(1, "fr"), (2, "en")], "doc_id long, language string")
    assert {r.doc_id: r.line for r in files.summary(entities, texts).collect()} == {1: "2 entities, lang=fr", 2: "0 entities, lang=en"}


def test_codes_are_those_of_the_class(spark):
    rows = spark.range(0x10000).where("id > 0 and (id < 55296 or id > 57343)").select("id", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    wrong = rows.where(F.ascii("c").isin(T.SPACE_CODES) != F.col("c").rlike(f"^{T.SPACE}$"))
    assert wrong.count() == 0


def test_deep_and_long_pages_take_linear_time():
    assert files.visible("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(files.visible("<p>word <b>x" * 20_000)) > 100_000


def test_references_without_a_semicolon():
    html = "<p>a&amp</p><p>b &lt;i&gt; &amp;lt; &#65; &#x41; R&D & c&am</p>"
    assert files.visible(html) == "a&b <i> &lt; A A R&D & c&am"
    assert files.visible(html, closed=True) == "a&ampb <i> &lt; A A R&D & c&am"
