"""Text, alias tables and web pages as tables, and results as files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

from . import tables
from .pages import visible

ALIAS_HEADER = ["Original", "Alias", "Type", "Confidence"]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path), text: one row for each file, read as UTF-8."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def write_texts(texts: DataFrame, path: str, column: str = "anonymized") -> None:
    texts.select(F.col(column).alias("value")).where("value is not null").write.text(path)


def alias_lines(aliases: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and line: every row of an alias table (original, alias, type, confidence) as a line of CSV."""
    return aliases.select(*keep, F.concat_ws(",", *[T.csv_field(F.coalesce(F.col(c), F.lit(""))) for c in ("original", "alias", "type", "confidence")]).alias("line"))


def write_aliases(aliases: DataFrame, path: str) -> None:
    rows = aliases.select(*[F.col(c.lower()).alias(c) for c in ALIAS_HEADER])
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, nth, record: the records of CSV files, in that order; quoted values may hold line breaks and quotes, doubled.

    Files are read in splits of lines, and a record may begin in one split and end in another. A line begins a record if the
    number of quotes before it in its file is even: quotes are summed by split, then over the splits of a file, of which there
    are few, and then over the lines of each split by itself. Lines that go on with a record of an earlier split are sent to it.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    splits = splits.select("file", "block", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("file", "block").orderBy("at")
    rows = lines.join(splits, ["file", "block"])
    open_ = F.col("before") + F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("begins", (open_ % 2 == 0).cast("long"))
    rows = tables.written(rows.withColumn("nth", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("quotes", "before", "begins"), "lines")
    last = rows.groupBy("file", "block").agg(F.max("nth").alias("n"))
    last = last.select("file", "block", F.last(F.when(F.col("n") > 0, F.struct("block", "n")), ignorenulls=True).over(earlier).alias("open"))
    rows = rows.join(last, ["file", "block"])
    of = F.when(F.col("nth") == 0, F.col("open")).otherwise(F.struct("block", F.col("nth").alias("n")))
    rows = rows.select("file", of.alias("of"), F.struct("block", "at", "value").alias("line"))
    parts = F.transform(F.array_sort(F.collect_list("line")), lambda x: x["value"])
    records = rows.groupBy("file", "of").agg(F.array_join(parts, "\n").alias("record"))
    return records.select("file", F.col("of.block").alias("block"), F.col("of.n").alias("nth"), F.regexp_replace("record", "\r$", "").alias("record"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """original, alias: the last row of each original counts, files in order of their names. Values may hold line breaks.

    All files have the header of one of them. A large file is read by many tasks.
    """
    names = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path).columns
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    rows = csv_records(spark, path).where("not (block = 0 and nth = 1) and record <> ''")
    # Blanks are a value's own; without a sign of its own for null an empty value is one that is there.
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "lineSep": "\u0001"}
    values = F.from_csv("record", schema, options)
    at = F.struct("file", "block", "nth").alias("at")
    rows = rows.select(values["Original"].alias("original"), values["Alias"].alias("alias"), at).where("original is not null and alias is not null")
    return rows.groupBy("original").agg(F.max_by("alias", "at").alias("alias"))


def parsed_alias(line: Column) -> Column:
    """(original, alias) of a line of CSV with quoted fields; null where the line isn't one."""
    pattern = r'^"((?:[^"]|"")*)","((?:[^"]|"")*)"'
    field = lambda k: F.replace(F.regexp_extract(line, pattern, k), F.lit('""'), F.lit('"'))
    return F.when(line.rlike(pattern), F.struct(field(1).alias("original"), field(2).alias("alias")))


def page_texts(pages: DataFrame, closed: bool = False) -> DataFrame:
    """pages with `text`: what a reader sees of html. Parsing runs in Arrow batches; html is the only column that travels.

    `closed`: only references that a semicolon ends are read as such, as in XML; else as browsers read them.
    """

    @F.pandas_udf("string")
    def read(column: pd.Series) -> pd.Series:
        return column.map(lambda html: visible(html, closed))

    return pages.withColumn("text", read("html"))


def summary(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, line: `N entities, lang=X` for each document."""
    counts = entities.groupBy("doc_id").agg(F.count("*").alias("n"))
    return texts.select("doc_id", "language").join(counts, "doc_id", "left").select("doc_id", F.format_string("%d entities, lang=%s", F.coalesce("n", F.lit(0)), "language").alias("line"))

