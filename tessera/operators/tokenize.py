"""Identifier spans and tokens of documents. Nothing here shuffles.

Long texts are worked on in pieces of about CHUNK characters. They are cut only after white space and before a character
that neither an IBAN, nor a number of any kind, can hold; the other identifiers hold no white space. So no identifier and no
token reaches over a cut, and the pieces give what the whole text gives, in time that grows with its length. Where a
piece's tokens stand in the document follows from a carry that goes from piece to piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Characters of a piece at least; the place to cut may be further on, or nowhere. While Python works on a batch, its rows wait
#: with all their tokens, so that a piece's size settles what a task holds, whatever the length of texts.
CHUNK = 512


def pieces(text: Column) -> Column:
    """The text cut up; an empty text is one piece."""
    space = T.SPACE[1:-1]
    cut = rf"(?s).{{{CHUNK},}}?[{space}](?=[^A-Z0-9+.\-{space}])|.+"
    return F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(cut), F.lit(0)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: a one-element array binds it to a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def resolved_spans(text: Column) -> Column:
    """Spans (start, end, kind, text) of all patterns by priority, ordered: a match that overlaps an accepted one is dropped.

    IBANs whose check fails are dropped too; they don't block others.
    """
    moved = lambda s, at: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["kind"].alias("kind"), s["text"].alias("text"))

    def of_all(cut: Column) -> Column:
        starts = F.aggregate(cut, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
        return F.flatten(F.zip_with(cut, F.slice(starts, F.lit(1), F.size(cut)), lambda p, at: F.transform(spans_of(p), lambda s: moved(s, at))))

    return bound(pieces(text), lambda cut: F.when(F.size(cut) == 1, spans_of(F.get(cut, F.lit(0)))).otherwise(of_all(cut)))


def spans_of(text: Column) -> Column:
    """resolved_spans() of one piece."""
    accepted = None
    for kind, pattern in T.PATTERNS:
        found = T.matches(text, kind, pattern)
        if kind == "iban":
            found = F.filter(found, lambda s: F.coalesce(T.iban_remainder(s["text"]) == 1, F.lit(False)))
        accepted = found if accepted is None else fitted(accepted, found)
    return F.array_sort(accepted)


def fitted(accepted: Column, found: Column) -> Column:
    """accepted and those of found that overlap none of it. The one-element array binds `accepted` to a name."""
    free = lambda taken: F.concat(taken, F.filter(found, lambda c: ~F.exists(taken, lambda a: (a["start"] < c["end"]) & (a["end"] > c["start"]))))
    return F.get(F.transform(F.array(accepted), free), F.lit(0))


def spans(docs: DataFrame) -> DataFrame:
    """docs with `spans`; null texts have none."""
    return docs.withColumn("spans", resolved_spans(F.coalesce("text", F.lit(""))))


def kind_of(first: Column, pattern: Column) -> Column:
    """Of a token, by its first character's code, which must be at hand: each branch would work it out again."""
    return (
        F.when(pattern.isNotNull(), "pattern")
        .when(first.between(97, 122) | first.between(65, 90) | first.between(192, 255), "word")
        .when(first.isin(T.SPACE_CODES), "whitespace")
        .when(first.between(48, 57), "number")
        .otherwise("punctuation")
    )


def token_array(source: Column) -> Column:
    """An array of (text, pattern) for one piece: identifier spans and, between them, the basic tokens. They cover the text."""
    basic = F.lit(T.TOKENS)
    none = F.lit(None).cast("string")
    token = lambda text, pattern: F.struct(text.alias("text"), pattern.alias("pattern"))

    def basic_tokens(gap: Column) -> Column:
        return F.transform(F.regexp_extract_all(gap, basic, F.lit(0)), lambda t: token(t, none))

    def around(found: Column, at: Column) -> Column:
        before, own = F.get(found, at - 1), F.get(found, at)
        start = F.coalesce(before["end"], F.lit(0))
        plain = basic_tokens(F.substring(source, start + 1, F.coalesce(own["start"], F.length(source)) - start))
        return F.when(own.isNull(), plain).otherwise(F.concat(plain, F.array(token(own["text"], own["kind"]))))

    def every(found: Column) -> Column:
        parts = F.flatten(F.transform(F.sequence(F.lit(0), F.size(found)), lambda at: around(found, at)))
        return F.when(F.size(found) == 0, basic_tokens(source)).otherwise(parts)

    return bound(spans_of(source), every)


def chunked(docs: DataFrame) -> DataFrame:
    """docs with a row for each piece: `text` is the piece, `chunk` its number, `after` the TAIL characters that follow it."""
    text = F.coalesce("text", F.lit(""))
    follows = lambda cut: F.transform(F.sequence(F.lit(1), F.size(cut)), lambda k: F.substring(F.get(cut, k), 1, TAIL))
    pairs = bound(pieces(text), lambda cut: F.arrays_zip(cut.alias("piece"), F.when(F.size(cut) == 1, F.array(F.lit(""))).otherwise(follows(cut)).alias("after")))
    rows = docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(pairs).alias("chunk", "x"))
    return rows.select(*[c for c in docs.columns if c != "text"], "chunk", F.col("x")["piece"].alias("text"), F.coalesce(F.col("x")["after"], F.lit("")).alias("after"))


#: Characters after a token that detection may ask for.
TAIL = 3
CARRIED = "first int, ends array<int>"


def with_tokens(rows: DataFrame) -> DataFrame:
    """chunked() rows with `texts`, what the tokens of the piece are, and `patterns`, the identifiers' kinds at the same places,
    or null. Few pieces have anything that an identifier needs; the others are cut into tokens and no more."""
    found = F.when(F.col("text").rlike(T.HINTED), token_array(F.col("text")))
    basic = F.regexp_extract_all("text", F.lit(T.TOKENS), F.lit(0))
    rows = rows.withColumn("found", found)
    return rows.withColumns({"texts": F.when(F.col("found").isNull(), basic).otherwise(F.col("found")["text"]), "patterns": F.col("found")["pattern"]}).drop("found")


def borders(lists: pa.Array) -> np.ndarray:
    """Where each list begins in the flattened array, and where the last one ends."""
    return np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))


def placed(docs: DataFrame) -> DataFrame:
    """chunked() docs with tokens and `at`: the number of the piece's first token in the document, and the ends of all.

    Only lengths go to numpy and back, in Arrow batches, which stay Arrow: as pandas objects a batch took some 300 MB of a
    worker. A document's pieces follow one another, as posexplode leaves them, and the carry is what adds up over them.
    """

    @F.arrow_udf(CARRIED)
    def carried(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tokens, end = 0, 0
        for chunk, lengths in parts:
            of, total = borders(lengths), np.cumsum(np.concatenate(([0], lengths.flatten().to_numpy(zero_copy_only=False))))
            # What came before the document of each piece in this batch, negative where earlier batches had some of it.
            at = np.maximum.accumulate(np.where(chunk.to_numpy(zero_copy_only=False) == 0, np.arange(len(chunk)), -1))
            before, chars = np.where(at >= 0, of[at], -tokens), np.where(at >= 0, total[of[at]], -end)
            ends = total[1:] - np.repeat(chars, np.diff(of))
            if len(chunk):
                tokens, end = int(of[-1] - before[-1]), int(total[-1] - chars[-1])
                lists = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(ends.astype(np.int32)))
                yield pa.StructArray.from_arrays([pa.array((of[:-1] - before).astype(np.int32)), lists], names=["first", "ends"])

    rows = with_tokens(chunked(docs))
    return rows.withColumn("at", carried("chunk", F.transform("texts", F.length)))


def kinds_of(found: Column) -> Column:
    codes = lambda tokens: F.transform(tokens, lambda t: F.ascii(t["text"]))
    token = lambda t, code: F.struct(t["text"].alias("text"), t["pattern"].alias("pattern"), kind_of(code, t["pattern"]).alias("kind"))
    return bound(found, lambda tokens: F.zip_with(tokens, codes(tokens), token))


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, tok, text, kind, pattern, start, end: one row for each token, in order of tok. doc_id must be unique."""
    rows = placed(docs.select("doc_id", "text")).select("doc_id", "patterns", F.col("at.first").alias("first"), F.arrays_zip(F.col("texts").alias("text"), F.col("at.ends").alias("end")).alias("each"))
    # The outer form, since for the plain one Catalyst works the array out two more times, to leave out empty ones.
    rows = rows.select("doc_id", "patterns", "first", F.posexplode_outer("each").alias("k", "t")).where("t is not null")
    rows = rows.select("doc_id", (F.col("first") + F.col("k")).alias("tok"), "t.text", F.get("patterns", F.col("k")).alias("pattern"), "t.end")
    return rows.select("doc_id", "tok", "text", kind_of(F.ascii("text"), F.col("pattern")).alias("kind"), "pattern", (F.col("end") - F.length("text")).alias("start"), "end")


def token_kinds(docs: DataFrame) -> DataFrame:
    """text, kind, n: how often a token of each kind occurs. Nothing leaves the JVM, and kinds are settled once for each."""
    rows = with_tokens(chunked(docs.select("text"))).select("patterns", F.posexplode_outer("texts").alias("k", "text")).where("text is not null")
    rows = rows.groupBy("text", F.get("patterns", F.col("k")).isNotNull().alias("found")).agg(F.count("*").alias("n"))
    return rows.select("text", kind_of(F.ascii("text"), F.when(F.col("found"), "pattern")).alias("kind"), "n")
