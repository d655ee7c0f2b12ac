"""Language and local detection: which tokens belong together as a candidate entity.

What detection asks of a token is settled in the token arrays of a document's pieces, where also the words that can be in no
group are left out, some nine of ten. The rest is exploded and shuffled once, by document. Four passes take runs of words:
within a chain of words that may follow, everything from the first word that may start a group on. A word that may not
follow opens a chain, and may be its start. Each pass sees what earlier ones have taken; all windows are by document.
Addresses are taken greedily, eight tokens at a time, by one scan in the order that the windows leave. All of it takes time
in proportion to a text's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions import text as T
from tessera.functions.lexicon import DEFAULT, Lexicon
from tessera.sources import tables

from .tokenize import TAIL, borders, chunked, kinds_of, pieces, token_array, with_tokens

ADDRESS_TOKENS = 8
#: Pass, local type and confidence of groups.
PASSES = {2: ("company_candidate", "probable"), 3: ("address_fragment", "probable"), 4: ("person_candidate", "probable"), 5: (None, "candidate")}
GROUP_FIELDS = ["pass", "ord", "text", "start", "end", "tail", "local_type", "confidence", "skip", "words"]


def among(name: str, words: list[str]) -> str:
    """SQL for a test of membership. As one string, since a column for each of some hundred words is slow to build."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return f"coalesce({name} IN ({quoted}), false)" if words else "false"


def scores(lexicon: Lexicon) -> list[Column]:
    """The number of stop words of each language, from `upper`, an array of upper-case words (null for other tokens)."""
    return [F.expr(f"cast(size(filter(upper, u -> {among('u', stop)})) AS bigint) AS score_{x}") for x, stop in lexicon.stop_words.items()]


def best_language(languages: list[str]) -> Column:
    """The language with most stop words, the first listed on ties and without any."""
    best = F.greatest(*[F.col(f"score_{x}") for x in languages], F.lit(0))
    pick = F.lit(languages[-1])
    for x in reversed(languages):
        pick = F.when(F.col(f"score_{x}") == best, x).otherwise(pick)
    return pick


def words_of(piece: Column) -> Column:
    """The words of a piece. Only identifiers can take letters that would be words otherwise."""
    others = F.transform(F.filter(kinds_of(token_array(piece)), lambda t: t["kind"] == "word"), lambda t: t["text"])
    return F.when(piece.rlike(T.HINTED), others).otherwise(F.regexp_extract_all(piece, F.lit(T.WORDS), F.lit(0)))


def with_language(docs: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """docs (with text) with language and score_*; nothing shuffles."""
    words = F.transform(F.flatten(F.transform(pieces(F.coalesce("text", F.lit(""))), words_of)), F.upper)
    rows = docs.withColumn("words", words)
    rows = rows.withColumn("upper", F.expr(f"filter(words, u -> {among('u', lexicon.every_stop_word)})")).select(*docs.columns, *scores(lexicon))
    return rows.withColumn("language", best_language(list(lexicon.stop_words)))


#: Pieces whose tokens Python has in hand at a time.
AT_ONCE = 1_000
KINDS = ["pattern", "word", "whitespace", "number", "punctuation"]
ASKED = ["company_word", "street_word", "honorific", "stop"]
MARKED = "lead boolean, tok int, text string, kind string, pattern string, end int, w int, cap boolean, " + ", ".join(f"{name} boolean" for name in ASKED) + ", before struct<kind:string,text:string,start:int>, tail string"


def starting(codes: list[int]) -> pa.Array:
    return pa.array([chr(c) for c in codes])


def marker(keep: list[str], asks: dict[str, list[str]], stops: dict[str, list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes the rows of kept_tokens() from batches of pieces (doc_id, keep, chunk, texts, patterns, after), in order.

    What is asked of a token is settled once for each text in AT_ONCE pieces. Numbers run on in a document; `carry` is
    how many tokens, words and characters earlier pieces had, and their last street word and token that isn't white space.
    """
    letters, capitals, spaces, digits = starting(T.LETTER_CODES), starting(T.CAPITAL_CODES), starting(T.SPACE_CODES), starting(range(48, 58))
    lists = {name: pa.array(words, pa.string()) for name, words in {**asks, **stops}.items()}
    numpy = lambda x: x.to_numpy(zero_copy_only=False)
    picked = lambda values, at: values.take(pa.array(at, mask=at < 0))

    def of_pieces(part: pa.RecordBatch, carry: tuple) -> tuple[pa.RecordBatch, tuple]:
        rows, of, flat = part.num_rows, borders(part["texts"]), part["texts"].flatten()
        n, sizes = len(flat), np.diff(of)
        piece = np.repeat(np.arange(rows), sizes)
        coded = flat.dictionary_encode()
        index, texts = numpy(coded.indices), coded.dictionary
        first, upper = pc.utf8_slice_codeunits(texts, 0, 1), pc.utf8_upper(pc.replace_substring(texts, "ß", "SS"))
        begins = lambda with_: numpy(pc.is_in(first, value_set=with_))
        kind = np.where(begins(letters), 1, np.where(begins(spaces), 2, np.where(begins(digits), 3, 4)))[index].astype(np.int8)
        pattern = np.full(n, -1)
        identifiers = part["patterns"].flatten()
        if len(identifiers):
            place = np.flatnonzero(np.repeat(numpy(part["patterns"].is_valid()), sizes))
            some = np.flatnonzero(numpy(identifiers.is_valid()))
            pattern[place[some]] = some
        kind[pattern >= 0] = 0
        word = kind == 1
        asked = {name: word & numpy(pc.is_in(upper, value_set=values))[index] for name, values in lists.items()}
        cap = word & begins(capitals)[index]

        # Where the document of each piece begins in these pieces; -1 if earlier ones had some of it.
        starts = np.maximum.accumulate(np.where(numpy(part["chunk"]) == 0, np.arange(rows), -1))
        tokens, words, chars, street, last = carry
        run = lambda x: np.cumsum(np.concatenate(([0], x)))
        long = numpy(pc.utf8_length(texts)).astype(np.int64)[index]
        base = {}
        for name, total, before in (("tok", np.arange(n + 1), tokens), ("w", run(word), words), ("end", run(long), chars)):
            base[name] = (total, np.where(starts >= 0, total[of[starts]], -before))
        number = {name: total[1:] - np.repeat(of_piece, sizes) for name, (total, of_piece) in base.items()}
        # The last street word so far, as a number over all pieces; those of other documents are too low.
        known = np.maximum.accumulate(np.concatenate(([street - words], np.where(asked["street_word"], base["w"][0][1:], street - words))))[1:]
        near = word & (known > np.repeat(base["w"][1], sizes)) & (base["w"][0][1:] < known + ADDRESS_TOKENS)
        solid = np.maximum.accumulate(np.concatenate(([-1], np.where(kind != 2, np.arange(n), -1))))
        begin = np.where(starts >= 0, of[starts], 0)
        own = np.where(solid[:-1] >= np.repeat(begin, sizes), solid[:-1], -1)

        kept = np.flatnonzero((kind == 0) | cap | asked["company_word"] | asked["street_word"] | asked["honorific"] | near)
        empty = np.setdiff1d(np.arange(rows), piece[kept])
        at, of_piece = np.concatenate((kept, np.full(len(empty), -1))), np.concatenate((piece[kept], empty))
        order = np.argsort(of_piece, kind="stable")
        at, of_piece = at[order], of_piece[order]
        gone = at < 0
        # Numbers and flags of the rows; a piece without a token to keep has none.
        shown = lambda x, to: pa.array((x[at] if n else np.zeros(len(at))).astype(to), mask=gone)
        previous = np.where(gone, -1, own[at]) if n else at
        names = pa.array(KINDS)
        begun = number["end"] - long
        before = [picked(names, np.where(previous >= 0, kind[previous], -1) if n else at), picked(flat, previous), pa.array((begun[previous] if n else at).astype(np.int32), mask=previous < 0)]
        earlier = ~gone & (previous < 0) & (starts[of_piece] < 0)
        if last is not None and earlier.any():
            before = [pc.if_else(pa.array(earlier), pa.scalar(value, x.type), x) for value, x in zip(last, before)]
            previous = np.where(earlier, 0, previous)
        follows = [pc.fill_null(picked(flat, np.where(~gone & (at + k < of[1:][of_piece]), at + k, -1)), "") for k in range(1, TAIL + 1)]
        tail = pc.utf8_slice_codeunits(pc.binary_join_element_wise(*follows, part["after"].take(pa.array(of_piece)), ""), 0, TAIL)
        columns = {name: part[name].take(pa.array(of_piece)) for name in ("doc_id", *keep)}
        columns |= {name: pa.array(np.bincount(piece[asked[name]], minlength=rows)[of_piece].astype(np.int64)) for name in stops}
        columns |= {
            "lead": pa.array(np.diff(of_piece, prepend=-1) > 0), "tok": shown(number["tok"] - 1, np.int32), "text": picked(flat, at), "kind": picked(names, np.where(gone, -1, kind[at]) if n else at),
            "pattern": picked(identifiers, np.where(gone, -1, pattern[at]) if n else at), "end": shown(number["end"], np.int32), "w": pa.array((number["w"][at] if n else at).astype(np.int32), mask=gone | (~word[at] if n else gone)),
            "cap": shown(cap, bool), **{name: shown(asked[name], bool) for name in ASKED},
            "before": pa.StructArray.from_arrays(before, names=["kind", "text", "start"], mask=pa.array(previous < 0)), "tail": pc.if_else(pa.array(gone), pa.scalar(None, pa.string()), tail),
        }
        final = int(solid[-1])
        if final >= begin[-1]:
            last = (KINDS[kind[final]], flat[final].as_py(), int(begun[final]))
        elif starts[-1] >= 0:
            last = None
        tokens, words, chars = (int(total[-1] - of_piece[-1]) for total, of_piece in base.values())
        street = max(0, int(known[-1] - base["w"][1][-1])) if n else street if starts[-1] < 0 else 0
        return pa.RecordBatch.from_pydict(columns), (tokens, words, chars, street, last)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = (0, 0, 0, 0, None)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                out, carry = of_pieces(batch.slice(at, AT_ONCE), carry)
                yield out

    return of_batches


def kept_tokens(docs: DataFrame, keep: list[str], lexicon: Lexicon) -> DataFrame:
    """doc_id, keep, score_*, lead, and a row for each pattern token and each word that can be in a group.

    A piece of a document without such has one row with tok null; `lead` marks one row of each piece, whose score_* the
    other rows of the piece repeat. Tokens leave Python as rows, so that nothing waits in the JVM beside them.
    """
    asks = {"company_word": lexicon.company_words, "street_word": lexicon.street_words, "honorific": lexicon.honorifics, "stop": lexicon.every_stop_word}
    stops = {f"score_{x}": words for x, words in lexicon.stop_words.items()}
    rows = with_tokens(chunked(docs.select("doc_id", *keep, "text"))).select("doc_id", *keep, "chunk", "texts", "patterns", "after")
    own = rows.select("doc_id", *keep).schema
    schema = StructType([*own.fields, *(StructField(name, LongType()) for name in stops), *StructType.fromDDL(MARKED).fields])
    rows = rows.mapInArrow(marker(keep, asks, stops), schema)
    first = F.col("before").isNull() | ((F.col("before.kind") == "punctuation") & (F.col("before.text") == "."))
    return rows.withColumn("start", F.col("end") - F.length("text")).withColumn("sentence_start", first).withColumn("all_upper", T.all_upper(F.col("text")))


def ordered() -> Window:
    return Window.partitionBy("doc_id").orderBy("tok")


def chained(rows: DataFrame, name: str, follows: Column, starts: Column, least: int) -> DataFrame:
    """rows with `name`: the word number at which the row's group starts, null for rows without a group.

    Words that aren't rows may neither follow nor start a group; a gap in the numbers tells that they were there.
    """
    word = F.col("kind") == "word"
    last = F.last("w", ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    opens = word & ~(follows & F.coalesce(F.col("w") == last + 1, F.lit(False)))
    rows = rows.withColumn("opens", opens.cast("int"))
    rows = rows.withColumn("chain", F.sum("opens").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("doc_id", "chain")
    rows = rows.withColumn("first", F.min(F.when(word & starts, F.col("w"))).over(chain))
    inside = word & (F.col("w") >= F.col("first"))
    size = F.sum(F.when(inside, 1).otherwise(0)).over(chain)
    return rows.withColumn(name, F.when(inside & (size >= least), F.col("first"))).drop("opens", "chain", "first")


def covering(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """From (first row of a document, word number, street word, end of its group, segment), in order: the start of the group
    that covers the row, else null. What goes from batch to batch is the last group."""
    start, end, segment = -1, -1, -1
    for first, w, street, until, of in parts:
        first, street, numbers, until, of = first.to_numpy(), street.to_numpy(), w.to_numpy(), until.to_numpy(), of.to_numpy()
        at, found = [0], [(start, end, segment)]
        for k in np.flatnonzero(first | street).tolist():
            if first[k]:
                end = -1
            if street[k] and (numbers[k] >= end or of[k] != segment):
                start, end, segment = int(numbers[k]), int(until[k]), int(of[k])
            at.append(k)
            found.append((start, end, segment))
        picks = np.array(found)[np.searchsorted(at, np.arange(len(numbers)), side="right") - 1]
        inside = (picks[:, 1] > numbers) & (picks[:, 2] == of)
        yield pd.Series(np.where(inside, picks[:, 0], -1)).astype("Int32").where(inside)


def addresses(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows, in as many parts as given, with g3: groups of a street word, the number before it, and the words after it that no company has taken.

    A street word inside the group of an earlier one starts no group; a company ends a group. The scan needs a document's
    rows in order and in one partition, which the windows before it have seen to; the sort says so and is not done again.
    """
    taken = F.col("g2").isNotNull()
    street = F.coalesce(F.col("street_word"), F.lit(False)) & ~taken
    numbered = F.coalesce(F.col("before.kind") == "number", F.lit(False))
    end = F.col("w") + F.when(numbered, ADDRESS_TOKENS - 1).otherwise(ADDRESS_TOKENS)
    rows = rows.withColumn("segment", F.sum(F.when(taken, 1).otherwise(0)).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("first", F.row_number().over(ordered()) == 1).sortWithinPartitions("doc_id", "tok")
    start = F.pandas_udf(covering, "int").asNondeterministic()("first", F.coalesce("w", F.lit(-1)), street, F.coalesce(end, F.lit(-1)), "segment")
    rows = rows.withColumn("pick", start)
    # The windows that follow need a document's rows together again, since Spark doesn't know that a scan leaves them so.
    rows = rows if parts is None else rows.repartition(parts, "doc_id")
    return rows.withColumn("g3", F.when((F.col("kind") == "word") & ~taken, F.col("pick"))).drop("segment", "first", "pick")


def grouped_words(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows of kept_tokens(), each with pass and g (its group's start), null outside groups; `parts` deals documents out."""
    rows = rows if parts is None else rows.repartition(parts, "doc_id")
    rows = chained(rows, "g2", F.col("cap"), F.col("company_word"), 2)
    rows = addresses(rows, parts)
    free = F.col("g2").isNull() & F.col("g3").isNull()
    rows = chained(rows, "g4", free & F.col("cap") & ~F.col("stop"), free & F.col("honorific"), 2)
    free = free & F.col("g4").isNull()
    follows = free & F.col("cap") & ~F.col("stop")
    rows = chained(rows, "g5", follows, follows & (F.length("text") >= 2) & ~(F.col("sentence_start") & ~F.col("all_upper")), 1)
    number = F.when(F.col("kind") == "pattern", 1)
    for k in PASSES:
        number = number.when(F.col(f"g{k}").isNotNull(), k)
    g = F.when(F.col("kind") == "pattern", F.col("tok")).otherwise(F.coalesce("g2", "g3", "g4", "g5"))
    return rows.withColumn("pass", number).withColumn("g", g)


def analysed(docs: DataFrame, keep: list[str] | None = None, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """doc_id, the columns `keep`, score_*, language, groups: one row for each document, whose id must be unique and not null.

    Lengths of texts are summed beforehand, which settles in how many parts documents are worked on.
    groups is an array of GROUP_FIELDS, ordered by pass and then `ord`, the first token's start. A group's text joins its
    words by single spaces; its span may hold more. `tail` is the text after it.
    """
    keep = [] if keep is None else keep
    rows = grouped_words(kept_tokens(docs, keep, lexicon), tables.parts_of(docs, "text"))
    scored = [f"score_{x}" for x in lexicon.stop_words]
    # One row of each piece stays for its scores, and for documents without groups.
    rows = rows.where(F.col("pass").isNotNull() | F.col("lead"))
    found = rows.groupBy("doc_id", *keep, "pass", "g").agg(
        F.array_sort(F.collect_list(F.struct("tok", "text"))).alias("members"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max_by("tail", "tok").alias("tail"),
        F.first("pattern").alias("pattern"),
        F.min_by("before", "tok").alias("before"),
        *[F.sum(F.when(F.col("lead"), F.col(c)).otherwise(0)).alias(c) for c in scored],
    )
    number = F.when((F.col("pass") == 3) & (F.col("before.kind") == "number"), F.col("before"))
    words = F.transform("members", lambda m: m["text"])
    text = F.array_join(F.when(number.isNotNull(), F.concat(F.array(number["text"]), words)).otherwise(words), " ")
    kind, confidence = F.when(F.col("pattern") == "ssn_fr", "ssn").otherwise(F.col("pattern")), F.lit("certain")
    for k, (local, sure) in PASSES.items():
        kind, confidence = F.when(F.col("pass") == k, F.lit(local).cast("string")).otherwise(kind), F.when(F.col("pass") == k, sure).otherwise(confidence)
    group = F.struct(
        F.col("pass"), F.col("start").alias("ord"), text.alias("text"), F.coalesce(number["start"], F.col("start")).alias("start"), F.col("end"),
        F.col("tail"), kind.alias("local_type"), confidence.alias("confidence"), (F.col("pass") == 1).alias("skip"), words.alias("words"),
    )
    found = found.select("doc_id", *keep, *scored, F.when(F.col("pass").isNotNull(), group).alias("group"))
    out = found.groupBy("doc_id", *keep).agg(*[F.sum(c).alias(c) for c in scored], F.array_sort(F.collect_list("group")).alias("groups"))
    return out.select("doc_id", *keep, *scored, best_language(list(lexicon.stop_words)).alias("language"), "groups")


def groups(table: DataFrame) -> DataFrame:
    """doc_id and GROUP_FIELDS, a row for each group of analysed()."""
    return table.select("doc_id", F.explode("groups").alias("g")).select("doc_id", *[F.col("g")[f].alias(f) for f in GROUP_FIELDS])
