"""Line dedup: later copies of repeated line runs are deleted.

Every line becomes an id, and the suffixes of the documents' id sequences are sorted by distributed prefix doubling: the
rank of a suffix by its first 2h lines is that of the pair (rank by h lines at s, rank by h lines at s + h). A rank's
suffixes are an interval of the suffix array with a longest common prefix of h lines at least; suffixes alone in their
interval are settled and leave, so that each round works on what still repeats and the rounds end after the logarithm of
the longest repeated run. In each interval the suffix that comes first in the corpus is kept and every other one is a
later copy of its h lines. Whether lines go follows from the runs of one to MIN_LINES lines that they are in: those of three
are a pair and the line after it. The maximal runs of later copies are covered by these prefixes, since a run of n lines is the
union of two prefixes of the largest power of two up to n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Lines in a row that have stood before are deleted if they have so many words together, or are so many (four: three_lines() has the only size between powers of two).
MIN_WORDS, MIN_LINES = 5, 4
#: Suffixes of an interval that meet in a task; more are dealt to several. At most 1 / SPLITS of all intervals' rows.
TOGETHER, SPLITS = 5_000, 100_000


def broken() -> Column:
    return F.split(common.whole_text(), "\n", -1)


def mark() -> Column:
    """Tells rows with one doc_id apart. Rows that are equal in both count as one."""
    return F.xxhash64(common.whole_text())


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, mark, line (number in the text), words and two hashes of each line that isn't blank.

    `nth` numbers these lines within the text: blank lines neither make nor break a run.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), broken().alias("all"))
    kept = F.filter(F.transform("all", lambda x, k: F.struct(k.alias("line"), F.trim(x).alias("text"))), lambda x: x["text"] != "")
    lines = texts.select("doc_id", "mark", F.posexplode(kept).alias("nth", "at"))
    text = F.col("at.text")
    words = F.size(F.split(text, r"\s+"))
    return lines.select("doc_id", "mark", "nth", F.col("at.line").alias("line"), F.least(words, F.lit(MIN_WORDS)).alias("words"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def ranked(suffixes: DataFrame) -> DataFrame:
    """suffixes (place, a, b) of intervals of two or more, with `first`, the interval's earliest place.

    The sums are taken before the shuffle, so that a frequent line is one row from each task; then its suffixes are dealt
    to as many tasks as they need.
    """
    intervals = suffixes.groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
    intervals = common.written(intervals.where("first < last").drop("last"), "intervals")
    most = max(TOGETHER, (intervals.agg(F.sum("n")).first()[0] or 0) // SPLITS)
    parts = F.ceil(F.col("n") / most).cast("int")
    # Fewer than SPLITS rows, since each stands for more than 1 / SPLITS of all.
    large = F.broadcast(intervals.where(F.col("n") > most).select("a", "b", parts.alias("parts")))
    rows = suffixes.join(large, ["a", "b"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("place"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    dealt = intervals.select("a", "b", "first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return rows.join(dealt, ["a", "b", "part"]).drop("part")


def three_lines(pairs: DataFrame, single: DataFrame) -> DataFrame:
    """Later copies of three lines, as repeated_runs() has them, where neither pair and line make them go already."""
    after = F.struct(F.col("place.doc_id").alias("doc_id"), F.col("place.mark").alias("mark"), (F.col("place.nth") - 2).alias("nth"))
    third = single.select(after.alias("before"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("at").alias("at2"), F.col("words").alias("words2"))
    rows = pairs.drop("first").join(third, F.col("place") == F.col("before"))
    rows = rows.where(((F.col("words") < MIN_WORDS) | (F.col("words2") < MIN_WORDS)) & (F.col("words") + F.col("words2") >= MIN_WORDS))
    rank = F.xxhash64("a", "b", "a2", "b2").alias("a"), F.xxhash64(F.lit("second"), "a", "b", "a2", "b2").alias("b")
    rows = ranked(rows.select("place", *rank, (F.col("words") + F.col("words2")).alias("words"), F.concat("at", "at2").alias("at")))
    return rows.where("place > first").select("place", "words", F.lit(3).alias("lines"), "at")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """place (doc_id, mark, nth), words, lines, at: a later copy of `lines` lines begins at the nth line that isn't blank.

    Each suffix has one row for every power of two up to the longest that it shares with an earlier one, and one for three
    lines where those matter. `at` holds the
    numbers of the first MIN_LINES lines at most, `words` how many words they have, at most MIN_WORDS for each.
    """
    place = F.struct("doc_id", "mark", "nth").alias("place")
    table = common.written(line_table(docs).select(place, "a", "b", "words", F.array("line").alias("at")), "lines")
    # Rows equal in doc_id and text give a place several times; one counts.
    level, length, found = common.written(ranked(table).dropDuplicates(["place"]), "suffixes-1"), 1, []
    single = level
    while not level.isEmpty():
        if length == 2:
            found.append(three_lines(level, single))
        found.append(level.where("place > first").select("place", "words", F.lit(length).alias("lines"), "at"))
        before = F.struct(F.col("place.doc_id").alias("doc_id"), F.col("place.mark").alias("mark"), (F.col("place.nth") - length).alias("nth"))
        ahead = level.select(before.alias("before"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("at").alias("at2"), F.col("words").alias("words2"))
        pairs = level.drop("first").join(ahead, F.col("place") == F.col("before"))
        length *= 2
        # The rank of a pair: equal for equal pairs of ranks only, but for a collision of 128 bits.
        rank = F.xxhash64("a", "b", "a2", "b2").alias("a"), F.xxhash64(F.lit("second"), "a", "b", "a2", "b2").alias("b")
        more = length <= MIN_LINES
        at, words = F.concat("at", "at2") if more else F.col("at"), F.col("words") + F.col("words2") if more else F.col("words")
        level = common.written(ranked(pairs.select("place", *rank, words.alias("words"), at.alias("at"))), f"suffixes-{length}")
    runs = found[0] if found else level.select("place", "words", F.lit(length).alias("lines"), "at")
    for more in found[1:]:
        runs = runs.unionByName(more)
    return runs


def dedup(docs: DataFrame) -> DataFrame:
    """docs with `text` shortened, and n_lines, n_deleted, deleted, longest_run.

    The first occurrence, by doc_id (null first), then hash of the text and line number, stays. Lines in a row that have
    stood before in this order are deleted if they have MIN_WORDS words together or are MIN_LINES; a line by itself so
    needs MIN_WORDS. Blank lines don't count and stay. `deleted` lists the numbers of deleted lines, from 0, comma-joined;
    longest_run is the largest power of two of lines in a row that have stood before. Spaces around a line don't count in
    comparisons. Long texts are read whole. Null texts stay null, with no lines; an empty text has one blank line. Rows
    equal in doc_id and text are treated alike, as one document. Columns of docs named like the four new ones are replaced.
    """
    runs = repeated_runs(docs)
    deleted = (F.col("lines") <= MIN_LINES) & ((F.col("words") >= MIN_WORDS) | (F.col("lines") == MIN_LINES))
    of = [F.col("place.doc_id").alias("doc_id"), F.col("place.mark").alias("mark")]
    runs = runs.select(*of, "lines", F.explode_outer(F.when(deleted, F.col("at"))).alias("line"))
    longest = F.max(F.when(F.col("lines") != 3, F.col("lines")))
    gone = runs.groupBy("doc_id", "mark").agg(longest.alias("longest"), F.sort_array(F.collect_set("line")).alias("gone"))
    new = ["n_lines", "n_deleted", "deleted", "longest_run"]
    names = [c for c in docs.columns if c.lower() not in new]
    # Columns travel under numbers, so that no name of theirs can clash or be read as a path.
    own = [common.named(c).alias(f"c{k}") for k, c in enumerate(names)]
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"))
    rows = docs.select(*own, F.col("text"), key.alias("key"))
    joined = rows.join(gone.select(F.struct("doc_id", "mark").alias("of"), "longest", "gone"), F.col("key") == F.col("of"), "left")
    out = F.coalesce("gone", F.array().cast("array<int>"))

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")

    # The one-element array binds the lines to a name, so that the text is split once and not once for each line.
    shorter = F.get(F.transform(F.array(broken()), kept), F.lit(0))
    text = F.when(F.size(out) == 0, F.col("text")).otherwise(shorter)
    return joined.select(
        *[text.alias(c) if c.lower() == "text" else F.col(f"c{k}").alias(c) for k, c in enumerate(names)],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(broken())).cast("long").alias("n_lines"),
        F.size(out).cast("long").alias("n_deleted"),
        F.array_join(out.cast("array<string>"), ",").alias("deleted"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
    )
