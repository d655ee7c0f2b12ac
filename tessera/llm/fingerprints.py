"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraph digests, with DataFrame functions only.

A text is cut into paragraphs: its lines, and long lines into parts of PARAGRAPH_WORDS words. Each distinct paragraph's
64-bit digest goes into one cell of each of three subtables; a cell holds a count, the exclusive or of the digests and
that of their checks. Two sketches of one size subtract cell by cell, which leaves what the texts don't share, and
peeling takes it out: a cell with one digest left tells it, and the digest is removed from its other cells. Where that
stalls, the comparison is repeated with larger sketches. The likeness of two fingerprints is the Jaccard similarity of
their digests, from the recovered differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PARAGRAPH_WORDS = 16
PARAGRAPH = rf"\S{{1,200}}(?:[^\S\n]+\S{{1,200}}){{0,{PARAGRAPH_WORDS - 1}}}"
TABLES = 3
#: Cells of the sketch that is the fingerprint, what a sketch grows by when peeling fails, and cells a digest when retrying.
CELLS, GROWTH, ROOM = 36, 4, 1.6
#: Times that every subtable is peeled before a comparison counts as failed.
PEELS = 4
#: Documents that are put in order together, and into how many parts quantiles can cut them; beyond, parts grow.
ORDERED, MOST_PARTS = 2000, 10_000
#: A doc_id (or none) that more rows have than this and one in so many is cut into parts by the hash of the text.
SAME, SAME_SHARE = 8000, 1000
SUB = 1 << 20


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def check(digest: str) -> str:
    return f"(xxhash64({digest}, 'check') & 4294967295)"


def cell(table: int, digest: str) -> str:
    """Where a digest goes in a subtable of a sketch of `cells` cells."""
    third = f"cast(cells / {TABLES} as int)"
    return f"cast({third} * {table} + pmod(xxhash64({digest}, {table}), {third}) as int)"


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, digests, next_text, next_digests: the next row by descending doc_id (null last), after the last the first.

    Rows with one doc_id follow one another by the hash of their text. Rows are dealt out by quantiles of doc_id, those of
    a frequent doc_id and those without one by that hash too, so that texts move once and no task holds them all; the last
    row of each part gets the first one of the next part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    total = rows.count()
    parts = max(1, min(MOST_PARTS, total // ORDERED))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    # At most SAME_SHARE rows.
    same = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > max(SAME, total // SAME_SHARE)).collect()
    cuts = sorted({*(cuts or []), *(r["doc_id"] for r in same if r["doc_id"] is not None)})
    # One part for each interval of the cuts, numbered by descending doc_id; null ids come last. A frequent id begins its
    # interval, and so comes last in it.
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - above(cuts, F.col("doc_id"))).cast("long") * SUB
    share = F.col("mark").cast("double") / F.lit(2.0**64) + 0.5
    for r in same:
        many = min(SUB - 2, -(-r["n"] // ORDERED))
        sub = F.least(F.floor(share * many), F.lit(many - 1)) + 1
        part = part + F.when(F.col("doc_id").eqNullSafe(F.lit(r["doc_id"]).cast("long")), sub).otherwise(0)
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("mark")).withColumn("part", part)
    inside = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.asc("mark"))
    following = rows.withColumn("digests", digests(F.col("text"))).withColumn("next", F.lead(F.struct("text", "digests")).over(inside))
    # A row for each part: its first document, and that of the part after it.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.bitwise_not("doc_id").alias("down"), F.col("mark"))).alias("head")
    heads = common.written(rows.groupBy("part").agg(least), "heads")
    after = heads.withColumn("whole", F.first("head").over(Window.orderBy("part")))
    after = after.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.col("whole")).alias("head"))
    key = F.struct(F.col("doc_id").isNull().alias("null"), F.bitwise_not("doc_id").alias("down"), F.col("mark")).alias("head")
    wanted = rows.select(key, "text").join(after, "head").groupBy("part").agg(F.first("text").alias("text"))
    wanted = wanted.select("part", F.struct("text", digests(F.col("text")).alias("digests")).alias("first"))
    both = following.join(wanted, "part", "left").withColumn("next", F.coalesce("next", "first"))
    return both.select("doc_id", "text", "digests", F.col("next.text").alias("next_text"), F.col("next.digests").alias("next_digests"))


def above(bounds: list[int], x: Column) -> Column:
    """How many of the sorted bounds are at most x, by halving."""
    if not bounds:
        return F.lit(0)
    table = F.lit(bounds).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= x), at + step).otherwise(at))


def labelled(digests_: str, version: int) -> Column:
    return F.transform(digests_, lambda d: F.struct(F.lit(version).alias("version"), d.alias("digest")))


def cells_of(rows: DataFrame, versions: list[str], cells: Column) -> DataFrame:
    """rows' id columns with cell, and count, key and check of each version's sketch. rows: row, cells, arrays of digests."""
    entries = F.flatten(F.array(*[labelled(v, k) for k, v in enumerate(versions)]))
    each = rows.select("row", cells.alias("cells"), F.explode(entries).alias("e")).select("row", "cells", "e.version", "e.digest")
    places = ", ".join(cell(k, "digest") for k in range(TABLES))
    each = each.selectExpr("row", "cells", "version", "digest", f"{check('digest')} AS mark", f"explode(array({places})) AS cell")
    sums = []
    for k, v in enumerate(versions):
        own = F.col("version") == k
        sums += [F.count(F.when(own, 1)).alias(f"n_{v}"), F.coalesce(F.bit_xor(F.when(own, F.col("digest"))), F.lit(0)).alias(f"key_{v}"), F.coalesce(F.bit_xor(F.when(own, F.col("mark"))), F.lit(0)).alias(f"check_{v}")]
    return each.groupBy("row", "cells", "cell").agg(*sums)


def subtracted(table: DataFrame, a: str, b: str) -> DataFrame:
    """row, cells, cell, n, key, check of a's sketch less b's, without empty cells."""
    left = table.select("row", "cells", "cell", (F.col(f"n_{a}") - F.col(f"n_{b}")).alias("n"), F.col(f"key_{a}").bitwiseXOR(F.col(f"key_{b}")).alias("key"), F.col(f"check_{a}").bitwiseXOR(F.col(f"check_{b}")).alias("check"))
    return left.where("n <> 0 or key <> 0 or check <> 0")


def peeled(table: DataFrame) -> DataFrame:
    """row, only_a, only_b (digests recovered on either side), left (cells that peeling couldn't empty).

    Cells -1 and -2 count what was recovered. Subtables take turns, so that a digest is only seen once at a time.
    """
    for turn in range(TABLES * PEELS):
        own = turn % TABLES
        pure = f"cell >= 0 AND abs(n) = 1 AND cell = {cell(own, 'key')} AND check = {check('key')}"
        recovered = "named_struct('cell', if(n > 0, -1, -2), 'n', 1L, 'key', 0L, 'check', 0L)"
        others = ", ".join(f"named_struct('cell', {cell(k, 'key')}, 'n', -n, 'key', key, 'check', check)" for k in range(TABLES) if k != own)
        rest = "named_struct('cell', cell, 'n', n, 'key', key, 'check', check)"
        table = table.selectExpr("row", "cells", f"explode(if({pure}, array({recovered}, {others}), array({rest}))) AS e")
        table = table.selectExpr("row", "cells", "e.*").groupBy("row", "cells", "cell").agg(F.expr("sum(n) AS n"), F.expr("bit_xor(key) AS key"), F.expr("bit_xor(check) AS check"))
        table = table.where("n <> 0 or key <> 0 or check <> 0")
    side = lambda at: F.coalesce(F.sum(F.when(F.col("cell") == at, F.col("n"))), F.lit(0))
    return table.groupBy("row").agg(side(-1).alias("only_a"), side(-2).alias("only_b"), F.count(F.when(F.col("cell") >= 0, 1)).alias("left"))


def likeness(pairs: DataFrame) -> DataFrame:
    """row, likeness for pairs (row, a, b: arrays of distinct digests), retrying with larger sketches until all are recovered."""
    todo, out, again = pairs.select("row", "a", "b", F.lit(CELLS).alias("cells")), None, False
    while True:
        dealt = todo.repartition("row")  # digests move once a round; all that follows is by row
        table = subtracted(cells_of(dealt, ["a", "b"], F.col("cells")), "a", "b")
        result = dealt.join(peeled(table), "row", "left").fillna(0, ["only_a", "only_b", "left"])
        kept = lambda c: F.when(F.col("left") > 0, F.col(c)).alias(c)
        result = result.select("row", "cells", "only_a", "only_b", "left", F.size("a").alias("n_a"), F.size("b").alias("n_b"), kept("a"), kept("b"))
        result = common.written(result, "peeled")
        union = F.col("n_a") + F.col("only_b")
        done = result.where("left = 0").select("row", F.when(union == 0, 1.0).otherwise((F.col("n_a") - F.col("only_a")) / union).alias("likeness"))
        out = done if out is None else out.unionByName(done)
        failed = result.where("left > 0")
        if failed.isEmpty():
            return out
        # First as many cells as hold all digests of both texts, then GROWTH times as many.
        power = F.ceil(F.log(float(GROWTH), F.greatest(F.lit(GROWTH), (F.col("n_a") + F.col("n_b")) * ROOM / CELLS)))
        grown = F.col("cells") * GROWTH if again else (CELLS * F.pow(F.lit(GROWTH), power)).cast("int")
        todo, again = failed.select("row", "a", "b", grown.alias("cells")), True


def written_out(version: str) -> Column:
    """The cells of a sketch as text, ordered: count:key:check, empty ones left out."""
    one = lambda c: F.concat_ws(":", F.hex(c["cell"]), F.hex(c["n"]), F.lower(F.hex(c["key"])), F.lower(F.hex(c["check"])))
    return F.array_join(F.transform(F.array_sort(version), one), ",")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text has its last third (n_chars / 3, rounded down) replaced by as much of the beginning of the next
    document, or all of that. Null texts count as empty; texts without paragraphs are alike (1.0). Repeated rows are kept
    one by one, each the next of the one before; an only row is its own next. Other columns are ignored; an empty table
    gives no row.
    """
    rows = with_next(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "digests", "next_digests", edited.alias("edited"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("digests").alias("own"), digests(F.col("edited")).alias("edited"), F.col("next_digests").alias("next"))
    table = common.written(rows, "digests")
    dealt = table.select("row", "own", "edited").repartition("row")
    part = lambda v: F.collect_list(F.when(F.col(f"n_{v}") > 0, F.struct("cell", F.col(f"n_{v}").alias("n"), F.col(f"key_{v}").alias("key"), F.col(f"check_{v}").alias("check")))).alias(v)
    prints = cells_of(dealt, ["own", "edited"], F.lit(CELLS)).groupBy("row").agg(part("own"), part("edited"))
    prints = prints.select("row", written_out("own").alias("fingerprint"), written_out("edited").alias("edited_fingerprint"))
    # Both comparisons of a row go through the same jobs: twice the row's number for one, one more for the other.
    pairs = table.select(F.explode(F.array(F.struct((F.col("row") * 2).alias("row"), F.col("own").alias("a"), F.col("edited").alias("b")), F.struct((F.col("row") * 2 + 1).alias("row"), F.col("own").alias("a"), F.col("next").alias("b")))).alias("p")).select("p.*")
    near = likeness(pairs)
    near = near.groupBy(F.floor(F.col("row") / 2).alias("row")).agg(F.max(F.when(F.col("row") % 2 == 0, F.col("likeness"))).alias("near_edited"), F.max(F.when(F.col("row") % 2 == 1, F.col("likeness"))).alias("near_next"))
    out = table.select("row", "doc_id", "n_chars", "edited_sha256").join(prints, "row", "left").join(near, "row")
    return out.select("doc_id", "n_chars", "edited_sha256", *[F.coalesce(c, F.lit("")).alias(c) for c in ("fingerprint", "edited_fingerprint")], "near_edited", "near_next")
