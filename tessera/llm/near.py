"""Near-duplicate documents by Order MinHash.

A text's k-mers are its shingles of five words, each labelled with its occurrence number. A sketch holds, for each of
SKETCHES hash functions, the ORDER labelled k-mers of least hash, in text order, so that it notes what is shared and in
which order. Texts with an equal entry are candidates; banded alignment of their shingle sequences verifies them.
Of few k-mers an entry can miss too often, or always where one text has fewer than ORDER. So texts of SHORT shingles or
fewer also have single k-mers as entries: so many of least hash that two texts of SIMILARITY must share one of them.

Exact copies (equal words) collapse into one unit first. Units with an equal entry are a bucket. Buckets don't write out
all their pairs, so that the work grows with the number of their members: every unit is aligned with the leaders of its
buckets. The first leader of a bucket is its most central unit, the one whose buckets have most members, to which the
copies of a text are mostly near; once links have become components, the most central units of the LEADERS - 1 next
components in the bucket lead too. A pair could only be missed then if none of the two leads a bucket of both, and no chain
of links joins them. So the units of buckets that still hold several components meet once more by their rarest k-mers, which
no pair of SIMILARITY can miss; that takes pairs of units that share rare k-mers and aren't joined, not all pairs of a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 32
ORDER = 5
#: Texts of so many shingles at most have entries that no pair of SIMILARITY can miss.
SHORT = 12
#: Leaders of a bucket, one of them in the first round.
LEADERS = 4
#: Units with one k-mer that meet all others with it in a task; of more, several tasks take a part each.
MET_TOGETHER = 1000
#: Pairs with one leader that are aligned in a task; a leader of more goes to several.
LED_TOGETHER = 2000
CACHED_WORDS = 400_000
#: The unit of all texts without words, where they count as copies.
WORDLESS = bytes(16)
#: Hashes in work at a time.
BLOCK = 1 << 21

UNITS = "doc_id long, mark long, unit binary, n int, sketch array<long>, body binary"


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of each five words in a row; of all words, if there are fewer."""
    words = words.astype(np.uint64)
    width = min(SHINGLE, len(words))
    out = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)] + np.uint64(1))
    return out


def occurrences(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))
    out = np.empty(len(values), dtype=np.uint64)
    out[order] = (np.arange(len(values)) - start).astype(np.uint64)
    return out


def sketch(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One entry for each seed: the k-mers of least hash, in text order, hashed together."""
    labelled = mixed(values + occurrences(values) * np.uint64(0xD1B54A32D192ED03))
    n, out = len(values), np.empty(len(seeds), dtype=np.uint64)
    take = min(ORDER, n)
    step = max(1, BLOCK // n)
    for at in range(0, len(seeds), step):
        part = seeds[at : at + step, None]
        hashes = labelled[None, :] * part
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0x94D049BB133111EB)
        least = np.sort(np.argpartition(hashes, take - 1, axis=1)[:, :take], axis=1)
        entry = part[:, 0].copy()
        for k in range(take):
            entry = mixed(entry * np.uint64(0x9E3779B97F4A7C15) + labelled[least[:, k]])
        out[at : at + step] = entry
    return out.view(np.int64)


def short_entries(values: np.ndarray) -> np.ndarray:
    """The labelled k-mers of least hash by which a short text meets all texts of SIMILARITY; none for other texts.

    Two texts of n and m shingles and that similarity share at least SIMILARITY * max(n, m) labelled k-mers. If the
    least shared one came after the first n - SIMILARITY * n + 1 of a text, more of its k-mers would be unshared than may
    be; so it is among these of both.
    """
    n = len(values)
    if n > SHORT:
        return np.zeros(0, dtype=np.int64)
    labelled = mixed(values + occurrences(values) * np.uint64(0xD1B54A32D192ED03))
    return np.unique(labelled)[: n - math.ceil(SIMILARITY * n - 1e-9) + 1].view(np.int64)


def mark() -> Column:
    """Tells rows with one doc_id apart."""
    return F.xxhash64(common.whole_text())


def sketched(docs: DataFrame) -> DataFrame:
    """UNITS for each row of docs; unit, sketch and body are null where the text has no word. body: hashes of the words, compressed."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        import zstandard

        pack, known = zstandard.ZstdCompressor(level=1).compress, WordHash()
        seeds = np.random.default_rng(20).integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = text.lower().split()
                if not words:
                    rows.append((None, 0, None, None))
                    continue
                body = np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words))
                unit = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                values = shingles(body)
                rows.append((unit, len(values), np.unique(np.concatenate((sketch(values, seeds), short_entries(values)))), pack(body.tobytes())))
            out = pd.DataFrame(rows, columns=["unit", "n", "sketch", "body"])
            yield pd.concat([batch[["doc_id", "mark"]].reset_index(drop=True), out], axis=1).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), common.whole_text().alias("text"))
    return rows.mapInPandas(make, UNITS)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Shingles that a banded alignment matches, over those of both texts together; 0 where that can't reach `similarity`.

    A pair that reaches it leaves few shingles unmatched, and so its matches lie near the diagonal; the band holds all
    such alignments.
    """
    na, nb = len(a), len(b)
    least = similarity * (na + nb) / (1 + similarity)
    if min(na, nb) < least - 1e-9:
        return 0.0
    short = min(na, nb)
    same = a[:short] == b[:short]
    head = short if same.all() else int(same.argmin())
    rest = short - head
    same = a[na - rest :][::-1] == b[nb - rest :][::-1]
    tail = rest if same.all() else int(same.argmin())
    left, right = a[head : na - tail], b[head : nb - tail]
    matched = head + tail
    if len(left) and len(right):
        values, number = np.unique(np.concatenate((left, right)), return_inverse=True)
        counts = np.minimum(np.bincount(number[: len(left)], minlength=len(values)), np.bincount(number[len(left) :], minlength=len(values)))
        if matched + counts.sum() < least - 1e-9:
            return 0.0
        matched += banded(number[: len(left)].tolist(), number[len(left) :].tolist(), int(na + nb - 2 * least) + 1)
    return matched / (na + nb - matched) if matched >= least - 1e-9 else 0.0


def banded(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence with matches at most `band` off the diagonal, by bit-parallel rows.

    Each row only works on the bits of its window; bits below it are final and are counted when they leave.
    """
    places: dict[int, int] = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    n = len(b)
    row, low, done = (1 << n) - 1, 0, 0  # bits of row: columns from low on; a zero is a step of the length
    for k, x in enumerate(a):
        move = max(0, min(k - band, n)) - low
        if move > 0:
            done += move - (row & ((1 << move) - 1)).bit_count()
            row >>= move
            low += move
        width = min(n, k + band + 1) - low
        if width <= 0:
            continue
        window = (1 << width) - 1
        hit = (places.get(x, 0) >> low) & window
        part = row & window
        u = part & hit
        row = (row & ~window) | (((part + u) | (part - u)) & window)
    return done + (n - low) - row.bit_count()


def linked(pairs: DataFrame, bodies: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """pairs (a, b: a leader) that the alignment verifies, with `similarity`, as a written table. A leader of many pairs is dealt to several tasks."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack, kept = zstandard.ZstdDecompressor().decompress, (None, None)
        for batch in batches:
            found = []
            for b, body_a, body_b in zip(batch["b"], batch["body_a"], batch["body_b"]):
                if kept[0] != b:
                    kept = b, shingles(np.frombuffer(unpack(body_b), dtype=np.uint32))
                found.append(aligned(shingles(np.frombuffer(unpack(body_a), dtype=np.uint32)), kept[1], similarity))
            out = batch[["a", "b"]].assign(similarity=found)
            yield out[out["similarity"] >= similarity]

    pairs = common.written(pairs, "pairs")
    tasks = pairs.groupBy("b").agg(F.ceil(F.count("*") / LED_TOGETHER).cast("int").alias("tasks"))
    left = pairs.join(tasks, "b").select(F.col("a").alias("unit"), "b", F.pmod(F.xxhash64("a"), F.col("tasks")).cast("int").alias("task"))
    left = left.join(bodies.select("unit", "body"), "unit").select(F.col("unit").alias("a"), "b", "task", F.col("body").alias("body_a"))
    right = tasks.withColumnRenamed("b", "unit").join(bodies.select("unit", "body"), "unit")
    right = right.select(F.col("unit").alias("b"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.col("body").alias("body_b"))
    links = left.join(right, ["b", "task"]).select("a", "b", "body_a", "body_b").mapInPandas(verify, "a binary, b binary, similarity double")
    links = common.written(links, "links", common.TEXT_ROWS)
    common.removed(pairs)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for the nodes of edges (a, b), by large and small stars."""
    before = None
    stars = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        last, stars = stars, common.written(small, "stars")
        common.removed(last)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    least = stars.groupBy("a").agg(F.min("b").alias("label"))
    roots = stars.select(F.col("b").alias("node")).distinct()
    labels = common.written(least.select(F.col("a").alias("node"), "label").unionByName(roots.select("node", F.col("node").alias("label"))), "labels")
    common.removed(stars)
    return labels


def memberships(distinct: DataFrame) -> DataFrame:
    """unit, n, score, values for the units that share an entry with others: these entries, and how many they are shared with in all."""
    entries = distinct.select("unit", "n", F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    found = entries.join(shared, "value").groupBy("unit").agg(F.first("n").alias("n"), F.sum("size").alias("score"), F.collect_list("value").alias("values"))
    return common.written(found, "members")


def candidates(members: DataFrame, leaders: DataFrame, similarity: float) -> DataFrame:
    """a, b: the members (value, unit, n, label) of a leader's bucket that have another label, and a size that can be near."""
    led = members.join(leaders.select("value", F.col("unit").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b")), "value")
    able = F.least("n", "n_b") >= similarity * F.greatest("n", "n_b") - 1e-9
    return led.where(able & (F.col("label") != F.col("label_b"))).select(F.col("unit").alias("a"), "b").distinct()


def with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each unit and entry of members, with the unit's label, its own name where it has none."""
    named = members.join(labels.withColumnRenamed("node", "unit"), "unit", "left").withColumn("label", F.coalesce("label", "unit"))
    return named.select("unit", "n", "score", "label", F.explode("values").alias("value"))


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after links (a, b) have joined components."""
    now = links
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        now = now.join(named, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    joined = components(now.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    merged = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = joined.join(labels.select("node"), "node", "left_anti")
    return common.written(old.unionByName(fresh), "labels")


def classes(distinct: DataFrame, similarity: float = SIMILARITY, exact: bool = True) -> DataFrame:
    """unit, label for the units that are joined to others; distinct: unit, n, sketch, body, bucketed by unit."""
    members = memberships(distinct)
    alone = members.select("unit", "n", "score", F.col("unit").alias("label"), F.explode("values").alias("value"))
    central = F.max(F.struct("score", "unit", "n", "label")).alias("x")
    leaders = alone.groupBy("value").agg(central).select("value", "x.*")
    links = linked(candidates(alone, leaders, similarity), distinct, similarity)
    labels = components(links.select("a", "b"))

    here = with_labels(members, labels)
    heads = here.groupBy("value", "label").agg(F.max(F.struct("score", "unit", "n")).alias("x")).select("value", "label", "x.*")
    order = Window.partitionBy("value").orderBy(F.desc("score"), F.desc("unit"))
    # The first is the leader that all have been aligned with.
    more = heads.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= LEADERS).where("nth > 1").drop("nth")
    links = linked(candidates(here, more, similarity), distinct, similarity)
    if not links.isEmpty():
        labels = relabelled(labels, links)
    if not exact:
        return labels

    # Only buckets that hold several components can have pairs that are near and not yet joined.
    here = with_labels(members, labels)
    open_ = here.groupBy("value").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("value")
    rest = here.join(open_, "value", "left_semi").select("unit", "label").distinct()
    links = linked(near_pairs(kmers(distinct.join(rest, "unit")), similarity), distinct, similarity)
    return labels if links.isEmpty() else relabelled(labels, links)


def kmers(units: DataFrame) -> DataFrame:
    """unit, label, n, kmers (the labelled k-mers of the whole text) for units with their body, as a written table."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            values = (shingles(np.frombuffer(unpack(body), dtype=np.uint32)) for body in batch["body"])
            found = [np.unique(mixed(x + occurrences(x) * np.uint64(0xD1B54A32D192ED03))).view(np.int64) for x in values]
            yield batch[["unit", "label"]].assign(n=[len(x) for x in found], kmers=found)

    return common.written(units.select("unit", "label", "body").mapInPandas(make, "unit binary, label binary, n int, kmers array<long>"), "kmers", common.TEXT_ROWS)


def near_pairs(units: DataFrame, similarity: float) -> DataFrame:
    """a, b: every pair of units (of kmers()) with different labels that can have the similarity, and some that don't.

    Such a pair shares `similarity` of the larger one's k-mers. So the first k-mer that both hold, rarest first, is among the
    first n - similarity * n + 1 of each, and enough of them come after it. Units that share no rare k-mer never meet.
    """
    each = units.select("unit", "label", "n", F.explode("kmers").alias("kmer"))
    shared = each.groupBy("kmer").agg(F.count("*").alias("df")).where("df > 1")
    found = each.join(shared, "kmer").groupBy("unit", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "kmer"))).alias("held"))
    # K-mers of one unit alone are the rarest, and stand before the shared ones.
    own = F.col("n") - F.size("held")
    first = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1
    found = found.withColumn("own", own).where(first > own).select("unit", "label", "n", "own", F.posexplode(F.slice("held", F.lit(1), (first - own).cast("int"))).alias("at", "x"))
    found = common.written(found.select("unit", "label", "n", (F.col("own") + F.col("at")).alias("at"), F.col("x.kmer").alias("kmer")), "prefixes")
    parts = found.groupBy("kmer").agg(F.count("*").alias("m")).where("m > 1").select("kmer", F.ceil(F.col("m") / MET_TOGETHER).cast("int").alias("parts"))
    found = found.join(parts, "kmer")
    left = found.withColumn("part", F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int")).drop("parts")
    right = found.select("kmer", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}_b") for c in ("unit", "label", "n", "at")])
    both = left.join(right, ["kmer", "part"]).where((F.col("unit") < F.col("unit_b")) & (F.col("label") != F.col("label_b")))
    able = F.least("n", "n_b") >= similarity * F.greatest("n", "n_b") - 1e-9
    enough = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) >= similarity / (1 + similarity) * (F.col("n") + F.col("n_b")) - 1e-9
    return both.where(able & enough).select(F.col("unit").alias("a"), F.col("unit_b").alias("b")).distinct()


def grouped(docs: DataFrame, similarity: float = SIMILARITY, wordless: bool = False, exact: bool = True) -> DataFrame:
    """doc_id, mark (hash of the text), class_id, kept for each row of docs.

    class_id is the least doc_id of the row's class (null if it has none); kept marks one row of each class, that with
    the least doc_id (ties: the least hash of the text). Texts are compared whole, as lower-case words; long ones are
    only aligned in a band that widens with them. Texts with fewer than five words are one shingle. Null texts
    and those without words are copies of each other if `wordless`; else each is alone in its class, whose id is its
    doc_id. Repeated rows are copies, of which one is kept. Other columns are ignored; an empty table gives no row.
    Without `exact` only leaders are aligned, and links may be missed; see the head of this module.
    """
    units = sketched(docs)
    if wordless:
        units = units.withColumn("unit", F.coalesce("unit", F.lit(WORDLESS)))
    units = common.written(units, "units", common.TEXT_ROWS)
    distinct = units.where("sketch is not null").groupBy("unit").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "body")])
    distinct = common.bucketed(distinct, "distinct", "unit")
    labels = classes(distinct, similarity, exact).withColumnRenamed("node", "unit")
    common.removed(distinct)
    row = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"))
    # Copies of a text meet as one row from each task here, so that no key below has more rows than there are texts.
    least = units.where("unit is not null").groupBy("unit").agg(F.min(row).alias("least"))
    named = common.written(least.join(labels, "unit", "left").withColumn("label", F.coalesce("label", "unit")), "named")
    first = named.groupBy("label").agg(F.min(F.struct("least", "unit")).alias("first"))
    named = named.join(first, "label").select("unit", F.col("first.least.doc_id").alias("class_id"), F.when(F.col("first.unit") == F.col("unit"), F.col("first.least.mark")).alias("lead"))
    rows = units.groupBy("unit", "doc_id", "mark").agg(F.count("*").alias("copies"))
    out = rows.join(named, "unit", "left").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    lead = F.col("unit").isNull() | (F.col("mark").eqNullSafe(F.col("lead")) & F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("nth") == 1))
    return out.select("doc_id", "mark", F.when(F.col("unit").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), lead.alias("kept"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, wordless: bool = False) -> DataFrame:
    """The rows of docs without near copies: one of each class, that with the least doc_id; columns as in docs.

    Rows equal in doc_id and text count as one, also where the text is null or has no words. With `wordless`, one of all
    rows without words stays.
    """
    key, own = common.fresh(docs, "key"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"))
    kept = grouped(docs, similarity, wordless).where("kept").select(F.struct("doc_id", "mark").alias(key))
    return docs.withColumn(key, own).dropDuplicates([key]).join(kept, key, "left_semi").drop(key)
