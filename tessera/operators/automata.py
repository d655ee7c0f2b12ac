"""Many terms at once: restoration, replacement and highlighting by tables of thousands of terms.

A table belongs to a key, such as a session. Where all tables are small, each is made into an automaton once for all texts
of its key that a task sees. Tables and texts are dealt out together by key; a key with many texts is dealt to several
places, each of which gets its table. Texts stream past their automaton, so that a task holds one table and a batch of texts
at a time.

Where a table has more than HELD rows, no task gets a whole one: a filter of hashes, in which every term leaves two bits,
finds the parts of a text that may be terms; these meet the table in a join, and each text gets the rows of its own terms.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import cached_property
from html import escape

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from tessera.sources import tables

#: Texts of a key that go to one place.
TEXTS = 20_000
#: Rows of a table that go to a place whole.
HELD = 20_000


#: Words that are sought one after another, since an automaton takes longer to make.
FEW = 8
#: The same of aliases, where a text is short: their number times its length at most.
SHORT = 1 << 14


class Few:
    """What an automaton of a few words finds."""

    def __init__(self, words: list[str]):
        self.words = words

    def iter(self, text: str) -> Iterator[tuple[int, int]]:
        for k, word in enumerate(self.words):
            at = text.find(word)
            while at >= 0:
                yield at + len(word) - 1, k
                at = text.find(word, at + 1)


def automaton(words: list[str]):
    if len(words) <= FEW:
        return Few(words)
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, word in enumerate(words):
        out.add_word(word, k)
    out.make_automaton()
    return out


class Restorer:
    """Replaces aliases by originals, longer aliases first and then in table order, each in all of the text that the ones
    before have left: an original that holds a later alias, or makes one with what is around it, is replaced in turn.

    The automaton finds which aliases occur. Nothing can change further from an occurrence than the longest alias reaches,
    so that occurrences close to one another are worked on by themselves, and the rest of the text is copied.

    Where rows are not the whole table, `reach` is the length of its longest alias, and `around` collects all parts of texts
    in which replacements may have made further aliases.
    """

    def __init__(self, rows: list[dict], reach: int = 0, around: list[str] | None = None):
        pairs: dict[str, str] = {}
        for r in rows:  # of equal aliases the last original, in the place of the first
            if r["alias"] and r["original"] is not None:
                pairs[r["alias"]] = r["original"]
        self.pairs = sorted(pairs.items(), key=lambda p: -len(p[0]))
        self.reach = max([reach, *map(len, pairs)])
        self.around = around

    @cached_property
    def found(self):
        return automaton([alias for alias, _ in self.pairs])

    def __call__(self, text: str) -> str:
        if len(self.pairs) <= FEW or len(self.pairs) * len(text) <= SHORT:
            return self.in_turn(text)
        spans = sorted((end - len(self.pairs[k][0]) + 1, end + 1) for end, k in self.found.iter(text))
        out, at, margin, n = [], 0, 4 * self.reach, len(text)
        clusters: list[list[int]] = []
        for start, end in spans:
            if clusters and start - margin <= clusters[-1][1]:
                clusters[-1][1] = max(clusters[-1][1], end + margin)
            else:
                clusters.append([start - margin, end + margin])
        for low, high in clusters:
            low, high = max(low, at), min(high, n)
            piece, left, right = self.whole(text[low:high])
            if low and left < self.reach or high < n and right < self.reach:
                return self.whole(text)[0]  # changes have come near the border
            out += [text[at:low], piece]
            at = high
        return "".join(out) + text[at:]

    def whole(self, text: str) -> tuple[str, int, int]:
        """The text restored, and how much at its start and its end no replacement has touched."""
        left = right = len(text)
        todo = sorted({k for _, k in self.found.iter(text)})
        seen = set(todo)
        while todo:
            k = heapq.heappop(todo)
            alias, original = self.pairs[k]
            parts = text.split(alias)
            if len(parts) == 1:
                continue
            left, right = min(left, len(parts[0])), min(right, len(parts[-1]))
            text = original.join(parts)
            for piece in self.changed(text, parts, original):
                for _, j in self.found.iter(piece):
                    if j > k and j not in seen:
                        seen.add(j)
                        heapq.heappush(todo, j)
        return text, left, right

    def in_turn(self, text: str) -> str:
        """The text restored by seeking each pair."""
        for alias, original in self.pairs:
            if alias in text:
                parts = text.split(alias)
                text = original.join(parts)
                if self.around is not None:
                    for _ in self.changed(text, parts, original):
                        pass
        return text

    def changed(self, text: str, parts: list[str], original: str) -> Iterator[str]:
        """What is around each original that was put between parts: what has come into being is there."""
        at, end = 0, -1
        for part in parts[:-1]:
            at += len(part)
            low, high = max(at - self.reach, end - self.reach, 0), at + len(original) + self.reach
            if self.around is not None:
                self.around.append(text[low:high])
            yield text[low:high]
            at += len(original)
            end = high


def folded(text: str) -> str:
    """The text with each character as its capital, where that is one character; ASCII and other letters stay apart."""
    if text.isascii():
        return text.upper()
    one = lambda c: c if len(u := c.upper()) != 1 or not c.isascii() and u.isascii() else u
    return "".join(map(one, text))


class Terms:
    """Leftmost occurrences of terms in any case, the longest first; of terms equal but for case the last row counts."""

    def __init__(self, rows: list[dict], wrap: Callable[[str, dict], str]):
        self.rows, self.wrap = {r["text"].lower(): r for r in rows}, wrap
        self.words = list(dict.fromkeys(folded(r["text"]) for r in rows))
        self.found = automaton(self.words) if self.words else None

    def __call__(self, text: str) -> str:
        if self.found is None:
            return text
        best: dict[int, int] = {}
        for end, k in self.found.iter(folded(text)):
            start = end + 1 - len(self.words[k])
            best[start] = max(best.get(start, 0), end + 1)
        out, at = [], 0
        for start in sorted(best):
            if start >= at:
                match = text[start : best[start]]
                row = self.rows.get(match.lower())
                out += [text[at:start], match if row is None else self.wrap(match, row)]
                at = best[start]
        return "".join(out) + text[at:]


def replacer(rows: list[dict]) -> Terms:
    """Rows whose alias is missing or is their text are no terms."""
    return Terms([r for r in rows if r["text"] and r["alias"] is not None and r["alias"] != r["text"]], lambda match, row: row["alias"])


def highlighter(rows: list[dict]) -> Terms:
    """Occurrences as <mark>, with a class for the type of their entity, unknown if there is none."""

    def mark(match: str, row: dict) -> str:
        kind = escape(row["type"] or "unknown")
        return f'<mark class="entity entity-{kind}" title="Type: {kind}">{match}</mark>'

    return Terms([r for r in rows if r["text"]], mark)


def dealt(docs: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """docs and table with `__place`, one of as many for each key as its texts need; table rows once for each place."""
    counts = docs.groupBy(key).agg(F.count("*").alias("__n"))
    places = counts.select(key, F.ceil(F.col("__n") / TEXTS).cast("int").alias("__places")).where("__places > 1")
    spread = lambda *of: F.pmod(F.xxhash64(*of), F.coalesce("__places", F.lit(1))).cast("int")
    # Texts without a key have no table and lie anywhere.
    own = F.when(F.col(key).isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 20)).cast("int")).otherwise(spread("text"))
    rows = docs.join(F.broadcast(places) if small(places) else places, key, "left").withColumn("__place", own).drop("__places")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__places", F.lit(1)) - 1)).alias("__place")
    return rows, table.where(F.col(key).isNotNull()).join(places, key, "left").select(*table.columns, copies)


#: Keys with more texts than TEXTS that are broadcast at most.
HOT_KEYS = 10_000


def small(places: DataFrame) -> bool:
    return places.limit(HOT_KEYS + 1).count() <= HOT_KEYS


def by_table(docs: DataFrame, table: DataFrame, key: str, order: list[str], term: str, make: Callable[[list[dict]], Callable[[str], str]], name: str) -> DataFrame:
    """docs with `name`: what the function that make() gives for a key's rows (the columns order, ordered by them) gives for
    the text. `term` is the column that is looked for in texts.

    Null texts stay null; a text whose key has no rows stays as it is. Column names that begin with two underscores are
    taken.
    """
    large = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HELD)
    rows = table.select(key, F.struct(*order).alias("__row"))
    return by_whole_table(docs, rows, key, make, name) if large.isEmpty() else by_found_terms(docs, rows, key, term, make, name)


def by_whole_table(docs: DataFrame, table: DataFrame, key: str, make: Callable[[list[dict]], Callable[[str], str]], name: str) -> DataFrame:
    """by_table() of tables (key, __row), each of which goes whole to the places of its key."""
    import pyarrow as pa

    rows, terms = dealt(docs, table, key)
    both = terms.withColumn("__kind", F.lit(0)).unionByName(rows.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(key, "__place").sortWithinPartitions(key, "__place", "__kind", "__row")
    schema = types.StructType([*docs.schema.fields, types.StructField(name, types.StringType())])
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, use = None, [], None
        for batch in batches:
            at = {c: batch.column(c).to_pylist() for c in (key, "__place", "__kind", "__row")}
            kinds, texts, out = at["__kind"], batch.column("text").to_pylist(), []
            for k, kind in enumerate(kinds):
                place = (at[key][k], at["__place"][k])
                if place != here:
                    here, held, use = place, [], None
                if kind == 0:
                    held.append(at["__row"][k])
                    continue
                if held and use is None:
                    use = make(held)
                out.append(texts[k] if texts[k] is None or use is None else use(texts[k]))
            if out:
                docs_only = batch.filter(pa.array([kind == 1 for kind in kinds]))
                arrays = [docs_only.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(out, pa.string())], names=[*columns, name])

    return both.mapInArrow(run, schema)


# Large tables ---------------------------------------------------------------------------------------------------------

#: Bits of the filter for each term, and at most in all: beyond, more of what is asked is no term, and nothing else changes.
BITS, MOST_BITS = 32, 1 << 28
#: Characters of texts that are hashed together.
HASHED = 1 << 19
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Hashes:
    """Hashes of any parts of some texts, from sums over their characters. The texts follow one another from `starts` on."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        power = lambda base: np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(len(codes), base, dtype=np.uint64))), dtype=np.uint64)
        sums = np.cumsum((codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * power(BASE)[:-1], dtype=np.uint64)
        self.sums, self.inverse = np.concatenate((np.zeros(1, dtype=np.uint64), sums)), power(INVERSE)

    def __call__(self, at: np.ndarray, length: np.ndarray | int, salt: np.ndarray | int = 0) -> np.ndarray:
        x = (self.sums[at + length] - self.sums[at]) * self.inverse[at]
        x += np.asarray(length).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.asarray(salt).astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
        return x ^ (x >> np.uint64(29))


def half(length: np.ndarray) -> np.ndarray:
    """The greatest power of two that isn't greater: so much of a term's beginning is looked for first, for any key."""
    return np.left_shift(1, np.floor(np.log2(length)).astype(np.int64))


def bits_of(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """The two bits that a hash has in a filter of `size` bits, a power of two."""
    return [(hashes & np.uint64(size - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)]


class Filter:
    """Which parts of texts may be terms of their keys; all that are terms are among them."""

    def __init__(self, bits: np.ndarray, size: int, lengths: list[int]):
        self.bits, self.size, self.lengths = bits, size, np.array(sorted(lengths), dtype=np.int64)
        self.most = int(self.lengths[-1])

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        first, second = bits_of(hashes, self.size)
        held = np.flatnonzero(self.bits[first >> 3] >> (first & 7) & 1)
        out = np.zeros(len(hashes), dtype=bool)
        second = second[held]
        out[held] = self.bits[second >> 3] >> (second & 7) & 1
        return out

    def found(self, texts: list[str], salts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(number of the text, start, end) of parts that may be terms."""
        cut = [(k, at, t[at : at + HASHED + self.most]) for k, t in enumerate(texts) for at in range(0, max(len(t), 1), HASHED)]
        here, size = [], 0
        for piece in cut:
            here.append(piece)
            size += len(piece[2])
            if size >= HASHED:
                yield from self.within(here, salts)
                here, size = [], 0
        if here:
            yield from self.within(here, salts)

    def within(self, pieces: list[tuple[int, int, str]], salts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        hashes = Hashes([t for _, _, t in pieces])
        starts, total = hashes.starts, int(hashes.starts[-1])
        nth = np.repeat(np.arange(len(pieces)), np.diff(starts))
        own = salts[[k for k, _, _ in pieces]]
        ends = starts[1:]
        halves = half(self.lengths)
        for first in np.unique(halves):
            at = np.arange(total - first + 1) if total >= first else np.zeros(0, dtype=np.int64)
            at = at[self.holds(hashes(at, int(first)))]
            at = at[at < total]
            for length in self.lengths[halves == first]:
                inside = at[at + length <= ends[nth[at]]]
                inside = inside[self.holds(hashes(inside, int(length), own[nth[inside]]))]
                for p, n in zip(inside.tolist(), nth[inside].tolist()):
                    k, from_, _ = pieces[n]
                    start = from_ + p - int(starts[n])
                    yield k, start, start + int(length)


def salted(key: str) -> Column:
    return (F.xxhash64(key).bitwiseOR(F.lit(1))).alias("__salt")


def filter_of(terms: DataFrame) -> Filter | None:
    """The filter of terms (__salt, __seen: as they are looked for). It is gathered as words of 64 bits."""
    size = terms.agg(F.count("*")).first()[0]
    if not size:
        return None
    size = min(1 << (BITS * size - 1).bit_length(), MOST_BITS)

    def bits(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            hashes = Hashes(batch["__seen"].tolist())
            at, length = hashes.starts[:-1], np.diff(hashes.starts)
            of = [hashes(at, half(length)), hashes(at, length, batch["__salt"].to_numpy())]
            found = np.unique(np.concatenate([b for x in of for b in bits_of(x, size)]))
            words, first = np.unique(found >> 6, return_index=True)
            values = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (found & 63).astype(np.uint64)), first)
            yield pd.DataFrame({"word": words, "bits": values.view(np.int64)})

    rows = terms.select("__salt", "__seen").mapInPandas(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64 if size >= 64 else 1, dtype=np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    lengths = [r["n"] for r in terms.select(F.length("__seen").alias("n")).distinct().collect()]
    return Filter(out.view(np.uint8), size, lengths)


def joined_as(term: str) -> str:
    """What terms that may stand for one another have in common: equal in lower case, or by folded()."""
    return folded(term.lower())


def by_found_terms(docs: DataFrame, table: DataFrame, key: str, term: str, make: Callable[[list[dict]], Callable[[str], str]], name: str) -> DataFrame:
    """by_table() of tables (key, __row) of any size. A text gets the rows of the terms that occur in it. Where restoration
    makes further terms, it is done anew with these, for the texts that have them, round by round."""
    import pyarrow as pa

    restores = make is Restorer
    seen, same = (str, str) if restores else (folded, joined_as)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("__term").to_pylist()
            more = [pa.array(list(map(f, words)), pa.string()) for f in (seen, same)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__seen", "__same"])

    terms = table.where(F.col(key).isNotNull()).select(key, salted(key), "__row", F.col("__row")[term].alias("__term")).where(F.length("__term") > 0)
    terms = terms.mapInArrow(named, types.StructType([*terms.schema.fields, types.StructField("__seen", types.StringType()), types.StructField("__same", types.StringType())]))
    terms = tables.written(terms, "terms")
    bits = filter_of(terms)
    if bits is None:
        return docs.withColumn(name, F.col("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    terms = terms.select(key, "__same", "__row")
    columns = docs.columns
    added = types.StructField(name, types.StringType())
    # Texts are numbered, so that what they ask for doesn't take more than its number along.
    docs = tables.written(docs.withColumn("__id", F.monotonically_increasing_id()), "texts")

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of texts that may be terms."""
        for batch in batches:
            texts, wanted = batch.column("text").to_pylist(), {}
            for k, start, end in shared.value.found(list(map(seen, texts)), batch.column("__salt").to_numpy()):
                wanted[k, same(texts[k][start:end])] = None
            at = pa.array([k for k, _ in wanted], pa.int64())
            schema = pa.schema([batch.schema.field(key), batch.schema.field("__id"), ("__same", pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(at), batch.column("__id").take(at), pa.array([part for _, part in wanted], pa.string())], schema=schema)

    def answered(asked: DataFrame) -> DataFrame:
        return asked.join(terms, [key, "__same"]).groupBy("__id").agg(F.collect_set("__row").alias("__rows"))

    asking = tables.spread(docs).where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, salted(key), "__id", "text")
    known = answered(asking.mapInArrow(asks, types.StructType([docs.schema[key], docs.schema["__id"], types.StructField("__same", types.StringType())])))
    rows = docs.join(known, "__id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of = batch.column("text").to_pylist(), rows_of(batch.column("__rows"))
            out = [make(sorted_rows(rows))(text) if rows else text for text, rows in zip(texts, of)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(out, pa.string())], names=[*columns, name])

    if not restores:
        return rows.select(*columns, "__rows").mapInArrow(run, types.StructType([*docs.schema.fields[:-1], added]))

    def restore_and_ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts restored by the rows they have, and the parts that may be further aliases where replacements came about."""
        for batch in batches:
            texts, rows = batch.column("text").to_pylist(), rows_of(batch.column("__rows"))
            out, of, parts = [], [], []
            for k, (text, own) in enumerate(zip(texts, rows)):
                around: list[str] = []
                out.append(Restorer(sorted_rows(own), shared.value.most, around)(text) if own else text)
                of += [k] * len(around)
                parts += around
            wanted: list[dict] = [{} for _ in texts]
            for k, start, end in shared.value.found(parts, batch.column("__salt").to_numpy()[of]) if parts else ():
                wanted[of[k]][parts[k][start:end]] = None
            wanted = [[part for part in w if all(part != r["alias"] for r in own)] if w else [] for w, own in zip(wanted, rows)]
            arrays = [*[batch.column(c) for c in (*columns, "__id", "__rows")], pa.array(out, pa.string()), pa.array(wanted, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "__id", "__rows", name, "__wanted"])

    done = None
    while True:
        given = rows.select(*columns, "__id", "__rows", salted(key))
        schema = types.StructType([*given.schema.fields[:-1], added, types.StructField("__wanted", types.ArrayType(types.StringType()))])
        out = given.mapInArrow(restore_and_ask, schema)
        # Only texts that ask for more are held against the table again.
        out = tables.written(out.withColumn("__rows", F.when(F.size("__wanted") > 0, F.col("__rows"))), "restored")
        more = tables.written(answered(out.select(key, "__id", F.explode("__wanted").alias("__same"))), "occurring")
        last = more.isEmpty()
        settled = (out if last else out.join(more, "__id", "left_anti")).select(*columns, name)
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        again = more.withColumnRenamed("__rows", "__more")
        rows = out.join(again, "__id").select(*columns, "__id", F.concat("__rows", "__more").alias("__rows"))


def rows_of(column) -> list[list[dict]]:
    """An Arrow array of lists of structs as Python values, empty lists for null. to_pylist() takes several times as long."""
    import pyarrow.compute as pc

    flat = column.flatten()
    names = [f.name for f in flat.type]
    rows = [dict(zip(names, values)) for values in zip(*[x.to_pylist() for x in flat.flatten()])]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [rows[a:b] for a, b in zip([0, *ends], ends)]


def sorted_rows(rows: list[dict]) -> list[dict]:
    """Rows by their columns in turn, nulls first, as Spark orders structs."""
    try:
        return sorted(rows, key=lambda r: tuple(r.values()))
    except TypeError:  # a null beside another value
        pass
    return sorted(rows, key=lambda r: [(v is not None, v.encode() if isinstance(v, str) else v) if v is not None else (False,) for v in r.values()])


def restore(docs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """docs with `restored`; table: key, original, alias, ord (the row's place in its table)."""
    return by_table(docs, table, key, ["ord", "original", "alias"], "alias", Restorer, "restored")


def replace(docs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """docs with `replaced`; table: key, text, alias, ord."""
    return by_table(docs, table, key, ["ord", "text", "alias"], "text", replacer, "replaced")


def highlight(docs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """docs with `marked`; table: key, text, type, ord."""
    return by_table(docs, table, key, ["ord", "text", "type"], "text", highlighter, "marked")
