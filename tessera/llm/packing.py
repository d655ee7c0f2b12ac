"""Best-fit packing by minimum bin slack.

Pieces of at most `capacity` tokens are packed into as few sequences as the method finds. What fits together
depends on lengths alone, so the plan is made from the histogram of lengths (at most `capacity` rows, whatever the
input): for each bin a bitset subset-sum dynamic programme over the lengths still available finds the fullest
combination that holds the longest of them; that combination is removed as often as the counts allow. The pieces are
then numbered within their length, in salted parts, and each looks up the sequence that its number falls into.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Parts in which the pieces of one length are numbered, for each million pieces of that length.
SALTS_PER_MILLION = 8
CACHED_WORDS = 400_000


class WordCache(dict):
    """Words, each with `lead` before it, to their ids as little-endian bytes; forgets everything when full, which changes no result."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(self.lead + word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids
        return ids


def ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary, in which a printable character stands for each byte, as bytes to ids."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
    return {bytes(map(byte.__getitem__, word)): k for word, k in vocabulary.items() if all(c in byte for c in word)}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """text -> ids as bytes of little-endian unsigned 32-bit integers, equal to the tokenizers library's.

    A worker makes it once: the tasks that it runs one after another find the words of those before remembered.

    Between two characters that aren't white space, a single space always starts a new word of this vocabulary's
    pattern, and a single line feed is a word of its own. So what stands between them is encoded apart, by tiktoken
    with the same vocabulary, and remembered. Texts with special tokens or with white space in runs go to the library.
    """
    import os
    import re

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    specials = [t.content for t in library.get_added_tokens_decoder().values()]
    unusual = specials + [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
    plain = ranks({w: k for w, k in library.get_vocab(with_added_tokens=False).items() if w not in specials})
    quick = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={})

    def encode(text: str) -> bytes:
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(text: str) -> bytes:
        return np.array(quick.encode_ordinary(text), dtype="<u4").tobytes()

    feed, bare, runs = word("\n"), WordCache(word, ""), re.compile(r"[ \n](?:[ \n]|\Z)|\A[ \n]").search

    def lines(text: str) -> bytes:
        return feed.join(map(bare.__getitem__, text.split("\n")))

    class Words(WordCache):
        def __missing__(self, text: str) -> bytes:
            head, feed_at, rest = text.partition("\n")
            return self[head] + feed + lines(rest) if feed_at else super().__missing__(text)

    led = Words(word, " ")

    def fast(text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in unusual) or runs(text):
            return encode(text)
        first, *rest = text.split(" ")
        return lines(first) + b"".join(map(led.__getitem__, rest))

    return fast


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokens of each document with end_id after them, cut into pieces of `capacity`, the first of which may be shorter.

    A null text counts as empty, so that its only token is end_id. Columns: those of PIECES; with_ids adds ids (array of int).
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = tokenizer(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                ids = encode(text) + end
                n = len(ids) // 4
                head = n % capacity or capacity
                for k, at in enumerate(range(head - capacity, n, capacity)):
                    part = ids[4 * max(at, 0) : 4 * (at + capacity)]
                    row = (doc_id, k, max(at, 0), len(part) // 4, zlib.crc32(part))
                    rows.append(row + (np.frombuffer(part, dtype="<u4").astype("int32"),) if with_ids else row)
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text")).mapInPandas(cut, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest available length and the combination of others that leaves the least slack beside it."""
    first = max(counts)
    room, reach, steps = capacity - first, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, times = counts[length] - (length == first), 1
        left = min(left, room // length)
        while left > 0:  # copies in powers of two
            take = min(times, left)
            grown = (reach | reach << take * length) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left, times = left - take, times * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {first: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, length -> copies in each of them), until no piece is left."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        chosen = fullest(counts, capacity)
        times = min(counts[k] // n for k, n in chosen.items())
        out.append((times, chosen))
        for k, n in chosen.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return out


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """length -> rows (first number of the length, copies in a sequence, first sequence, offset), ordered."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for times, chosen in patterns:
        offset = 0
        for length in sorted(chosen, reverse=True):
            copies = chosen[length]
            rows.setdefault(length, []).append((used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def numbered(cut: DataFrame) -> DataFrame:
    """cut with `number`, from 0 without gaps within each length. Lengths with many pieces are numbered in parts."""
    by = cut.groupBy("length").agg(F.count("*").alias("n"))
    salts = F.broadcast(by.select("length", F.ceil(F.col("n") * F.lit(SALTS_PER_MILLION / 1e6)).cast("int").alias("salts")))
    cut = cut.join(salts, "length").withColumn("salt", F.expr("cast(pmod(xxhash64(doc_id, piece), salts) as int)")).drop("salts")
    parts = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return cut.withColumn("within", F.row_number().over(inside) - 1).join(parts, ["length", "salt"]).withColumn("number", F.col("before") + F.col("within")).drop("salt", "within", "before")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and give one token, end_id. Repeated rows and doc_ids are packed one by one, an empty
    table gives no row, other columns are ignored. The histogram of lengths, at most `capacity` rows, is all that
    reaches the driver.
    """
    spark = docs.sparkSession
    cut = common.written(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            lengths, numbers = batch["length"].to_numpy(), batch["number"].to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                rows = table.value[int(length)]
                row = rows[np.searchsorted(rows[:, 0], numbers[at], side="right") - 1]
                nth = numbers[at] - row[:, 0]
                sequence[at] = row[:, 2] + nth // row[:, 1]
                offset[at] = row[:, 3] + nth % row[:, 1] * length
            yield batch.drop(columns="number").assign(sequence_id=sequence, offset=offset)

    columns = [c.split()[0] for c in PIECES.split(", ")]
    return numbered(cut).select(*columns, "number").mapInPandas(place, PIECES + ", sequence_id long, offset long")
