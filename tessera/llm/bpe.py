"""Byte-level BPE by a global shuffle of distinct words.

encode() splits every text into the matches of the pattern and keeps, for blocks of documents, each distinct word once
with its number in the block; the texts themselves become arrays of those numbers, in order of position. All blocks'
words are shuffled by a hash of the word, each distinct word is encoded once, its ids go back to the blocks that hold it,
and every document is put together by position. A frequent word thus travels once for each block and not once for each
use; the words of a block that go to one place travel together, compressed.
decode() looks ids up by position in the table of the tokens' bytes, which goes along with the plan: its size is that of
the vocabulary.

The blocks are made twice, once for their words and once for their texts, from the same scan, which must give its rows in
the same order again, as files do; a block compares digests of its words with those of the words that it gets back, so
that a scan in another order fails the query and can't give wrong ids.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters after which a block ends; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000
BLOCK_DOCS = 10_000
#: Places that words are dealt to, for each shuffle partition, and words that an encoder remembers at most.
PLACES = 2
KNOWN_WORDS = 200_000


def ranks(path: str) -> dict[bytes, int]:
    """The rank file's bytes and ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Characters that are neither letters, digits nor white space.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Split(dict):
    """What follows a space, with that space, to its matches of public_tokenizers.PATTERN.

    Letters, and letters with signs after them, split without the pattern. The rest is remembered; everything is
    forgotten when full, which changes no result.
    """

    def __init__(self, split):
        self.split = split

    def __missing__(self, text: str) -> list[str]:
        letters = text.rstrip(SIGNS)
        if letters.isalpha():
            return [" " + letters, text[len(letters) :]] if len(letters) < len(text) else [" " + letters]
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[text] = self.split(" " + text)
        return found


class Parts(dict):
    """What follows a space to its words' numbers in a block, as little-endian bytes."""

    def __init__(self, known: Split):
        self.known, self.words = known, {}

    def numbers(self, found: list[str]) -> bytes:
        words = self.words
        return b"".join([words.setdefault(w, len(words)).to_bytes(4, "little") for w in found])

    def __missing__(self, text: str) -> bytes:
        got = self[text] = self.numbers(self.known[text])
        return got


class Block:
    """Documents and their words, numbered in the order in which they first come."""

    def __init__(self, known: Split):
        self.parts = Parts(known)
        self.words = self.parts.words
        self.docs, self.codes, self.chars = [], [], 0

    def add(self, doc_id, text: str, plain: bool) -> None:
        if plain:
            first, *rest = text.split(" ")
            codes = self.parts.numbers(self.parts.known.split(first)) + b"".join(map(self.parts.__getitem__, rest))
        else:
            codes = self.parts.numbers(self.parts.known.split(text))
        self.docs.append(doc_id)
        self.codes.append(codes)
        self.chars += len(text)

    def done(self) -> "Block":
        return self


class Words:
    """The words of a block alone."""

    def __init__(self, known: Split):
        self.known, self.parts, self.words = known, set(), set()
        self.docs, self.chars = [], 0

    def add(self, doc_id, text: str, plain: bool) -> None:
        if plain:
            first, *rest = text.split(" ")
            self.parts.update(rest)
            self.words.update(self.known.split(first))
        else:
            self.words.update(self.known.split(text))
        self.docs.append(doc_id)
        self.chars += len(text)

    def done(self) -> "Words":
        for part in self.parts:
            self.words.update(self.known[part])
        return self


def blocks(batches: Iterator[pd.DataFrame], pattern: str, kind: type = Block) -> Iterator:
    """Blocks of whole documents, read from doc_id and text: as `kind` has them, the same documents for every kind."""
    import re

    import regex

    known, runs = Split(regex.compile(pattern).findall), re.compile(r"[ \n](?:[ \n]|\Z)|\A[ \n]").search
    unusual = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
    block = kind(known)
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
            block.add(doc_id, text, not (runs(text) or any(c in text for c in unusual)))
            if block.chars >= BLOCK_CHARS or len(block.docs) >= BLOCK_DOCS:
                yield block.done()
                block = kind(known)
    if block.docs:
        yield block.done()


def numbered(found: Iterator) -> Iterator[tuple[int, object]]:
    """Blocks with ids that no other partition gives."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k, block in enumerate(found):
        yield (part << 32) + k, block


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes dealt out by significance, compressed."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def restored(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def dealt(words, places: int) -> list[tuple[int, list[str]]]:
    """(place, its words, sorted), by place; the place follows from the word alone."""
    import zlib

    parts: dict[int, list[str]] = {}
    for word in words:
        parts.setdefault(zlib.crc32(word.encode()) % places, []).append(word)
    return [(place, sorted(parts[place])) for place in sorted(parts)]


def told(words: list[str]) -> int:
    """A digest of words in order, as a signed 64-bit number."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest("\0".join(words).encode("utf-8", "surrogatepass"))).view(np.int64))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) for each row of docs.

    Between two characters that aren't white space, a space must start a match of `pattern`, as it does in
    public_tokenizers.PATTERN. Null texts count as empty and give no ids. Rows are kept one by one: repeated rows and doc_ids, null doc_ids too.
    An empty table gives no row; columns besides doc_id and text are ignored. Every match of `pattern` is encoded
    separately and special tokens are ordinary text.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(ranks(ranks_path))  # one row for each id of the vocabulary
    places = PLACES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for k, block in numbered(blocks(batches, pattern, Words)):
            parts = dealt(block.words, places)
            sizes = [squeezed(np.fromiter(map(len, words), dtype="<u4", count=len(words))) for _, words in parts]
            yield pd.DataFrame({"place": [p for p, _ in parts], "block": k, "told": [told(words) for _, words in parts], "sizes": sizes, "words": [pack("".join(words).encode()) for _, words in parts]})

    def texts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, block in numbered(blocks(batches, pattern)):
            parts = dealt(block.words, places)
            order = np.fromiter((block.words[w] for _, words in parts for w in words), dtype="<u4", count=len(block.words))
            sizes = np.array([len(c) // 4 for c in block.codes], dtype="int32")
            ids = np.array([None if pd.isna(x) else x for x in block.docs], dtype=object)
            yield pd.DataFrame({"block": [k], "told": [np.array([told(words) for _, words in parts], dtype=np.int64)], "doc_ids": [ids], "sizes": [sizes], "order": [squeezed(order)], "codes": [squeezed(np.frombuffer(b"".join(block.codes), dtype="<u4"))]})

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        library = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=table.value, special_tokens={})
        known, here = {}, None
        for batch in batches:
            out = []
            for place, sizes, words in zip(batch["place"], batch["sizes"], batch["words"]):
                if place != here or len(known) > KNOWN_WORDS:  # a word has one place
                    known, here = {}, place
                text, at, found = unpack(words).decode(), 0, []
                for size in restored(sizes).tolist():
                    word = text[at : at + size]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = library.encode_ordinary(word)
                    found.append(ids)
                    at += size
                flat = np.fromiter((x for ids in found for x in ids), dtype="<u4")
                out.append((squeezed(np.fromiter(map(len, found), dtype="<u4", count=len(found))), squeezed(flat)))
            yield pd.DataFrame({"block": batch["block"], "place": batch["place"], "told": batch["told"], "sizes": [a for a, _ in out], "ids": [b for _, b in out]})

    def assembled(key, words: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("place")
        (text,) = texts.itertuples()
        order, codes = restored(text.order), restored(text.codes)
        got = np.concatenate([restored(x) for x in words["sizes"]] or [np.zeros(0, dtype="<u4")]).astype(np.int64)
        if len(got) != len(order) or words["told"].tolist() != list(text.told):
            raise RuntimeError(f"block {key[0]} got other words than it has: its rows came in another order")
        flat = np.concatenate([restored(x) for x in words["ids"]] or [np.zeros(0, dtype="<u4")]).astype(np.int32)
        sizes, starts = np.empty_like(got), np.empty_like(got)
        sizes[order], starts[order] = got, np.cumsum(got) - got
        ends, rows, at = np.cumsum(text.sizes), [], 0
        for end in ends.tolist():
            own = codes[at:end]
            n = sizes[own]
            rows.append(flat[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            at = end
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in text.doc_ids], dtype="Int64"), "ids": rows})

    words = docs.mapInPandas(words_of, "place int, block long, told long, sizes binary, words binary")
    words = words.repartition("place").sortWithinPartitions("place").mapInPandas(encoded, "block long, place int, told long, sizes binary, ids binary")
    texts = docs.mapInPandas(texts_of, "block long, told array<long>, doc_ids array<long>, sizes array<int>, order binary, codes binary")
    return words.groupBy("block").cogroup(texts.groupBy("block")).applyInPandas(assembled, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with `bytes`, the bytes of each row's ids; an id without bytes in the table fails the query.

    The table, a row for each id of the vocabulary, goes along with the plan and is looked up by position.
    """
    found = {k: b.hex() for b, k in ranks(ranks_path).items()}
    table = F.from_json(F.lit(json.dumps([found.get(k) for k in range(max(found) + 1)])), "array<string>")
    missing = lambda k: F.raise_error(F.concat(F.lit("no bytes for id "), k.cast("string"))).cast("string")
    signs = F.transform("ids", lambda k: F.coalesce(F.get(table, k), missing(k)))
    return encoded.withColumn("bytes", F.unhex(F.array_join(signs, "")))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the bytes that they decode to."""
    both = decode(encode(docs, ranks_path, pattern), ranks_path)
    out = both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
    return common.written(out, "round-trip", common.TEXT_ROWS)
