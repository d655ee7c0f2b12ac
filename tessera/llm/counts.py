"""Token counts of whole texts, long ones in overlapping chunks that are spliced where they agree.

A tokenizer splits a text into words from left to right, and where a word begins depends on nothing before it. So two
encodings, one of them true, that both have a word begin at a place agree on all that follows, up to what their right
ends cut off. A long text is cut at every CHUNK characters, and each cut, a seam, is looked at by itself: the chunk before
it is encoded on into the overlap, the chunk after it from the seam on, and the first place in the overlap where a word
begins in both, GUARD characters from the end at least, is their splice. By induction over the chunks everything is true
from there on, and a text's count is the sum over its seams of the tokens before the splice as the left chunk has them
less those as the right one has them; the last seam is the text's end.

A seam without such a place is encoded again with a wider overlap, up to a whole chunk. Chunks still not aligned then,
such as those inside one endless word, are dissolved into the chunk before, and its next seam is encoded anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, packing

#: Characters of a chunk; texts of up to LONG chunks are encoded in one piece.
CHUNK, LONG = 32_768, 2
#: Overlaps in characters, tried in turn; none is longer than a chunk, so that the splices of a text are in order.
OVERLAPS = (512, 4_096, CHUNK)
#: Characters before a cut that could have been split otherwise with what the cut has taken: more than a contraction, white
#: space before a word, or the special tokens have, which must be shorter.
GUARD = 64
LIMIT = 512
SEAM = "key string, k int, next int, splice long, before_left long, before_right long"


def library(path: str):
    """The tokenizers library's tokenizer, for use inside of a task. Short texts take the quicker way of packing.tokenizer()."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    if any(len(t.content) >= GUARD for t in out.get_added_tokens_decoder().values()):
        raise ValueError(f"special tokens must be shorter than {GUARD} characters")
    return out


def borders(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where words of the text begin, and its end; and how many tokens come before each."""
    if not text:
        return np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    found = tokenizer.encode(text, add_special_tokens=False)
    words = np.array(found.word_ids, dtype=np.int64)
    first = np.flatnonzero(np.diff(words, prepend=-1))
    offsets = found.offsets  # a new list at every use
    starts = np.array([offsets[k][0] for k in first.tolist()], dtype=np.int64)
    return np.append(starts, len(text)), np.append(first, len(words))


def splice(tokenizer, left: str, right: str, whole: bool) -> tuple[int | None, int | None, int | None]:
    """(place in right, tokens of left before it, tokens of right before it); None without a proven common border.

    right is the end of left; `whole`: both end where the text ends, so that nothing is cut off.
    """
    at, before = borders(tokenizer, left)
    other, other_before = borders(tokenizer, right)
    at = at - (len(left) - len(right))
    both, own, its = np.intersect1d(at, other, assume_unique=True, return_indices=True)
    proven = np.flatnonzero(both <= (len(right) if whole else len(right) - GUARD))
    if not len(proven):
        return None, None, None
    k = proven[0]
    return int(both[k]), int(before[own[k]]), int(other_before[its[k]])


def encoded_seams(cuts: DataFrame, path: str) -> DataFrame:
    """SEAM for rows of key, k, next, whole, left, right_chars."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = library(path)
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                right = r.left[len(r.left) - r.right_chars :] if r.right_chars else ""
                rows.append((r.key, r.k, r.next, *splice(tokenizer, r.left, right, r.whole)))
            out = pd.DataFrame(rows, columns=["key", "k", "next", "splice", "before_left", "before_right"])
            yield out.astype({c: "Int64" for c in ("splice", "before_left", "before_right")})

    return cuts.mapInPandas(encode, SEAM)


CUT = "key string, k int, next int, whole boolean, left string, right_chars int"


def cut_texts(texts: DataFrame, overlap: int) -> DataFrame:
    """CUT for the seams of texts (key, text, seams: array of (k, next), null for all)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text, seams in zip(batch["key"], batch["text"], batch["seams"]):
                n = len(text)
                pairs = [(k, k + 1) for k in range(-(-n // CHUNK))] if seams is None else [(s["k"], s["next"]) for s in seams]
                for at in range(0, len(pairs), 64):
                    rows = []
                    for k, after in pairs[at : at + 64]:
                        end = min(n, after * CHUNK + overlap)
                        rows.append((key, k, after, end == n, text[k * CHUNK : end], max(0, end - after * CHUNK)))
                    yield pd.DataFrame(rows, columns=["key", "k", "next", "whole", "left", "right_chars"])

    return texts.mapInPandas(cut, CUT)


def dissolved(seams: DataFrame) -> DataFrame:
    """The seams that have a splice; those whose left chunk was dissolved begin with the chunk before it and have none any more."""
    order = Window.partitionBy("key").orderBy("next")
    rows = seams.where("splice is not null").withColumn("from", F.lag("next", 1, 0).over(order))
    same = F.col("from") == F.col("k")
    return rows.select("key", F.col("from").alias("k"), "next", *[F.when(same, F.col(c)).alias(c) for c in ("splice", "before_left", "before_right")])


def long_counts(texts: DataFrame, path: str) -> DataFrame:
    """key, n_tokens: of texts (key, text), one for each key though rows may repeat.

    Seams, not texts, are shuffled and encoded, so that one text is as many tasks as it has chunks. Tables in between hold
    a row for each seam, without its text.
    """
    every = texts.withColumn("seams", F.lit(None).cast("array<struct<k:int,next:int>>"))
    cuts = cut_texts(every, OVERLAPS[0]).dropDuplicates(["key", "k"])
    seams, step = common.written(encoded_seams(cuts, path), "seams"), 0
    while not (open_ := seams.where("splice is null")).isEmpty():
        step += 1
        if step >= len(OVERLAPS):  # as wide as may be: chunks that can't be aligned go
            seams, step = common.written(dissolved(seams), "seams"), 0
            open_ = seams.where("splice is null")
        asked = open_.groupBy("key").agg(F.collect_list(F.struct("k", "next")).alias("seams"))
        again = texts.join(asked, "key").dropDuplicates(["key"]).select("key", "text", "seams")
        cuts = cut_texts(again, OVERLAPS[step]).repartition("key", "k")
        seams = common.written(seams.where("splice is not null").unionByName(encoded_seams(cuts, path)), "seams")
    return seams.groupBy("key").agg(F.sum(F.col("before_left") - F.col("before_right")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens, over_limit (more than `limit`) for each row of docs, by the tokenizer of a .json file.

    Its pattern must look at nothing before a word, and at fewer than GUARD characters after one, as that of byte-level
    vocabularies does. No special tokens are added, those that stand in a text count as the library takes them, nothing is
    cut off. Null texts count as empty and have no tokens. Rows are counted one by one, repeated ones and null or repeated
    ids too; equal long texts are encoded once. Texts of any length are read whole. An empty table gives no row; columns
    besides doc_id and text are left out, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    is_long = F.length("text") > LONG * CHUNK

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = packing.tokenizer(path)
        for batch in batches:
            tokens = [len(encode(text)) // 4 for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": batch["n_bytes"], "n_tokens": tokens})

    sized = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = sized.where(~is_long).mapInPandas(count, "doc_id long, n_bytes long, n_tokens long")
    long_ = sized.where(is_long).withColumn("key", F.sha2("text", 256))
    found = long_counts(long_.select("key", "text"), path)
    rows = short.unionByName(long_.drop("text").join(found, "key").drop("key"))
    return common.written(rows.withColumn("over_limit", F.col("n_tokens") > limit), "token-counts", common.TEXT_ROWS)
