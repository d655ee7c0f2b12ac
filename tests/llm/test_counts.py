"""Token counts against the library on whole texts, above all where chunks are hard to align."""

import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import counts

from .data import SCHEMA, odd, prose, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def hard(rng):
    """Texts that are cut inside of special tokens, contractions, white space, endless words and characters of many bytes."""
    out = ["x" * 1000, " " * 1000 + "a", "ab" * 300 + " cd" * 300, "it's we'll they've I'd " * 60, "<|endoftext|>" * 80, "a <|endoftext|>  b" * 60]
    out += ["日本語のテキスト" * 90, "😀é" * 300, "\n\n\t  \r\n" * 120, "  " * 400 + "<|endoftext|>" + " " * 300, "1234567890" * 70, "!?'s" * 200, "x" * 300 + " word" * 10 + "y" * 500 + "<|endof" + "text|>" * 30]
    pieces = [" ", "  ", "\n", "'s", "'ll", "a", "bc", "def ", "7", "!!", "<|endoftext|>", "<|end", "é", "日", " ", "'", "l"]
    return out + ["".join(rng.choice(pieces) for _ in range(rng.randint(50, 900))) for _ in range(40)]


def test_splices_are_true_at_every_cut():
    tokenizer, rng = library(), random.Random(3)
    for text in hard(rng):
        starts, before = counts.borders(tokenizer, text)
        true = dict(zip(starts.tolist(), before.tolist()))
        for cut in range(1, len(text), 37):
            for overlap in (70, 130, 400):
                end = min(len(text), cut + overlap)
                at, left, right = counts.splice(tokenizer, text[:end], text[cut:end], end == len(text))
                if at is not None:
                    assert true[cut + at] == left
                    total = len(tokenizer.encode(text[cut:], add_special_tokens=False))
                    assert left - right + total == before[-1]


@pytest.mark.parametrize("chunk,overlaps", [(97, (80, 97)), (160, (66, 90, 160))])
def test_against_the_library(spark, monkeypatch, chunk, overlaps):
    monkeypatch.setattr(counts, "CHUNK", chunk)
    monkeypatch.setattr(counts, "OVERLAPS", overlaps)
    rng, tokenizer = random.Random(5), library()
    texts = hard(rng) + ["x" * 500, "x" * 500] + [t for t in odd() if t is None or len(t) < 1000] + [prose(rng, 200)]
    table = rows(texts)
    table += table[2:5] + [(None, *table[1][1:])]
    out = counts.token_counts(spark.createDataFrame(table, SCHEMA), PATH).collect()
    expected = sorted((-1 if d is None else d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for d, t, *_ in table)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in out) == expected
    assert all(r.over_limit == (r.n_tokens > 512) for r in out)


def test_very_long_texts(spark):
    rng, tokenizer = random.Random(6), library()
    texts = [prose(rng, 60_000), "y" * 300_000, prose(rng, 20_000) + "z" * 150_000 + " " * 100_000 + prose(rng, 20_000)]
    table = rows(texts + texts[:1])
    out = {r.doc_id: r.n_tokens for r in counts.token_counts(spark.createDataFrame(table, SCHEMA), PATH).collect()}
    assert out == {d: len(tokenizer.encode(t, add_special_tokens=False)) for d, t, *_ in table}


def test_empty_table(spark):
    assert counts.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0
