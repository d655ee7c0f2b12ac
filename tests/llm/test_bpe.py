import hashlib
import random

import public_tokenizers
import regex
import tiktoken

from tessera.llm import bpe

from .data import SCHEMA, odd, rows

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_split_equals_the_pattern():
    split, rng = regex.compile(PATTERN).findall, random.Random(3)
    known = bpe.Split(split)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "the", "'s", "'", "é", "1", ".", "!!", "_", "ß", "²", "中", "́", "-"]) for _ in range(rng.randint(1, 6)))
        assert list(known[text]) == split(" " + text), text


def test_round_trip(spark):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})
    texts = odd() + ["a  b   c \n d", "<|endoftext|> x", " lead", "trail "]
    table = rows(texts) + rows(["same id"], first=3) + [(None, "no id", None, None, 0, 0.0, None)] * 2
    out = bpe.round_trip(spark.createDataFrame(table, SCHEMA), PATH, PATTERN).collect()
    expected = []
    for d, t, *_ in table:
        ids = library.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, out), key=key) == sorted(expected, key=key)


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH, PATTERN).count() == 0
