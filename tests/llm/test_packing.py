import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing

from .data import SCHEMA, odd, prose, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_fast_tokenizer_equals_the_library():
    library, fast, rng = Tokenizer.from_file(PATH), packing.tokenizer(PATH), random.Random(1)
    parts = ["a", "the", "\n", " ", "  ", "\t", "'s", ".", "é", "1", "<|endoftext|>", "　", " \n", "x "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert library.encode(text, add_special_tokens=False).ids == np.frombuffer(fast(text), "<u4").tolist(), text


@pytest.mark.parametrize("counts", [{5: 3}, {3: 1, 4: 1, 6: 1, 7: 1}, {10: 2, 1: 5}, {1: 40}, {6: 2, 5: 2, 4: 2}])
def test_fullest_is_the_fullest(counts):
    capacity, first = 10, max(counts)
    items = [k for k, n in counts.items() for _ in range(n - (k == first))]
    sums = {0}
    for k in items:
        sums |= {s + k for s in sums if s + k <= capacity - first}
    chosen = packing.fullest(counts, capacity)
    assert sum(k * n for k, n in chosen.items()) == first + max(sums)
    assert all(n <= counts[k] for k, n in chosen.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    counts = {k: rng.randint(1, 500) for k in range(1, 1025)}
    used: dict = {}
    for times, chosen in packing.plan(counts):
        assert sum(k * n for k, n in chosen.items()) <= 1024
        for k, n in chosen.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts


def test_pack(spark):
    rng = random.Random(3)
    texts = odd() + [prose(rng, n) for n in (100, 700, 701, 900, 3000)] + [None, "same text", "same text"]
    table = rows(texts) + rows(["same text"], first=len(texts) - 1)
    out = packing.pack(spark.createDataFrame(table, SCHEMA), PATH).toPandas()
    library = Tokenizer.from_file(PATH)
    expected = [(d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, *_ in table]
    assert sorted(out.groupby("doc_id")["length"].sum().items()) == sorted({d: sum(len(i) for e, i in expected if e == d) for d, _ in expected}.items())
    pieces = sorted(out[["doc_id", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    cut = []
    for d, ids in expected:
        head = len(ids) % 1024 or 1024
        for at in range(head - 1024, len(ids), 1024):
            part = ids[max(at, 0) : at + 1024]
            cut.append((d, max(at, 0), len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert pieces == sorted(cut)
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["length"].sum() <= 1024 and own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 1024) + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_tasks_of_a_worker_share_the_remembered_words():
    fast = packing.tokenizer(PATH)
    fast("remembered words")
    assert packing.tokenizer(PATH) is fast
