"""Small tables with what operators must stand: nulls, empty and long texts, ties, repeated rows, further columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, unit string"


def prose(rng, n, words=300):
    pool = [f"{a}{b}" for a in ("ba", "ko", "ri", "tu", "me", "sa", "lo", "vi") for b in ("n", "rt", "lle", "sk", "mo", "dan", "tis", "qua")]
    return " ".join(rng.choice(pool) + (str(rng.randrange(words)) if rng.random() < 0.3 else "") for _ in range(n))


def rows(texts, first=0):
    return [(first + k, t, "en", f"src{k % 3}/p{k % 2}", len(t or ""), 0.5, "x") for k, t in enumerate(texts)]


def odd(rng=None):
    """Texts that are null, empty, blank, very short, very long, equal, without spaces, and of other scripts."""
    rng = rng or random.Random(1)
    long = prose(rng, 30_000)
    return [None, "", " \n ", "a", "a", "x" * 50_000, long, "日本語のテキスト です", "é ü ß\tñ\x00\x01", prose(rng, 40), prose(rng, 40) + "\n" + prose(rng, 12)]
