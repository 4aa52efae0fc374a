from __future__ import annotations

import random
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def odd_documents(rng: random.Random):
    """Nulls, empty and long texts, repeated rows, null ids."""
    base = prose(rng, 120)
    long = prose(rng, 30_000, 50_000)
    return [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, long), (6, "!!! ..."), (None, base), (None, "one two three"), (7, prose(rng, 60)), (8, "Ünïcode çà 日本語 один"), (9, "a")]
