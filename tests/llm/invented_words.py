"""Invented texts for the tests: clean prose of a small vocabulary, and junk."""

import numpy as np


def clean_texts(n: int, seed: int = 1) -> list[str]:
    rng = np.random.default_rng(seed)
    parts = ["ba", "ne", "ro", "ti", "la", "mo", "su", "ve"]
    words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(300)]
    return [" ".join(rng.choice(words, 90)) + "." for _ in range(n)]


def junk_texts(n: int, seed: int = 2) -> list[str]:
    rng = np.random.default_rng(seed)
    letters = list("bcdfghjklmnpqrstvwxz#$%&")
    return [" ".join("".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(90)) for _ in range(n)]
