import random

SYLLABLES = ["ka", "lo", "mi", "ren", "tas", "vol", "qui", "dur", "es", "an"]


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))
