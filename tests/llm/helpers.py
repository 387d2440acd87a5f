"""Small documents with hard cases, and plain versions of the operators' rules."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def documents(spark, seed: int = 1):
    """Copies, near copies, a group of near copies, shared passages, empty, blank, null and long texts, repeated rows."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.choice([1, 3, 5, 8, 40, 120])) for _ in range(25)]
    base = sentence(rng, 100).split()
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    passage = sentence(rng, 60)
    texts += [f"{sentence(rng, 30)} {passage} {sentence(rng, 20)}" for _ in range(6)]
    texts += [texts[0], texts[0].upper(), texts[4] + " tail", "", "   \t\n", None, sentence(rng, 4000), "ÄÖ ü é " * 8]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (len(texts), "a null source", "en", None, 13)]
    return spark.createDataFrame(rows, SCHEMA)


def shingles(text, n: int = 5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def classes(items, linked):
    """Smallest member reachable from each of ``items``."""
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in items}
