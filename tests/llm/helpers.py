import random
import re

WORD = re.compile(r"[^\W_]+")
VOCABULARY = [a + b for a in ("water", "grond", "dijk", "sluis", "boer", "veld", "regen", "droog", "peil", "polder") for b in ("", "en", "je", "land", "weg", "huis", "bank", "man", "dag", "jaar")]


def text(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(base, seed, edits):
    rng = random.Random(seed)
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"nieuw{rng.randrange(1000)}"
    return " ".join(words)


def runs(t, k):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= 20 else set()


def sim(a, b, k):
    a, b = runs(a, k), runs(b, k)
    return len(a & b) / len(a | b) if a and b else 0.0
