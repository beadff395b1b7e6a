"""Plain versions of operators, for comparison."""

import math

import numpy as np

from brightloom.llm import toxicity


def bucket(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c)) % 2**32
    h ^= h >> 15
    h = h * (0x85EBCA6B + 2 * len(gram)) % 2**32
    return (h ^ h >> 13) % toxicity.BUCKETS


def grams_of(text: str) -> set[str]:
    """The distinct n-grams of characters of a text, between two spaces."""
    low = " " + "".join(c.lower() if "A" <= c <= "Z" else c for c in text) + " "
    return {low[i : i + n] for n in toxicity.NGRAMS for i in range(len(low) - n + 1)}


def buckets_of(text: str | None) -> np.ndarray:
    return np.array(sorted({bucket(g) for g in grams_of(text or "")}), int)


def toxicity_scores(taught: list[tuple[str, int]], texts: list[str | None]) -> list[float]:
    """Trains on the texts in their order, all in one shard, and scores the others."""
    sets, ys = [buckets_of(t) for t, _ in taught], [y for _, y in taught]
    seen, n = np.zeros((2, toxicity.BUCKETS)), np.zeros(2)
    for at, y in zip(sets, ys, strict=True):
        seen[y, at] += 1
        n[y] += 1
    prior, p = toxicity.PRIOR / n.sum(), toxicity.PRIOR
    ratio = np.log((seen[1] + n[1] * prior) / (n[1] + p)) - np.log((seen[0] + n[0] * prior) / (n[0] + p))
    scaled = lambda at: ratio[at] / np.sqrt(ratio[at] @ ratio[at] + toxicity.SHORT)
    w, bias = np.zeros(toxicity.BUCKETS), toxicity.LEAN
    for _ in range(toxicity.ROUNDS):
        for at, y in zip(sets, ys, strict=True):
            x = scaled(at)
            step = toxicity.STEP * n.sum() / 2 / n[y] * (1 / (1 + math.exp(-(w[at] @ x + bias))) - y)
            w[at] -= step * x
            bias = min(toxicity.LEAN, bias - 0.05 * step)
    return [1 / (1 + math.exp(-(w[at] @ scaled(at) + bias))) for at in map(buckets_of, texts)]
