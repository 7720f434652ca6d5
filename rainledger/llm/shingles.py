"""Words, word shingles and DartMinHash signatures of whole texts, in numpy batches."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A text of fewer words is similar to nothing.
LEAST_WORDS = 20
_WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_GOLD, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_MEMO_LIMIT = 500_000


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits in the lower-cased text."""
    return _WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a well-mixed 64-bit hash of a 64-bit number."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


class Shingler:
    """Distinct hashed runs of k successive words. Word hashes are kept in a bounded memo."""

    def __init__(self, k: int):
        self.k, self.memo, self.table = k, {}, np.empty(1024, _U)

    def _index(self, word: str) -> int:
        i = self.memo[word] = len(self.memo)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[i] = xxhash.xxh3_64_intdigest(word)
        return i

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text; empty for a text of fewer than LEAST_WORDS words."""
        if len(self.memo) > _MEMO_LIMIT:
            self.memo, self.table = {}, np.empty(1024, _U)
        get, index, least = self.memo.get, self._index, max(LEAST_WORDS, self.k)
        at, sizes = [], []
        for text in texts:
            words = words_of(text)
            if len(words) < least:
                sizes.append(0)
                continue
            at.extend([index(w) if (i := get(w)) is None else i for w in words])
            sizes.append(len(words))
        h = self.table[np.array(at, np.int64)] if at else np.empty(0, _U)
        n = max(0, len(h) - self.k + 1)
        runs = h[:n]
        for i in range(1, self.k):
            runs = mix(runs + _GOLD) ^ h[i : n + i]
        runs, out, start = mix(runs + _GOLD), [], 0
        for size in sizes:
            own = np.sort(runs[start : start + size - self.k + 1]) if size else runs[:0]
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if size else own)
            start += size
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        return self.batch([text])[0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted distinct hash arrays; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


class DartMinHash:
    """Weighted minwise signatures by darts (Christiani, 2020).

    Every element owns a quarter plane weight x rank over which a Poisson process of rate 1 throws
    darts; the process is a hash of the element, so all sets see the same darts. An element of weight
    w catches the darts below w. Each dart belongs to one of k coordinates, and a coordinate of the
    signature is its caught dart of lowest rank; two sets agree there with probability equal to their
    weighted Jaccard similarity. The plane is cut into cells, weight by doubling widths and rank by a
    geometric grid, and cells are visited in rank order only until all k coordinates are filled, which
    takes about k ln k darts however many elements there are.
    """

    def __init__(self, k: int, seed: int = 1):
        self.k, self.seed = k, _U(seed)
        self.grid = np.concatenate([[0.0], 2.0 ** np.arange(-4, 0), 1.5 ** np.arange(70)])
        self.tables = {}

    def _counts(self, u: np.ndarray, level: int, tall: int, area: float) -> np.ndarray:
        """Poisson(area) from 16 random bits by its distribution function."""
        table = self.tables.get((level, tall))
        if table is None:
            top = int(area + 12 * np.sqrt(area) + 14)
            terms = np.concatenate([[-area], np.log(area / np.arange(1, top + 1))])
            table = self.tables[level, tall] = np.searchsorted(np.cumsum(np.exp(np.cumsum(terms))), (np.arange(1 << 16) + 0.5) / (1 << 16), side="right")
        return table[u]

    def __call__(self, sets: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
        """Signatures (len(sets) x k, uint32) of non-empty sets of hashed elements; weights default to 1."""
        n, k = len(sets), self.k
        best = np.full(n * k, np.iinfo(np.uint64).max, _U)
        if not n:
            return np.empty((0, k), np.uint32)
        sizes = np.array([len(s) for s in sets])
        element, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        weight = np.ones(len(element)) if weights is None else np.concatenate(weights).astype(float)
        total = np.bincount(owner, weight, n)
        wanted = k * (np.log(k) + 1.0) / np.maximum(total, 1e-300)
        # the first pass goes up to the rank at which most sets are full; later passes take only the sets that are not
        start, stop = np.zeros(n, int), np.searchsorted(self.grid, wanted)
        while True:
            for level in range(int(start.min()), int(stop.max())):
                live = (start <= level) & (level < stop)
                if live.all():
                    self._throw(level, element, owner, weight, best)
                elif live.any():
                    pick = live[owner]
                    self._throw(level, element[pick], owner[pick], weight[pick], best)
            short = (best.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1) & (stop < len(self.grid) - 1)
            if not short.any():
                return (best & _U(0xFFFFFFFF)).astype(np.uint32).reshape(n, k)
            start, stop = np.where(short, stop, 0), np.where(short, np.minimum(stop + 1, len(self.grid) - 1), 0)

    def _throw(self, level, element, owner, weight, best):
        low, high = self.grid[level], self.grid[level + 1]
        tall = 0
        while len(element):
            left, right = 2.0**tall - 1, 2.0 ** (tall + 1) - 1
            area = (high - low) * (right - left)
            cell = mix(element + _U((((level << 8 | tall) * int(_GOLD)) + int(self.seed)) & 0xFFFFFFFFFFFFFFFF))
            count = self._counts(cell >> _U(48), level, tall, area)
            hit = np.flatnonzero(count)
            if len(hit):
                c = count[hit]
                which = np.repeat(hit, c)
                turn = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
                dart = mix(cell[which] + (turn.astype(_U) + _U(1)) * _MIX2)
                if weight.min() < right:
                    w = left + (right - left) * ((mix(dart + _GOLD) >> _U(11)) * 2.0**-53)
                    caught = w < weight[which]
                    dart, which = dart[caught], which[caught]
                rank = low + (high - low) * ((mix(dart + _MIX1) >> _U(11)) * 2.0**-53)
                coordinate = ((dart >> _U(33)) % _U(self.k)).astype(int)
                # a float of positive sign sorts like its bits: rank above, the dart's name below
                key = (rank.astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | (dart & _U(0xFFFFFFFF))
                np.minimum.at(best, owner[which] * self.k + coordinate, key)
            tall += 1
            more = weight > 2.0**tall - 1
            if not more.all():
                element, owner, weight = element[more], owner[more], weight[more]


def band_plan(k: int, rows: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Coordinates of each band: `rounds` shufflings of the k coordinates, each cut into bands of `rows`."""
    rng = np.random.default_rng(seed)
    return np.vstack([rng.permutation(k)[: k // rows * rows].reshape(-1, rows) for _ in range(rounds)])


def band_keys(signatures: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band."""
    keys = np.broadcast_to(np.arange(len(plan), dtype=_U) * _GOLD, (len(signatures), len(plan))).copy()
    for j in range(plan.shape[1]):
        keys = mix(keys + signatures[:, plan[:, j]].astype(_U) + _GOLD)
    return keys.view(np.int64)


def sketch(texts: DataFrame, k_words: int, darts: int, rows: int, rounds: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, print, words, keys, *keep) of each row (id, text, *keep) of at least LEAST_WORDS words; other rows are left out.

    print is a hash of the shingle set, equal for equal sets; words is the size of the set.
    """
    plan = band_plan(darts, rows, rounds)

    def run(batches):
        shingler, hasher = Shingler(k_words), DartMinHash(darts)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                made = [(n, s) for n, s in enumerate(shingler.batch(part.column(1).to_pylist())) if len(s)]
                sets, at = [s for _, s in made], pa.array([n for n, _ in made], pa.int64())
                keys = band_keys(hasher(sets), plan)
                offsets = np.arange(0, (len(sets) + 1) * len(plan), len(plan), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at),
                        pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], _U).view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel() if len(sets) else np.empty(0, np.int64))),
                        *[c.take(at) for c in part.columns[2:]],
                    ],
                    names=["id", "print", "words", "keys", *keep],
                )

    more = "".join(f", `{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    rows_in = texts.where("id is not null and text is not null").select(F.col("id").cast("bigint").alias("id"), "text", *keep)
    return rows_in.mapInArrow(run, f"id bigint, print bigint, words int, keys array<bigint>{more}")


def verify(pairs: DataFrame, texts: DataFrame, k_words: int, at_least: float) -> DataFrame:
    """(a, b, sim) of the pairs (a, b) whose exact k-word similarity over the whole texts is high enough.

    texts holds (id, text), one row per id.
    """

    def run(batches):
        shingler, memo = Shingler(k_words), {}

        def of(i, t):
            if i not in memo:
                if len(memo) >= 2_000:
                    memo.clear()
                memo[i] = shingler(t)
            return memo[i]

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sims = [similarity(of(i, s), of(j, t)) for i, j, s, t in zip(a, b, batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = [n for n, s in enumerate(sims) if s >= at_least]
            yield pa.RecordBatch.from_arrays([pa.array([a[n] for n in keep], pa.int64()), pa.array([b[n] for n in keep], pa.int64()), pa.array([sims[n] for n in keep], pa.float64())], schema=schema)

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, sim double")
