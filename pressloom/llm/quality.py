"""Quality classifier without labels: overlapping heuristic votes, a model of their accuracies, a hashed linear scorer.

Each labeller votes good, poor or nothing from simple rates of a text. How often each pattern of votes occurs is
counted over all documents (at most 3^labellers rows); expectation-maximisation on these counts estimates every
labeller's accuracy on good texts and on each of a few kinds of poor ones, and the shares of these classes. The posteriors label a bounded sample of documents
(SAMPLE), on which a logistic scorer over hashed word-shape and rate features is fitted. Every document is scored.
"""

from __future__ import annotations

from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import few_of, keyed

DIMS, SAMPLE, THRESHOLD, CACHE = 1 << 12, 6000, 0.5, 400_000
#: Labellers: rate, good at or below (or above, if reversed), poor beyond.
RATES = ("symbols", "capitals", "bars", "exclamations", "echoes", "short", "distinct", "noise")
#: (rate, good bound, poor bound): good up to the first and poor from the second, or the other way if they fall.
LABELLERS = ((0, 0.05, 0.25), (1, 0.25, 0.45), (2, 0.02, 0.15), (3, 0.04, 0.25), (4, 0.06, 0.25), (5, 0.20, 0.05), (6, 0.35, 0.20), (7, 0.02, 0.08))
#: Labellers that each see a kind of poor text of their own: the poor class is a mixture of these kinds. With one poor
#: class alone, labellers that never fire together would count as evidence against each other.
KINDS = (0, 1, 2, 4, 6)
_ENDS = set(".,;:?!\"'()[]{}«»…-/@+_=")


class _Kinds(dict):
    """Code point -> its kind: A or a for letters, 0 for digits, else itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        return kind


_KINDS = _Kinds()


def pattern_rates(pattern: str) -> tuple[int, ...]:
    """Of a word written in kinds: letters, capitals, symbol-laden, bar, exclamation, short, odd characters."""
    letters, last = pattern.count("a") + pattern.count("A"), pattern[-1]
    odd = sum(c not in "aA0" and not c.isalnum() and c not in _ENDS for c in pattern)
    return (letters, pattern.count("A"), int(last not in "aA0" and last not in _ENDS and letters > 0), int(pattern == "|"), int("!" in pattern), int(0 < letters <= 4), odd)


def shape(pattern: str) -> str:
    """Kinds with repeats once."""
    return "".join(c for i, c in enumerate(pattern) if not i or c != pattern[i - 1])


def pattern_features(pattern: str) -> tuple[int, int, int]:
    return tuple(crc32(x.encode()) % DIMS for x in (f"s{shape(pattern)}", f"e{pattern[-3:]}", f"n{min(len(pattern), 15)}{pattern[:1]}"))


def rate_features(rates: np.ndarray, n: int) -> list[int]:
    return [crc32(f"r{k}:{min(9, int(x * 10))}".encode()) % DIMS for k, x in enumerate(rates)] + [crc32(f"w{min(12, n.bit_length())}".encode()) % DIMS]


class Words(dict):
    """word -> row of its pattern of kinds, remembered for up to CACHE words. Patterns are far fewer than words."""

    def __init__(self):
        super().__init__()
        self.patterns: dict[str, int] = {}
        self.rates, self.features = np.zeros((1024, 7)), np.zeros((1024, 3), np.int64)

    def __missing__(self, word: str) -> int:
        pattern = word.translate(_KINDS)
        at = self.patterns.get(pattern)
        if at is None:
            at = self.patterns[pattern] = len(self.patterns)
            if at >= len(self.rates):
                self.rates = np.concatenate([self.rates, np.zeros_like(self.rates)])
                self.features = np.concatenate([self.features, np.zeros_like(self.features)])
            self.rates[at], self.features[at] = pattern_rates(pattern), pattern_features(pattern)
        self[word] = at
        return at

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns of a text's words with their counts, and the text's rates."""
        if len(self) > CACHE:
            self.clear()
            self.patterns.clear()
        words = text.split()
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(RATES))
        counts = np.bincount(np.fromiter(map(self.__getitem__, words), np.int64, n))
        at = np.flatnonzero(counts)
        counts = counts[at]
        sums = counts @ self.rates[at]
        letters = max(1.0, sums[0])
        distinct = min(1.0, len(set(words)) / min(n, 200)) if n >= 20 else 1.0
        echoes = sum(map(eq, words, islice(words, 1, None)))
        return at, counts, np.array([sums[2] / n, sums[1] / letters, sums[3] / n, sums[4] / n, echoes / n, sums[5] / n, distinct, sums[6] / letters])


def votes(rates: np.ndarray) -> int:
    """The labellers' votes as one number, base 3: 0 nothing, 1 good, 2 poor."""
    out = 0
    for k, good, poor in LABELLERS:
        x, g, p = (rates[k], good, poor) if good < poor else (-rates[k], -good, -poor)
        out = out * 3 + (1 if x <= g else 2 if x >= p else 0)
    return out


def _votes_of(words: Words, data: bytes) -> int:
    at, _, rates = words.of(data.decode())
    return votes(rates) if len(at) else -1


def _voted(batches):
    words = Words()
    for batch in batches:
        found = [_votes_of(words, t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["votes"])


def accuracies(counts: dict[int, int], steps: int = 100) -> tuple[np.ndarray, dict[int, float]]:
    """EM over counts of vote patterns: P(vote | poor, good) as (2, labellers, 3), and each pattern's probability of good."""
    n = len(LABELLERS)
    patterns = np.array(sorted(counts), np.int64)
    if not len(patterns):
        return np.full((2, n, 3), 1 / 3), {}
    weight = np.array([counts[p] for p in patterns], float)
    digits = (patterns[:, None] // 3 ** np.arange(n - 1, -1, -1)) % 3
    table = np.array([[[0.2, 0.795, 0.005]] * n] * (1 + len(KINDS)))
    for c, k in enumerate(KINDS, 1):
        table[c, k] = (0.1, 0.1, 0.8)
        table[c, [j for j in range(n) if j != k]] = (0.3, 0.6, 0.1)
    share = np.array([0.8] + [0.2 / len(KINDS)] * len(KINDS))
    for _ in range(steps):
        logs = np.log(share)[:, None] + np.log(table)[:, np.arange(n), digits].sum(2)
        p = np.exp(logs - logs.max(0))
        p /= p.sum(0)
        share = ((p * weight).sum(1) + 1) / (weight.sum() + len(share))
        for c in range(len(table)):
            for v in range(3):
                table[c, :, v] = ((digits == v) * (p[c] * weight)[:, None]).sum(0) + 0.5
            table[c] /= table[c].sum(1, keepdims=True)
    good = p[0]
    poor = (table[1:] * share[1:, None, None]).sum(0) / share[1:].sum()
    table = np.stack([poor, table[0]])
    return table, dict(zip(patterns.tolist(), good.tolist(), strict=True))


def _featured(batches):
    words = Words()
    for batch in batches:
        found, dims, values = [], [], []
        for data in batch.column("text").to_pylist():
            at, counts, rates = words.of(data.decode())
            found.append(votes(rates) if len(at) else -1)
            d, v = _vector(words, at, counts, rates)
            dims.append(d)
            values.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(dims, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["votes", "dims", "shares"])


def _vector(words: Words, at: np.ndarray, counts: np.ndarray, rates: np.ndarray) -> tuple[list[int], list[float]]:
    if not len(at):
        return [], []
    n = int(counts.sum())
    shares = np.bincount(words.features[at].ravel(), np.repeat(counts / n, 3), DIMS)
    dims = np.flatnonzero(shares)
    extra = rate_features(rates, n)
    return dims.tolist() + extra, shares[dims].tolist() + [1.0] * len(extra)


def fit(rows: list[tuple[list[int], list[float], float]], steps: int = 150) -> np.ndarray:
    """Logistic weights (the last is the constant) for soft labels, by adaptive gradient on the sample."""
    weights = np.zeros(DIMS + 1)
    if not rows:
        return weights
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    dims, shares, y = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows]), np.array([r[2] for r in rows])
    total = np.full_like(weights, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(weights[-1] + np.bincount(owner, weights[dims] * shares, len(rows)))))
        gap = (y - p) / len(rows)
        slope = np.append(np.bincount(dims, gap[owner] * shares, DIMS), gap.sum()) - 1e-5 * weights
        total += slope * slope
        weights += 0.5 * slope / np.sqrt(total)
    return weights


def _scored(batches, weights: np.ndarray, posterior: dict[int, float]):
    words = Words()
    for batch in batches:
        weak, scores, counts = [], [], []
        for data in batch.column("text").to_pylist():
            at, times, rates = words.of(data.decode())
            n = int(times.sum())
            counts.append(n)
            if not len(at):
                weak.append(0.0)
                scores.append(0.0)
                continue
            by_word = times @ weights[words.features[at]].sum(1)
            z = weights[-1] + by_word / n + weights[rate_features(rates, n)].sum()
            weak.append(posterior.get(votes(rates), 0.5))
            scores.append(float(1 / (1 + np.exp(-np.clip(z, -60, 60)))))
        ids = [batch.column(n) for n in ("doc_id", "text_id")]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(counts, pa.int64()), pa.array(weak), pa.array(scores)], ["doc_id", "text_id", "n_words", "weak_label", "score"])


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_id, n_words, weak_label (posterior of good), score, keep (score >= threshold).

    docs: doc_id, text; other columns are not read. Null texts and texts without words score 0 and are not kept;
    repeated rows are scored each; an empty table gives no rows.
    """
    spark, read = docs.sparkSession, keyed(docs)
    counts = {r["votes"]: r["count"] for r in read.select("text").mapInArrow(_voted, "votes int").where("votes >= 0").groupBy("votes").count().collect()}  # at most 3^labellers
    _, posterior = accuracies(counts)
    total = max(1, sum(counts.values()))
    place = F.pmod(F.xxhash64("doc_id", "text_id"), F.lit(1 << 30))
    few = read.where(place < int(min(1.0, 2 * sample / total) * (1 << 30))).orderBy(place, "text_id").limit(sample).select("text")
    rows = few.mapInArrow(_featured, "votes int, dims array<int>, shares array<double>").where("votes >= 0").collect()  # at most sample rows
    weights = fit([(r["dims"], r["shares"], posterior.get(r["votes"], 0.5)) for r in rows])
    model = spark.sparkContext.broadcast((weights, posterior))
    doc_id = read.schema["doc_id"].dataType.simpleString()
    scored = read.mapInArrow(lambda it: _scored(it, *model.value), f"doc_id {doc_id}, text_id bigint, n_words bigint, weak_label double, score double")
    return scored.withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, all columns kept."""
    return few_of(docs, classify(docs).where("not keep").select("doc_id", "text_id").distinct(), "left_anti")
