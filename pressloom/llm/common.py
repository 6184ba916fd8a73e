"""What the operators share: tables, the shared folder, and word arrays inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions.storage import shared_dir, staged, table

__all__ = ["WordHash", "chunks", "few_of", "folded_words", "gram_hashes", "keyed", "mixed", "same_row", "shared_dir", "slide", "spaced_words", "staged", "table", "whole_grams"]

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: A-Z folds to a-z; digits, a-z and every byte of a non-ASCII character stay; the rest separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words that a task keeps hashed at once (about 60 MB), and words that it holds as arrays at once.
CACHE_WORDS, CHUNK_WORDS = 300_000, 300_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes (null: empty) and text_id. (doc_id, text_id) names a row; equal rows share their answers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.cast("binary").alias("text"), F.xxhash64(text).alias("text_id"))


def few_of(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs joined by row to rows (doc_id, text_id and perhaps more): columns of docs, then the rest of rows.

    Always a merge join: rows grow with docs, so a broadcast has no bound, and the plan is the same at every size.
    """
    named = rows.withColumnsRenamed({"doc_id": "_d", "text_id": "_t"}).hint("merge")
    mine = docs.withColumn("_text_id", F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("string")))
    both = mine.join(named, mine["doc_id"].eqNullSafe(named["_d"]) & (mine["_text_id"] == named["_t"]), how)
    return both.drop("_text_id", "_d", "_t")


def same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_id"] == b["text_id"])


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered for as many words as CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def folded_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Runs of anything but space and \\t \\n \\v \\f \\r, which is how bytes.split() cuts."""
    return text.split()


def chunks(texts, split, hashes: WordHash, keep_words: bool = False):
    """(index of the first text, word lists or None, hashes of all words, offsets), a bounded number of words at a time."""
    first, lists, arrays, total = 0, [], [], 0
    for i, text in enumerate(texts):
        words = split(text)
        arrays.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        if keep_words:
            lists.append(words)
        total += len(words)
        if total >= CHUNK_WORDS:
            yield first, lists, *joined(arrays)
            first, lists, arrays, total = i + 1, [], [], 0
    if arrays:
        yield first, lists, *joined(arrays)


def joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(arrays) + 1, np.int64)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return np.concatenate(arrays), offsets


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place (places too near the end left out)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out = out * STEP + words[j : j + count]
    return mixed(out ^ np.uint64(n))


def whole_grams(offsets: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of the first count places begin n words of one document."""
    ends = np.repeat(offsets[1:], np.diff(offsets))[:count]
    return np.arange(count) + n <= ends


def slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over each width consecutive values, by doubling."""
    have = 1
    while have < width and len(a):
        step = min(have, width - have)
        a = op(a[:-step], a[step:]) if len(a) > step else a[:0]
        have += step
    return a
