"""Spelling variants: words one letter apart, found with k-d trees over letter counts.

One inserted or deleted letter changes one count by one, a replaced letter two counts: words one edit apart have letter
counts at most 2 apart in L1, and at most 1 apart where their lengths differ. Counts are kept per slot (a to z each, the
other letters in six slots) up to LEVELS, as thermometer codes of 128 bits: the L1 distance of two codes is the number
of bits in which they differ, and it is never more than that of the counts.

A k-d tree for each word length, cut by bits (a letter occurs at least t times) on a bounded sample, deals the words
into cells. A word searches the cells of its own length and of the next one: box pruning lets it into those that differ
from it in at most 2 (or 1) of the bits which the tree has fixed. Inside a cell a finer tree with tight boxes prunes
again, codes are compared, and letter order is verified. Tasks return, for each word, how many near words it met and
the most frequent of them; pairs are never listed. Cells of very many words are cut into blocks that meet each other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import keyed, staged

#: Fixed by the contract.
MIN_CHARS, MIN_TIMES, DROP_ONE_IN = 5, 3, 97
LEVELS, SLOTS, LEAF = 4, 32, 64
#: Words of a cell aimed at, words that the trees are cut on (bounds what goes to the driver), words and searches of one block.
CELL, SAMPLE, BLOCK, SEARCHES = 4096, 100_000, 16_384, 131_072
#: Runs that a task counts before it hands them on, and runs of text it numbers at once.
MOST_WORDS, CHUNK = 400_000, 400_000
#: Latin-1: letters of the contract's class, A-Z lower-cased; all else separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
SLOT = np.array([b - 97 if 97 <= b <= 122 else 26 + b % (SLOTS - 26) for b in range(256)])
FEW_BYTES = 64


class _Words(dict):
    """word (Latin-1) -> number; arrays of checksum and length follow the numbers."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []
        self.sums, self.sizes = np.zeros(1024, np.uint32), np.zeros(1024, np.int64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        if n >= len(self.sums):
            self.sums, self.sizes = np.resize(self.sums, 2 * n), np.resize(self.sizes, 2 * n)
        utf8 = word.decode("latin-1").encode()
        self.sums[n], self.sizes[n] = zlib.crc32(utf8), len(utf8)
        return n


def _less_one(word: bytes, h: int) -> bytes:
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _hits(words: _Words, ids: np.ndarray, owner: np.ndarray, prefixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places among ids whose checksum with the document's prefix is divisible, and these checksums.

    crc32 is linear: the sum of prefix and word is that of the word XOR the prefix's, carried over as many bytes.
    """
    sizes = words.sizes[ids]
    zeros = [bytes(n) for n in range(FEW_BYTES)]
    blank = [zlib.crc32(z) for z in zeros]
    used = np.unique(sizes[sizes < FEW_BYTES])
    carried = np.zeros((len(prefixes), FEW_BYTES), np.uint32)
    for d, prefix in enumerate(prefixes):
        start = zlib.crc32(prefix)
        carried[d, used] = [zlib.crc32(zeros[n], start) ^ blank[n] for n in used]
    sums = carried[owner, np.minimum(sizes, FEW_BYTES - 1)] ^ words.sums[ids]
    for k in np.flatnonzero(sizes >= FEW_BYTES):
        sums[k] = zlib.crc32(prefixes[owner[k]] + words.words[ids[k]].decode("latin-1").encode())
    at = np.flatnonzero(sums % DROP_ONE_IN == 0)
    return at, sums[at]


def _counted(batches):
    """Texts -> words and how often this task met them, handed on whenever it holds MOST_WORDS."""
    words, counts = _Words(), np.zeros(0, np.int64)

    def add(found: list[np.ndarray], prefixes: list[bytes]) -> None:
        nonlocal counts
        ids = np.concatenate(found)
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        at, sums = _hits(words, ids, owner, prefixes)
        changed = np.array([words[_less_one(words.words[i], h)] for i, h in zip(ids[at].tolist(), sums.tolist(), strict=True)], np.int64)
        total = np.bincount(ids, minlength=len(words.words)) - np.bincount(ids[at], minlength=len(words.words)) + np.bincount(changed, minlength=len(words.words))
        total[: len(counts)] += counts
        counts = total

    def handed() -> pa.RecordBatch:
        kept = [i for i in np.flatnonzero(counts).tolist() if len(words.words[i]) >= MIN_CHARS]
        return pa.RecordBatch.from_arrays([pa.array([words.words[i].decode("latin-1") for i in kept], pa.string()), pa.array(counts[kept])], ["word", "n"])

    for batch in batches:
        found, prefixes, size = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            runs = text.decode().encode("latin-1", "replace").translate(LETTERS).split()
            found.append(np.fromiter(map(words.__getitem__, runs), np.int64, len(runs)))
            prefixes.append(f"{'' if doc_id is None else doc_id}:".encode())
            size += len(runs)
            if size >= CHUNK:
                add(found, prefixes)
                found, prefixes, size = [], [], 0
                if len(words.words) >= MOST_WORDS:
                    yield handed()
                    words, counts = _Words(), np.zeros(0, np.int64)
        if found:
            add(found, prefixes)
        if len(words.words) >= MOST_WORDS:
            yield handed()
            words, counts = _Words(), np.zeros(0, np.int64)
    yield handed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of MIN_CHARS letters or more that occur MIN_TIMES or more over all documents."""
    counted = keyed(docs).mapInArrow(_counted, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TIMES)


def codes(words: list[bytes]) -> np.ndarray:
    """Thermometer codes of letter counts: two 64-bit numbers a word."""
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    slots = SLOT[np.frombuffer(b"".join(words), np.uint8)]
    counts = np.bincount(owner * SLOTS + slots, minlength=len(words) * SLOTS).reshape(len(words), SLOTS, 1)
    return np.packbits((counts > np.arange(LEVELS)).reshape(len(words), SLOTS * LEVELS), axis=1, bitorder="little").view(np.uint64)


def _bits(code: np.ndarray) -> np.ndarray:
    return np.unpackbits(code.view(np.uint8), axis=1, bitorder="little")


def _cut(bits: np.ndarray) -> int | None:
    """The bit that halves the rows best; none if all rows are alike."""
    ones = bits.sum(0, dtype=np.int64)
    best = int(np.argmin(np.abs(2 * ones - len(bits))))
    return best if 0 < ones[best] < len(bits) else None


def grown(bits: np.ndarray, scale: float, cell: int) -> list:
    """A tree over sampled codes: [bit, below, above] or the number of a cell, cells of about cell words (scale words a sampled one)."""
    cells = 0

    def node(rows: np.ndarray):
        nonlocal cells
        best = _cut(bits[rows]) if len(rows) * scale > cell and len(rows) >= 16 else None
        if best is None:
            cells += 1
            return cells - 1
        side = bits[rows, best] == 1
        return [best, node(rows[~side]), node(rows[side])]

    return node(np.arange(len(bits)))


def reached(tree, bits: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for each cell whose fixed bits differ from the row's in at most budget."""
    rows, cells, todo = [], [], [(tree, np.arange(len(bits)), np.full(len(bits), budget))]
    while todo:
        node, at, left = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, list):
            rows.append(at)
            cells.append(np.full(len(at), node))
            continue
        for side in (0, 1):
            now = left - (bits[at, node[0]] != side)
            todo.append((node[1 + side], at[now >= 0], now[now >= 0]))
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _routed(batches, trees: dict):
    """Words -> their own cell and the other cells that they search; a cell is its length and its number."""
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        sizes = np.array([len(w) for w in words], np.int64)
        bits = _bits(codes(words)) if words else np.zeros((0, SLOTS * LEVELS), np.uint8)
        own, rows, cells = np.zeros(len(words), np.int64), [], []
        for size in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == size)
            at, cell = reached(trees.get(size, 0), bits[of], 0)
            own[of[at]] = (size << 24) + cell
            at, cell = reached(trees.get(size, 0), bits[of], 2)
            cell = (size << 24) + cell
            later = cell > own[of[at]]  # of two words of one length, that of the earlier cell searches
            rows.append(of[at][later])
            cells.append(cell[later])
            at, cell = reached(trees.get(size + 1, 0), bits[of], 1)
            rows.append(of[at])
            cells.append((size + 1 << 24) + cell)
        row, cell = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cells))
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(words) + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell[order], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(own), lists], ["word", "n", "own", "cells"])


def candidates(data: np.ndarray, search: np.ndarray, radius: int, leaf: int = LEAF):
    """(places in search, places in data) of codes that differ in at most radius bits, some at a time."""
    bits, todo = _bits(data), [(np.arange(len(data)), np.arange(len(search)))]
    while todo:
        d, q = todo.pop()
        best = _cut(bits[d]) if len(d) > leaf else None
        if best is None:
            step = max(1, 2_000_000 // max(len(d), 1))
            for a in range(0, len(q), step):
                part = q[a : a + step]
                apart = np.bitwise_count(search[part, None, 0] ^ data[None, d, 0]) + np.bitwise_count(search[part, None, 1] ^ data[None, d, 1])
                i, j = np.nonzero(apart <= radius)
                yield part[i], d[j]
            continue
        side = bits[d, best] == 1
        for half in (d[~side], d[side]):
            every, some = np.bitwise_and.reduce(data[half]), np.bitwise_or.reduce(data[half])
            out = np.bitwise_count((search[q] & ~some) | (every & ~search[q])).sum(1)
            inside = q[out <= radius]
            if len(inside):
                todo.append((half, inside))


def letters(words: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether long is short with a letter put in: its common start and common end cover short."""
    start = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(1)
    end = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return start + end >= short.shape[1]


def _near(rows: pd.DataFrame) -> pd.DataFrame:
    """One block: its words (role 0), searches from other cells or blocks (1), -> near words of each, counted, and the best."""
    rows = rows.reset_index(drop=True)
    words = [w.encode("latin-1") for w in rows["word"]]
    sizes, role = np.array([len(w) for w in words]), rows["role"].to_numpy()
    size = int(rows["cell"].iloc[0]) >> 24
    data, times = np.flatnonzero(role == 0), rows["n"].to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((np.array(words), -times))] = np.arange(len(words))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    code = codes(words)
    own = bool((rows["first"].to_numpy() != 0).any())

    def meet(search: np.ndarray, radius: int, inside: bool) -> None:
        if not len(search) or not len(data):
            return
        target, source = letters([words[i] for i in data], size), letters([words[i] for i in search], int(sizes[search[0]]))
        test = one_replaced if radius == 2 else one_inserted
        for i, j in candidates(code[data], code[search], radius):
            if inside:
                i, j = i[i < j], j[i < j]
            ok = test(source[i], target[j])
            a, b = search[i[ok]], data[j[ok]]
            for x, y in ((a, b), (b, a)):
                count[:] += np.bincount(x, minlength=len(words))
                np.minimum.at(best, x, rank[y])

    if own:
        meet(data, 2, True)
    others = np.flatnonzero(role == 1)
    meet(others[sizes[others] == size], 2, False)
    meet(others[sizes[others] == size - 1], 1, False)
    met = np.flatnonzero(count)
    by_rank = np.argsort(rank)[best[met]]
    return pd.DataFrame({"word": rows["word"].to_numpy()[met], "n_near": count[met], "best_n": times[by_rank], "best": rows["word"].to_numpy()[by_rank]})


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE, block: int = BLOCK, searches: int = SEARCHES) -> DataFrame:
    """words: word (distinct, Latin-1 letters), n -> word, n_near, best, best_n for words with a near one; best: of largest n, then least.

    cell, sample: words of a cell and words that the trees are cut on; they change the dealing, never the result.
    """
    total = words.count()
    scale = max(1, -(-total // sample))
    by_size: dict[int, list[bytes]] = {}
    for (w,) in words.where(F.pmod(F.xxhash64("word"), F.lit(scale)) == 0).select("word").collect():  # about sample words
        by_size.setdefault(len(w), []).append(w.encode("latin-1"))
    trees = {size: grown(_bits(codes(some)), scale, cell) for size, some in by_size.items()}
    routed = staged(words.mapInArrow(lambda it: _routed(it, trees), "word string, n bigint, own bigint, cells array<bigint>"))
    ways = routed.select(F.explode("cells").alias("cell"))
    filled = routed.groupBy(F.col("own").alias("cell")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sought = ways.groupBy("cell").agg(F.ceil(F.count("*") / searches).cast("int").alias("ways"))
    grid = filled.join(sought, "cell", "left").select("cell", "blocks", F.coalesce("ways", F.lit(1)).alias("ways"))  # a row a cell: at most sample / 16 and one a length
    grid = F.broadcast(grid)

    def place(of: str, n: str):
        return F.pmod(F.xxhash64(of, F.lit(n)), F.col(n)).cast("int")

    steps = lambda end: F.sequence(F.lit(0), F.col(end) - 1)
    mine = routed.withColumnRenamed("own", "cell").join(grid, "cell").withColumn("i", place("word", "blocks"))
    held = mine.select("cell", "i", F.explode(steps("ways")).alias("j"), "word", "n").select("cell", "i", "j", F.lit(0).alias("role"), F.when(F.col("j") == 0, 1).otherwise(0).alias("first"), "word", "n")
    beside = mine.where("i + 1 < blocks").select("cell", F.explode(F.sequence(F.col("i") + 1, F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(1).alias("role"), F.lit(0).alias("first"), "word", "n")
    away = routed.select("word", "n", F.explode("cells").alias("cell")).join(grid, "cell").withColumn("j", place("word", "ways"))
    away = away.select("cell", F.explode(steps("blocks")).alias("i"), "j", F.lit(1).alias("role"), F.lit(0).alias("first"), "word", "n")
    met = held.unionByName(beside).unionByName(away).groupBy("cell", "i", "j").applyInPandas(_near, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form (null: none) -> word, root: the last word that the forms lead to.

    Each round doubles the steps; the count of a form is twice its word's at least, so six rounds reach any end.
    """
    at = staged(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        on = at.withColumnsRenamed({"word": "w", "root": "next"}).where("w <> next").hint("merge")
        further = staged(at.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, cell: int = CELL, sample: int = SAMPLE, block: int = BLOCK, searches: int = SEARCHES) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row a word of the whole corpus.

    docs: doc_id, text; other columns are not read. Null and empty texts have no runs; a null doc_id is written as
    nothing before the colon; runs of any length are read whole; repeated rows count each; equal counts are settled by
    code-point order; an empty table gives no rows.
    """
    words = staged(vocabulary(docs))
    near = staged(near_words(words, cell, sample, block, searches))
    all_words = words.join(near.hint("merge"), "word", "left")
    fits = F.col("best_n") >= 2 * F.col("n")
    formed = all_words.select("word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n"))
    return formed.join(roots(formed.select("word", "form")).hint("merge"), "word").select("word", "form", "root", "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return variants(docs)
