"""Language of every word by a linear-chain conditional random field, and of every text from its words.

Features of a word: its affixes of up to three letters, its character pairs and triples, its length and its entry
in a lexicon; all hashed into DIMS weights a language. The lexicon counts all words by language over every document
that may be learned from, in a table of SLOTS places that words are hashed to, so its size does not follow the corpus.
Transitions are learned from sequences that switch language: stretches of documents of different languages in a row.
Marginals come from forward-backward over the whole text; a text's language is the one with the most expected words
and its score their share.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM_BITS, SLOTS = 15, 1 << 17
DIMS = 1 << DIM_BITS
#: Sample that weights are fitted on: documents a language, characters of each. Lexicon: fewest counts of a place that is used.
SAMPLE_DOCS, SAMPLE_CHARS, SEEN = 200, 3000, 5
STEPS, LENGTH, SEGMENT, CACHE, CHUNK = 60, 64, 64, 400_000, 200_000
#: Signs that count as word characters but are neither letters nor decimal digits (fractions, circled numbers).
_SIGNS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
WORD, LETTERS = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{_SIGNS}]+")
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    if not words or "".join(words).isalpha():
        return words
    return [part for w in words for part in ([w] if w.isalpha() else LETTERS.findall(w))]


def slot_of(word: str) -> int:
    return crc32(word.encode()) % SLOTS


def _dims(salt: int, *codes: np.ndarray) -> np.ndarray:
    """Hashed place of a feature: its kind and up to three numbers."""
    h = np.full(len(codes[0]), salt + 1, np.uint64)
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return ((h * _MIX) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, and the number of the word that each belongs to. lexicon: (SLOTS, labels) shares in tenths, -1: not met."""
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    starts, owner = ends - lens, np.repeat(np.arange(len(words)), lens)
    longer = lambda k: np.where(lens > k, codes[np.minimum(starts + k, len(codes) - 1)], 0)
    before = lambda k: np.where(lens > k, codes[np.maximum(ends - 1 - k, 0)], 0)
    found = [_dims(0, np.minimum(lens, 14)), _dims(1, longer(1)), _dims(2, longer(1), longer(2)), _dims(3, longer(1), longer(2), longer(3))]
    found += [_dims(4, before(1)), _dims(5, before(1), before(2)), _dims(6, before(1), before(2), before(3))]
    owners = [np.arange(len(words))] * len(found)
    for n in (2, 3):
        at = np.flatnonzero(np.arange(len(codes)) + n <= ends[owner])
        found.append(_dims(5 + n, *(codes[at + k] for k in range(n))))
        owners.append(owner[at])
    shares = lexicon[np.fromiter(map(slot_of, words), np.int64, len(words))]
    for k in range(shares.shape[1]):
        at = np.flatnonzero(shares[:, k] >= 0)
        found.append(_dims(9 + k, shares[at, k]))
        owners.append(at)
    return np.concatenate(found), np.concatenate(owners)


def summed(weights: np.ndarray, hashed: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Weights of features summed by word: (n, labels)."""
    return np.stack([np.bincount(owner, weights[hashed, k], n) for k in range(weights.shape[1])], 1)


def _lexicon_counts(batches):
    for batch in batches:
        met: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            met.setdefault(lang, Counter()).update(words_of(text))
        rows = []
        for lang, counts in met.items():
            table = np.bincount(np.fromiter(map(slot_of, counts), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts)), SLOTS)
            at = np.flatnonzero(table)
            rows.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at].astype(np.int64))], ["lang", "slot", "n"]))
        yield from rows


def marginals(emission: np.ndarray, transition: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Forward-backward over many sequences at once: probability of each label for each word.

    emission: (words, labels) log scores; transition: (labels, labels) log scores; offsets: where sequences (none of
    them empty) begin and end. Sequences are cut into segments of SEGMENT words, whose effect on what enters them is a
    (labels, labels) matrix; what enters and leaves each follows from these matrices, and then all segments run at
    once. The result is that of one pass over each whole sequence.
    """
    e, a = np.exp(emission - emission.max(1, keepdims=True)), np.exp(transition - transition.max()).astype(emission.dtype)
    labels, lens = e.shape[1], np.diff(offsets)
    parts = -(-lens // SEGMENT)
    sequence = np.repeat(np.arange(len(lens)), parts)
    begin = np.cumsum(parts) - parts
    part = np.arange(len(sequence)) - begin[sequence]
    sizes = np.minimum(SEGMENT, lens[sequence] - part * SEGMENT)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = (offsets[:-1][sequence] + part * SEGMENT)[order], sizes[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # where a segment is kept
    active = np.searchsorted(-sizes, -np.arange(SEGMENT), "left")  # segments longer than t
    at = [starts[:n] + t for t, n in enumerate(active.tolist())]
    scores = [e[x] for x in at]

    def even(x):
        return x / x.sum(-1, keepdims=True)

    product = np.eye(labels, dtype=e.dtype) * scores[0][:, None, :]
    for n, now in zip(active[1:].tolist(), scores[1:], strict=True):
        if n:
            step = (product[:n] @ a) * now[:, None, :]
            product[:n] = step / step.sum((1, 2), keepdims=True)
    enter, leave = np.ones((len(order), labels), e.dtype), np.ones((len(order), labels), e.dtype)
    by_parts = np.argsort(-parts, kind="stable")
    many = parts[by_parts]
    for j in range(1, int(many[0]) if len(many) else 0):
        going = begin[by_parts[: np.searchsorted(-many, -j, "left")]] + j  # sequences with a segment j
        last = place[going - 1]
        enter[place[going]] = even((enter[last][:, None, :] @ product[last])[:, 0] @ a)
    for j in range(int(many[0]) - 1 if len(many) else 0, 0, -1):
        going = begin[by_parts[: np.searchsorted(-many, -j, "left")]] + j
        here = place[going]
        leave[place[going - 1]] = even((product[here] @ leave[here][:, :, None])[:, :, 0] @ a.T)
    both, now = np.empty_like(e), None
    for t, n in enumerate(active.tolist()):
        now = even((enter if t == 0 else now[:n] @ a) * scores[t])
        both[at[t]] = now
    back = leave
    for t in range(SEGMENT - 1, -1, -1):
        if n := int(active[t]):
            if t + 1 < SEGMENT and (m := int(active[t + 1])):
                back[:m] = even((back[:m] * scores[t + 1]) @ a.T)
            both[at[t]] *= back[:n]
    return even(both)


def fit(texts: list[tuple[str, int]], labels: int, lexicon: np.ndarray, steps: int = STEPS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIMS, labels) and transitions from labelled stretches of text, by gradient on the log likelihood."""
    rng = np.random.default_rng(seed)
    stretches = []
    for text, label in texts:
        words, at = words_of(text), 0
        while at < len(words):
            n = int(rng.integers(3, 40))
            stretches.append((words[at : at + n], label))
            at += n
    rng.shuffle(stretches)
    flat = [(w, label) for words, label in stretches for w in words]
    flat = flat[: len(flat) // LENGTH * LENGTH or len(flat)]
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w, _ in flat])
    gold = np.array([label for _, label in flat])
    offsets = np.unique(np.append(np.arange(0, len(flat), LENGTH), len(flat)))
    hashed, owner = features(list(index), lexicon)
    weights, transition = np.zeros((DIMS, labels)), np.zeros((labels, labels))
    sums = [np.full_like(weights, 1e-6), np.full_like(transition, 1e-6)]
    inner = np.setdiff1d(np.arange(1, len(flat)), offsets)
    pairs = np.zeros_like(transition)
    np.add.at(pairs, (gold[inner - 1], gold[inner]), 1)
    one = np.eye(labels)[gold]
    for _ in range(steps):
        p = marginals(summed(weights, hashed, owner, len(index))[ids], transition, offsets)
        gap = one - p
        word_gap = np.stack([np.bincount(ids, gap[:, k], len(index)) for k in range(labels)], 1)
        slope = np.stack([np.bincount(hashed, word_gap[owner, k], DIMS) for k in range(labels)], 1) / len(flat) - 1e-6 * weights
        a = np.exp(transition - transition.max())
        joint = p[inner - 1][:, :, None] * a[None] * p[inner][:, None, :]
        expect = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        for what, total, g in ((weights, sums[0], slope), (transition, sums[1], (pairs - expect) / max(1, len(inner)))):
            total += g * g
            what += 0.5 * g / np.sqrt(total)
    return weights.astype(np.float32), transition.astype(np.float32)


class Emissions:
    """Emission scores of words, remembered for up to CACHE words."""

    def __init__(self, weights: np.ndarray, lexicon: np.ndarray):
        self.weights, self.lexicon = weights, lexicon
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, weights.shape[1]), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.place)
        if new and len(self.place) + len(new) > CACHE:
            self.place.clear()
            self.rows, new = self.rows[:0], set(words)
        if new:
            listed = list(new)
            self.place.update(zip(listed, range(len(self.rows), len(self.rows) + len(listed)), strict=True))
            scores = summed(self.weights, *features(listed, self.lexicon), len(listed))
            self.rows = np.concatenate([self.rows, scores.astype(np.float32)])
        return self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


def _predicted(batches, model):
    langs, weights, transition, lexicon = model
    cache = Emissions(weights, lexicon) if langs else None
    for batch in batches:
        texts = batch.column("text").to_pylist()
        chosen, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        held: list[tuple[int, list[str]]] = []

        def settle():
            lens = np.array([len(x) for _, x in held])
            offsets = np.concatenate([[0], np.cumsum(lens)])
            p = marginals(cache.of(list(chain.from_iterable(x for _, x in held))), transition, offsets)
            share = np.add.reduceat(p, offsets[:-1]) / lens[:, None]
            for (i, _), row in zip(held, share, strict=True):
                chosen[i], scores[i] = langs[int(row.argmax())], min(1.0, float(row.max()))
            held.clear()

        total = 0
        for i, text in enumerate(texts):
            words = words_of(text) if langs else []
            if words:
                held.append((i, words))
                total += len(words)
                if total >= CHUNK:
                    settle()
                    total = 0
        if held:
            settle()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(chosen, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS):
    """(languages, weights, transitions, lexicon) from doc_id, text and non-null lang of docs.

    The lexicon counts every word of docs; weights are fitted on a passage of sample_chars characters of sample_docs documents a language.
    """
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    start = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.lit(1), F.char_length("text") - sample_chars)) + 1
    sample = known.select("lang", "doc_id", F.substring("text", start.cast("int"), F.lit(sample_chars)).alias("text")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs).orderBy("lang", "rank").collect()
    langs = sorted({r["lang"] for r in sample if words_of(r["text"])})
    if not langs:
        return [], None, None, None
    counted = known.select("text", "lang").mapInArrow(_lexicon_counts, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    place, table = {k: i for i, k in enumerate(langs)}, np.zeros((SLOTS, len(langs)))
    for part in counted.toArrow().to_batches():  # at most SLOTS rows a language
        at = [place.get(x, -1) for x in part.column("lang").to_pylist()]
        ok = np.array(at) >= 0
        table[part.column("slot").to_numpy()[ok], np.array(at)[ok]] = part.column("n").to_numpy()[ok]
    total = table.sum(1, keepdims=True)
    lexicon = np.where(total >= SEEN, np.minimum(9, 10 * table // np.maximum(total, 1)), -1).astype(np.int8)
    weights, transition = fit([(r["text"], place[r["lang"]]) for r in sample if r["lang"] in place], len(langs), lexicon)
    return langs, weights, transition, lexicon


def predict(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang; other columns are not read).

    Held out: crc32 of doc_id as text is 2 modulo 4; such rows, and rows with a null id, text or lang, teach nothing.
    A null text, one without a letter (fractions and circled numbers are none), or a table that teaches nothing: 'und' with
    score 0. Repeated rows are scored each. sample_docs, sample_chars: bounds of the labelled sample, see learn().
    """
    bucket = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    marked = docs.select("doc_id", "text", "lang", F.coalesce(bucket == 2, F.lit(False)).alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(learn(marked.where(bucket != 2), sample_docs, sample_chars))
    read = marked.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"))
    doc_id = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(lambda it: _predicted(it, model.value), f"doc_id {doc_id}, held_out boolean, lang_pred string, score double")
