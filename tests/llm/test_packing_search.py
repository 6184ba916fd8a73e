"""Best-fit packing, spelling variants and ranked search against plain versions, with the awkward cases of the common corpus."""

from __future__ import annotations

import collections
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.llm import best_fit, ranked, spelling
from pressloom.llm.tokens import tokenizer_path
from tests.llm.test_operators import COLUMNS, docs, empty, folded, rows  # noqa: F401

SF = "/root/testdata/sf0.001"


def fewest(sizes, full):
    """Best-fit decreasing, one after the other."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in room if r >= s]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - s)
        else:
            room.append(full - s)
    return len(room)


def check_layout(placed, full):
    at = collections.defaultdict(list)
    for offset, length, sequence in placed:
        at[sequence].append((offset, length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= full
    return len(at)


def test_best_fit(docs, rows, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = best_fit.digest(docs).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    want = collections.defaultdict(list)
    for i, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] += [(k // 4096, k, len(part := ids[k : k + 4096]), zlib.crc32(struct.pack(f"<{len(part)}I", *part))) for k in range(0, len(ids), 4096)]
    assert {i: sorted(x) for i, x in pieces.items()} == {i: sorted(x) for i, x in want.items()}
    assert max(p for p, *_ in want[118]) > 0
    used = check_layout([(r["offset"], r["length"], r["sequence_id"]) for r in got], 4096)
    assert used == fewest([n for x in want.values() for _, _, n, _ in x], 4096)
    assert best_fit.digest(empty).count() == 0


@pytest.mark.parametrize("kind", ["mixed", "one size", "large", "tiny"])
def test_rounds_over_many_ranges_pack_as_tightly(spark, kind):
    """Ranges of 100 rows: many rounds, and a third or all of the sizes alike."""
    rng = random.Random(kind)
    sizes = {
        "mixed": [rng.choice([7, 7, 7, rng.randint(1, 1000), rng.randint(1, 300)]) for _ in range(1500)],
        "one size": [333] * 700,
        "large": [rng.randint(501, 999) for _ in range(400)],
        "tiny": [1] * 900 + [999] * 3,
    }[kind]
    sizes = [min(s, 999) for s in sizes]
    got = best_fit.fit(spark.createDataFrame(list(enumerate(sizes)), "id long, size int").repartition(7), 1000, 100).collect()
    assert sorted(r["id"] for r in got) == list(range(len(sizes)))
    used = check_layout([(r["offset"], sizes[r["id"]], r["bin"]) for r in got], 1000)
    assert used <= fewest(sizes, 1000) * 1.02 + 1


def test_meetings_take_the_latest_free_gaps_first():
    assert best_fit.meetings({1: 2, 2: 3}, {0: 3, 1: 1}) == [(1, 0, 2, 0, 2), (2, 0, 1, 1, 0), (2, 1, 2, 0, 0)]


def edits(word, letters):
    for k in range(len(word) + 1):
        for c in letters:
            yield word[:k] + c + word[k:]
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            for c in letters:
                yield word[:k] + c + word[k + 1 :]


def plain_variants(rows):
    times = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            times[run] += 1
    words = {w: n for w, n in times.items() if n >= 3 and len(w) >= 5}
    letters = sorted({c for w in words for c in w})
    form, near = {}, {}
    for w in words:
        found = {x for x in edits(w, letters) if x != w and x in words}
        near[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, near[w], words.get(form[w])) for w, n in words.items()}


@pytest.fixture(scope="module")
def misspelt(spark, rows):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéñü") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    more = []
    for d in range(400):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.08)), 59)]
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice("abÉ×") + w[k:], w[:k] + w[k + 1 :], w[:k] + "x" + w[k + 1 :]])
            words.append(w.capitalize() if rng.random() < 0.2 else w)
        more.append((1000 + d, "-".join(words)))
    long = "abcdefghij" * 30
    more += [(2000 + d, f"{long} {long[:-1]}b {long[:-1]} ł日本{long}") for d in range(4)]
    return [*rows, *more]


def test_spelling(spark, misspelt, empty):
    got = spelling.digest(spark.createDataFrame([(i, t, None, "s", 0, "", "", "", "") for i, t in misspelt], COLUMNS).repartition(5)).collect()
    want = plain_variants(misspelt)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r["form"] and r["root"] != r["form"] for r in got) and any(len(r["word"]) == 300 and r["n_near"] for r in got)
    assert spelling.digest(empty).count() == 0


def test_spelling_over_many_cells_and_blocks(spark, misspelt):
    """Cells of a few words, blocks of a few words and searches, tasks that hand on early: the same result."""
    docs = spark.createDataFrame(misspelt, "doc_id long, text string")
    assert {tuple(r) for r in spelling.variants(docs, cell=20, sample=500, block=9, searches=11).collect()} == plain_variants(misspelt)


def test_word_counts_do_not_depend_on_when_tasks_hand_on(spark, misspelt, monkeypatch):
    import pyarrow as pa

    texts = [(i, (t or "").encode()) for i, t in misspelt]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t for _, t in texts])], ["doc_id", "text"])

    def total():
        out = collections.Counter()
        for b in spelling._counted([batch]):
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                out[w] += n
        return out

    whole = total()
    monkeypatch.setattr(spelling, "CHUNK", 200)
    monkeypatch.setattr(spelling, "MOST_WORDS", 100)
    assert total() == whole


def test_distance_of_codes_never_exceeds_that_of_letter_counts():
    rng = random.Random(1)
    words = ["".join(rng.choice("aaabcdé") for _ in range(rng.randint(5, 12))).encode("latin-1") for _ in range(200)]
    code = spelling.codes(words)
    for _ in range(500):
        a, b = rng.randrange(200), rng.randrange(200)
        x, y = collections.Counter(words[a]), collections.Counter(words[b])
        assert np.bitwise_count(code[a] ^ code[b]).sum() <= sum(((x - y) + (y - x)).values())


def plain_search(rows, items, k=20):
    texts = [(i, collections.Counter(folded(t))) for i, t in rows]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    total, words = len(texts), sum(n for *_, n in texts)
    df = collections.Counter(w for _, c, _ in texts for w in c)
    out = collections.Counter()
    for item, text in items:
        scored = []
        for i, c, n in texts:
            m = 100 - 25 + (25 * n * total) // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w in folded(text) if c[w])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out[(item, rank, i, -s)] += 1
    return out


def test_ranked_search(spark, docs, rows, empty):
    rng = random.Random(2)
    items = [(n, " ".join(rng.choice(folded(rows[n % 12][1])) for _ in range(rng.choice([1, 3, 12, 40])))) for n in range(30)]
    items += [(100, None), (101, ""), (102, "nowhere atall"), (103, "ONE one two"), (104, rows[0][1]), (None, "one"), (105, "ünï")]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, rank int")
    assert collections.Counter(map(tuple, ranked.digest(docs, bench).collect())) == plain_search(rows, items)
    small = ranked.search(docs, bench, block=7, shard=50)
    assert collections.Counter(map(tuple, small.collect())) == plain_search(rows, items)
    assert ranked.digest(empty, bench).count() == 0 and ranked.digest(docs, bench.limit(0)).count() == 0


def test_ties_are_whole(spark):
    """Copies of one text: the least ids come first, however many there are."""
    rows = [(n, "same words here") for n in range(500, 0, -1)] + [(n, "other words") for n in range(600, 700)]
    got = ranked.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(1, "same words"), (1, "same words")], "item_id long, text string")).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {n: 2 for n in range(1, 21)}


def test_best_positions_read_less_than_whole_lists():
    rng = np.random.default_rng(0)
    docs, terms = np.nonzero(rng.random((4000, 12)) < 0.4)
    impacts = (rng.pareto(1.5, len(docs)) * 1000).astype(np.int64) + 1
    shard = ranked.Shard(np.arange(4000), docs, terms, impacts, 12)
    query, weight = {0: 1, 3: 2, 7: 1}, np.zeros(12, np.int64)
    weight[list(query)] = list(query.values())
    found, scores, read = shard.best(query, weight, 5)
    whole = np.bincount(docs, impacts * weight[terms], 4000)
    assert sorted(scores.tolist(), reverse=True) == sorted(whole.astype(int).tolist(), reverse=True)[:5]
    assert read < 0.25 * np.isin(terms, [0, 3, 7]).sum()
    assert len(found) == 5
