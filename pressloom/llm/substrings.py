"""Substring dedup: words covered by a window of WINDOW words that starts at two places or more are removed.

Every window names an anchor: the least of the hashes of its GRAM-word grams. Equal windows have equal anchors
at equal offsets, so an anchor is met at least as often as any window that names it. A count-min sketch (ROWS
rows) counts the anchors: each task writes its cells, a shuffle by block of cells adds them up, and one bit a
cell (count of two or more) comes back as a bitmap of at most 2 * max_cells / 8 bytes, whatever the corpus. The
sketch only overestimates, so a window whose anchor is estimated once starts nowhere else. The second pass
sends only windows of anchors estimated repeated, one row an anchor, and groups them exactly by the hashes of
all their words (128 bits: anchor and window).

An anchor that the sketch counts HOT times or more is sent by window instead: a key is anchor, offset and window,
so a passage met in other text each time is spread over all tasks, and any other key has fewer than HOT rows.

Before they are sent, equal rows within an Arrow batch become one row that counts for two, and the batch
settles its own copies: a passage that fills a third of all rows gives a batch one row. Groups are read as a
sorted stream in bounded memory. Beyond max_cells the filter passes more windows and the result stays exact.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import WordHash, chunks, gram_hashes, keyed, mixed, same_row, slide, spaced_words, staged, whole_grams

WINDOW, GRAM, ROWS = 35, 8, 2
BLOCK = 1 << 16
#: Estimated places of an anchor from which its windows are keys of their own (counts of the sketch end here).
HOT = 1000
#: Characters of text for one anchor, from the density of least-of-28 anchors (2 in 29 words of 6 characters), kept low.
CHARS_PER_ANCHOR = 60


def _anchors(words: np.ndarray, offsets: np.ndarray, window: int):
    """starts, anchor hash and anchor place of every window."""
    span = window - GRAM + 1
    grams = gram_hashes(words, GRAM)
    if len(grams) < span:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    least = slide(grams, span, np.minimum)
    starts = np.flatnonzero(whole_grams(offsets, window, len(least)))
    return starts, least[starts], _leftmost(grams, span)[starts]


def _leftmost(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the first least gram of each span of grams, by doubling over (hash, place) pairs."""
    best, at, have = grams, np.arange(len(grams)), 1
    while have < span:
        step = min(have, span - have)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        have += step
    return at


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(anchors + np.uint64(row + 1) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(batches, window: int, bits: int):
    """A task's part of the sketch: for each block of cells, the cells met once, and those met more often with their counts."""
    hashes = WordHash()
    for batch in batches:
        met = [[] for _ in range(ROWS)]
        for _, _, words, offsets in chunks(batch.column("text").to_pylist(), spaced_words, hashes):
            _, anchors, places = _anchors(words, offsets, window)
            if len(places):
                _, first = np.unique(places, return_index=True)  # each place counts once
                for row in range(ROWS):
                    met[row].append(_cells(anchors[first], row, bits))
        blocks, once, often, times = [], [], [], []
        for row in range(ROWS):
            if met[row]:
                cells, counts = np.unique(np.concatenate(met[row]), return_counts=True)
                block = cells // BLOCK
                cuts = np.flatnonzero(np.diff(block)) + 1
                for part, count in zip(np.split(cells, cuts), np.split(counts, cuts), strict=True):
                    blocks.append(row << 32 | int(part[0] // BLOCK))
                    low = (part % BLOCK).astype(np.uint16)
                    once.append(low[count == 1].tobytes())
                    often.append(low[count > 1].tobytes())
                    times.append(np.minimum(count[count > 1], HOT).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(once, pa.binary()), pa.array(often, pa.binary()), pa.array(times, pa.binary())], ["block", "once", "often", "times"])


def _merged(batches):
    """Parts of blocks -> one bitmap a block: cells whose counts add up to two or more; and the cells that add up to HOT or more."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, once, often, times in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            cells = counts.setdefault(block, np.zeros(BLOCK, np.uint16))
            for low, n in ((np.frombuffer(once, np.uint16), np.uint16(1)), (np.frombuffer(often, np.uint16), np.frombuffer(times, np.uint16))):
                cells[low] = np.minimum(cells[low] + n, np.uint16(HOT))
    ids = list(counts)
    hot = [np.flatnonzero(counts[b] >= HOT).astype(np.uint16).tobytes() for b in ids]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([np.packbits(counts[b] > 1).tobytes() for b in ids], pa.binary()), pa.array(hot, pa.binary())], ["block", "bits", "hot"])


def _met_in(sorted_cells: np.ndarray, cells: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_cells, cells)
    return sorted_cells[np.minimum(at, len(sorted_cells) - 1)] == cells if len(sorted_cells) else np.zeros(len(cells), bool)


def _window_key(anchor: int, offset: int, whole: bytes) -> int:
    return xxhash.xxh3_64_intdigest(struct.pack("<Qq", anchor, offset) + whole)


def _hot_rows(runs: list[tuple]):
    """Runs (anchor, offset, whole, doc, start) of hot anchors in a batch -> rows (key, doc or None, start, offset, whole or None, n).

    Windows that the batch repeats leave as runs, with one witness each; any other window is a row of its own.
    """
    times: dict[tuple, int] = {}
    for anchor, offset, whole, _, _ in runs:
        for i in range(len(whole) // 8):
            w = (anchor, offset - i, whole[8 * i : 8 * i + 8])
            times[w] = times.get(w, 0) + 1
    for anchor, offset, whole, doc, start in runs:
        run = None
        for i in range(len(whole) // 8 + 1):
            w = (anchor, offset - i, whole[8 * i : 8 * i + 8])
            again = times.get(w, 0) > 1
            if again and run is None:
                run = i
            elif not again and run is not None:
                yield hash((doc, start + run, anchor)), doc, start + run, offset - run, None, i - run
                run = None
            if w[2] and not again:
                yield _window_key(*w), doc, start + i, offset - i, w[2], 1
    for w, n in times.items():
        if n > 1:
            yield _window_key(*w), None, None, w[1], w[2], 0


def _suspects(batches, window: int, bits: int, sketch: list[np.ndarray], hot_cells: list[np.ndarray]):
    """Windows whose anchor is estimated repeated: a row an anchor place, with the hashes of its windows; a row a window where the anchor is hot."""
    hashes = WordHash()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ids, text_ids = batch.column("doc_id").to_pylist(), batch.column("text_id").to_pylist()
        seen: dict[tuple, list] = {}  # (anchor, window hashes) -> places in this batch
        runs: list[tuple] = []  # of hot anchors
        for first, _, words, offsets in chunks(texts, spaced_words, hashes):
            starts, anchors, places = _anchors(words, offsets, window)
            if not len(starts):
                continue
            keep = np.ones(len(starts), bool)
            for row in range(ROWS):
                cells = _cells(anchors, row, bits)
                keep &= (sketch[row][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1) == 1
            starts, anchors, places = starts[keep], anchors[keep], places[keep]
            if not len(starts):
                continue
            hot = np.ones(len(starts), bool)
            for row in range(ROWS):
                hot &= _met_in(hot_cells[row], _cells(anchors, row, bits))
            whole = gram_hashes(words, window)[starts]
            cut = np.flatnonzero((np.diff(places) != 0) | (np.diff(starts) != 1)) + 1
            edges = np.concatenate([[0], cut, [len(starts)]])
            docs = np.searchsorted(offsets, starts, "right") - 1
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                doc = int(docs[a])
                if hot[a]:
                    runs.append((int(anchors[a]), int(places[a] - starts[a]), whole[a:b].tobytes(), first + doc, int(starts[a] - offsets[doc])))
                    continue
                seen.setdefault((int(anchors[a]), int(places[a] - starts[a]), whole[a:b].tobytes()), []).append((first + doc, int(starts[a] - offsets[doc])))
        out = [[] for _ in range(7)]
        for (anchor, offset, whole), where in seen.items():
            key = np.uint64(anchor).view(np.int64).item()
            for doc, start in where:
                lone = len(where) == 1
                row = (key if lone else hash((doc, start, key)), ids[doc], text_ids[doc], start, offset, whole if lone else None, len(whole) // 8)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            if len(where) > 1:  # a witness that stands for all copies in this batch
                for column, value in zip(out, (key, None, None, None, offset, whole, 0), strict=True):
                    column.append(value)
        for key, doc, start, offset, whole, n in _hot_rows(runs):
            key = np.uint64(key & 0xFFFFFFFFFFFFFFFF).view(np.int64).item()
            row = (key, None if doc is None else ids[doc], None if doc is None else text_ids[doc], start, offset, whole, n)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        types = [pa.int64(), batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["anchor", "doc_id", "text_id", "start", "offset", "whole", "n"])


def _repeated(batches):
    """Rows sorted by anchor -> windows that occur twice, as (doc_id, text_id, start, n) runs."""
    held: list[dict] = []

    def settle(rows, out):
        """rows of one anchor."""
        times: dict[bytes, int] = {}
        for r in rows:
            for i in range(0, len(r["whole"]), 8):
                w = (r["offset"] - i // 8, r["whole"][i : i + 8])
                times[w] = times.get(w, 0) + (1 if r["n"] else 2)
        for r in rows:
            if r["n"]:
                run = None
                for i in range(0, len(r["whole"]) + 8, 8):
                    again = i < len(r["whole"]) and times[(r["offset"] - i // 8, r["whole"][i : i + 8])] > 1
                    if again and run is None:
                        run = i // 8
                    elif not again and run is not None:
                        out.append((r["doc_id"], r["text_id"], r["start"] + run, i // 8 - run))
                        run = None

    def batch_of(out, kind):
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32())], ["doc_id", "text_id", "start", "n"])

    kind, key = None, None
    for batch in batches:
        kind, out = batch.schema.field("doc_id").type, []
        for r in batch.to_pylist():
            if r["whole"] is None:
                out.append((r["doc_id"], r["text_id"], r["start"], r["n"]))
                continue
            if r["anchor"] != key:
                settle(held, out)
                held, key = [], r["anchor"]
            held.append(r)
            if len(held) >= HELD:  # settle what is known, keep one witness of each row's windows
                _thin(held, out, settle)
        yield batch_of(out, kind)
    if kind is not None:
        out = []
        settle(held, out)
        yield batch_of(out, kind)


#: Rows of one anchor that are held before they are thinned.
HELD = 20_000


def _thin(held: list[dict], out: list, settle) -> None:
    """Thin a long group: rows all of whose windows are known to repeat leave with their result; witnesses stay."""
    times: dict[tuple, int] = {}
    for r in held:
        for i in range(0, len(r["whole"]), 8):
            w = (r["offset"] - i // 8, r["whole"][i : i + 8])
            times[w] = times.get(w, 0) + (1 if r["n"] else 2)
    kept, witnessed = [], set()
    for r in held:
        wins = [(r["offset"] - i // 8, r["whole"][i : i + 8]) for i in range(0, len(r["whole"]), 8)]
        if all(times[w] > 1 for w in wins):
            if r["n"]:
                out.append((r["doc_id"], r["text_id"], r["start"], r["n"]))
            if not witnessed.issuperset(wins):
                witnessed.update(wins)
                kept.append(r | {"n": 0})
        else:
            kept.append(r)
    held[:] = kept


def _kept(batches, window: int):
    """Texts with their repeated windows -> counts and the words that stay."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            words = spaced_words(text)
            if runs:
                gone = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    gone[r["start"]] += 1
                    gone[r["start"] + r["n"] + window - 1] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            else:
                left = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())], ["doc_id", "text_id", "n_words", "n_removed", "kept_sha256", "kept"])


def deduplicate(docs: DataFrame, window: int = WINDOW, max_cells: int = 1 << 30) -> DataFrame:
    """doc_id, text_id, n_words, n_removed, kept_sha256, kept (bytes of the kept words joined by a space).

    docs: doc_id, text; other columns are not read. Null, empty and short texts (under window words) keep all
    their words. Rows with the same doc_id and text are separate places: each repeats the other.
    """
    spark = docs.sparkSession
    read = keyed(docs)
    doc_id = read.schema["doc_id"].dataType.simpleString()
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(16, min(int(max_cells).bit_length() - 1, int(4 * chars / CHARS_PER_ANCHOR).bit_length()))
    parts = read.select("text").mapInArrow(lambda it: _sketch(it, window, bits), "block bigint, once binary, often binary, times binary")
    merged = parts.repartition("block").mapInArrow(_merged, "block bigint, bits binary, hot binary")
    sketch = [np.zeros(1 << bits - 3, np.uint8) for _ in range(ROWS)]
    hot: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
    for row in merged.toLocalIterator():  # at most ROWS * max_cells / 8 bytes, and a cell for every HOT anchors of the text
        at = (row["block"] & 0xFFFFFFFF) * (BLOCK // 8)
        sketch[row["block"] >> 32][at : at + BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
        hot[row["block"] >> 32].append((row["block"] & 0xFFFFFFFF) * BLOCK + np.frombuffer(row["hot"], np.uint16).astype(np.int64))
    shared = spark.sparkContext.broadcast((sketch, [np.sort(np.concatenate([np.zeros(0, np.int64), *x])) for x in hot]))
    names = f"anchor bigint, doc_id {doc_id}, text_id bigint, start bigint, offset int, whole binary, n int"
    # written before they are dealt: which rows stand for others depends on the batch that they came in, and a task that
    # is done again may get its texts in another order
    suspects = staged(read.mapInArrow(lambda it: _suspects(it, window, bits, *shared.value), names), "zstd")
    runs = suspects.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeated, f"doc_id {doc_id}, text_id bigint, start bigint, n int")
    runs = runs.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    both = read.join(runs, same_row(read, runs), "left").select(read["doc_id"], read["text_id"], "text", "runs")
    return both.mapInArrow(lambda it: _kept(it, window), f"doc_id {doc_id}, text_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
places as (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from w),
windows as (select doc_id, i, count(*) over (partition by array_to_string(w[i:i+{WINDOW - 1}], ' ')) as times from places),
gone as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as p from windows where times > 1),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from w),
kept as (select s.doc_id, count(*) as n_words, count(g.p) as n_removed, string_agg(s.x, ' ' order by s.p) filter (where g.p is null) as kept from words s left join gone g on g.doc_id = s.doc_id and g.p = s.p group by s.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join kept k on k.doc_id = d.doc_id
"""
