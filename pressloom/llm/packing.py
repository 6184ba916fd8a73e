"""Packing by first-fit decreasing, in randomised groups of documents.

A document is its token ids and an end id. It is cut into pieces of SEQUENCE ids and a rest; whole pieces fill
sequences of their own, rests are packed longest first into the first sequence of their group that has room.
A tournament tree over the room that is left in a group's sequences finds that one in a logarithm of steps.
Only piece sizes are shuffled, never text; a group holds about GROUP documents whatever the corpus. Pieces are written
with a number of their own before they are dealt, so a group is drawn from what is in a file: many equal rows are spread
over the groups too, and a task that is done again deals as before.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import keyed, staged
from pressloom.llm.tokens import loaded, tokenizer_path

SEQUENCE, END_ID, GROUP, SEED = 2048, 1, 4096, 17


def _pieces(batches, path: str, size: int, end_id: int):
    """Texts -> pieces: start, length and checksum of their ids."""
    tokenizer, end = loaded(path), int(end_id).to_bytes(4, "little")
    for batch in batches:
        rows, out = [], [[] for _ in range(4)]
        for i, ids in enumerate(tokenizer.ids(batch.column("text").to_pylist())):
            ids += end
            n = len(ids) // 4
            for start in range(0, n, size):
                part = ids[4 * start : 4 * (start + size)]
                rows.append(i)
                for column, value in zip(out, (start, len(part) // 4, zlib.crc32(part), n), strict=True):
                    column.append(value)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_id").take(at), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", "text_id", "start", "length", "ids_crc32", "doc_tokens"])


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, text_id, start, length, ids_crc32, doc_tokens, row (a number that no other piece has), written to the shared folder."""
    path, read = tokenizer or tokenizer_path("word_bpe_49k.json"), keyed(docs)
    doc_id = read.schema["doc_id"].dataType.simpleString()
    cut = read.mapInArrow(lambda it: _pieces(it, path, size, end_id), f"doc_id {doc_id}, text_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")
    return staged(cut.withColumn("row", F.monotonically_increasing_id()))


def first_fit(sizes: np.ndarray, room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, in the given order; a size goes to the first bin with room for it."""
    leaves = 1 << max(0, int(max(len(sizes), 1) - 1).bit_length())
    tree = [room] * (2 * leaves)  # tree[i]: the most room below node i
    bins, offsets = [], []
    for size in sizes.tolist():
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(room - tree[node])
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def _packed(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "text_id", "start"], ascending=[False, True, True, True], kind="stable")
    lengths = rows["length"].to_numpy()
    whole = int((lengths == size).sum())  # these come first and need no search
    bins, offsets = first_fit(lengths[whole:], size)
    bins, offsets = np.append(np.arange(whole), np.array(bins, np.int64) + whole), np.append(np.zeros(whole, np.int64), np.array(offsets, np.int64))
    return rows.assign(sequence_id=rows["bucket"] * (1 << 32) + bins, offset=offsets).drop(columns="bucket")


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """A row a piece: doc_id, text_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id, text; other columns are not read. tokenizer: path of a tokenizer file. Null and empty texts are
    the end id alone; repeated rows are packed each; an empty table gives no rows.
    """
    groups = max(1, -(-docs.count() // group))
    cut = pieces(docs, tokenizer, size, end_id)
    doc_id = cut.schema["doc_id"].dataType.simpleString()
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(groups))).drop("row")
    names = f"doc_id {doc_id}, text_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return dealt.groupBy("bucket").applyInPandas(lambda rows: _packed(rows, size), f"{names}, sequence_id bigint, offset bigint")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
