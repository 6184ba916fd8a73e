"""Best-fit packing in bulk-synchronous rounds over documents and gaps that are sorted by size together.

A document is its token ids and an end id; longer ones are cut into pieces of SEQUENCE ids and a rest. Whole pieces are
sequences of their own. The rests start with as many empty sequences as their ids fill at least; each round then

1. range-sorts rests and gaps together by size, largest first (equal sizes by id, so that a size which a third of all
   rests have still spreads over many tasks);
2. sweeps each range: a rest takes its successor, the least gap of the range that holds it, and what is left of that gap
   goes on within the sweep;
3. settles what found no gap in its own range by rank: the k-th such rest of a range meets the k-th free gap, counted
   from the least, of the ranges before it. Only the numbers of rests and gaps a range travel through the driver;
4. updates the gaps, and opens sequences for the rests that are longer than every gap.

Rounds end when every rest lies somewhere. When what remains fits into one range, the sweep opens sequences itself.
Only ids and sizes are shuffled, never text. Each round is written to the shared folder: a lost task is done again
from files, so nothing depends on the order in which rows arrive.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import staged
from pressloom.llm.packing import END_ID, pieces

SEQUENCE, RANGE_ROWS = 4096, 16_384
#: Kinds of rows: gaps, rests, rests that have got their place, gaps that no later range may use in this round.
GAP, REST, PLACED, LATER = range(4)
_SWEPT = "part int, kind int, id bigint, size int, bin bigint, offset int, idx bigint"


class Gaps:
    """Sequences by the room left in them, with the least room of at least a size found by one bit scan."""

    def __init__(self, size: int):
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask = 0

    def put(self, gap: int, bin_id: int) -> None:
        self.bins[gap].append(bin_id)
        self.mask |= 1 << gap

    def successor(self, size: int) -> tuple[int, int] | None:
        """(room, sequence) of the least room that holds size, taken out."""
        above = self.mask >> size
        if not above:
            return None
        gap = size + (above & -above).bit_length() - 1
        bin_id = self.bins[gap].pop()
        if not self.bins[gap]:
            self.mask ^= 1 << gap
        return gap, bin_id


def sweep(rows, full: int, next_bin: int | None):
    """rows: (kind, size, id), largest first, gaps before rests of their size -> (placed, rests left, gaps left, gaps for later).

    placed: (id, bin, offset); the rest: (id, size). Gaps that are left hold every rest of the ranges after this one;
    those for later have shrunk below that. With next_bin, sequences are opened where no gap is found.
    """
    gaps, placed, left, last = Gaps(full), [], [], 0
    for kind, size, row in rows:
        last = size
        if kind == GAP:
            gaps.put(size, row)
            continue
        found = gaps.successor(size)
        if found is None and next_bin is not None:
            found, next_bin = (full, next_bin), next_bin + 1
        if found is None:
            left.append((row, size))
            continue
        gap, bin_id = found
        placed.append((row, bin_id, full - gap))
        if gap > size:
            gaps.put(gap - size, bin_id)
    free, later = [], []
    for gap in range(full, 0, -1):
        (free if gap >= last else later).extend((b, gap) for b in gaps.bins[gap])
    return placed, left, free, later


def _swept(batches, full: int, next_bin: int | None):
    def rows():
        for batch in batches:
            yield from zip(batch.column("kind").to_pylist(), batch.column("size").to_pylist(), batch.column("id").to_pylist(), strict=True)

    part = TaskContext.get().partitionId()
    placed, left, free, later = sweep(rows(), full, next_bin)
    out = [(part, PLACED, i, 0, b, o, 0) for i, b, o in placed]
    for kind, found in ((REST, left), (GAP, free), (LATER, later)):
        out += [(part, kind, i, s, 0, 0, k) for k, (i, s) in enumerate(found)]
    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["part", "kind", "id", "size", "bin", "offset", "idx"]).astype({"part": "int32", "kind": "int32", "id": "int64", "size": "int32", "bin": "int64", "offset": "int32", "idx": "int64"}), preserve_index=False)


def meetings(left: dict[int, int], free: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Numbers of rests and of gaps left in each range -> (range, first rest, rest after the last, range of the gaps, gap of the first).

    The sweep over ranges: a range's rests take the latest free gaps of the ranges before it, least first.
    """
    stack, out = [], []
    for part in sorted(left.keys() | free.keys()):
        at, need = 0, left.get(part, 0)
        while at < need and stack:
            other, n = stack.pop()
            take = min(need - at, n)
            out.append((part, at, at + take, other, n - 1))
            at += take
            if n > take:
                stack.append((other, n - take))
        if free.get(part):
            stack.append((part, free[part]))
    return out


def _round(rests: DataFrame, gaps: DataFrame, parts: int, full: int, next_bin: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: (placed: id, bin, offset; rests left; gaps left)."""
    spark = rests.sparkSession
    both = gaps.select(F.lit(GAP).alias("kind"), "size", "id").unionByName(rests.select(F.lit(REST).alias("kind"), "size", "id"))
    order = [F.desc("size"), F.asc("kind"), F.asc("id")]
    ranged = both.repartitionByRange(parts, *order) if parts > 1 else both.coalesce(1)
    swept = staged(ranged.sortWithinPartitions(*order).mapInArrow(lambda it: _swept(it, full, next_bin), _SWEPT))
    counts = {GAP: {}, REST: {}}
    for r in swept.where(F.col("kind").isin(GAP, REST)).groupBy("part", "kind").count().collect():  # two rows a range at most
        counts[r["kind"]][r["part"]] = r["count"]
    met = spark.createDataFrame(meetings(counts[REST], counts[GAP]), "of int, first bigint, after bigint, gap_part int, top bigint")
    left = swept.where(F.col("kind") == REST).select("part", "idx", F.col("id").alias("rest"), F.col("size").alias("need"))
    # a range has two meetings more than there are ranges, all ranges together
    left = left.join(F.broadcast(met), (F.col("part") == F.col("of")) & (F.col("idx") >= F.col("first")) & (F.col("idx") < F.col("after")), "left")
    wants = left.where("gap_part is not null").select(F.col("gap_part").alias("p"), (F.col("top") - F.col("idx") + F.col("first")).alias("k"), "rest", "need")
    free = swept.where(F.col("kind") == GAP).select("part", "idx", "id", "size")
    settled = staged(free.join(wants.hint("merge"), (F.col("part") == F.col("p")) & (F.col("idx") == F.col("k")), "left").select("id", "size", "rest", "need"))
    placed = swept.where(F.col("kind") == PLACED).select("id", "bin", "offset")
    placed = placed.unionByName(settled.where("rest is not null").select(F.col("rest").alias("id"), F.col("id").alias("bin"), (full - F.col("size")).alias("offset")))
    room = settled.select("id", (F.col("size") - F.coalesce("need", F.lit(0))).alias("size")).unionByName(swept.where(F.col("kind") == LATER).select("id", "size"))
    return placed, left.where("gap_part is null").select(F.col("rest").alias("id"), F.col("need").alias("size")), room.where("size > 0")


def fit(rests: DataFrame, full: int = SEQUENCE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rests: id (unique), size (1 to full) -> id, bin, offset: sequences of at most full, each gapless from 0."""
    spark = rests.sparkSession
    gaps, parts_done, opened = spark.range(0).select("id", F.lit(full).alias("size")), [], 0
    while True:
        most = gaps.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
        n, total, least, hopeless = rests.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.min("size"), F.coalesce(F.sum(F.when(F.col("size") > most, F.col("size"))), F.lit(0))).first()
        if not n:
            break
        gaps = gaps.where(F.col("size") >= least)  # the others are full for every rest
        rows = n + gaps.count()
        if rows <= range_rows:
            parts, next_bin = 1, opened
        else:
            new = -(-hopeless // full)
            if new:
                gaps = gaps.unionByName(spark.range(opened, opened + new).select("id", F.lit(full).alias("size")))
                opened += new
            parts, next_bin = -(-(rows + new) // range_rows), None
        placed, rests, gaps = _round(rests, gaps, parts, full, next_bin)
        parts_done.append(placed)
    if not parts_done:
        return rests.select("id", F.lit(0).cast("bigint").alias("bin"), F.lit(0).alias("offset"))
    out = parts_done[0]
    for more in parts_done[1:]:
        out = out.unionByName(more)
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, range_rows: int = RANGE_ROWS) -> DataFrame:
    """A row a piece: doc_id, text_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id, text; other columns are not read. tokenizer: path of a tokenizer file. range_rows: rests and gaps that
    one task sweeps. Null and empty texts are the end id alone; repeated rows are packed each; texts of any length are
    packed whole; equal lengths fall where their row's number says; an empty table gives no rows.
    """
    cut = pieces(docs, tokenizer, size, end_id)
    rests = cut.where(F.col("length") < size).select(F.col("row").alias("id"), F.col("length").cast("int").alias("size"))
    at = fit(rests, size, range_rows).withColumnsRenamed({"id": "row", "bin": "sequence_id"})
    whole = cut.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0)})  # numbers that no other sequence has
    some = cut.where(F.col("length") < size).join(at.hint("merge"), "row")
    return whole.unionByName(some).withColumns({"piece": (F.col("start") / size).cast("int"), "offset": F.col("offset").cast("long")}).select("doc_id", "text_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
