"""Near-duplicate join: documents whose sets of 5-word shingles have Jaccard similarity of 0.8 or more.

1. Documents with equal shingle sets are one node (a 128-bit hash of the set); copies are counted, never paired.
2. Nodes meet in buckets of 32 bands of 4 MinHash values; at similarity 0.8 a pair misses all with probability 5e-8.
3. In a bucket, pairs are compared value by value, 16 MinHash bytes at a time, and dropped once the posterior
   probability that their similarity reaches the threshold is below TOLERANCE. Survivors give links, and only as
   many as connect the bucket: a pair that is already connected needs no test.
4. Components of these links hold every surviving pair. Inside a component all pairs are verified exactly, in tiles
   of at most two blocks of nodes, by counting common shingles; a tile returns numbers of links for its nodes and
   links that span its verified classes, never the pairs.
5. Components of the verified links are the classes.

Large buckets and components are split into tiles of two blocks, so no task holds more than two blocks of a group.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import WordHash, chunks, few_of, folded_words, gram_hashes, keyed, mixed, same_row, staged
from pressloom.operators.components import components

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
HASHES, BANDS, STEP = 128, 32, 16
BUCKET_BLOCK, CLASS_BLOCK = 4096, 256
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_ROW_SEEDS = mixed(np.arange(101, 101 + HASHES // BANDS, dtype=np.uint64))
_BAND_SEEDS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(texts: list[bytes], hashes: WordHash):
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one of none has none."""
    for _, _, words, offsets in chunks(texts, folded_words, hashes):
        grams = gram_hashes(words, SHINGLE)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            else:
                yield gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """HASHES least values (32 bits) of a set."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, ((shingles[at : at + 1024, None] * _A + _B) >> np.uint64(32)).min(0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, HASHES // BANDS)
    key = _BAND_SEEDS.copy()
    for j in range(rows.shape[1]):
        key = mixed(key ^ (rows[:, j] + _ROW_SEEDS[j]))
    return key


def _sketched(batches):
    hashes = WordHash()
    for batch in batches:
        nodes, sizes, keys, sigs = [], [], [], []
        for shingles in shingle_sets(batch.column("text").to_pylist(), hashes):
            sizes.append(len(shingles))
            if len(shingles):
                least = minhashes(shingles)
                nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                keys.append(band_keys(least).tobytes())
                sigs.append(least.astype(np.uint8).tobytes())
            else:
                for column in (nodes, keys, sigs):
                    column.append(None)
        ids = [batch.column(n) for n in ("doc_id", "text_id")]
        yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x, pa.binary()) for x in (nodes, keys, sigs))], ["doc_id", "text_id", "node", "keys", "sig"])


def _bands(batches):
    for batch in batches:
        nodes, keys = batch.column("node"), batch.column("keys").to_pylist()
        flat = np.frombuffer(b"".join(keys), np.int64)
        at = pa.array(np.repeat(np.arange(len(keys)), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(flat), nodes.take(at)], ["key", "node"])


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After each STEP compared values, the fewest matches that leave P(similarity >= threshold | matches) >= tolerance.

    Uniform prior; a byte of two different values agrees once in 256.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    match = grid + (1 - grid) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(match) + (n - m) * np.log1p(-match)
            p = np.exp(logs - logs.max())
            if p[grid >= threshold].sum() >= tolerance * p.sum():
                out.append(m)
                break
    return out


def survivors(one: np.ndarray, many: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of many that are still candidates for one after all incremental tests."""
    at, matches = np.arange(len(many)), np.zeros(len(many), np.int64)
    for step, need in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        matches += (many[at, part] == one[part]).sum(1)
        ok = matches >= need
        at, matches = at[ok], matches[ok]
        if not len(at):
            break
    return at


def bucket_links(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> list[tuple[int, int]]:
    """Links that connect whatever surviving pairs connect. left, right: which rows may pair with which (both: a whole block)."""
    group = np.arange(len(sigs))
    links = []
    for x in range(1, len(sigs)):
        heads = np.unique(group[:x], return_index=True)[1]
        for pool in (heads, np.arange(x)):  # one of each group first: most rows need no more
            while True:
                pool = pool[group[pool] != group[x]]
                pool = pool[(left[pool] & right[x]) | (right[pool] & left[x])]
                found = survivors(sigs[x], sigs[pool], least) if len(pool) else []
                if not len(found):
                    break
                y = int(pool[found[0]])
                links.append((y, x))
                old, new = group[x], group[y]
                group[: x + 1][group[: x + 1] == old] = new
                pool = pool[found[1:]]
    return links


def grouped(batches, names: tuple[str, ...]):
    """Runs of rows with equal names from sorted batches, as lists of dicts."""
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[n] for n in names)
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def _pruned(batches, least: list[int]):
    a, b = [], []
    for rows in grouped(batches, ("key", "i", "j")):
        sigs = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(len(rows), HASHES)
        left = np.array([r["block"] == r["i"] for r in rows])
        right = np.array([r["block"] == r["j"] for r in rows])
        for x, y in bucket_links(sigs, left, right, least):
            a.append(rows[x]["node"])
            b.append(rows[y]["node"])
        if len(a) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _reshingled(batches):
    hashes = WordHash()
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), hashes)]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sets, pa.binary())], [*names, "shingles"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all pairs of sets, a bounded number of columns at a time."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times[column] > 1
    column, owner = column[shared], owner[shared]
    place = np.cumsum(times > 1) - 1
    column = place[column]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 8192
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verified(batches, threshold: Fraction):
    """Tiles of nodes with their shingles -> per node: weighted number of links, and links that span the verified classes."""
    out: list[tuple] = []

    def batch_of():
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["node", "links", "other"])

    for rows in grouped(batches, ("component", "i", "j")):
        rows = [r for k, r in enumerate(rows) if not k or r["node"] != rows[k - 1]["node"]]  # repeated rows of one document
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        common, sizes = common_counts(sets), np.array([len(s) for s in sets])
        near = common * threshold.denominator >= (sizes[:, None] + sizes[None, :] - common) * threshold.numerator
        np.fill_diagonal(near, False)
        if rows[0]["i"] != rows[0]["j"]:  # only pairs across the two blocks
            first = np.array([r["block"] == r["i"] for r in rows])
            near &= first[:, None] != first[None, :]
        degree = near @ np.array([r["copies"] for r in rows])
        group = np.arange(len(rows))
        for x in range(len(rows)):
            for y in np.flatnonzero(near[x, :x]).tolist():
                if group[x] != group[y]:
                    group[group == group[x]] = group[y]
                    out.append((rows[x]["node"], 0, rows[y]["node"]))
        out += [(r["node"], int(n), None) for r, n in zip(rows, degree.tolist(), strict=True) if n]
        if len(out) >= 50_000:
            yield batch_of()
            out = []
    yield batch_of()


def _tiles(rows: DataFrame, blocks: str, block: str) -> DataFrame:
    """Each row once for every block that its own block meets: tile (i, j) with i <= j."""
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return met.withColumn("i", F.least(block, "other")).withColumn("j", F.greatest(block, "other")).drop("other", blocks)


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, text_id, class_id (least doc_id of the class), n_links (documents that are near this one), first (it is the class's least row).

    docs: doc_id, text; other columns are not read. A text without words (null, empty) links to nothing and is a class of
    its own; a text of fewer than five words is one shingle; repeated rows are copies of each other.
    """
    exact = Fraction(str(threshold))
    read = keyed(docs)
    doc_id = read.schema["doc_id"].dataType.simpleString()
    seen = staged(read.mapInArrow(_sketched, f"doc_id {doc_id}, text_id bigint, node binary, keys binary, sig binary"))
    row = F.struct("doc_id", "text_id")
    known = seen.where("node is not null")
    nodes = staged(known.groupBy("node").agg(F.count("*").alias("copies"), F.min(row).alias("row"), F.max("keys").alias("keys"), F.max("sig").alias("sig")))
    bands = nodes.select("node", "keys").mapInArrow(_bands, "key bigint, node binary")
    crowded = staged(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    # a plain join, so that Spark splits the rows of a hot key; a key's nodes are dealt to blocks by their hash
    blocks = F.ceil(F.col("size") / BUCKET_BLOCK)
    placed = bands.join(crowded.hint("merge"), "key").select("key", "node", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), blocks.alias("blocks"))
    tiles = _tiles(placed, "blocks", "block").join(nodes.select("node", "sig"), "node")
    least = least_matches(threshold, tolerance)
    pruned = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(lambda it: _pruned(it, least), "a binary, b binary")
    cells = components(pruned)
    sizes = cells.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / CLASS_BLOCK)
    cells = cells.join(sizes, "component").select("component", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    cells = staged(cells.join(nodes.select("node", "copies", "row"), "node").select("component", "node", "copies", "block", "blocks", F.col("row.doc_id").alias("doc_id"), F.col("row.text_id").alias("text_id")))
    texts = read.join(cells.hint("merge"), same_row(read, cells)).select("component", "node", "copies", "block", "blocks", "text")
    sets = texts.mapInArrow(_reshingled, "component binary, node binary, copies bigint, block int, blocks bigint, shingles binary")
    sets = _tiles(sets, "blocks", "block").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    verified = staged(sets.mapInArrow(lambda it: _verified(it, exact), "node binary, links bigint, other binary"))
    degrees = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(verified.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    info = nodes.join(degrees, "node", "left").join(classes, "node", "left").select("node", "copies", "row", "links", F.coalesce("component", "node").alias("class"))
    firsts = info.groupBy("class").agg(F.min("row").alias("head"))
    info = info.join(firsts, "class").select("node", "head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    full = seen.select("doc_id", "text_id", "node").join(info, "node", "left")
    return full.select(
        "doc_id", "text_id",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("head").isNull() | row.eqNullSafe(F.col("head"))).alias("first"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class: the least doc_id, all columns kept. Repeated rows count once."""
    kept = few_of(docs, join(docs).where("not first").select("doc_id", "text_id").distinct(), "left_anti")
    if not keyed(docs).groupBy("doc_id", "text_id").count().where("count > 1").isEmpty():  # else no need to shuffle texts
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
near as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where k * 5 >= 4 * (x.n + y.n - k)),
links as (select a as x, b as y from near union all select b, a from near),
walk(id, g) as (select doc_id, doc_id from documents where doc_id in (select x from links) union select y, g from walk join links on x = id),
classes as (select id, min(g) as g from walk group by id),
degrees as (select x, count(*) as n from links group by x)
select d.doc_id, coalesce(g, d.doc_id) as class_id, coalesce(n, 0) as n_links from documents d left join classes on id = d.doc_id left join degrees on x = d.doc_id
"""
