"""Benchmark decontamination by winnowing.

From every GRAMS consecutive k-grams (5 words) the least hash is kept, on both sides. A span of
SPAN = K + GRAMS - 1 = 10 words that both sides share is one such window on both sides, so both keep
the same gram of it: joining the kept grams finds every shared span. Each joined pair is extended to
the left and right by comparing the words themselves, so the result is exact. Items of fewer than
SPAN words are one window: their whole word sequence is looked up instead.

A bitmap of fixed size (BLOOM_BITS) of the benchmark's fingerprints goes to the tasks and drops most
document fingerprints before the join; it never drops a shared one. The join itself is an equi-join
on the fingerprint, so a large benchmark needs no broadcast and a hot passage is split by AQE.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import WordHash, chunks, few_of, folded_words, gram_hashes, keyed, same_row, slide, staged, whole_grams

K, GRAMS, SPAN = 5, 6, 10
BLOOM_BITS = 1 << 23
_CAND = "array<struct<n:int,fp:bigint,pos:int,n_left:int,ctx:string>>"


def _selected(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the kept k-grams: each is the least of some window of GRAMS grams of one text."""
    grams = gram_hashes(words, K)
    if len(grams) < GRAMS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = slide(grams, GRAMS, np.minimum)
    least = np.where(whole_grams(offsets, SPAN, len(least)), least, np.uint64(0))
    padded = np.concatenate([np.zeros(GRAMS - 1, np.uint64), least, np.zeros(GRAMS - 1, np.uint64)])
    most = slide(padded, GRAMS, np.maximum)[: len(grams)]
    at = np.flatnonzero((most == grams) & whole_grams(offsets, K, len(grams)))
    return at, grams[at]


def _context(words: list[bytes], pos: int, n: int) -> tuple[int, str]:
    """Words around a gram, far enough for any window that holds it; n < 0: the -n words of a short item."""
    if n < 0:
        return 0, b" ".join(words[pos : pos - n]).decode()
    low = max(0, pos - (SPAN - K))
    return pos - low, b" ".join(words[low : pos + SPAN]).decode()


def _fingerprints(batches, lengths: list[int], bloom: bytes | None, short_texts: bool):
    """Per text: its id, its word count and its fingerprints. short_texts: texts under SPAN words give their whole sequence."""
    hashes, mask = WordHash(), np.uint64(BLOOM_BITS - 1)
    bits = None if bloom is None else np.unpackbits(np.frombuffer(bloom, np.uint8))
    rows = pa.list_(pa.struct([("n", pa.int32()), ("fp", pa.int64()), ("pos", pa.int32()), ("n_left", pa.int32()), ("ctx", pa.string())]))
    for batch in batches:
        texts = batch.column("text").to_pylist()
        counts, found = [], []
        for _, lists, words, offsets in chunks(texts, folded_words, hashes, keep_words=True):
            at, fps = _selected(words, offsets)
            parts = [(np.full(len(at), K), at, fps)]
            sizes = np.diff(offsets)
            for n in lengths:
                grams = gram_hashes(words, n) ^ np.uint64(0x5851F42D4C957F2D)
                ok = np.zeros(len(grams), bool)
                if short_texts:
                    ok[offsets[:-1][sizes == n]] = True
                else:
                    ok = whole_grams(offsets, n, len(grams))
                where = np.flatnonzero(ok)
                parts.append((np.full(len(where), -n), where, grams[where]))
            if bits is not None:
                parts = [(n[k], at[k], fp[k]) for n, at, fp in parts for k in [bits[(fp & mask).astype(np.int64)] == 1]]
            ns, at, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
            mine = [[] for _ in lists]
            for n, place, doc, fp in zip(ns.tolist(), at.tolist(), (np.searchsorted(offsets, at, "right") - 1).tolist(), fps.view(np.int64).tolist(), strict=True):
                pos = place - int(offsets[doc])
                left, ctx = _context(lists[doc], pos, n)
                mine[doc].append({"n": n, "fp": fp, "pos": pos, "n_left": left, "ctx": ctx})
            counts += sizes.tolist()
            found += mine
        arrays = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array(found, rows)], [*names, "n_words", "cands"])


def _extended(batches):
    """Joined fingerprints -> hit ranges, after comparing words to both sides of the shared gram."""
    for batch in batches:
        out = {"doc_id": [], "text_id": [], "item_id": [], "s": [], "e": []}
        for r in batch.to_pylist():
            if r["n"] != K:
                if r["ctx"] == r["item_ctx"]:
                    s, e = r["pos"], r["pos"] - r["n"]
                else:
                    continue
            else:
                a, b, i, j = r["ctx"].split(" "), r["item_ctx"].split(" "), r["n_left"], r["item_left"]
                left = 0
                while left < min(i, j) and a[i - 1 - left] == b[j - 1 - left]:
                    left += 1
                right = 0
                while right < min(len(a) - i, len(b) - j) and a[i + right] == b[j + right]:
                    right += 1
                if right < K or left + right < SPAN:
                    continue
                s, e = r["pos"] - left, r["pos"] + right
            for k, v in (("doc_id", r["doc_id"]), ("text_id", r["text_id"]), ("item_id", r["item_id"]), ("s", s), ("e", e)):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], batch.schema.field("doc_id").type), pa.array(out["text_id"], pa.int64()), pa.array(out["item_id"], batch.schema.field("item_id").type), pa.array(out["s"], pa.int64()), pa.array(out["e"], pa.int64())], list(out))


def _bitmap(batches):
    """One bitmap of fixed size for a task's fingerprints."""
    bits = np.zeros(BLOOM_BITS, np.uint8)
    for batch in batches:
        fps = np.asarray(batch.column("fp")).view(np.uint64)
        bits[(fps & np.uint64(BLOOM_BITS - 1)).astype(np.int64)] = 1
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_id, n_words, n_hit, items (ids of items with a window in the text), spans (hit word ranges).

    docs: doc_id, text; benchmark: item_id, text; other columns are not read. Null or wordless texts have no
    words and no hits; an empty benchmark hits nothing; repeated rows (same id and text) get the same answer each;
    an item with a null id still marks words but is not listed.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    item_id = _type(items, "item_id")
    item_fps = items.mapInArrow(lambda it: _fingerprints(it, list(range(1, SPAN)), None, True), f"item_id {item_id}, n_words bigint, cands {_CAND}")
    item_fps = staged(item_fps.select("item_id", F.inline("cands")).withColumnsRenamed({"n_left": "item_left", "ctx": "item_ctx"}).drop("pos").distinct())
    bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    for row in item_fps.select("fp").repartition(4).mapInArrow(_bitmap, "bits binary").toLocalIterator():  # four bitmaps of fixed size
        bits |= np.frombuffer(row["bits"], np.uint8)
    bloom = spark.sparkContext.broadcast(bits.tobytes())
    lengths = sorted(-r["n"] for r in item_fps.where("n < 0").select("n").distinct().collect())  # nine at most
    read = keyed(docs)
    doc_id = _type(read, "doc_id")
    seen = staged(read.mapInArrow(lambda it: _fingerprints(it, lengths, bloom.value, False), f"doc_id {doc_id}, text_id bigint, n_words bigint, cands {_CAND}"))
    cands = seen.where(F.size("cands") > 0).select("doc_id", "text_id", F.inline("cands"))
    hits = cands.join(item_fps, ["n", "fp"]).mapInArrow(_extended, f"doc_id {doc_id}, text_id bigint, item_id {item_id}, s bigint, e bigint")
    hits = hits.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["e"]).alias("reach")),
    )["n"]
    base = seen.select("doc_id", "text_id", "n_words")
    joined = base.join(hits, same_row(base, hits), "left").select(base["doc_id"], base["text_id"], "n_words", "items", "spans")
    return joined.select(
        "doc_id", "text_id", "n_words",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast(f"array<{item_id}>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that share no window with the benchmark, all columns kept."""
    return few_of(docs, contamination(docs, benchmark).where("n_hit > 0").select("doc_id", "text_id").distinct(), "left_anti")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with b as (select item_id, {_FOLDED} as w from benchmark), d as (select doc_id, {_FOLDED} as w from documents),
windows as (select distinct item_id, least(len(w), {SPAN}) as n, array_to_string(w[i:i+least(len(w), {SPAN})-1], ' ') as s from (select *, unnest(range(1, greatest(len(w) - {SPAN - 1}, least(len(w), 1)) + 1)) as i from b)),
lengths as (select distinct n from windows),
grams as (select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join lengths)),
hits as (select doc_id, item_id, i, g.n from grams g join windows using (n, s)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered on covered.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""
