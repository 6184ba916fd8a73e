"""Ranked lexical search by the Best Position Algorithm.

Texts are read once for a block of queries: of each document its length and how often it holds the block's terms. The
weights follow from sums over all documents. Then every task takes its documents by shards, orders each term's postings
by impact, and answers every query: it reads the query's lists side by side, scores each document that it meets in full
by direct access to its other postings, and notes it as seen in all lists. The best position of a list is the end of
its unbroken run of seen postings, however these came to be seen; what stands behind it bounds every document not seen
yet. Reading ends when the sum of these bounds is strictly below the k-th score, so ties are met too. The k best of a
shard go on, and the k best of all shards are kept; the window that keeps them cuts its groups before the shuffle.

No list of a term is ever one task's: lists are cut by document, whatever a term's frequency.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.common import folded_words, keyed, staged

K, QUERIES_A_BLOCK, SHARD_POSTINGS, FIRST_READ = 20, 4096, 2_000_000, 16


def _postings(batches, numbers: dict[bytes, int]):
    """Texts -> terms in all, and numbers and counts of the query terms."""
    get = numbers.get
    for batch in batches:
        sizes, ends, terms, times = [], [0], [], []
        for text in batch.column("text").to_pylist():
            words = folded_words(text)
            found = np.array([t for t in map(get, words) if t is not None], np.int32)
            which, count = np.unique(found, return_counts=True)
            sizes.append(len(words))
            terms.append(which)
            times.append(count.astype(np.int32))
            ends.append(ends[-1] + len(which))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (terms, times)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])


class Shard:
    """Postings of some documents by term, greatest impact first, and by document."""

    def __init__(self, order: np.ndarray, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        """order: rank of each document by its id; docs, terms, impacts: the postings, documents in order."""
        self.order, self.terms, self.impacts = order, terms, impacts
        self.starts = np.searchsorted(docs, np.arange(len(order) + 1))
        by_term = np.lexsort((-impacts, terms))
        self.list_docs, self.list_impacts = docs[by_term], impacts[by_term]
        self.lists = np.searchsorted(terms[by_term], np.arange(n_terms + 1))

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Direct access: the whole score of each document. weight: how often the query has each term."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[docs] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.concatenate(([0], np.cumsum(self.impacts[at] * weight[self.terms[at]])))
        return sums[ends] - sums[ends - sizes]

    def best(self, query: dict[int, int], weight: np.ndarray, k: int, read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read in order): the k best scores over 0, ties by the order of ids."""
        lists = [(self.lists[t], self.lists[t + 1], n) for t, n in query.items() if self.lists[t] < self.lists[t + 1]]
        seen = np.zeros(len(self.order), bool)
        bests = [a for a, _, _ in lists]  # of each list the first posting that is not seen
        docs, scores, at, accesses = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        while lists:
            new = np.unique(np.concatenate([self.list_docs[min(a + at, b) : min(a + at + read, b)] for a, b, _ in lists]))
            accesses += sum(min(a + at + read, b) - min(a + at, b) for a, b, _ in lists)
            new = new[~seen[new]]
            seen[new] = True
            docs, scores = np.concatenate((docs, new)), np.concatenate((scores, self.scores(new, weight)))
            bound = 0
            for i, (_, b, n) in enumerate(lists):
                bests[i] = _first_unseen(self.list_docs, seen, max(bests[i], min(lists[i][0] + at + read, b)), b)
                bound += n * int(self.list_impacts[bests[i]]) if bests[i] < b else 0
            at, read = at + read, 2 * read
            if len(docs) > k:
                top = np.lexsort((self.order[docs], -scores))[:k]
                docs, scores = docs[top], scores[top]
            if bound == 0 or len(docs) == k and bound < scores.min():
                break
        top = np.lexsort((self.order[docs], -scores))[:k]
        top = top[scores[top] > 0]
        return docs[top], scores[top], accesses


def _first_unseen(docs: np.ndarray, seen: np.ndarray, start: int, end: int) -> int:
    """Best position: the first place of a list, from start on, whose document is not seen."""
    step = 64
    while start < end:
        part = seen[docs[start : min(start + step, end)]]
        if not part.all():
            return start + int(np.argmin(part))
        start, step = start + len(part), 2 * step
    return end


def _found(batches, queries: list[dict[int, int]], weights: np.ndarray, documents: int, words: int, k: int, shard: int):
    """Documents by shards -> query, doc_id, score of the shard's k best."""

    def answered(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(parts).combine_chunks()
        n = held.column("n").to_numpy()
        terms, times = (held.column(c).combine_chunks() for c in ("terms", "times"))
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        docs, term, tf = np.repeat(np.arange(len(n)), sizes), terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
        m = 100 - 25 + (25 * n * documents) // max(words, 1)
        impacts = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
        order = np.empty(len(n), np.int64)
        order[pc.sort_indices(held.column("doc_id"), null_placement="at_start").to_numpy()] = np.arange(len(n))
        here, weight, out = Shard(order, docs, term, impacts, len(weights)), np.zeros(len(weights), np.int64), []
        for q, query in enumerate(queries):
            weight[list(query)] = list(query.values())
            found, scores, _ = here.best(query, weight, k)
            weight[list(query)] = 0
            out.append((np.full(len(found), q), found, scores))
        q, found, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), held.column("doc_id").combine_chunks().take(pa.array(found)), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    parts, size = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            size += len(batch.column("terms").flatten())
        if size >= shard:
            yield answered(parts)
            parts, size = [], 0
    if parts:
        yield answered(parts)


def _block(docs: DataFrame, items: list[tuple], item_type, k: int, shard: int) -> DataFrame:
    """One block of queries, (item_id, text) each, against all documents."""
    spark, numbers, queries = docs.sparkSession, {}, []
    for _, text in items:
        query: dict[int, int] = {}
        for word in folded_words((text or "").encode()):
            t = numbers.setdefault(word, len(numbers))
            query[t] = query.get(t, 0) + 1
        queries.append(query)
    read = keyed(docs)
    doc_id = read.schema["doc_id"].dataType.simpleString()
    held = staged(read.mapInArrow(lambda it: _postings(it, numbers), f"doc_id {doc_id}, n bigint, terms array<int>, times array<int>").where("n > 0"))
    documents, words = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(numbers), np.int64)
    for t, df in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
        weights[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    found = held.mapInArrow(lambda it: _found(it, queries, weights, documents, words, k, shard), f"query int, doc_id {doc_id}, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id")))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], f"query int, item_id {item_type}")
    return top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # a row a query of the block


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = QUERIES_A_BLOCK, shard: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score over 0 for each item.

    docs: doc_id, text; items: item_id, text; other columns are not read. Items go in blocks of about block (parameter),
    each against all documents; only a block's items reach the driver. shard: postings that a task holds at once. Null
    and empty texts have no terms: such documents count nowhere, such items find nothing. Equal scores come by ascending
    doc_id, null first; repeated documents are ranked each, and a repeated item has a list of its own for every row;
    texts of any length are read whole; empty tables give no rows.
    """
    item_type = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else asked
        found = _block(docs, [(r["item_id"], r["text"]) for r in some.collect()], item_type, k, shard)
        out = found if out is None else out.unionByName(found)
    return out


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns."""
    return search(docs, items)


SQL = r"""
with docs as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from documents
),
asked as (
    select item_id, term, count(*) as times
    from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
    group by item_id, term
),
sizes as (select doc_id, count(*)::bigint as n from docs group by doc_id),
whole as (select count(*)::bigint as total, sum(n)::bigint as words from sizes),
held as (select doc_id, term, count(*)::bigint as tf from docs where term in (select term from asked) group by doc_id, term),
weights as (select term, floor(1000 * ln((2 * max(total) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, whole group by term),
scored as (
    select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total) // words))))::bigint as score
    from asked join held using (term) join weights using (term) join sizes using (doc_id), whole
    group by item_id, doc_id
),
ranked as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::integer as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""
