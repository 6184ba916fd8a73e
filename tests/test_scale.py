"""Operators that must hold where one key, day or component has most of the rows, against plain versions."""

from __future__ import annotations

import collections
import difflib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.functions.storage import shared_dir
from pressloom.operators import conflicts, context, coverage, grouping, lexical, metrics, similarity, topics, verify
from pressloom.operators import retrieval
from pressloom.operators.merge import merge_captures
from pressloom.operators.nearest import Cells
from pressloom.operators.ranks import places
from pressloom.plans import views
from pressloom.streaming import jobs


def plain_closest(reports, events, span, tolerance):
    out = {}
    for i, t, m in reports:
        fits = [(abs(t - at), e) for e, at, size in events if t is not None and at is not None and abs(t - at) <= span and (m is None or m == [] or size is not None and any(round(abs(x - size), 1) <= tolerance for x in (m if isinstance(m, list) else [m])))]
        if fits:
            gap, e = min(fits)
            out[i] = (e, gap)
    return out


@pytest.mark.parametrize("listed", [False, True])
@pytest.mark.parametrize("span,extent", [(86400, 40 * 86400), (1000, 900), (50, 20000)])
def test_closest_event(spark, listed, span, extent):
    rng = random.Random(span + listed)
    magnitude = lambda: rng.choice([None, *(round(rng.uniform(3, 6), 1) for _ in range(6))])
    reports = [(i, rng.choice([rng.randrange(extent), 77, None]) if i % 5 == 0 else rng.randrange(extent), (rng.choice([None, [], [magnitude() or 4.0, 5.5]]) if listed else magnitude())) for i in range(400)]
    events = [(e, None if e == 3 else rng.randrange(extent), magnitude()) for e in range(150)] + [(900, 77, 4.0), (901, 77, 4.0)]
    kind = "array<double>" if listed else "double"
    got = context.closest_event(spark.createDataFrame(reports, f"id int, moment long, magnitude {kind}"), spark.createDataFrame(events, "event int, moment long, magnitude double"), span_s=span)
    assert {r["id"]: (r["event"], r["gap"]) for r in got.collect()} == plain_closest(reports, events, span, 0.3)


def test_a_hot_day_makes_no_pairs(spark):
    """20,000 reports and 20,000 events of one day: each report once, and no join of reports with events."""
    reports = spark.range(20000).select("id", (F.col("id") % 86400).alias("moment"), F.lit(None).cast("double").alias("magnitude"))
    events = spark.range(20000).select(F.col("id").alias("event"), (F.col("id") * 4 % 86400).alias("moment"), (F.col("id") % 30 / 10).alias("magnitude"))
    got = context.closest_event(reports, events)
    assert got.count() == 20000 and got.agg(F.max("gap")).first()[0] <= 2


def test_places_of_a_hot_key(spark):
    """Most rows have one key and share values; places are those of a sort, and the key is split over tasks."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50)) for i in range(3000)]
    got = places(spark.createDataFrame(rows, "id int, k string, v int"), ["k"], [F.desc("v"), F.asc("id")], ranges=7).collect()
    by = collections.defaultdict(list)
    for i, k, v in rows:
        by[k].append((-v, i))
    want = {i: (n, len(x)) for x in by.values() for n, (_, i) in enumerate(sorted(x), 1)}
    assert {r["id"]: (r["place"], r["total"]) for r in got} == want
    assert places(spark.createDataFrame([], "id int, k string"), ["k"], [F.asc("id")]).count() == 0


def test_nearest_rank_and_median(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), rng.choice([None, rng.random(), 0.5])) for _ in range(777)] + [("one", 3.0)]
    by = collections.defaultdict(list)
    for k, v in rows:
        if v is not None:
            by[k].append(v)
    want = {k: (len(x), float(np.median(x)), sorted(x)[max(1, -(-95 * len(x) // 100)) - 1]) for k, x in by.items()}
    got = metrics.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "v", 0.95, "k").collect()
    assert {r["k"]: (r["n"], pytest.approx(r["median"]), r["high"]) for r in got} == want


def test_rate_window(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("mmmn"), rng.choice([500, rng.randrange(5000)]), rng.choice(["miss", "miss", "hit"]), rng.randrange(9)) for i in range(600)]
    good = [r for r in rows if r[3] == "miss"]
    want = {i: (sum(1 for r in good if r[1] == m and us - 100 < r[2] <= us), sum(r[4] for r in good if r[1] == m and us - 100 < r[2] <= us)) for i, m, us, _, _ in good}
    got = metrics.rate_window(spark.createDataFrame(rows, "id int, model string, us long, cache string, tokens int"), 100).collect()
    assert {r["id"]: (r["calls"], r["tokens"]) for r in got} == want


def test_rate_window_sweeps_a_hot_cell_once(spark, capsys):
    n = 20000  # a call each microsecond: a frame that lets go of rows would be summed anew for each
    rows = spark.range(n).select("id", F.lit("m").alias("model"), F.col("id").alias("us"), F.lit("miss").alias("cache"), F.lit(1).alias("tokens"))
    out = metrics.rate_window(rows, n)
    out.explain()
    assert "RangeFrame" not in capsys.readouterr().out
    assert out.where((F.col("calls") != F.col("id") + 1) | (F.col("tokens") != F.col("id") + 1)).count() == 0 and out.count() == n
    edges = spark.createDataFrame([(1, "m", 0, "miss", None), (2, "m", 99, "miss", 5), (3, "m", 100, "miss", None), (4, "m", -1, "miss", 2), (5, "m", 5000, "miss", None)], "id int, model string, us long, cache string, tokens int")
    assert {r["id"]: (r["calls"], r["tokens"]) for r in metrics.rate_window(edges, 100).collect()} == {4: (1, 2), 1: (2, 2), 2: (2, 5), 3: (2, 5), 5: (1, None)}


def test_folds_and_outliers(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    sizes = {(r["label"], r["fold"]): r["count"] for r in topics.folds(rows).groupBy("label", "fold").count().collect()}
    assert sizes == {(0, k): 180 for k in range(5)} | {(1, k): 20 for k in range(5)}
    rng = np.random.default_rng(3)
    first, second = rng.integers(10**5, 10**5 + 3000, 150).tolist(), [10**5 + 50, 10**5 + 2999]
    x = sorted(first)
    place = 0.99 * 151
    cut = x[int(place) - 1] + (x[int(place)] - x[int(place) - 1]) * (place - int(place)) - 300
    got = conflicts.id_outliers(spark.createDataFrame([(1, i) for i in first] + [(2, i) for i in second], "month int, id long")).collect()
    assert sorted(r["id"] for r in got) == [i for i in second if i < cut]


CAPTURES = "url string, fetched long, seq int, channel string, title string, published long, modified long"


def captures(rng, n):
    urls = ["https://a.test/x/%d", "http://www.a.test/x/%d/", "https://a.test/x/%d?utm_source=y", "ftp://a.test/x/%d"]
    return [(rng.choice(urls) % rng.randrange(12), rng.randrange(1000), rng.randrange(3), rng.choice(["rss", "web", None]), rng.choice([None, f"t{rng.randrange(5)}"]), rng.choice([None, rng.randrange(900)]), rng.choice([None, rng.randrange(900)])) for _ in range(n)]


def run(spark, source, parts, checkpoint, keep_s, late_s):
    query = jobs.merged_captures(spark.readStream.schema(CAPTURES).parquet(source), parts, checkpoint, keep_s, late_s)
    query.awaitTermination(120)
    assert query.exception() is None


def test_incremental_merge_equals_a_whole_one_after_any_split(spark):
    rng = random.Random(12)
    rows = captures(rng, 120)
    whole = {tuple(r) for r in merge_captures(spark.createDataFrame(rows, CAPTURES)).collect()}
    source, parts, checkpoint = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    for batch in (rows[:50], rows[50:53], rows[53:]):
        spark.createDataFrame(batch, CAPTURES).coalesce(2).write.mode("append").parquet(source)
        run(spark, source, parts, checkpoint, 10**6, 10**6)
    got = jobs.merged(spark, parts, 10**6).collect()
    assert {tuple(r) for r in got} == whole and len(got) == len(whole)


def test_addresses_are_let_go_after_their_window(spark):
    """A timer clears an address whose last capture is too far behind; what comes later begins it anew."""
    source, parts, checkpoint = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    one = lambda url, at: (f"https://a.test/{url}", at, 0, "rss", f"{url}{at}", None, None)
    for batch in ([one("old", 100), one("kept", 950)], [one("new", 5000)], [one("new", 5010)], [one("old", 5020)]):
        spark.createDataFrame(batch, CAPTURES).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, parts, checkpoint, 1000, 500)
    gone = {r["canon"] for r in spark.read.schema(jobs.MERGED).parquet(f"{parts}/*").where("gone").collect()}
    assert {c.rsplit("/", 1)[1] for c in gone} == {"old", "kept"}
    assert {r["title"]: r["captures"] for r in jobs.merged(spark, parts, 10**6).collect()} == {"new5000": 2, "old5020": 1}


def clouds(rng, n):
    """Items around a few directions, many of them copies, over ten windows' time."""
    centres = rng.normal(size=(4, 6))
    rows = []
    for i in range(n):
        v = centres[rng.integers(4)] if rng.random() < 0.3 else centres[rng.integers(4)] + rng.normal(size=6) * 0.35
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 400)), int(rng.integers(0, 10**6))))
    return rows


@pytest.mark.parametrize("told", [False, True])
def test_rounds_of_average_linkage_equal_one_task(spark, told):
    """Components of any size: merged in rounds down to 3 clusters, or in one task."""
    rng = np.random.default_rng(5 + told)
    items = spark.createDataFrame(clouds(rng, 150), "id long, v array<double>, moment long, ord long")
    verdicts = spark.createDataFrame([(int(a), int(b), bool(rng.random() < 0.5)) for a, b in {tuple(sorted(rng.choice(150, 2, replace=False).tolist())) for _ in range(12)}], "a long, b long, same boolean") if told else None
    one, rounds = ({r["id"]: r["group"] for r in grouping.average_link(items, 0.3, 100, verdicts, max_component=most, block=20).collect()} for most in (5000, 3))
    assert one == rounds and 5 < len(set(one.values())) < 140


def test_split_by_time_equals_a_split_by_pairs():
    rng = np.random.default_rng(2)
    for _ in range(50):
        t = rng.integers(0, 60, 30)
        bad = np.abs(t[:, None] - t[None]) > 20
        parted = {}
        for i, j in rng.integers(0, 30, (8, 2)).tolist():
            if i != j:
                bad[i, j] = bad[j, i] = True
                parted.setdefault(i, set()).add(j)
                parted.setdefault(j, set()).add(i)
        assert grouping.split_by_time(t.tolist(), 20, parted) == grouping.split_constrained(np.zeros(30, int), bad).tolist()


def spots(rng, n, spread=0.25):
    """Vectors around eight directions, with copies and one without length."""
    centres = rng.normal(size=(8, 5))
    v = centres[rng.integers(8, size=n)] + rng.normal(size=(n, 5)) * spread * (rng.random((n, 1)) < 0.9)
    v[0] = 0
    return v


def unit_rows(v):
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def vector_table(spark, v, name, at=None):
    return spark.createDataFrame([(i, [float(x) for x in r], 0 if at is None else int(at[i])) for i, r in enumerate(v)], f"{name} long, v array<double>, at long")


@pytest.mark.parametrize("pivots", [1, 6, 40])
def test_cells_find_every_near_pair_and_every_nearest(spark, pivots, monkeypatch):
    rng = np.random.default_rng(pivots)
    x, y = spots(rng, 90), spots(rng, 200)
    monkeypatch.setattr("pressloom.operators.nearest.BLOCK", 17)
    monkeypatch.setattr("pressloom.operators.nearest.QUERIES", 13)
    cos = np.round(unit_rows(x) @ unit_rows(y).T, 6)
    cells = Cells(vector_table(spark, y, "doc"), pivots, cell=2)
    queries = vector_table(spark, x, "query")
    got = {(r["query"], r["doc"]) for r in cells.within(queries, 0.8).collect()}
    assert got == set(map(tuple, np.argwhere(cos >= 0.8).tolist()))
    for k in (1, 7):
        ranked = retrieval.top(cells.nearest(queries, k), k).collect()
        want = {(i, j, r) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(y)), -cos[i]))[:k].tolist(), 1)}
        assert {(r["query"], r["doc"], r["rank"]) for r in ranked} == want
    if pivots > 6:
        assert cells.skipped(queries, 0.9) > 0.3


def test_cells_of_no_vectors(spark):
    none = vector_table(spark, np.ones((1, 5)), "doc").limit(0)
    queries = vector_table(spark, np.ones((3, 5)), "query")
    assert Cells(none).nearest(queries, 2).count() == 0 and Cells(none).within(queries, 0.1).count() == 0
    assert Cells(vector_table(spark, np.ones((3, 5)), "doc")).nearest(queries.limit(0), 2).count() == 0


def test_earlier_similarity(spark):
    rng = np.random.default_rng(9)
    v, at = unit_rows(spots(rng, 150)), rng.integers(0, 30, 150)
    cos = np.round(v @ v.T, 6)
    before = (at[None] < at[:, None]) | ((at[None] == at[:, None]) & (np.arange(150)[None] < np.arange(150)[:, None]))
    want = np.where(before.any(1), np.where(before, cos, -2).max(1), 0)
    groups = vector_table(spark, v, "group", at).withColumnsRenamed({"v": "centroid", "at": "earliest"})
    for pivots in (1, 30):
        got = {r["group"]: r["similarity"] for r in grouping.earlier_similarity(groups, pivots, 3).collect()}
        assert got == {i: pytest.approx(w) for i, w in enumerate(want.tolist())}


def test_more_queries_than_go_to_every_task(spark, monkeypatch):
    """The ranking of distributed queries is that of queries sent to every task."""
    rng = np.random.default_rng(11)
    docs, queries = (vector_table(spark, spots(rng, n), name) for n, name in ((120, "doc"), (60, "query")))
    few = {tuple(r) for r in retrieval.cosine(docs, queries, 5, 0.2).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    assert {tuple(r) for r in retrieval.cosine(docs, queries, 5, 0.2).collect()} == few


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc long, text string")


def test_index_skips_blocks_and_keeps_the_ranking(spark, monkeypatch):
    """Blocks that cannot enter are not read, whatever the query; the ranking is that of all postings."""
    monkeypatch.setattr(lexical, "SHARD", 12)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.choice([3, 20, 200])))) for i in range(300)] + [(900, None), (901, "")]
    queries = spark.createDataFrame([(q, " ".join(rng.sample(words, 3))) for q in range(12)] + [(50, "nothing held"), (51, None)], "query long, text string")
    index = lexical.lexical_index(texts(spark, rows))
    for every in (False, True):
        got = [tuple(r) for r in retrieval.bm25(index, queries, 4, every).orderBy("query", "rank").collect()]
        whole = [tuple(r) for r in retrieval.top(plain_bm25(index, queries, every), 4).orderBy("query", "rank").collect()]
        assert got == whole and got
    took = lexical.Search(index, queries).candidates(4)[1].agg(F.sum("read"), F.sum("shards")).first()
    assert 0 < took[0] < 0.9 * took[1]


def test_a_search_sends_few_documents_of_a_shard(spark, monkeypatch):
    """Every document holds every word asked for; a shard sends the best of a query alone, and lengths are cut without a test for each cut."""
    monkeypatch.setattr(lexical, "SHARD", 50)
    rng = random.Random(6)
    index = lexical.lexical_index(texts(spark, [(i, " ".join(["luna", "costa"] * rng.randint(1, 30))) for i in range(400)]))
    queries = spark.createDataFrame([(q, "luna costa") for q in range(30)], "query long, text string")
    search = lexical.Search(index, queries)
    found, took = search.candidates(3)
    assert 30 * 3 <= found.count() <= 3 * took.agg(F.sum("shards")).first()[0] < 30 * 400 / 3
    assert [tuple(r) for r in retrieval.top(found, 3).orderBy("query", "rank").collect()] == [tuple(r) for r in retrieval.top(plain_bm25(index, queries, False), 3).orderBy("query", "rank").collect()]
    assert len({r["shard"] for r in index.blocks.select("shard").distinct().collect()}) >= 8


def test_a_search_sends_few_documents_of_a_task(spark, monkeypatch):
    """All documents score alike, so no shard can be skipped: what comes back still grows with the tasks, not with the shards, and queries beyond those of a task go to further ones."""
    monkeypatch.setattr(lexical, "SHARD", 10)
    index = lexical.lexical_index(texts(spark, [(i, "luna costa") for i in range(400)]))
    assert index.blocks.select("shard").distinct().count() >= 30
    queries = spark.createDataFrame([(q, "luna costa") for q in range(30)], "query long, text string")
    for held in (lexical.QUERIES, 7):
        monkeypatch.setattr(lexical, "QUERIES", held)
        found = lexical.Search(index, queries).candidates(3)[0]
        assert found.count() <= 3 * 30 * max(spark.sparkContext.defaultParallelism, 2)
        assert [tuple(r)[:2] for r in retrieval.top(found, 3).orderBy("query", "rank").collect()] == [(q, d) for q in range(30) for d in range(3)]


def plain_bm25(index, queries, every):
    asked, posts = lexical.query_terms(queries), index.postings()
    held = posts.join(asked, "term").join(index.frequencies, "term").crossJoin(index.size)
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("len") / F.col("mean")))
    sums = held.groupBy("query", "doc").agg(F.round(F.sum(weight), 6).alias("score"), F.count("*").alias("hits"), F.max("n_terms").alias("n_terms"))
    return sums.where("hits = n_terms" if every else "score > 0").select("query", "doc", "score")


def test_an_index_kept_up_equals_one_built_anew(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("casa perro gato barco nube lluvia".split()) for _ in range(rng.randint(1, 9)))
    now = {i: text() for i in range(40)}
    index = lexical.lexical_index(texts(spark, list(now.items())))
    for _ in range(3):
        changes = [(i, text(), i in now) for i in rng.sample(range(60), 12)] + [(i, None, True) for i in rng.sample(sorted(now), 3)]
        changes = list({c[0]: c for c in changes}.values())
        index = lexical.updated(index, spark.createDataFrame(changes, "doc long, text string, known boolean"))
        for i, t, _ in changes:
            now.pop(i, None)
            if t is not None:
                now[i] = t
    anew = lexical.lexical_index(texts(spark, list(now.items())))
    state = lambda x: (sorted(tuple(r) for r in x.postings().drop("segment").collect()), sorted(tuple(r) for r in x.frequencies.collect()), x.size.first())
    assert state(index) == state(anew) == state(lexical.compacted(index))
    queries = spark.createDataFrame([(1, "casa barco"), (2, "nube")], "query long, text string")
    assert [tuple(r) for r in retrieval.bm25(index, queries, 5).orderBy("query", "rank").collect()] == [tuple(r) for r in retrieval.bm25(anew, queries, 5).orderBy("query", "rank").collect()]


def test_dead_documents_come_with_their_shard(spark, capsys):
    """A search over a changed index takes no posting out of its block before it is scored."""
    index = lexical.updated(lexical.lexical_index(texts(spark, [(i, "casa barco") for i in range(9)])), spark.createDataFrame([(0, "nube", True), (1, None, True)], "doc long, text string, known boolean"))
    assert sorted(tuple(r)[::2] for r in index.dead.collect()) == [(0, 0), (0, 1)]
    found = lexical.Search(index, spark.createDataFrame([(1, "casa"), (2, "nube")], "query long, text string")).candidates(3)[0]
    found.explain()
    assert "inline" not in capsys.readouterr().out
    assert [tuple(r)[:2] for r in retrieval.top(found, 3).orderBy("query", "rank").collect()] == [(1, 2), (1, 3), (1, 4), (2, 0)]


def test_a_kept_index_is_built_once_for_the_same_texts(spark):
    rows = texts(spark, [(1, "una casa"), (2, "un barco azul")])
    lexical.kept_index(rows)
    first = lexical.kept_index(rows.orderBy("doc")).blocks.inputFiles()
    assert sorted(first) == sorted(lexical.kept_index(rows).blocks.inputFiles())
    assert not set(first) & set(lexical.kept_index(texts(spark, [(1, "otra casa")])).blocks.inputFiles())


def test_near_duplicate_arrivals_come_once_and_common_words_are_no_keys(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(10**5), sorted({"el", "la", *(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))})) for i in range(80)]
    source, out = shared_dir(spark), shared_dir(spark)
    frame = spark.createDataFrame(rows, "id long, at long, tokens array<string>").select("id", F.timestamp_seconds("at").alias("ts"), "tokens")
    frame.write.parquet(source)
    common = jobs.common_tokens(frame, 2)
    assert sorted(common) == ["el", "la"]
    query = jobs.near_duplicates(spark.readStream.schema("id long, ts timestamp, tokens array<string>").parquet(source), out, shared_dir(spark), 0.7, 10, common)
    query.awaitTermination(120)
    want = {(i, j) for i, t, a in rows for j, u, b in rows if i != j and (u, j) < (t, i) and t - u <= 36000 and len(set(a) & set(b)) >= 0.7 * len(set(a) | set(b)) - 1e-9}
    got = [tuple(r) for r in spark.read.schema("id long, earlier long").parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_alike_arrivals_are_counted_over_batches_and_copies_make_no_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3 * 10**5), sorted({"el", *(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 9, 9])))})) for i in range(150)]
    rows += [(200 + i, 36000 * (i % 7), ["copia", "el", "mismo", "texto"]) for i in range(140)]  # copies, at the edges of cells
    source, parts, checkpoint = (shared_dir(spark) for _ in range(3))
    frame = spark.createDataFrame(rows, "id long, at long, tokens array<string>").select("id", F.timestamp_seconds("at").alias("ts"), "tokens")
    for k in range(3):  # deliveries out of order of time
        frame.where(F.col("id") % 3 == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, ts timestamp, tokens array<string>").parquet(source)
        assert jobs.alike_arrivals(stream, parts, checkpoint, 0.7, 10, ["b", "el"]).awaitTermination(120)
    want = {}
    for i, t, a in rows:
        met = [j for j, u, b in rows if (u, j) < (t, i) and t - u <= 36000 and len(set(a) & set(b)) >= 0.7 * len(set(a) | set(b)) - 1e-9]
        if met:
            want[i] = (len(met), min(met))
    assert {r["id"]: (r["n"], r["first"]) for r in jobs.earlier_alike(spark, parts, 10).collect()} == want
    links = spark.read.parquet(f"{parts}/links").select("a", "b")
    assert links.where("a = b").count() == 0 and links.count() < 5000


def plain_closest_window(p, t, least):
    best = (least, None)
    starts = [i for i in range(len(t)) if i == 0 or t[i - 1] == " "]
    ends = [i for i in range(1, len(t) + 1) if i == len(t) or t[i] == " "]
    for i in starts:
        for j in ends:
            if i + int(0.8 * len(p)) <= j <= i + 1.2 * len(p) + 1:
                r = difflib.SequenceMatcher(None, t[i:j], p, autojunk=False).ratio()
                if r >= best[0] and (best[1] is None or r > best[0]):
                    best = (r, t[i:j])
    return best[1]


def test_repairs_equal_a_search_of_all_windows():
    rng = random.Random(2)
    words = ["casa", "perro", "gato", "barco", "nube", "lluvia", "sol", "a", "de", "mar"]
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(60))
        start = rng.randrange(40)
        passage = list(" ".join(text.split()[start : start + rng.randint(2, 9)]))
        for _ in range(rng.randint(0, 3)):
            passage[rng.randrange(len(passage))] = rng.choice("xyz ")
        passage = "".join(passage)
        if passage.strip():
            assert verify._closest(passage, text, 0.9) == plain_closest_window(passage, text, 0.9), (passage, text)


def test_repairs_in_a_text_of_a_million_characters():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(180_000))
    at = text.index(" ", len(text) // 2) + 1
    passage = text[at : text.index(" ", at + 150)]
    start = time.process_time()
    assert verify._closest(passage[:70] + "X" + passage[71:], text, 0.9) == passage
    assert time.process_time() - start < 3


def test_texts_are_moved_once_and_shorter_ones_are_no_candidates(spark, monkeypatch):
    """Reports of one text are written once a text, and a text is not fetched for a longer needle that has its rarest words."""
    written, plain = [], coverage.staged
    monkeypatch.setattr(coverage, "staged", lambda d, *a, **k: written.append(plain(d, *a, **k)) or written[-1])
    long, other = "alfa betar gammas deltass " * 40, "zeta etas thetas iotass kappa"
    rows = spark.createDataFrame([(i, i % 2 == 0, "", long if i < 20 else other) for i in range(40)], "id long, own boolean, title string, body string")
    links, held = coverage.classes(rows, with_vectors=False)
    assert sorted(tuple(r) for r in links.join(held, "class").groupBy("id").agg(F.count("*"), F.max("how")).collect()) == [(i, 10, "text") for i in range(1, 40, 2)]
    assert [d.count() for d in written if "text" in d.columns] == [2, 2]
    needles, texts_ = spark.createDataFrame([(1, "de la casa grande y azul")], "id long, text string"), spark.createDataFrame([(7, "la casa grande y"), (8, "x de la casa grande y azul x")], "doc long, text string")
    monkeypatch.setattr(F, "contains", lambda a, b: F.lit(True))
    assert [tuple(r) for r in similarity.containment(needles, texts_).collect()] == [(1, 8)]


def test_any_number_of_short_texts_is_looked_up(spark):
    """Texts of under three tokens, signs and accents among them, in texts that hold them anywhere, across lines too."""
    rng = random.Random(7)
    signs = "ab é!\n¿日"
    short = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 7)))) for i in range(300)]
    short = [(i, t) for i, t in short if len(re.findall("[a-z0-9]+", t)) < 3]
    long = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    got = [tuple(r) for r in similarity.containment(spark.createDataFrame(short, "id int, text string"), spark.createDataFrame(long, "doc int, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, d) for i, t in short for d, u in long if t and t in u}
    assert similarity.containment(spark.createDataFrame([], "id int, text string"), spark.createDataFrame(long, "doc int, text string")).count() == 0


@pytest.mark.parametrize("most", [5000, 20])
def test_groups_of_the_given_vectors_equal_a_plain_clustering(spark, most):
    """All vectors of the smallest tables at once, without components, against the grouping; some pairs are judged by hand."""
    items = views.vectors(spark, "/root/testdata/sf0.001").select("id", "v", "moment", F.col("id").alias("ord")).cache()
    rows = items.orderBy("ord").collect()
    ids, t = [r["id"] for r in rows], np.array([r["moment"] for r in rows])
    v = unit_rows(np.array([r["v"] for r in rows]))
    far = np.abs(t[:, None] - t[None]) > grouping.WINDOW_S
    d, bad = np.round(1 - v @ v.T, 9), far.copy()
    rng = np.random.default_rng(1)
    near = np.argwhere(~far & (d < 0.65) & (np.arange(len(ids))[:, None] < np.arange(len(ids))[None]))
    said = [(ids[i], ids[j], bool(k % 2)) for k, (i, j) in enumerate(near[rng.choice(len(near), min(10, len(near)), replace=False)].tolist())]
    for a, b, same in said:
        i, j = ids.index(a), ids.index(b)
        d[i, j] = d[j, i] = 0.0 if same else 1.0
        bad[i, j] = bad[j, i] = not same
    d[far] = 2.0
    want = grouping.split_constrained(grouping.linkage(d, 0.65), bad)
    got = {r["id"]: r["group"] for r in grouping.average_link(items, 0.65, verdicts=spark.createDataFrame(said, "a long, b long, same boolean"), max_component=most).collect()}
    assert got == {i: ids[g] for i, g in zip(ids, want.tolist(), strict=True)}


def test_rounds_of_average_linkage_write_no_pairs(spark, monkeypatch):
    """What a tile sends of its clusters is their nearest ones; a cluster that has none is met no more."""
    rng = np.random.default_rng(9)
    items = spark.createDataFrame(clouds(rng, 200), "id long, v array<double>, moment long, ord long")
    rows = items.select(F.lit(0).cast("long").alias("component"), F.col("id").alias("k"), "v", "moment", F.col("id").alias("cluster"), F.lit(None).cast("array<struct<k:bigint,s:bigint>>").alias("told"))
    near = grouping._nearest(rows, 0.3, 100, 50).collect()
    assert len(near) == len({r["x"] for r in near}) <= 200
    monkeypatch.setattr(grouping, "STRIP", 7)  # clusters of several strips
    halves = rows.withColumn("cluster", F.expr("k - k % 40"))
    got = {(r["a"], r["b"]): (r["s"], r["c"], r["na"], r["nb"]) for r in grouping._pair_sums(halves, 100, 50).collect()}
    data = {r["k"]: r for r in halves.collect()}
    v = unit_rows(np.array([data[k]["v"] for k in range(200)]))
    d = np.rint((1 - v @ v.T) * grouping.UNIT).astype(int)
    t = np.array([data[k]["moment"] for k in range(200)])
    ok, of = np.abs(t[:, None] - t[None]) <= 100, np.arange(200) // 40 * 40
    for a in range(0, 200, 40):
        for b in range(a + 40, 200, 40):
            both = np.ix_(of == a, of == b)
            s, c, na, nb = got[a, b]
            assert (c, na, nb) == (ok[both].sum(), 40, 40) and abs(s - (d[both] * ok[both]).sum()) < 2000
