"""Operators on rows made by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.operators import conflicts, exports
from pressloom.functions import text as T
from pressloom.functions import urls as U
from pressloom.operators import grouping as G
from pressloom.operators import members as P
from pressloom.operators import scoring as R
from pressloom.operators import similarity as S
from pressloom.operators import verify as X
from pressloom.operators.components import components
from pressloom.operators.merge import merge_captures
from pressloom.sources import readers

H = 3600


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("cell, value", [("1,234.5", 1234.5), ("1.234,5", 1234.5), ("12,5", 12.5), ("-", None), ("..", None), ("", None), ("-3", -3.0)])
def test_statistics_cells(spark, cell, value):
    assert one(spark, T.parse_number(F.lit(cell))) == value


@pytest.mark.parametrize("url, canon", [("HTTPS://WWW.Site.com/a/b/", "site.com/a/b"), ("http://site.com?q=1", "site.com"), ("ftp://site.com/a", "invalid:ftp://site.com/a"), ("http://u@site.com/", "invalid:http://u@site.com/"), ("http://site.com:80/a#b", "site.com:80/a"), ("http://si te.com/", "invalid:http://si te.com/")])
def test_addresses(spark, url, canon):
    assert one(spark, U.canonical_url(F.lit(url))) == canon


def test_periods_and_words(spark):
    assert one(spark, T.spanish_period(F.lit("2026-08"))) == "agosto de 2026"
    assert one(spark, T.spanish_period(F.lit("2026-T2"))) == "segundo trimestre de 2026"
    assert one(spark, T.matched_word(F.lit("La CANCIÓN nueva"), ["cancion"])) == "cancion"
    assert one(spark, T.matched_word(F.lit("canciones"), ["cancion"])) is None
    assert one(spark, T.near_identical(F.array().cast("array<string>"), F.array().cast("array<string>"))) is False


def test_feed_date_before_modification_and_first_title_by_time(spark):
    rows = [("http://a.com/x", 20, 0, "feed", "late", 5, None), ("https://www.a.com/x/", 10, 1, "map", None, None, 7), ("http://a.com/y", 1, 2, "map", "y", None, 9)]
    got = {r["canon"]: r for r in merge_captures(spark.createDataFrame(rows, "url string, fetched long, seq int, channel string, title string, published long, modified long")).collect()}
    assert (got["a.com/x"]["moment"], got["a.com/x"]["origin"], got["a.com/x"]["title"], got["a.com/x"]["channels"], got["a.com/x"]["captures"]) == (5, "feed", "late", "feed+map", 2)
    assert (got["a.com/y"]["moment"], got["a.com/y"]["origin"]) == (9, "lastmod")


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], t, i) for i, v, t in rows], "id long, v array<double>, moment long, ord long")


def angle(d):
    return [np.cos(np.radians(d)), np.sin(np.radians(d))]


def test_the_window_is_inclusive_and_holds_identical_vectors_apart(spark):
    rows = vectors(spark, [(1, (1, 0), 0), (2, (1, 0), 72 * H), (3, (1, 0), 144 * H + 1)])
    assert [tuple(r)[:2] for r in S.window_pairs(rows, 0.9).collect()] == [(1, 2)]


@pytest.mark.parametrize("block", [2000, 2])
def test_window_pairs_against_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, rng.normal(size=3), int(rng.integers(0, 20 * 24 * H))) for i in range(60)]
    want = {(a, b) for a, v, t in rows for b, w, u in rows if a < b and abs(t - u) <= 72 * H and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.5}
    assert {tuple(r)[:2] for r in S.window_pairs(vectors(spark, rows), 0.5, block=block).collect()} == want


def test_average_linkage_does_not_chain(spark):
    rows = vectors(spark, [(1, angle(0), 0), (2, angle(40), H), (3, angle(80), 2 * H)])
    groups = {r["id"]: r["group"] for r in G.average_link(rows, distance=0.275).collect()}
    assert len(set(groups.values())) == 2
    assert len({r["group"] for r in G.single_link(rows, 0.725).collect()}) == 1


def test_a_bridge_cannot_join_reports_out_of_the_window(spark):
    rows = vectors(spark, [(1, (1, 0), 0), (2, (1, 0), 60 * H), (3, (1, 0), 120 * H)])
    groups = {r["id"]: r["group"] for r in G.average_link(rows, distance=2.5).collect()}
    assert groups[1] != groups[3]


def test_verdicts_join_and_part(spark):
    rows = vectors(spark, [(1, angle(0), 0), (2, angle(60), H), (3, angle(1), H)])
    said = spark.createDataFrame([(1, 2, True), (1, 3, False)], "a long, b long, same boolean")
    groups = {r["id"]: r["group"] for r in G.average_link(rows, verdicts=said).collect()}
    assert groups[1] == groups[2] != groups[3]


def test_linkage_against_plain_clustering():
    rng = np.random.default_rng(1)
    for _ in range(20):
        p = rng.normal(size=(9, 2))
        d = np.linalg.norm(p[:, None] - p[None], axis=2)
        clusters = [[i] for i in range(9)]
        while len(clusters) > 1:
            mean = {(a, b): d[np.ix_(clusters[a], clusters[b])].mean() for a in range(len(clusters)) for b in range(a)}
            a, b = min(mean, key=mean.get)
            if mean[a, b] >= 1.1:
                break
            clusters[b] += clusters.pop(a)
        got = G.linkage(d, 1.1)
        assert sorted(map(sorted, clusters)) == sorted([np.flatnonzero(got == g).tolist() for g in set(got)])


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_provenance_follows_the_chain_to_its_source(spark):
    rows = [("g", 1, "a", "A", ["x", "y"], 1), ("g", 2, "b", "B", ["x", "y"], 2), ("g", 3, "c", "C", ["x", "y"], 3), ("g", 4, "d", "D", ["z"], 0), ("h", 5, "e", "E", ["x", "y"], 0)]
    got = {r["id"]: r["provenance"] for r in P.merge_provenances(spark.createDataFrame(rows, "group string, id long, outlet string, provenance string, tokens array<string>, moment long")).collect()}
    assert got == {1: "A", 2: "A", 3: "A", 4: "D", 5: "E"}


def test_scores(spark):
    assert [one(spark, R.urgency(F.lit(h * H), F.lit(False))) for h in (23, 24, 71, 72, 167, 336)] == [1.0, 0.8, 0.6, 0.4, 0.4, 0.1]
    assert [one(spark, R.novelty(F.lit(s), F.lit(False))) for s in (0.4, 0.5, 0.7, 0.95)] == [1.0, 1.0, 0.5, 0.0]
    full = one(spark, R.score(*[F.lit(1.0)] * 5))
    assert (full["score"], full["range"]) == (100.0, "alto")
    assert one(spark, R.score(F.lit(1.0), F.lit(0.4), F.lit(0.0), F.lit(0.0), F.lit(0.0)))["range"] == "medio"


@pytest.mark.parametrize("text, found", [("1,234.5 and 1.234,5", ["1234.5"]), ("12,50 or 12.5", ["12.5"]), ("in 2024: +7, -3 and 0.10", ["2024", "7", "-3", "0.1"]), ("a1 b", [])])
def test_figures(spark, text, found):
    assert one(spark, X.figures(F.lit(text))) == found


def test_repair_of_passages(spark):
    cites = spark.createDataFrame([(1, 1, "t", "El Canal creció"), (2, 1, "t", "EL CANAL CRECIO"), (3, 1, "t", "el canal creció muchos"), (4, 1, "t", "nothing like it at all")], "claim long, evidence long, field string, passage string")
    ev = spark.createDataFrame([(1, {"t": "Hoy El Canal creció mucho este año"})], "evidence long, fields map<string,string>")
    got = {r["claim"]: r["found"] for r in X.repaired(cites, ev).collect()}
    assert got == {1: "El Canal creció", 2: "El Canal creció", 3: "El Canal creció mucho", 4: None}


def test_feeds(spark, tmp_path):
    (tmp_path / "rss.xml").write_text("<rss><channel><item><title>A</title><link>http://a.com/1</link><pubDate>Mon, 03 Aug 2026 10:00:00 -0500</pubDate></item><item><title>B</title><link>http://a.com/2</link><pubDate>Mon, 08/03/2026 - 10:00</pubDate></item><item><title>C</title></item></channel></rss>")
    got = {r["title"]: r for r in readers.read_rss(spark, str(tmp_path / "rss.xml")).selectExpr("title", "unix_seconds(published) s").collect()}
    assert set(got) == {"A", "B"} and got["A"]["s"] == got["B"]["s"] == 1785769200
    (tmp_path / "m.xml").write_text('<urlset><url><loc>http://a.com/1</loc><news:news><news:publication_date>2026-08-03T15:00:00+00:00</news:publication_date><news:title>T</news:title></news:news></url></urlset>')
    assert readers.read_news_sitemap(spark, str(tmp_path / "m.xml")).selectExpr("url", "title", "unix_seconds(published)").first()[:] == ("http://a.com/1", "T", 1785769200)


def test_years_are_carried_to_their_months(spark):
    rows = spark.createDataFrame([("s", 0, "2025", None), ("s", 1, "Enero", "1,5"), ("s", 2, "Febrero", None), ("s", 3, " 2026 ", None), ("s", 4, "Enero", "-")], "sheet string, pos int, label string, value string")
    assert [tuple(r)[1:] for r in readers.carried_years(rows).orderBy("year", "month").collect()] == [("2025", "enero", 1.5, True), ("2025", "febrero", None, False), ("2026", "enero", None, True)]


def test_repeated_keys_are_refused(spark):
    with pytest.raises(ValueError):
        readers.unique_records(spark.createDataFrame([(1,), (1,)], "k long"), "k")


def test_texts_are_read_once_for_both_voices(spark, capsys):
    rows = spark.createDataFrame([(1, "g", "x", "Vendieron 3 cajas. El puente se abrirá el 2 de mayo."), (2, "g", "y", "Vendieron 4 cajas, 4 cajas. El puente se abrirá el 3 de mayo.")], "id long, group string, provenance string, text string").withColumn("day", F.lit("2024-01-01").cast("date"))
    figures, dates = conflicts.figure_conflicts(conflicts.voices(rows), conflicts.metrics(rows)), conflicts.date_conflicts(conflicts.voices(rows), conflicts.dates(rows))
    assert [tuple(r) for r in figures.collect()] == [(1, 2, "unidad caja", ["3"], ["4"])] and [tuple(r) for r in dates.collect()] == [(1, 2, "abrir")]
    figures.explain()
    dates.explain()
    assert "regexp_extract_all" not in capsys.readouterr().out


def test_conflicts_are_judged_where_pairs_are_made(spark, capsys):
    """Groups that are dealt once are not shuffled again, whether by pair or by voice, and give what pairs and readings apart give."""
    said = ["Vendieron 3 cajas con 5 % de descuento.", "Vendieron 4 cajas, 3 cajas con 6 % de descuento.", "Abrirá el 2 de mayo. Cerrará el 1 de junio.", "Abrirá el 2 de mayo de 2020; cerrará el 3 de junio.", "Abrirá el 4 de mayo, abrirá el 2 de mayo de 2021. Nada más.", "Vendieron 9 cajas. Abrirá el 5 de mayo.", "", None]
    rows = spark.createDataFrame([(n, n % 5, f"p{n % 3}", said[n * 7 % len(said)]) for n in range(120)], "id long, group long, provenance string, text string").withColumn("day", F.expr("date_add(date'2024-01-01', int(id % 2))")).repartition(4, "group")
    pairs = conflicts.voices(rows)
    listed = lambda d: sorted(tuple(r) for r in d.collect())
    figures, dates = conflicts.told_figure_conflicts(rows), conflicts.told_date_conflicts(rows)
    for found in (figures, dates):
        found.explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") == 2
    assert listed(figures) == listed(conflicts.figure_conflicts(pairs, conflicts.metrics(rows))) != []
    assert listed(dates) == listed(conflicts.date_conflicts(pairs, conflicts.dates(rows))) != []


@pytest.mark.parametrize("gathered", [1 << 20, 3])
def test_questions_of_cases_shuffle_no_pairs(spark, monkeypatch, capsys, gathered):
    monkeypatch.setattr(exports, "GATHERED", gathered)
    answers = spark.createDataFrame([(1, False, [1, 2, 2]), (2, True, [1]), (3, False, [3]), (4, False, []), (5, False, [9])], "answer long, probe boolean, evidence array<long>")
    sources = spark.createDataFrame([(7, 1), (7, 2), (8, 2), (8, 2), (9, 3)], "case_id long, evidence long")
    pairs = exports.case_questions(answers, sources)
    assert sorted(tuple(r) for r in pairs.collect()) == [(7, 1), (8, 1), (9, 3)]
    pairs.explain()
    assert "hashpartitioning(case_id" not in capsys.readouterr().out
