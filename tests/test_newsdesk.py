"""Operators of evidence, context, casework and judging on rows made by hand."""

from __future__ import annotations

import random
import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.functions import text as T
from pressloom.functions import urls as U
from pressloom.functions.storage import clear_staged, shared_dir, staged
from pressloom.operators import casework as W
from pressloom.operators import conflicts as K
from pressloom.operators import context as C
from pressloom.operators import coverage as O
from pressloom.operators import evidence as E
from pressloom.operators import judging as J
from pressloom.operators import similarity as S
from pressloom.operators import topics as M
from pressloom.operators import verify as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word, stem", [("elecciones", "eleccion"), ("canales", "canal"), ("barcos", "barco"), ("crisis", "crisis"), ("aguas", "agua"), ("paises", "pais"), ("heroes", "heroe"), ("tres", "tre"), ("mes", "mes"), ("hoteles", "hotel")])
def test_stems(spark, word, stem):
    assert one(spark, T.stem(F.lit(word))) == stem


def test_folding_and_entities_of_any_kind(spark):
    assert one(spark, T.fold_any(F.lit("ÇA Łódź ΣΊΣΥΦΟΣ ﬁ"))) == "ca łodz σισυφοσ fi"
    assert one(spark, T.clean_any(F.lit("<p>caf&eacute; &#x41;&#66;&nbsp;&lt;ok&gt; </p>"))) == "café AB <ok>"
    assert one(spark, T.clean_any(F.lit("<br>"))) is None


def test_agency_is_a_whole_word_as_written(spark):
    said = lambda t, d: one(spark, E.agency(F.lit(t), F.lit(d)))
    assert said("APertura", "nota de AP") == "AP" and said("CAFÉAP", "efe") is None and said("(Europa Press) x", None) == "Europa Press"
    assert one(spark, E.provenance(F.lit("Sin agencia"), F.lit(""), F.lit("La Voz"))) == "La Voz"


@pytest.mark.parametrize(
    "text, found",
    [("Aviso a los viajeros", True), ("cierre el 31 de diciembre", True), ("fue el 1 de enero", False), ("el 31 de febrero de 2030", False), ("el 3 de mayo de 2030", True), ("el 15 de junio", False), ("alertas", False), ("a partir del lunes", True)],
)
def test_future_dates_and_alerts(spark, text, found):
    assert one(spark, E.future_or_alert(F.lit(text), F.lit("2024-06-15").cast("date"))) is found


def test_magnitudes_and_places(spark):
    assert one(spark, C.magnitudes_in(F.lit("Sismo de magnitud 4,5; otro de 5.1 grados y M 6.0, no EM 7"))) == [4.5, 5.1, 6.0]
    foreign = lambda t: one(spark, C.names_another_country(F.lit(t)))
    assert foreign("Temblor en Japón") and not foreign("Temblor en Japón y Chiriquí") and not foreign("Temblor")
    assert one(spark, C.in_country(F.lit("10 km de David"), F.lit(8.4), F.lit(-82.4))) and not one(spark, C.in_country(F.lit("Cali"), F.lit(3.4), F.lit(-76.5)))
    assert one(spark, E.shows_scale(F.lit("pagó $ 5"))) and one(spark, E.shows_scale(F.lit("paro nacional"))) and not one(spark, E.shows_scale(F.lit("la Asamblea Nacional")))


def test_a_rule_falls_back_to_its_second_finder_and_gives_its_reason(spark):
    groups = spark.createDataFrame([(1, "sube el IPC", "economia", 0), (2, "un sismo de magnitud 4", "x", 0), (3, "sube el IPC en Colombia", "economia", 0), (4, "nada", "x", 0)], "id long, text string, topic string, moment long")
    official = spark.createDataFrame([("S-b-2024", {"valor": "1", "periodo": "2024"}), ("S-b-2025", {"valor": "", "periodo": "2025"}), ("S-b-2023", {"valor": "2", "periodo": "2023"})], "evidence string, fields map<string,string>")
    catalog = spark.createDataFrame([("Q1", 86400, 4.3, True), ("Q2", 10, 4.1, False), ("Q3", 20, 5.0, True)], "event string, moment long, magnitude double, home boolean")
    rules = [C.Rule("ipc", ("ipc",), (), (("latest", "S-a-"), ("latest", "S-b-"))), C.Rule("sismo", ("sismo",), (), (("nearest", ""),), "no quake")]
    links, reasons = C.link_context(groups, rules, official, catalog)
    assert {(r["id"], r["evidence"], r["word"]) for r in links.collect()} == {(1, "S-b-2024", "ipc"), (2, "Q1", "sismo")}
    assert {(r["id"], r["reason"]) for r in reasons.collect()} == {(3, C.FOREIGN), (4, C.NONE)}
    for part in (links, reasons):  # texts are read once, beforehand
        assert "text#" not in part._jdf.queryExecution().optimizedPlan().toString()
    table = spark.createDataFrame([(1, "b", ["x"], None, None, None), (0, "a", ["y", "z"], ["t"], [("latest", "P-")], "why")], "ord int, name string, words array<string>, topics array<string>, finders array<struct<kind:string,prefix:string>>, none string")
    assert C.read_rules(table) == [C.Rule("a", ("y", "z"), ("t",), (("latest", "P-"),), "why"), C.Rule("b", ("x",))]


@pytest.mark.parametrize(
    "html, image",
    [
        ('<meta property="og:image" content="https://a.com/1.jpg">', "https://a.com/1.jpg"), ('<meta content="/x.png" name="twitter:image"/>', "https://site.com/x.png"), ('<meta property="og:image" content="y.png">', "https://site.com/news/y.png"), ('<meta property="og:image" content="//cdn.com/z">', "https://cdn.com/z"),
        ('<meta property="og:image" content="data:abc"><meta name="twitter:image" content="http://b.com/2">', "http://b.com/2"), ("<p>none</p>", None), ('<meta name="twitter:image" content="http://b.com/2"><meta property="og:image:secure_url" content="https://s.com/?a=1&amp;b=2">', "https://s.com/?a=1&b=2"),
    ],
)
def test_image_of_a_page(spark, html, image):
    assert one(spark, U.page_image(F.lit(html), F.lit("https://site.com/news/a.html"))) == image


def test_own_outlet(spark):
    own = lambda o, u: one(spark, U.own_outlet(F.lit(o), F.lit(u), ("Mine",), "mine.com"))
    assert own(" MINE ", "http://x.com/") and own("x", "http://www.mine.com:80/a") and own("x", "http://b.mine.com/a") and not own("x", "http://notmine.com/")


def test_every_own_row_counts_towards_what_is_known(spark):
    """Sixty own rows near one external one: a figure of the last is known."""
    v = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [(k, 1, True, f"own report {k}", f"{k + 5000} casas", v(0.001 * k)) for k in range(60)] + [(100, 1, False, "external one", "hay 5059 casas y tres mil personas en 1999", v(0.0)), (101, 2, False, "external two", "hay 5059 casas", v(0.0)), (102, 3, False, "far away", "nada", v(1.5))]
    table = spark.createDataFrame(rows, "id long, group long, own boolean, title string, body string, v array<double>")
    found = O.matches(table)
    assert found.where("id = 100").count() == found.where("id = 101").count() == 60
    got = {r["group"]: (r["state"], r["matched"]) for r in O.assess(table, found).collect()}
    assert got == {1: ("dato_nuevo", 60), 2: ("no_comprobada", 60), 3: ("sin_coincidencia", 0)}


def test_alike_sets_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [f"t{k}" for k in rng.choice(12, rng.integers(0, 9))]) for i in range(120)]
    sets = {i: frozenset(t) for i, t in rows}
    got = {(r["a"], r["b"]) for r in S.set_pairs(spark.createDataFrame(rows, "id long, tokens array<string>")).collect()}
    assert got == {(i, j) for i in sets for j in sets if i < j and sets[i] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])}


def test_containment_takes_short_texts_too(spark):
    short = spark.createDataFrame([(1, "b c d"), (2, "xy"), (3, ""), (4, "no such text")], "id long, text string")
    long = spark.createDataFrame([(7, "a b c d e"), (8, "wxyz b cc d")], "doc long, text string")
    assert {(r["id"], r["doc"]) for r in S.containment(short, long).collect()} == {(1, 7), (2, 8)}


def test_passages_come_back_with_their_brackets(spark):
    cites = spark.createDataFrame([(1, 1, "t", "si x ‹ y y z"), (2, 1, "t", "   ")], "claim long, evidence long, field string, passage string")
    ev = spark.createDataFrame([(1, {"t": "dice: si x < y y z."})], "evidence long, fields map<string,string>")
    assert {r["claim"]: r["found"] for r in X.repaired(cites, ev).collect()} == {1: "si x < y y z", 2: None}


def test_metrics_of_a_sentence(spark):
    text = "El 12 de mayo la inflación anual de alimentos subió 2,3 % y hubo 1.500 muertos en 2020 a las 10:30; otros 32 mil millones dólares."
    said = {(r["key"], r["value"]) for r in K.metrics(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).collect()}
    assert said == {("% alimento", "2.3"), ("% subio", "2.3"), ("unidad muerto", "1500"), ("unidad dolar", "32")}


def test_numbers_that_are_no_figures(spark):
    for text in ("el modelo A-15 llegó", "a las 10:30 horas", "entre 2019/2020 años", "el 3 de junio llegó", "en 1999 casas", "la versión 1.2.3 nueva", "covid19 casos", "15km recorridos"):
        assert K.metrics(spark.createDataFrame([(1, text)], "id int, text string")).count() == 0, text
    far = "subieron 40 " + "de la " * 60 + "toneladas"
    assert [(r["key"], r["value"]) for r in K.metrics(spark.createDataFrame([(1, far)], "id int, text string")).collect()] == [("unidad tonelada", "40")]


def test_dates_go_with_their_verbs(spark):
    text = "El puente se abrirá el 3 de Mayo de 2024 y cerrará. El 4 de junio llegaron todos; el 5 de julio nada. Partir el 6 de agosto"
    got = [(r["pos"], r["key"], r["day"], r["month"], r["year"]) for r in K.dates(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("pos").collect()]
    assert got == [(0, "abrir", 3, "mayo", "2024"), (1, "llega", 4, "junio", None)]


def test_claim_support_counts_a_statement_once(spark):
    claims = spark.createDataFrame([(1, "Uno  dos", True, "h"), (2, "uno dos", True, "h"), (3, "tres", False, "h"), (4, "cuatro", True, "h")], "claim long, text string, cited boolean, hash string")
    reviews = spark.createDataFrame([(1, "h", True, "supported"), (2, "h", True, "unsupported"), (3, "old", True, "supported"), (4, "h", False, "supported")], "claim long, hash string, human boolean, verdict string")
    r = J.claim_support(claims, reviews).first()
    assert (r["claims"], r["covered"], r["reviewed"], r["supported"], r["rejected"], r["coverage"], r["support"], r["meets"]) == (4, 3, 1, 1, 3, 0.75, 1.0, False)


def test_answers_have_the_shape_of_their_state(spark):
    rows = [(1, "respondida", "a b", 1, None, None, 0, ["a", "b"]), (2, "respondida", "a c", 1, None, None, 0, ["a", "b"]), (3, "abstencion", None, 0, "r", "m", 0, []), (4, "contradiccion", None, 0, None, None, 1, []), (5, None, None, 0, None, None, 0, [])]
    got = {(r["rule"], r["id"]) for r in W.answer_problems(spark.createDataFrame(rows, "answer long, state string, text string, n_citations int, reason string, missing string, n_versions int, claims array<string>")).collect()}
    assert got == {("text that is not its claims", "2"), ("contradiction of one version", "4"), ("unknown state", "5")}


def test_the_linear_model_equals_a_plain_solver(spark):
    """Multinomial regression with balanced weights against gradient descent on the same objective."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(loc=m, size=(n, 2)) for m, n in (((0, 0), 40), ((2, 1), 15), ((-1, 2), 25))])
    y = np.repeat([0, 1, 2], [40, 15, 25])
    n, k, c = len(y), 3, 4.0
    weight = n / (k * np.bincount(y)[y])
    w, b = np.zeros((3, 2)), np.zeros(3)
    for _ in range(6000):
        z = x @ w.T + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - np.eye(3)[y]) * weight[:, None] / weight.sum()
        w -= 0.5 * (g.T @ x + w / (c * n))
        b -= 0.5 * g.sum(0)
    want = np.exp(x @ w.T + b)
    want /= want.sum(1, keepdims=True)
    table = spark.createDataFrame([(i, int(t), [float(q) for q in v]) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, label int, v array<double>")
    got = {r["id"]: r for r in M.predict(M.linear_model(table.select("label", "v")), table.select("id", "v")).collect()}
    assert all(abs(got[i]["confidence"] - want[i].max()) < 2e-3 and got[i]["label"] == want[i].argmax() for i in range(n))


def test_staged_folders_can_be_cleared(spark):
    staged(spark.range(3))
    assert clear_staged(spark) >= 1
    kept = staged(spark.range(5))
    assert kept.count() == 5 and "/" in shared_dir(spark)


def test_queries_are_listed_without_a_session():
    """Importing the plans makes no columns: names and SQL can be read before Spark is started."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


@pytest.mark.parametrize("threshold, long", [(0.3, 128), (0.5, 6), (0.8, 6), (0.8, 128)])
def test_alike_sets_by_pairs_of_tokens_equal_brute_force(spark, monkeypatch, threshold, long):
    monkeypatch.setattr(S, "LONG", long)
    rng = random.Random(long)
    base = [rng.sample("abcdefghijklmnop", rng.randint(1, 14)) for _ in range(40)]
    rows = list(enumerate(base + [[w for w in b if rng.random() > 0.1] for b in base]))
    got = {(r["a"], r["b"]) for r in S.set_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), threshold).collect()}
    want = {(i, j) for i, x in rows for j, y in rows if i < j and set(x) and set(y) and len(set(x) & set(y)) >= threshold * len(set(x) | set(y)) - 1e-9}
    assert got == want and want


def test_sets_of_frequent_tokens_seldom_share_a_key(spark):
    rng = random.Random(5)
    words = [f"w{k:03d}" for k in range(300)]
    rows = [(i, sorted(rng.sample(words, 20))) for i in range(200)]
    keys = [set(r["k"]) for r in spark.createDataFrame(rows, "id long, tokens array<string>").select(S.head_keys(F.col("tokens"), 0.8).alias("k")).collect()]
    met = sum(bool(a & b) for i, a in enumerate(keys) for b in keys[:i])
    heads = [set(t[:5]) for _, t in rows]
    assert 2 * met < sum(bool(a & b) for i, a in enumerate(heads) for b in heads[:i])
