"""Measures over predictions, calls and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions.storage import table
from pressloom.functions.text import unit
from pressloom.operators import metrics as M
from pressloom.operators import topics as T
from pressloom.plans import views as V
from pressloom.plans.intake import ACC

KEYWORDS = {"a": ("the", "and"), "b": ("que", "les"), "c": ("nicht", "und"), "d": ("los", "una")}


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """labels.quality against a guess: enough letters a symbol; every seventh guess is missing."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    symbols = F.length(F.regexp_replace("text", "[^*#$%&!|]", ""))
    both = l.join(d.select("doc_id", "lang", symbols.alias("symbols"), "n_chars"), "doc_id")
    return both.select("doc_id", "lang", (F.col("quality") == 1).alias("truth"), F.when(F.col("doc_id") % 7 != 0, F.col("symbols") * 50 < F.col("n_chars")).alias("predicted"))


PRED = """pred as (select doc_id, lang, quality = 1 as truth, case when doc_id % 7 <> 0 then length(regexp_replace(text, '[^*#$%&!|]', '', 'g')) * 50 < n_chars end as predicted from labels join documents using (doc_id))"""


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts, precision, recall and F1 by language."""
    return M.binary_counts(_predictions(spark, sf), "lang")


CONFUSION = V.with_(PRED) + """, c as (select lang, sum((coalesce(predicted, false) and truth)::int)::bigint as tp, sum((coalesce(predicted, false) and not truth)::int)::bigint as fp, sum((not coalesce(predicted, false) and truth)::int)::bigint as fn,
  sum((not coalesce(predicted, false) and not truth)::int)::bigint as tn, sum((predicted is null)::int)::bigint as missing from pred group by lang), r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as q from c)
select lang, tp, fp, fn, tn, missing, round(p, 6) as precision, round(q, 6) as recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) as f1 from r"""


def _guesses(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).select("lang", F.col("doc_id").alias("id"), F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False)).alias("passed"))


def failures(spark: SparkSession, sf: str) -> DataFrame:
    """Ratio of right guesses by language."""
    return M.ratio(_guesses(spark, sf), "lang")


def failing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The guesses that failed."""
    return M.failing(_guesses(spark, sf), "lang")


_OK = V.with_(PRED) + ", g as (select lang, doc_id as id, coalesce(truth = predicted, false) as ok from pred) "
FAILURES = _OK + "select lang, sum(ok::int)::bigint as passed, count(*) as total, round(sum(ok::int) / count(*), 6) as value from g group by lang"
FAILING = _OK + "select lang, id from g where not ok"


def keyword_report(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword topics against languages, per class with macro F1 last."""
    n = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    name = F.create_map(*[F.lit(x) for p in (("en", "a"), ("fr", "b"), ("de", "c"), ("es", "d")) for x in p])
    rows = n.join(T.keyword_topics(n, KEYWORDS, "none"), "id").select(name[F.col("lang")].alias("truth"), F.col("topic").alias("predicted"))
    classes = spark.createDataFrame([(k,) for k in (*KEYWORDS, "none")], "label string")
    report = M.class_report(rows, classes)
    return report.unionByName(report.agg(F.lit("macro").alias("label"), F.sum("support").alias("support"), F.round(F.avg("precision"), 5).alias("precision"), F.round(F.avg("recall"), 5).alias("recall"), F.round(F.avg("f1"), 5).alias("f1")))


def _hits(words) -> str:
    return " + ".join(f"len(regexp_extract_all({ACC.format('text')}, '{w}'))" for w in words)


KEYWORD_REPORT = f"""with h as (select case lang when 'en' then 'a' when 'fr' then 'b' when 'de' then 'c' else 'd' end as truth, {", ".join(f"{_hits(w)} as h{k}" for k, w in KEYWORDS.items())} from documents),
p as (select truth, case greatest(ha, hb, hc, hd) when 0 then 'none' when ha then 'a' when hb then 'b' when hc then 'c' else 'd' end as predicted from h),
c as (select unnest(['a', 'b', 'c', 'd', 'none']) as label), s as (select label, (select count(*) from p where truth = label) as support, (select count(*) from p where predicted = label) as said, (select count(*) from p where truth = label and predicted = label) as tp from c),
r as (select label, support, coalesce(tp / nullif(said, 0), 0) as p, coalesce(tp / nullif(support, 0), 0) as q from s),
f as (select label, support, round(p, 6) as precision, round(q, 6) as recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) as f1 from r)
select * from f union all select 'macro', sum(support)::bigint, round(avg(precision), 5), round(avg(recall), 5), round(avg(f1), 5) from f"""


def centroid_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest class mean, trained on even ids, for odd ids."""
    v = V.vectors(spark, sf).withColumn("v", unit(F.col("v")))
    return T.nearest_centroid(v.where("id % 2 = 0"), v.where("id % 2 = 1"))


CENTROID = V.with_(V.VECTORS) + """, u as (select id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from vectors),
m as (select label, k, avg(x) as x from (select label, unnest(u) as x, generate_subscripts(u, 1) as k from u where id % 2 = 0) group by label, k), c as (select label, list(x order by k) as m from m group by label)
select id, label, score from (select id, c.label, round(list_dot_product(u.u, c.m) / sqrt(list_dot_product(c.m, c.m)), 6) as score, row_number() over (partition by id order by round(list_dot_product(u.u, c.m) / sqrt(list_dot_product(c.m, c.m)), 6) desc, c.label) as r from u cross join c where id % 2 = 1) where r = 1"""


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """A topic, a confidence and the method that gave them for every document: centroids where there is a vector to judge, else keywords."""
    near = centroid_topics(spark, sf).select("id", F.col("label").cast("string").alias("topic"), F.col("score").alias("confidence"))
    words = T.keyword_topics(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), KEYWORDS, "none")
    return T.classified({"centroid": near, "keywords": words})


CLASSIFIED = f"""with near as ({CENTROID}), h as (select doc_id as id, {", ".join(f"{_hits(w)} as h{k}" for k, w in KEYWORDS.items())} from documents),
p as (select id, case greatest(ha, hb, hc, hd) when 0 then 'none' when ha then 'a' when hb then 'b' when hc then 'c' else 'd' end as topic, round(least(greatest(ha, hb, hc, hd) / 3, 1.0::double), 6) as confidence from h)
select id, label::varchar as topic, score as confidence, 'centroid' as method from near union all select id, topic, confidence, 'keywords' from p where id not in (select id from near)"""


def fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the stratified folds of each class."""
    return T.folds(V.vectors(spark, sf).select("id", "label")).groupBy("label", "fold").agg(F.count("*").alias("n"))


FOLDS = "select label, i as fold, count(*) // 5 + (i < count(*) % 5)::int as n from embeddings cross join range(0, 5) x(i) group by label, i"


def topic_model(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validated linear model over all labelled vectors, its accuracy by class."""
    rows = T.cross_validated(V.vectors(spark, sf).select("id", "label", "v"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("right"))


def call_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Usage by model."""
    return M.usage(V.ledger(spark, sf))


USAGE = V.with_(V.LEDGER) + """select model, sum((cache = 'miss')::int)::bigint as calls, sum((cache <> 'miss')::int)::bigint as hits, sum((cache = 'miss' and status = 'error')::int)::bigint as errors, sum(tokens)::bigint as tokens,
  round(coalesce(quantile_cont(latency, 0.5) filter (where cache = 'miss' and status = 'ok'), 0), 4) as p50, round(coalesce(quantile_cont(latency, 0.95) filter (where cache = 'miss' and status = 'ok'), 0), 4) as p95 from ledger group by model"""


def call_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Units spent since a time."""
    return M.spent(V.ledger(spark, sf), (V.START + 10 * 86400) * 1_000_000)


BUDGET = V.with_(V.LEDGER) + f"select model, sum(case when status = 'error' then 1 else greatest(tokens, 1) end)::bigint as units from ledger where cache = 'miss' and us >= {(V.START + 10 * 86400) * 1_000_000} group by model"


def call_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Most calls and tokens a minute."""
    return M.peaks(V.ledger(spark, sf))


PEAKS = V.with_(V.LEDGER) + "select model, max(c) as calls, max(t)::bigint as tokens from (select model, us // 60000000 as m, count(*) as c, sum(tokens) as t from ledger where cache = 'miss' group by 1, 2) group by model"


def call_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Calls and tokens of the last hour at each call."""
    return M.rate_window(V.ledger(spark, sf), 3_600_000_000)


WINDOWS = V.with_(V.LEDGER) + "select id, model, count(*) over w as calls, (sum(tokens) over w)::bigint as tokens from ledger where cache = 'miss' window w as (partition by model order by us range between 3599999999 preceding and current row)"


def latency_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Median and nearest-rank p95 of latency by model."""
    return M.nearest_rank(V.ledger(spark, sf), "latency", 0.95, "model")


LATENCY = V.with_(V.LEDGER) + """, r as (select model, latency, row_number() over (partition by model order by latency) as k, count(*) over (partition by model) as n from ledger)
select model, max(n) as n, quantile_cont(latency, 0.5) as median, min(latency) filter (where k >= ceil(0.95 * n)) as high from r group by model"""


def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by outcome with token sums, NULL for failures."""
    l = V.ledger(spark, sf)
    return l.groupBy("status", "cache").agg(F.count("*").alias("calls"), F.countDistinct("model").alias("models"), F.sum(F.when(F.col("status") == "ok", F.col("tokens"))).alias("tokens"))


TOKENS = V.with_(V.LEDGER) + "select status, cache, count(*) as calls, count(distinct model) as models, sum(case when status = 'ok' then tokens end)::bigint as tokens from ledger group by 1, 2"

def feed_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of a feed, distinct queries that came back whole, and errors by status; pages are what was fetched."""
    p = table(spark, sf, "pages")
    site = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    status = F.when(F.col("page_id") % 7 == 0, 503).when(F.col("page_id") % 11 == 0, 429).otherwise(200)
    return M.feed_coverage(p.select(site.alias("url"), status.alias("status"), (F.col("page_id") % 3 != 0).alias("complete"), F.when((status != 200) | (F.col("page_id") % 13 == 0), "failed").alias("error")))


FEED_COVERAGE = """with r as (select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as site, case when page_id % 7 = 0 then 503 when page_id % 11 = 0 then 429 else 200 end as status, page_id % 3 <> 0 as complete, page_id % 13 = 0 as failed from pages)
select 'attempts' as measure, 'all' as value, count(*) as n from r union all select 'complete', 'all', count(distinct site) from r where complete union all select 'errors', status::varchar, count(*) from r where status <> 200 or failed group by status"""

QUERIES = {
    "classified": (classified, CLASSIFIED),
    "feed_coverage": (feed_coverage, FEED_COVERAGE),
    "confusion": (confusion, CONFUSION), "failures": (failures, FAILURES), "failing_rows": (failing_rows, FAILING), "keyword_report": (keyword_report, KEYWORD_REPORT), "centroid_topics": (centroid_topics, CENTROID), "fold_sizes": (fold_sizes, FOLDS),
    "topic_model": (topic_model, None), "call_usage": (call_usage, USAGE), "call_budget": (call_budget, BUDGET), "call_peaks": (call_peaks, PEAKS), "call_windows": (call_windows, WINDOWS), "latency_ranks": (latency_ranks, LATENCY), "token_totals": (token_totals, TOKENS),
}
