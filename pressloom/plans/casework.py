"""Cases, the inbox and the checks on what is recorded, over stand-ins out of orders, customers, events and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions.storage import staged, table
from pressloom.functions.text import dot, tokens, unit
from pressloom.operators import casework as W
from pressloom.operators import coverage as O
from pressloom.operators import exports as X
from pressloom.operators import retrieval as R
from pressloom.operators import reviews as D
from pressloom.plans import views as V
from pressloom.plans.editorial import _ALLOWED, STATES
from pressloom.plans.intake import tokens_sql
from pressloom.plans.sourcing import QUAKES

EVIDENCE_STATES = (W.ENOUGH, W.PARTLY, W.TOO_LITTLE)


def _pick(values, k) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values, k: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({k}) % {len(values)} + 1]"


def _range() -> F.Column:
    return F.when(F.col("c_acctbal") < 2000, "bajo").when(F.col("c_acctbal") < 7000, "medio").otherwise("alto")


_RANGE_SQL = "case when c_acctbal < 2000 then 'bajo' when c_acctbal < 7000 then 'medio' else 'alto' end"


def _states(spark: SparkSession, sf: str) -> DataFrame:
    decided = V.reviews(spark, sf)
    return D.current_state(decided, decided.select("case_id").distinct())


REVIEW_STATES = "states as (select case_id, arg_max(state, row(us, seq)) as state from reviews group by case_id)"


def case_records(spark: SparkSession, sf: str) -> DataFrame:
    """Export records of cases. Orders are cases, customers their groups, lines the citations."""
    o, l, c = (table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    cases = o.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("group"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("draft"))
    citations = l.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("evidence"), F.col("l_linestatus").alias("field"), F.col("l_returnflag").alias("passage"))
    groups = c.select(F.col("c_custkey").alias("group"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("topic"), F.struct(F.col("c_acctbal").alias("score"), _range().alias("range")).alias("score"), _pick(EVIDENCE_STATES, F.col("c_nationkey")).alias("state"))
    r = W.case_records(cases, citations, groups, _states(spark, sf))
    first = F.concat_ws(":", F.get("citations", F.lit(0))["evidence"].cast("string"), F.get("citations", F.lit(0))["field"], F.get("citations", F.lit(0))["passage"])
    return r.select("case_id", "title", "topic", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), F.size("citations").alias("citations"), first.alias("first"), F.col("score.score").alias("score"), F.col("score.range").alias("range"), "evidence_state", "draft", "review_state")


RECORDS = V.with_(V.REVIEWS, REVIEW_STATES) + f""", f as (select l_orderkey as k, l_partkey as e, l_linestatus as d, l_returnflag as p, min(l_linenumber) as pos from lineitem group by all),
r as (select *, row_number() over (partition by k order by pos, e, d, p) as rn from f), s as (select k, e, min(rn) as rn from r group by k, e), ss as (select k, string_agg(e::varchar, ',' order by rn) as sources from s group by k),
cc as (select k, count(*) as n, max(case when rn = 1 then e || ':' || d || ':' || p end) as first from r group by k)
select o_orderkey as case_id, c_name as title, c_mktsegment as topic, coalesce(sources, '') as sources, coalesce(n, 0)::int as citations, coalesce(first, '') as first, c_acctbal as score, {_RANGE_SQL} as range, {_pick_sql(EVIDENCE_STATES, 'c_nationkey')} as evidence_state,
  case when o_orderstatus <> 'O' then o_orderpriority end as draft, coalesce(st.state, 'nuevo') as review_state from orders join customer on c_custkey = o_custkey left join ss on ss.k = o_orderkey left join cc on cc.k = o_orderkey left join states st on st.case_id = o_orderkey"""


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("group"), F.when(F.col("c_custkey") % 3 == 0, F.pmod("c_custkey", F.lit(200))).alias("case_id"), F.col("c_mktsegment").alias("topic"), (F.col("c_nationkey") % 4 == 0).alias("covered"), _range().alias("range"), _pick(EVIDENCE_STATES, F.col("c_nationkey")).alias("state"))


def inbox(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that are not covered yet, with counts, image, review state, context and what to do about them. Customers are groups, their orders the members."""
    o, p, s = (table(spark, sf, t) for t in ("orders", "pages", "supplier"))
    members = o.select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("outlet"), F.col("o_orderstatus").alias("provenance"))
    images = p.select((F.col("page_id") * 7).alias("id"), F.col("url").alias("image"))
    context = s.select(F.col("s_suppkey").alias("group"), F.col("s_name").alias("figures"))
    full = W.hydrated_inbox(_groups(spark, sf), members, images, _states(spark, sf), context)
    return W.inbox(full).select("group", "topic", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("outlets", F.lit(0)).alias("outlets"), F.coalesce("provenances", F.lit(0)).alias("provenances"), "image", "review_state", F.array_join("figures", ",").alias("figures"), "investigate", "file_state")


INBOX = V.with_(V.REVIEWS, REVIEW_STATES) + f""", g as (select c_custkey as k, case when c_custkey % 3 = 0 then c_custkey % 200 end as case_id, c_mktsegment as topic, {_RANGE_SQL} as rg, {_pick_sql(EVIDENCE_STATES, 'c_nationkey')} as st from customer where c_nationkey % 4 <> 0),
m as (select o_custkey as k, count(*) as items, count(distinct o_orderpriority) as outlets, count(distinct o_orderstatus) as provenances from orders group by 1), im as (select o_custkey as k, arg_min(url, o_orderkey) as image from orders join pages on page_id * 7 = o_orderkey group by 1)
select g.k as "group", topic, coalesce(items, 0) as items, coalesce(outlets, 0) as outlets, coalesce(provenances, 0) as provenances, image, coalesce(s.state, 'nuevo') as review_state, coalesce(s_name, '') as figures, rg = 'alto' and st = '{W.TOO_LITTLE}' as investigate,
  case when g.case_id is null then '{W.NO_CASE}' else coalesce(s.state, 'nuevo') end as file_state from g left join m using (k) left join im using (k) left join states s on s.case_id = g.case_id left join supplier on s_suppkey = g.k"""


def case_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that take a case file, and those to fall back on; customers are groups, scored by balance."""
    g = _groups(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("group"), F.col("c_acctbal").alias("score")), "group")
    return W.case_groups(g, 40, [F.desc("score"), F.asc("group")])


CASE_GROUPS = f"""with g as (select c_custkey as k, c_acctbal as score, c_nationkey % 4 = 0 as covered, {_pick_sql(EVIDENCE_STATES, 'c_nationkey')} as st from customer),
s as (select k, row_number() over (order by score desc, k) as place from g where not covered and st <> '{W.TOO_LITTLE}')
select 'slot' as role, k as "group", place from s where place <= 40 union all select 'fallback', k, row_number() over (order by score desc, k) from g where st = '{W.TOO_LITTLE}'"""


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What a run made: groups by range and topic, with several items, with context."""
    items = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("group")).agg(F.count("*").alias("items"))
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("group"), F.lit(True).alias("has_context"))
    g = _groups(spark, sf).join(items, "group", "left").join(known, "group", "left").withColumns({"items": F.coalesce("items", F.lit(0)), "has_context": F.coalesce("has_context", F.lit(False))})
    return W.run_summary(g)


SUMMARY = f"""with g as (select {_RANGE_SQL} as rg, c_mktsegment as topic, (select count(*) from orders where o_custkey = c_custkey) as items, c_custkey in (select s_suppkey from supplier) as ctx from customer)
select 'groups' as measure, 'all' as value, count(*) as n from g union all select 'range', rg, count(*) from g group by 2 union all select 'topic', topic, count(*) from g group by 2 union all select 'several', 'all', count(*) filter (where items > 1) from g union all select 'context', 'all', count(*) filter (where ctx) from g"""


def guarded_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed decisions that stand, and what stops the rest."""
    r = V.reviews(spark, sf)
    proposed = r.select(F.col("seq").alias("id"), "case_id", F.when(F.col("seq") % 29 == 0, "otro").otherwise(F.col("state")).alias("state"), F.when(F.col("seq") % 17 == 0, " ").otherwise("a").alias("actor"), F.when(F.col("seq") % 3 == 0, "n").alias("note"), (F.col("case_id") % 4 + F.when(F.col("seq") % 5 == 0, 1).otherwise(0)).alias("version"))
    k = F.col("case_id")
    cases = r.select("case_id").distinct().where("case_id % 31 <> 0").select("case_id", (k % 4).alias("version"), _pick(D.STATES, k).alias("review_state"), _pick(EVIDENCE_STATES, k).alias("evidence_state"), F.when(k % 7 != 0, "text").alias("draft"), (k % 2).alias("pending"))
    return W.guarded(proposed, cases).groupBy("verdict").agg(F.count("*").alias("n"), F.min("id").alias("first"))


GUARDED = V.with_(V.REVIEWS) + f""", p as (select seq as id, case_id as k, case when seq % 29 = 0 then 'otro' else state end as state, seq % 17 = 0 as mute, seq % 3 = 0 as noted, case_id % 4 + (seq % 5 = 0)::int as version, {_pick_sql(D.STATES, 'case_id')} as previous, {_pick_sql(EVIDENCE_STATES, 'case_id')} as ev from reviews),
v as (select id, case when state = 'otro' or mute then 'invalid decision' when k % 31 = 0 then 'unknown case' when version <> k % 4 then 'case has changed' when not ({_ALLOWED}) then 'move not allowed'
  when state = 'en_revision' and previous in ('aprobado_como_borrador', 'descartado') and not noted then 'reopening needs a note' when state = 'requiere_evidencia' and not noted then 'asking for evidence needs a note'
  when state = 'aprobado_como_borrador' and (ev = '{W.TOO_LITTLE}' or k % 7 = 0) then 'nothing to approve' when state = 'aprobado_como_borrador' and (ev = '{W.PARTLY}' or k % 2 > 0) and not noted then 'cautions need a note' else 'accepted' end as verdict from p)
select verdict, count(*) as n, min(id) as first from v group by 1"""


def record_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule that records break, with how often and the first that does."""
    c = table(spark, sf, "conversations").where("turn = 0")
    k = F.col("conv_id")
    text = F.when(k % 3 != 0, F.substring("text", 1, 20))
    answers = c.select(k.alias("answer"), _pick(("respondida", "abstencion", "contradiccion", "otra"), k).alias("state"), text.alias("text"), (k % 2).alias("n_citations"), F.when(k % 5 != 0, "r").alias("reason"), F.when(k % 7 != 0, "m").alias("missing"), (k % 3).alias("n_versions"), F.when(k % 6 == 1, F.split(text, " ")).when(k % 6 == 2, F.array(text, F.lit("more"))).otherwise(F.array().cast("array<string>")).alias("claims"))
    n = table(spark, sf, "nation")
    groups = n.select(F.col("n_nationkey").alias("group"), F.when(F.col("n_nationkey") % 2 == 0, "x").alias("no_context_reason"))
    members = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("group"), F.pmod("s_suppkey", F.lit(50)).alias("id"))
    links = table(spark, sf, "customer").where("c_nationkey % 3 = 0").select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("evidence"))
    q = F.col("c_custkey")
    part = lambda j: (F.pmod(q * j, F.lit(11)) / 10).cast("decimal(6,4)")
    right = F.round(30 * part(1) + 25 * part(2) + 20 * part(3) + 15 * part(4) + 10 * part(5), 2).cast("double")
    score = F.when(q % 13 == 0, right + 1).otherwise(right)
    scores = table(spark, sf, "customer").select(q.alias("group"), (part(1).cast("double") + F.when(q % 19 == 0, 2.0).otherwise(0.0)).alias("r"), *[part(j).cast("double").alias(x) for j, x in ((2, "i"), (3, "u"), (4, "n"), (5, "e"))], score.alias("score"), F.when(q % 17 == 0, "bajo").when(score < 40, "bajo").when(score < 70, "medio").otherwise("alto").alias("range"))
    r = V.reviews(spark, sf).withColumn("actor", F.when(F.col("seq") % 23 != 0, "a"))
    i = F.col("case_id")
    cases = r.select("case_id").distinct().where("case_id % 31 <> 0").select("case_id", _pick(EVIDENCE_STATES, i).alias("evidence_state"), F.when(i % 7 != 0, "text").alias("draft"))
    parts = {"answer": W.answer_problems(answers), "group": W.group_problems(groups, members, links), "score": W.score_problems(scores), "review": W.review_problems(r, cases)}
    every = None
    for kind, rows in parts.items():
        named = rows.withColumn("kind", F.lit(kind))
        every = named if every is None else every.unionByName(named)
    return every.groupBy("kind", "rule").agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("first"))


def _problems_sql() -> str:
    part = lambda j: f"(((c_custkey * {j}) % 11)::decimal(9,4) / 10)::decimal(6,4)"
    rules = [
        ("answer", "unknown state", "select k as id from a where state = 'otra'"), ("answer", "answer without text or citation", "select k from a where state = 'respondida' and (coalesce(trim(t), '') = '' or k % 2 = 0)"),
        ("answer", "abstention that answers", "select k from a where state = 'abstencion' and (coalesce(trim(t), '') <> '' or k % 2 > 0)"), ("answer", "abstention without reason", "select k from a where state = 'abstencion' and k % 5 = 0"),
        ("answer", "abstention without what is missing", "select k from a where state = 'abstencion' and k % 7 = 0"), ("answer", "contradiction of one version", "select k from a where state = 'contradiccion' and k % 3 < 2"),
        ("answer", "text that is not its claims", "select k from a where (k % 6 = 1 and state <> 'respondida') or k % 6 = 2"),
        ("group", "no members", "select n_nationkey from nation where n_nationkey not in (select s_nationkey from supplier)"), ("group", "member twice", "select s_nationkey from supplier group by s_nationkey, s_suppkey % 50 having count(*) > 1"),
        ("group", "context and a reason for none, or neither", "select n_nationkey from nation where (n_nationkey in (select c_nationkey from customer where c_nationkey % 3 = 0)) = (n_nationkey % 2 = 0)"),
        ("score", "part outside 0 to 1", "select k from sc where r not between 0 and 1"), ("score", "score is not its parts", "select k from sc where score <> total"), ("score", "range is not the score's", "select k from sc where rg <> case when score < 40 then 'bajo' when score < 70 then 'medio' else 'alto' end"),
        ("review", "no actor", "select seq from reviews where seq % 23 = 0"), ("review", "case without a file", "select seq from reviews where case_id % 31 = 0"), ("review", "approved on too little evidence", "select seq from reviews where state = 'aprobado_como_borrador' and case_id % 31 <> 0 and case_id % 3 = 2"),
        ("review", "approved without a draft", "select seq from reviews where state = 'aprobado_como_borrador' and case_id % 31 <> 0 and case_id % 7 = 0"), ("review", "move that is not allowed", f"select seq from (select *, lag(state) over (partition by case_id order by us, seq) as previous from reviews) where previous is not null and not ({_ALLOWED})"),
    ]
    total = " + ".join(f"{w} * {part(j)}" for w, j in zip((30, 25, 20, 15, 10), (2, 2, 3, 4, 5), strict=True)).replace(f"30 * {part(2)}", f"30 * {part(1)}", 1)
    stored = f"round({total} + case when c_custkey % 19 = 0 then 60 else 0 end, 2)::double"
    right = f"round({total}, 2)::double"
    ctes = [V.REVIEWS, f"a as (select conv_id as k, {_pick_sql(('respondida', 'abstencion', 'contradiccion', 'otra'), 'conv_id')} as state, case when conv_id % 3 <> 0 then substr(text, 1, 20) end as t from conversations where turn = 0)", f"s0 as (select c_custkey as k, {part(1)}::double + case when c_custkey % 19 = 0 then 2 else 0 end as r, {stored} as total, {right} + case when c_custkey % 13 = 0 then 1 else 0 end as score from customer)", "sc as (select *, case when k % 17 = 0 or score < 40 then 'bajo' when score < 70 then 'medio' else 'alto' end as rg from s0)"]
    return V.with_(*ctes) + "select kind, rule, count(*) as n, min(id) as first from (" + " union all ".join(f"select '{kind}' as kind, '{rule.replace(chr(39), chr(39) * 2)}' as rule, id::bigint as id from ({sql.replace('select k from', 'select k as id from', 1) if ' as id' not in sql else sql}) x(id)" for kind, rule, sql in rules) + ") group by 1, 2"


def case_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that an entailment verdict drops, and what each group still lacks."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("claim"), F.pmod("item_id", F.lit(7)).alias("group"))
    verdicts = b.where("claim % 4 <> 3").select("claim", F.when(F.col("claim") % 4 == 0, "no_respaldada").when(F.col("claim") % 4 == 1, "respaldada").alias("verdict"))
    kept = W.entailed(b.select("claim"), verdicts)
    report = kept.join(b, "claim").select("group", "claim", F.col("kept") & (F.col("claim") % 5 != 0), F.when(F.col("claim") % 5 == 0, "citation: not literal").otherwise(F.col("reason")).alias("reasons")).toDF("group", "claim", "kept", "reasons")
    groups = b.select("group").distinct()
    return W.gaps(report, groups.where("group % 2 = 0").select("group", F.lit("too long").alias("error")), groups.select("group", _pick(EVIDENCE_STATES, F.col("group")).alias("state"))).select("group", F.array_join("gaps", "; ").alias("gaps"))


GAPS = f"""with b as (select item_id as c, item_id % 7 as g from benchmark), r as (select g, case when c % 5 = 0 then 'claim without a citation that holds: ' else 'claim not supported: ' end || c as gap from b where c % 5 = 0 or c % 4 = 0
  union select g, 'no package: too long' from b where g % 2 = 0 union select g, 'evidence is ' || {_pick_sql(EVIDENCE_STATES, 'g')} from b where g % 3 <> 0)
select g as "group", string_agg(gap, '; ' order by gap) as gaps from r group by g"""
SCOPES = ("titular", "resumen", "texto")


def text_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """The richest text that a group has."""
    n = V.news(spark, sf).select(F.pmod("id", F.lit(90)).alias("group"), F.when(F.length("body") == 0, SCOPES[0]).when(F.length("body") < 400, SCOPES[1]).otherwise(SCOPES[2]).alias("scope"))
    return W.richest_scope(n, SCOPES)


TEXT_SCOPES = V.with_(V.NEWS) + """, s as (select id % 90 as g, max(case when length(body) = 0 then 1 when length(body) < 400 then 2 else 3 end) as k from news group by 1) select g as "group", ['titular', 'resumen', 'texto'][k] as scope, k <= 1 as headline_only from s"""


def case_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles beside the own sources of a case. Every twentieth report is a case, it and the two after it its sources."""
    d = table(spark, sf, "documents")
    n = V.news(spark, sf).where("id % 20 = 0")
    terms = staged(d.select(F.col("doc_id").alias("doc"), F.array_distinct(tokens(F.col("text"))).alias("terms")))
    ranked = staged(R.bm25(d.select(F.col("doc_id").alias("doc"), "text"), n.select(F.col("id").alias("query"), F.col("title").alias("text")), 60).select(F.col("query").alias("case_id"), "doc", "rank"))
    v = V.vectors(spark, sf).select("id", unit(F.col("v")).alias("v"))
    near = ranked.join(v.select(F.col("id").alias("case_id"), F.col("v").alias("x")), "case_id").join(v.select(F.col("id").alias("doc"), F.col("v").alias("y")), "doc").select("case_id", "doc", F.round(dot(F.col("x"), F.col("y")), 6).alias("cosine"))
    own = n.select(F.col("id").alias("case_id"), F.explode(F.array(F.col("id"), F.col("id") + 1, F.col("id") + 2)).alias("doc"))
    return W.related_articles(n.select(F.col("id").alias("case_id"), F.array_distinct(tokens(F.col("title"))).alias("title_terms")), own, ranked, terms, near, least=0.0)


ARTICLES = V.with_(V.NEWS, V.VECTORS) + f""", toks as (select doc_id as doc, {tokens_sql('text')} as t from documents), post as (select doc, term, len, count(*) as tf from (select doc, len(t) as len, unnest(t) as term from toks) group by all),
stat as (select count(*) as n, avg(len(t)) as mean from toks), c as (select id as q, list_distinct({tokens_sql('title')}) as tt from news where id % 20 = 0), q as (select q, unnest(tt) as term from c), dfs as (select term, count(*) as df from post group by term),
bm as (select q, doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) as score from q join dfs using (term) join post using (term) cross join stat group by q, doc),
rk as (select q, doc, row_number() over (partition by q order by score desc, doc) as rank from bm where score > 0 qualify rank <= 60), held as (select q, doc, list_distinct(t) as t from c join toks on doc between q and q + 2),
common as (select q.q, list(q.term) as topic from q where (select count(*) from held h where h.q = q.q and list_contains(h.t, q.term)) >= 2 group by q.q), topic as (select c.q, case when len(coalesce(topic, [])) >= 2 then topic else tt end as topic from c left join common using (q)),
ok as (select rk.q, rk.doc, rk.rank from rk join topic on topic.q = rk.q join toks on toks.doc = rk.doc join vectors a on a.id = rk.q join vectors b on b.id = rk.doc where not (rk.doc between rk.q and rk.q + 2)
  and round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) >= 0.0 and len(list_intersect(topic, list_distinct(toks.t))) >= least(2, len(topic)))
select q as case_id, doc, row_number() over (partition by q order by rank, doc) as place from ok qualify place <= 4"""

def package_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Packages whose selection of claims cannot stand. Orders are packages, their lines the claims of a part."""
    l = table(spark, sf, "lineitem")
    packages = l.groupBy(F.col("l_orderkey").alias("package"), F.when(F.col("l_linenumber") == 1, "titulo").otherwise(F.col("l_linestatus")).alias("part")).agg(F.collect_list(F.pmod("l_partkey", F.lit(40))).alias("claim_ids"))
    claims = table(spark, sf, "part").where("p_partkey < 38").select(F.col("p_partkey").alias("claim"))
    questions = table(spark, sf, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("package"), F.pmod("l_suppkey", F.lit(9)).alias("question"))
    return X.package_problems(packages, claims, questions, ("titulo", "F", "O"), "titulo").groupBy("rule").agg(F.count("*").alias("n"), F.min("package").alias("first"))


PACKAGES = """with f as (select l_orderkey as k, case when l_linenumber = 1 then 'titulo' else l_linestatus end as part, l_partkey % 40 as c from lineitem), q as (select l_orderkey as k, count(*) as n, count(distinct l_suppkey % 9) as d from lineitem where l_linenumber <= 3 group by 1),
p as (select distinct 'part without a claim' as rule, k from (select distinct k from f) cross join (select unnest(['titulo', 'F', 'O']) as part) where (k, part) not in (select k, part from f) union all select 'title of other than one claim', k from f where part = 'titulo' group by k having count(*) <> 1
  union all select distinct 'claim twice', k from (select k from f group by k, part, c having count(*) > 1) union all select distinct 'claim that was not accepted', k from f where c not in (select p_partkey from part where p_partkey < 38)
  union all select 'not three distinct questions', k from (select distinct k from f) left join q using (k) where not coalesce(n = 3 and d = 3, false))
select rule, count(*) as n, min(k) as first from p group by rule"""


def rescored_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of groups once their coverage is known."""
    q = F.col("c_custkey")
    parts = [F.round(F.pmod(q * j, F.lit(11)) / 10, 1).alias(x) for j, x in ((1, "r"), (2, "i"), (3, "u"), (4, "n"), (5, "e"))]
    return O.rescored(table(spark, sf, "customer").select(q.alias("group"), *parts, _pick(COVERED, F.col("c_nationkey")).alias("coverage")))


COVERED = ("cubierto", "dato_nuevo", "no_comprobada", "sin_coincidencia")
RESCORED = f"""with p as (select c_custkey as g, round(c_custkey % 11 / 10, 1) as r, round(c_custkey * 2 % 11 / 10, 1) as i, round(c_custkey * 3 % 11 / 10, 1) as u, round(c_custkey * 4 % 11 / 10, 1) as n0, round(c_custkey * 5 % 11 / 10, 1) as e, {_pick_sql(COVERED, 'c_nationkey')} as s from customer),
a as (select *, case when s in ('cubierto', 'no_comprobada') then 0.0::double when s = 'dato_nuevo' then least(n0, 0.75::double) else n0 end as n from p),
t as (select *, round(30 * r::decimal(6,4) + 25 * i::decimal(6,4) + 20 * u::decimal(6,4) + 15 * n::decimal(6,4) + 10 * e::decimal(6,4), 2)::double as score from a)
select g as "group", r, i, u, n, e, score, case when score < 40 then 'bajo' when score < 70 then 'medio' else 'alto' end as "range" from t"""


def context_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Links of groups with the labels of the official records as they are now."""
    from pressloom.plans.sourcing import _official

    links = table(spark, sf, "events").select(F.pmod("event_id", F.lit(60)).alias("group"), F.concat(F.lit("USGS-"), F.col("event_id").cast("string")).alias("evidence"))
    more = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("group"), F.concat(F.lit("WB-"), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("-SUP.BAL-2024")).alias("evidence"))
    return X.relabelled(links.union(more), _official(spark, sf)).groupBy("group", "label").agg(F.count("*").alias("n"), F.min("evidence").alias("first"))


LABELS = V.with_(QUAKES) + """, l as (select event_id % 60 as g, 'USGS-' || event_id as e, null as lab from events union all select n_nationkey, 'WB-' || replace(n_name, ' ', '_') || '-SUP.BAL-2024', 'Saldo de proveedores' from nation)
select g as "group", coalesce(lab, 'Sismo M' || replace(printf('%.1f', magnitude), '.', ',')) as label, count(*) as n, min(e) as first from l left join quakes q on q.evidence = l.e group by 1, 2"""

QUERIES = {
    "case_groups": (case_groups, CASE_GROUPS),
    "package_problems": (package_problems, PACKAGES), "rescored_groups": (rescored_groups, RESCORED), "context_labels": (context_labels, LABELS),
    "case_records": (case_records, RECORDS), "inbox": (inbox, INBOX), "run_summary": (run_summary, SUMMARY), "guarded_decisions": (guarded_decisions, GUARDED), "record_problems": (record_problems, _problems_sql()), "case_gaps": (case_gaps, GAPS), "text_scopes": (text_scopes, TEXT_SCOPES), "case_articles": (case_articles, ARTICLES),
}
