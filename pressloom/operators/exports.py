"""Delivered content: current versions, overlays of edited drafts, refreshed official rows, questions and proofs of packages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_decisions(contents: DataFrame, decisions: DataFrame) -> DataFrame:
    """contents: case_id, content_version, active; decisions: case_id, content_version, ... -> decisions on the current version of active content alone."""
    return decisions.join(contents.where("active").select("case_id", "content_version"), ["case_id", "content_version"], "left_semi")


def overlaid(cases: DataFrame, edits: DataFrame) -> DataFrame:
    """cases: case_id, draft, sources; edits: case_id, edited, extra -> the edited draft where there is one; sources with the extra ones after, each once, in order."""
    both = cases.join(edits, "case_id", "left")
    none = F.array().cast(cases.schema["sources"].dataType)
    return both.select("case_id", F.coalesce("edited", "draft").alias("draft"), F.array_distinct(F.concat(F.coalesce("sources", none), F.coalesce("extra", none))).alias("sources"))


def refreshed(rows: DataFrame, newer: DataFrame) -> DataFrame:
    """rows: id, kind, value; newer: id, value -> newer values where there are any, the rest as it is."""
    new = newer.select("id", F.col("value").alias("_new"))
    return rows.join(new, "id", "left").select("id", "kind", F.coalesce("_new", "value").alias("value"), F.col("_new").isNotNull().alias("replaced"))


def official_first(news: DataFrame, official: DataFrame, key: str = "evidence") -> DataFrame:
    """Union of both by key; an official record wins over a report of the same key."""
    return official.unionByName(news.join(official.select(key), key, "left_anti"))


def case_questions(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers: answer, probe, evidence (array); sources: case_id, evidence -> case_id, answer: answers that cite a source of the case, probes left out.

    The cases of a source travel as one array to the answers that cite it, and each answer drops its repeats by itself:
    pairs are neither shuffled nor sorted. Cases are dealt into so many buckets that an answer meets about GATHERED ids at
    most in one, however many cases a source has and however many sources an answer.
    """
    cited = answers.where(~F.col("probe")).select("answer", F.explode(F.array_distinct("evidence")).alias("evidence"))
    most = sources.groupBy("evidence").count().agg(F.max("count")).first()[0] or 0
    widest = answers.agg(F.max(F.size("evidence"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("case_id"), F.lit(1 + most * max(widest, 0) // GATHERED))
    held = sources.groupBy("evidence", bucket.alias("bucket")).agg(F.collect_set("case_id").alias("cases"))
    met = cited.join(held, "evidence").groupBy("answer", "bucket").agg(F.array_distinct(F.flatten(F.collect_list("cases"))).alias("cases"))
    return met.select(F.explode("cases").alias("case_id"), "answer")


#: Ids of cases that an answer gathers in one bucket.
GATHERED = 1 << 20


def linked_cases(groups: DataFrame, cases: DataFrame) -> DataFrame:
    """groups: group, case_id (nullable); cases: case_id, group -> groups with the case that names them where they have none (the least)."""
    named = cases.groupBy("group").agg(F.min("case_id").alias("_case"))
    return groups.join(named, "group", "left").select("group", F.coalesce("case_id", "_case").alias("case_id"))


def package_proof(packages: DataFrame, claims: DataFrame) -> DataFrame:
    """packages: package, part, text, claim_ids (array); claims: claim, rendered -> package, part, proven: the text is the claims in order joined by a space."""
    placed = packages.select("package", "part", F.posexplode("claim_ids").alias("k", "claim")).join(claims, "claim", "left")
    built = placed.groupBy("package", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "rendered"))), lambda x: x["rendered"]), " ").alias("built"), F.count_if(F.col("rendered").isNull()).alias("unknown"))
    return packages.join(built, ["package", "part"], "left").select("package", "part", F.coalesce((F.col("unknown") == 0) & (F.col("built") == F.col("text")), F.lit(False)).alias("proven"))


def package_problems(packages: DataFrame, claims: DataFrame, questions: DataFrame, parts: tuple[str, ...], title: str) -> DataFrame:
    """packages: package, part, claim_ids (array); claims: claim; questions: package, question -> rule, package: a part that
    selects nothing, a title of other than one claim, a claim twice in a part, one that was not accepted, other than three distinct questions."""
    every = packages.select("package").distinct()
    flat = packages.select("package", "part", F.explode("claim_ids").alias("claim"))
    full = flat.select("package", "part").distinct()
    wanted = every.select("package", F.explode(F.array(*[F.lit(p) for p in parts])).alias("part"))
    asked = every.join(questions.groupBy("package").agg(F.count("*").alias("n"), F.countDistinct("question").alias("k")), "package", "left")
    rules = {
        "part without a claim": wanted.join(full, ["package", "part"], "left_anti"), "title of other than one claim": flat.where(F.col("part") == title).groupBy("package").count().where("count <> 1"), "claim twice": flat.groupBy("package", "part", "claim").count().where("count > 1"),
        "claim that was not accepted": flat.join(claims.select("claim"), "claim", "left_anti"), "not three distinct questions": asked.where(~F.coalesce((F.col("n") == 3) & (F.col("k") == 3), F.lit(False))),
    }
    return reduce(DataFrame.unionByName, [rows.select(F.lit(rule).alias("rule"), "package").distinct() for rule, rows in rules.items()])


def context_label(kind: Column, fields: Column) -> Column:
    """What a link shows for an official record."""
    field = lambda name: F.try_element_at(fields, F.lit(name))
    return F.when(kind == "indicador", field("indicador")).when(kind == "serie_inec", field("serie")).otherwise(F.concat(F.lit("Sismo M"), field("valor")))


def relabelled(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """links: group, evidence; evidence: evidence, kind, fields -> links with the label of the record as it is now."""
    return links.join(evidence.select("evidence", context_label(F.col("kind"), F.col("fields")).alias("label")), "evidence", "left").select("group", "evidence", "label")


def applied_labels(records: DataFrame, reviews: DataFrame, now_us: int) -> DataFrame:
    """records: id, label, hash; reviews: id, new_label, hash, human, us -> id, label, status ('reviewed', 'stale', 'not human', 'bad time', 'original').

    A review replaces the label only if it was made on the record as it is now, by a person, at a known time that has passed.
    """
    r = reviews.select("id", "new_label", F.col("hash").alias("_h"), "human", "us")
    both = records.join(r, "id", "left")
    status = F.when(F.col("new_label").isNull(), "original").when(~F.col("_h").eqNullSafe(F.col("hash")), "stale").when(~F.coalesce("human", F.lit(False)), "not human").when(F.col("us").isNull() | (F.col("us") > now_us), "bad time").otherwise("reviewed")
    return both.select("id", F.when(status == "reviewed", F.col("new_label")).otherwise(F.col("label")).alias("label"), status.alias("status"))


def snapshot_state(listed: DataFrame, found: DataFrame) -> DataFrame:
    """listed: file, hash; found: file, hash -> file, state: 'verified', 'missing', 'mismatched', or 'unsafe' for a name that leaves its folder."""
    f = found.select("file", F.col("hash").alias("_found"))
    both = listed.join(f, "file", "left")
    return both.select("file", F.when(F.col("file").rlike(r"(^/|(^|/)\.\.(/|$))"), "unsafe").when(F.col("_found").isNull(), "missing").when(F.col("_found") != F.col("hash"), "mismatched").otherwise("verified").alias("state"))


def snapshot_verdict(states: DataFrame) -> DataFrame:
    """states: file, state -> one row: 'invalid' with a mismatch or an unsafe name, else 'incomplete' with a missing file or none at all, else 'verified'."""
    counts = states.agg(F.count("*").alias("n"), F.count_if(F.col("state").isin("mismatched", "unsafe")).alias("bad"), F.count_if(F.col("state") == "missing").alias("lost"))
    return counts.select(F.when(F.col("bad") > 0, "invalid").when((F.col("lost") > 0) | (F.col("n") == 0), "incomplete").otherwise("verified").alias("verdict"))


def distinct_versions(versions: DataFrame) -> DataFrame:
    """versions: answer, pos, key, evidence -> the first version of each value key and of each piece of evidence, in order."""
    by_key = versions.groupBy("answer", "key").agg(F.min(F.struct("pos", "evidence")).alias("v")).select("answer", "key", "v.pos", "v.evidence")
    return by_key.groupBy("answer", "evidence").agg(F.min(F.struct("pos", "key")).alias("v")).select("answer", F.col("v.pos").alias("pos"), F.col("v.key").alias("key"), "evidence")


def resolved_answers(answers: DataFrame, claims: DataFrame, versions: DataFrame) -> DataFrame:
    """answers: answer, abstained; claims: answer, claim (verified ones); versions: answer, ... (verified ones) -> state: abstention, contradiction (two versions or more), answered, else abstention."""
    n_claims = claims.groupBy("answer").agg(F.count("*").alias("claims"))
    n_versions = distinct_versions(versions).groupBy("answer").agg(F.count("*").alias("versions"))
    both = answers.join(n_claims, "answer", "left").join(n_versions, "answer", "left").na.fill(0, ["claims", "versions"])
    return both.select("answer", F.when(F.col("abstained"), "abstencion").when(F.col("versions") >= 2, "contradiccion").when(F.col("claims") >= 1, "respondida").otherwise("abstencion").alias("state"), "claims", "versions")


#: Kinds of claims and what stands before their text; a statement names who made it.
CLAIM_PREFIXES = {"declaracion": "Declaración atribuida a ", "inferencia": "Inferencia por verificar: ", "hipotesis": "Hipótesis por verificar: "}


def rendered_claim(kind: Column, author: Column, text: Column) -> Column:
    """A claim as it is shown: statements with their author, inferences and hypotheses marked, facts as they are."""
    prefix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CLAIM_PREFIXES.items() for x in pair]), kind), F.lit(""))
    who = F.when(kind == "declaracion", F.concat(F.coalesce(author, F.lit("")), F.lit(": "))).otherwise("")
    return F.concat(prefix, who, F.coalesce(text, F.lit("")))
