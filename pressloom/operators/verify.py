"""Checks over claims and what they cite, as joins that list every problem.

claims: claim, text, kind; citations: claim, evidence, field, passage; evidence: evidence, kind, fields (map), date.
"""

from __future__ import annotations

import bisect
import difflib
import re
import unicodedata
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions.text import fold
from pressloom.operators.figures import figures_in, read_figures, shown
from pressloom.sources.readers import content_hash

NUMBER = r"[+-]?[0-9]+(?:[.,][0-9]+)*"


def figures(c: Column) -> Column:
    """Distinct numbers of a text as plain strings: thousands separators out, decimal comma to point, zeros at the end left out."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9])" + NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, plain_number))


def plain_number(n: Column) -> Column:
    """1,234.5 and 1.234,5 and 1234,50 are one number. A lone separator before three digits is a thousands one."""
    grouped = n.rlike(r"^[+-]?[0-9]{1,3}([.,][0-9]{3})+$")
    bare = F.when(grouped, F.regexp_replace(n, "[.,]", "")).otherwise(F.concat(F.regexp_replace(F.regexp_replace(n, r"[.,][0-9]*$", ""), "[.,]", ""), F.regexp_replace(F.regexp_extract(n, r"[.,][0-9]*$", 0), ",", ".")))
    short = F.regexp_replace(F.regexp_replace(bare, r"^\+", ""), r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(short, r"\.$", "")


def citation_errors(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """citations with error: 'unknown evidence', 'unknown field', 'not literal' or NULL."""
    joined = citations.join(evidence.select("evidence", "fields"), "evidence", "left")
    text = F.try_element_at("fields", F.col("field"))
    error = F.when(F.col("fields").isNull(), "unknown evidence").when(text.isNull(), "unknown field").when(~F.contains(text, F.col("passage")), "not literal")
    return joined.select(*citations.columns, error.alias("error"))


def repaired(citations: DataFrame, evidence: DataFrame, least: float = 0.9) -> DataFrame:
    """citations with passage put right: literal as it is, with brackets that a prompt replaced put back, found without
    accents and case, else the closest window; NULL if none is close."""
    joined = citations.join(evidence.select("evidence", "fields"), "evidence", "left").withColumn("text", F.try_element_at("fields", F.col("field"))).drop("fields")
    bare = F.translate("passage", "‹›", "<>")
    at = F.instr(fold(F.col("text")), fold(bare))
    cheap = F.when(F.contains("text", "passage"), F.col("passage")).when(F.contains(F.col("text"), bare), bare).when((at > 0) & (F.trim(bare) != ""), F.substring("text", at, F.length(bare)))
    marked = joined.withColumn("found", F.when(F.length("passage") > 0, cheap)).withColumn("_bare", bare)
    hopeless = F.col("text").isNull() | (F.trim("_bare") == "")

    def closest(batches):
        for pdf in batches:
            pdf["found"] = [_closest(p, t, least) for p, t in zip(pdf["_bare"], pdf["text"], strict=True)]
            yield pdf

    rest = marked.where(F.col("found").isNull() & ~hopeless)
    return marked.where(F.col("found").isNotNull() | hopeless).unionByName(rest.mapInPandas(closest, rest.schema)).drop("text", "_bare")


#: Length of the pieces that a window and the passage are counted by, and by how much their lengths may differ, as a share.
GRAM, SLACK = 3, 0.2


def _grams(text: str) -> np.ndarray:
    """The pieces of GRAM characters that begin at each place, as numbers."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = np.zeros(max(0, len(codes) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(1 << 21) + codes[k : k + len(out)]
    return out


def _promising(passage: str, text: str, least: float) -> np.ndarray:
    """Places where a window alike to the passage may begin.

    A ratio of least means that least of both lengths' mean is matched, in blocks; between two blocks stands something
    unmatched, so blocks are few, and each costs GRAM - 1 pieces at most: windows hold a least number of the passage's
    pieces. That is counted for all places at once.
    """
    n, size = len(passage), int((1 + SLACK) * len(passage)) + 1
    both = (2 - SLACK) * n
    need = both * (least / 2 - (GRAM - 1) * (1 - least)) - (GRAM - 1)
    if need <= 0 or len(text) < GRAM:
        return np.arange(len(text))
    sums = np.concatenate(([0], np.cumsum(np.isin(_grams(text), np.unique(_grams(passage))))))
    starts = np.arange(len(text))
    ends = np.minimum(starts + size - GRAM + 1, len(sums) - 1)
    return starts[sums[np.maximum(ends, np.minimum(starts, len(sums) - 1))] - sums[np.minimum(starts, len(sums) - 1)] >= need]


def plain(text: str) -> str:
    """Case-folded text without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))


def _closest(passage: str, text: str, least: float) -> str | None:
    """The window of words within a fifth of the passage's length that is most alike, if alike enough. Only windows with enough of the passage's pieces are compared."""
    p, t = plain(passage), plain(text)
    if len(t) != len(text):  # folding that changes lengths: compare as written
        p, t = passage.casefold(), text if len(text.casefold()) != len(text) else text.casefold()
    n = len(p)
    starts = _promising(p, t, least).tolist()
    best = (least, None)
    m = difflib.SequenceMatcher(None, autojunk=False)
    m.set_seq2(p)
    ends = [*(x.start() for x in re.finditer("(?<=.) ", t, re.DOTALL)), *[len(t)][: len(t)]]
    for i in (s for s in starts if s == 0 or t[s - 1] == " "):
        for j in ends[bisect.bisect_left(ends, i + int(0.8 * n)) :]:
            if j - i > 1.2 * n + 1:
                break
            m.set_seq1(t[i:j])
            if m.real_quick_ratio() >= best[0] and m.quick_ratio() >= best[0] and (r := m.ratio()) >= best[0] and (best[1] is None or r > best[0]):
                best = (r, text[i:j])
    return best[1]


def _figures(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, figure: distinct figures of each text, digits and words alike; nothing is shuffled."""
    return rows.select(key, read_figures(F.col(text)).alias("figures")).select(key, F.explode(F.array_distinct("figures")).alias("figure"))


def unsupported_figures(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim, figure (decimal): figures of a claim, in digits or words, that stand neither in its cited passages nor in any field of its cited records."""
    said = _figures(claims, "claim", "text").distinct()
    passages = _figures(citations, "claim", "passage")
    cited = citations.select("claim", "evidence")
    texts = evidence.join(cited, "evidence", "left_semi").select("evidence", F.explode(F.map_values("fields")).alias("text"))
    fields = cited.distinct().join(_figures(texts, "evidence", "text"), "evidence").select("claim", "figure")
    return said.join(passages.union(fields), ["claim", "figure"], "left_anti")


def official_period_errors(claims: DataFrame, citations: DataFrame, evidence: DataFrame, official: tuple[str, ...] = ("indicador", "serie_inec"), period: str = "periodo") -> DataFrame:
    """claim, reason: claims that cite an official record without naming its period or year, or as if it were today's."""
    rows = citations.join(evidence.where(F.col("kind").isin(*official)).select("evidence", F.trim(F.coalesce(F.try_element_at("fields", F.lit(period)), F.lit(""))).alias("period")), "evidence").join(claims.select("claim", "text"), "claim")
    year = F.regexp_extract("period", "[0-9]{4}", 0)
    named = (F.col("period") != "") & (F.contains("text", "period") | ((year != "") & F.contains(F.col("text"), year)))
    today = fold(F.col("text")).rlike(PRESENT)
    reasons = F.filter(F.array(F.when(~named, F.lit("official figure without its period")), F.when(today, F.lit("official figure as of today"))), lambda r: r.isNotNull())
    return rows.select("claim", F.explode(reasons).alias("reason")).distinct()


#: What presents a figure as today's (folded), and what accuses (lower case, accents kept).
PRESENT = r"\b(actual|actualmente|hoy|en este momento|vigente)\b"
ACCUSING = ("robó", "malversó", "estafó", "es culpable", "cometió", "corrupto")


def accusations(claims: DataFrame, fact: str = "hecho", words: tuple[str, ...] = ACCUSING) -> DataFrame:
    """claims: claim, text, type -> claim, reason: facts that accuse."""
    pattern = r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(words) + r")(?:$|[^\p{L}\p{N}_])"
    return claims.where((F.col("type") == fact) & F.lower("text").rlike(pattern)).select("claim", F.lit("accusation as a fact").alias("reason"))


def claim_issues(claims: DataFrame, citations: DataFrame, evidence: DataFrame, canary: str) -> list[DataFrame]:
    """Every check of a claim as claim, reason: citations that do not hold, none at all, figures, official periods, accusations, the canary."""
    broken = citation_errors(citations, evidence).where("error is not null").select("claim", F.concat(F.lit("citation: "), "error").alias("reason"))
    uncited = claims.join(citations, "claim", "left_anti").select("claim", F.lit("no citation").alias("reason"))
    figures = unsupported_figures(claims, citations, evidence).select("claim", F.concat(F.lit("figure: "), shown(F.col("figure"))).alias("reason"))
    leaked = claims.where(F.contains(F.lower("text"), F.lit(canary.lower()))).select("claim", F.lit("internal canary in claim").alias("reason"))
    return [broken, uncited, figures, official_period_errors(claims, citations, evidence), accusations(claims), leaked]


def supported_versions(versions: DataFrame, evidence: DataFrame, require_scope: bool = False) -> DataFrame:
    """versions: version, evidence, value, scope -> version, supported, fields (array): the fewest fields of the record, those
    with most of the figures first (ties: the shorter text, then the name), whose figures cover those of value and scope. A value without a
    figure must stand in a field as written; require_scope: so must value and scope both."""
    named = F.transform(F.map_entries("fields"), lambda f: F.struct(F.length(f["value"]).alias("size"), f["key"].alias("name"), fold(f["value"]).alias("text"), F.array_distinct(figures_in(f["value"])).alias("figures")))
    joined = versions.join(evidence.select("evidence", "fields"), "evidence", "left").select("version", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("scope", F.lit("")).alias("scope"), F.sort_array(named).alias("f"))
    asked = joined.withColumns({"asked": F.array_distinct(figures_in(F.col("value"))), "limits": figures_in(F.col("scope"))})

    def holder(words: str, wanted: Column) -> Column:
        """The shortest field that has the words as written, where they are wanted; fields come by length, then name."""
        pattern = F.concat(F.lit(r"(?<!\w)\Q"), F.replace(fold(F.col(words)), F.lit("\\E"), F.lit("")), F.lit(r"\E(?!\w)"))
        return F.when(wanted, F.get(F.filter("f", lambda x: F.regexp_like(x["text"], pattern)), F.lit(0)))

    literal = F.lit(require_scope) | (F.size("asked") == 0)
    held = asked.withColumns({"by_value": holder("value", literal), "by_scope": holder("scope", F.lit(require_scope))})
    lost = (literal & F.col("by_value").isNull()) | (F.lit(require_scope) & F.col("by_scope").isNull()) | F.col("f").isNull()
    chosen = F.filter(F.array("by_value", "by_scope"), lambda x: x.isNotNull())
    first = held.select("version", "f", lost.alias("lost"), F.transform(chosen, lambda x: x["name"]).alias("names"), F.array_except(F.array_union("asked", "limits"), F.flatten(F.transform(chosen, lambda x: x["figures"]))).alias("needed"))
    # the field that says most of what is needed comes first, and each next one is taken if it says something that is still open
    by_use = F.sort_array(F.transform("f", lambda x: F.struct((-F.size(F.array_intersect(x["figures"], "needed"))).alias("use"), x["size"].alias("size"), x["name"].alias("name"), x["figures"].alias("figures"))))
    start = F.struct("names", F.col("needed").alias("open"))
    cover = F.aggregate(by_use, start, lambda s, x: F.when(F.arrays_overlap(x["figures"], s["open"]), F.struct(F.array_append(s["names"], x["name"]).alias("names"), F.array_except(s["open"], x["figures"]).alias("open"))).otherwise(s))
    done = first.select("version", "lost", F.when(~F.col("lost"), cover).alias("c"))
    ok = ~F.col("lost") & F.coalesce(F.size("c.open") == 0, F.lit(False))
    return done.select("version", ok.alias("supported"), F.when(ok, F.array_distinct("c.names")).otherwise(F.array().cast("array<string>")).alias("fields"))


def claim_report(claims: DataFrame, issues: list[DataFrame]) -> DataFrame:
    """issues: claim, reason -> claim, kept, reasons (sorted, joined by '; ')."""
    all_issues = reduce(DataFrame.unionByName, issues)
    reasons = all_issues.groupBy("claim").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))
    return claims.select("claim").join(reasons, "claim", "left").select("claim", F.col("reasons").isNull().alias("kept"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def missing_references(links: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """rule -> (references: id, known ids: id); rule, id of every reference that leads nowhere."""
    return reduce(DataFrame.unionByName, [a.select("id").distinct().join(b.select("id"), "id", "left_anti").select(F.lit(rule).alias("rule"), "id") for rule, (a, b) in links.items()])


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """n, hash: order-insensitive fingerprint of rows; another one means that what was built from them is stale."""
    return rows.agg(F.count("*").alias("n"), content_hash(list(columns or rows.columns)).alias("hash"))


def vector_problems(vectors: DataFrame, dim: int) -> DataFrame:
    """id, problem: wrong dimension, values that aren't finite, or no length."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("id", F.when(F.size("v") != dim, "dimension").when(bad, "not finite").when(norm == 0, "zero").alias("problem")).where("problem is not null")


