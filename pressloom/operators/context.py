"""Official context of a group of reports: rules that fire on its words, and what each rule's finders find.

Rules are data: a name, key words, topics (none: any), finders in order of preference and the reason given when none
finds anything. Finders: ('latest', prefix), the newest point with a value of a series; ('nearest', ''), the catalog
event nearest in time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.storage import staged
from pressloom.functions.text import fold, matched_word, word_pattern

#: Span of a catalog event, tolerance of a stated magnitude, and the box and name of the country.
SPAN_S, TOLERANCE = 86400, 0.3
HOME, LATITUDES, LONGITUDES = "panama", (7.0, 9.7), (-83.1, -77.1)
#: Other countries and own regions, folded.
OTHERS = ("colombia", "costa rica", "mexico", "chile", "peru", "ecuador", "guatemala", "japon", "nicaragua", "honduras", "el salvador", "venezuela", "argentina", "bolivia", "haiti", "cuba", "turquia", "indonesia", "filipinas", "china", "iran", "italia", "grecia", "nepal", "nueva zelanda")
REGIONS = ("panama", "bocas del toro", "chiriqui", "veraguas", "cocle", "herrera", "los santos", "colon", "panama oeste", "darien", "guna yala", "embera-wounaan", "ngabe-bugle")
MOST_RULES = 1000
#: Reasons that stand where no link is made.
NONE, FOREIGN = "no official record measures this", "the report is about another country"


@dataclass(frozen=True)
class Rule:
    name: str
    words: tuple[str, ...]
    topics: tuple[str, ...] = ()
    finders: tuple[tuple[str, str], ...] = ()
    none: str = NONE


def read_rules(rules: DataFrame) -> list[Rule]:
    """rules: ord, name, words, topics (arrays), finders (array of kind and prefix), none -> rules in order. A rule table is small: more than MOST_RULES raise."""
    rows = rules.orderBy("ord").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [Rule(r["name"], tuple(r["words"]), tuple(r["topics"] or ()), tuple((f["kind"], f["prefix"]) for f in r["finders"] or ()), r["none"] or NONE) for r in rows]


def fired_rules(reports: DataFrame, rules: Sequence[Rule | tuple]) -> DataFrame:
    """reports: id, text, topic -> id, rule, word. Rules are few, so each is a column of the one scan."""
    return reports.select("id", F.inline(_fired(rules)))


def _fired(rules: Sequence[Rule | tuple]) -> Column:
    """The rules that fire on text and topic, each with its word."""
    all_rules = [r if isinstance(r, Rule) else Rule(*r) for r in rules]
    found = [F.struct(F.lit(r.name).alias("rule"), F.when(F.col("topic").isin(*r.topics) if r.topics else F.lit(True), matched_word(F.col("text"), r.words)).alias("word")) for r in all_rules]
    return F.filter(F.array(*found), lambda r: r["word"].isNotNull())


def magnitudes_in(text: Column) -> Column:
    """Magnitudes that a text states: 'magnitud (de) 4,5', '4.5 grados / de magnitud / en la escala', 'M 4.5'."""
    number = r"([0-9]+(?:[.,][0-9]+)?)"
    plain = fold(text)
    found = [F.regexp_extract_all(plain, F.lit(rf"magnitud\s+(?:de\s+)?{number}"), F.lit(1)), F.regexp_extract_all(plain, F.lit(rf"{number}\s*(?:grados|de magnitud|en la escala)"), F.lit(1)), F.regexp_extract_all(text, F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_])M\s?{number}"), F.lit(1))]
    return F.transform(F.concat(*found), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def in_country(place: Column, latitude: Column, longitude: Column, name: str = HOME, latitudes: tuple[float, float] = LATITUDES, longitudes: tuple[float, float] = LONGITUDES) -> Column:
    """Whether the place names the country or the point lies in its box."""
    return F.coalesce(fold(place).contains(name), F.lit(False)) | F.coalesce(latitude.between(*latitudes) & longitude.between(*longitudes), F.lit(False))


def names_another_country(text: Column, others: Sequence[str] = OTHERS, regions: Sequence[str] = REGIONS) -> Column:
    """Whether a text names another country and no region of one's own."""
    plain = fold(text)
    return F.coalesce(plain.rlike(word_pattern(others)) & ~plain.rlike(word_pattern(regions)), F.lit(False))


def latest_points(official: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """official: evidence, fields -> prefix, evidence: the newest period with a value among the ids of each prefix (ties: the least id)."""
    valued = official.where(F.coalesce(F.try_element_at("fields", F.lit("valor")), F.lit("")) != "")
    which = F.filter(F.array(*[F.lit(p) for p in prefixes]).cast("array<string>"), lambda p: F.startswith("evidence", p))
    rows = valued.select("evidence", F.element_at("fields", F.lit("periodo")).alias("period"), F.explode(which).alias("prefix"))
    newest = rows.groupBy("prefix").agg(F.max("period").alias("period"))
    return rows.join(newest, ["prefix", "period"]).groupBy("prefix").agg(F.min("evidence").alias("evidence"))


def _fitting(asks: DataFrame, sizes: DataFrame, tolerance: float) -> DataFrame:
    """asks: magnitude (distinct: a number, or an array of them); sizes: size (distinct) -> magnitude, size: those within tolerance, one decimal kept.

    Both are cut into tenths, and a magnitude looks into the tenths that its tolerance reaches: no product of the two.
    """
    ask = asks.where("magnitude is not null").select("magnitude", F.explode("magnitude").alias("m") if asks.schema["magnitude"].dataType.typeName() == "array" else F.col("magnitude").alias("m"))
    reach = tolerance + 0.1
    ask = ask.where(F.col("m").isNotNull()).select("magnitude", "m", F.explode(F.sequence(F.floor((F.col("m") - reach) * 10), F.floor((F.col("m") + reach) * 10))).alias("tenth"))
    held = sizes.select("size", F.floor(F.col("size") * 10).alias("tenth"))
    return ask.join(held, "tenth").where(F.round(F.abs(F.col("m") - F.col("size")), 1) <= tolerance).select("magnitude", "size").distinct()


def closest_event(reports: DataFrame, events: DataFrame, span_s: int = SPAN_S, tolerance: float = TOLERANCE, cell_s: int | None = None) -> DataFrame:
    """reports: id, moment (whole seconds), magnitude (NULL: any; or an array: any of them, any at all if empty); events: event, moment, magnitude
    -> id, event, gap: nearest in time within span_s, ties by event. Reports without a moment find nothing.

    An as-of join. Questions and events form one stream for each magnitude, in order of time: equal events of a moment
    stand for each other, and so do reports that ask the same, so a stream has at most two rows a second. It is swept
    in cells of cell_s (an hour of the default span): within a cell the last event before and the next after each
    question come from windows; across borders every cell gets the last event of the cells before it and the first of
    those after it, from a table of one row a cell. No pair of a report and an event is made but the two that are kept.
    """
    cell_s = cell_s or max(1, span_s // 24)
    listed = reports.schema["magnitude"].dataType.typeName() == "array"
    asked = F.when(F.size("magnitude") == 0, None).otherwise(F.array_sort(F.array_distinct("magnitude"))) if listed else F.col("magnitude")
    seen = reports.where("moment is not null").select("id", "moment", asked.alias("magnitude"))
    asks = seen.select("moment", "magnitude").distinct()
    one = events.where("moment is not null").groupBy("moment", F.col("magnitude").alias("size")).agg(F.min("event").alias("event"))
    fits = _fitting(asks.select("magnitude").distinct(), one.where("size is not null").select("size").distinct(), tolerance)
    # the stream of a magnitude is named by it; that of all events has no name
    keyed = asks.where("magnitude is null").select("moment", "magnitude", F.lit(None).cast("double").alias("size")).unionByName(asks.join(fits, "magnitude").select("moment", "magnitude", F.col("size").cast("double")))
    told = one.where("size is not null").select("moment", F.col("size").cast("double"), "event").unionByName(one.groupBy("moment").agg(F.min("event").alias("event")).select("moment", F.lit(None).cast("double").alias("size"), "event"))
    at = F.struct("moment", "event")
    questions = keyed.select("size", "moment").distinct().select("size", "moment", F.lit(None).cast(told.select(at.alias("x")).schema["x"].dataType).alias("here"))
    stream = questions.unionByName(told.select("size", "moment", at.alias("here"))).withColumn("cell", F.floor(F.col("moment") / cell_s))
    # both directions run from the far end: a frame that reaches to the end is computed anew for every row
    asks_last = F.col("here").isNull()  # an event comes before the questions of its moment
    onward = Window.partitionBy("size", "cell").orderBy("moment", asks_last).rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("size", "cell").orderBy(F.desc("moment"), asks_last.desc()).rowsBetween(Window.unboundedPreceding, -1)
    swept = stream.select("size", "cell", "moment", "here", F.last("here", True).over(onward).alias("before"), F.last("here", True).over(backward).alias("after"))
    borders = stream.groupBy("size", "cell").agg(F.min("here").alias("first"), F.max("here").alias("last"))  # of equal moments: one event each
    past = Window.partitionBy("size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # rows: cells of time, however many reports they hold
    coming = Window.partitionBy("size").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    borders = borders.select("size", "cell", F.last("last", True).over(past).alias("past"), F.last("first", True).over(coming).alias("coming"))
    known = borders.withColumnsRenamed({"size": "_size", "cell": "_cell"})
    met = swept.where("here is null").join(known, F.col("size").eqNullSafe(F.col("_size")) & (F.col("cell") == F.col("_cell")))
    near = [F.struct(F.abs(F.col("moment") - e["moment"]).alias("gap"), e["event"].alias("event")) for e in (F.coalesce("before", "past"), F.coalesce("after", "coming"))]
    near = F.filter(F.array(*near), lambda e: e["gap"] <= span_s)
    answers = met.select("size", "moment", F.array_min(near).alias("best")).where("best is not null").withColumnsRenamed({"size": "_size", "moment": "_moment"})
    of_ask = keyed.join(answers, F.col("size").eqNullSafe(F.col("_size")) & (F.col("moment") == F.col("_moment"))).groupBy("moment", "magnitude").agg(F.min("best").alias("best"))
    of_ask = of_ask.withColumnsRenamed({"moment": "_moment", "magnitude": "_magnitude"})
    found = seen.join(of_ask, (F.col("moment") == F.col("_moment")) & F.col("magnitude").eqNullSafe(F.col("_magnitude")))
    return found.select("id", F.col("best.event").alias("event"), F.col("best.gap").alias("gap"))


def link_context(groups: DataFrame, rules: Sequence[Rule], official: DataFrame, catalog: DataFrame, others: Sequence[str] = OTHERS, regions: Sequence[str] = REGIONS) -> tuple[DataFrame, DataFrame]:
    """groups: id, text, topic, moment (earliest); official: evidence, fields; catalog: event (an evidence id), moment, magnitude, home.

    -> (id, evidence, rule, word: what the first finder of each rule that fires finds, a piece of evidence once, under its
    first rule; id, reason: why a group has no link). A text about another country links to nothing.
    """
    foreign = names_another_country(F.col("text"), others, regions)
    # texts are read once: what the joins below take of them is short, and read several times
    marks = staged(groups.select("id", "moment", foreign.alias("foreign"), _fired(rules).alias("fired"), magnitudes_in(F.col("text")).alias("magnitude")))
    own = marks.where(~F.col("foreign"))
    place = {r.name: (i, r) for i, r in enumerate(rules)}
    fired = own.select("id", F.inline("fired"))
    tried = F.element_at(F.create_map(*[x for name, (i, r) in place.items() for x in (F.lit(name), F.struct(F.lit(i).alias("ord"), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("prefix")) for k, p in r.finders]).cast("array<struct<kind:string,prefix:string>>").alias("finders")))]), F.col("rule"))
    steps = fired.select("id", "rule", "word", tried.alias("t")).select("id", "rule", "word", "t.ord", F.posexplode("t.finders").alias("k", "f"))
    steps = steps.select("id", "rule", "word", "ord", "k", "f.kind", "f.prefix")
    latest = latest_points(official, sorted({p for r in rules for k, p in r.finders if k == "latest"}))
    nearest = closest_event(own.select("id", "moment", "magnitude"), catalog.where("home").select("event", "moment", "magnitude"))
    found = steps.where("kind = 'latest'").join(F.broadcast(latest), "prefix").select("id", "rule", "word", "ord", "k", "evidence")  # a row a prefix of a rule
    found = found.unionByName(steps.where("kind = 'nearest'").join(nearest.select("id", F.col("event").alias("evidence")), "id").select("id", "rule", "word", "ord", "k", "evidence"))
    first = found.groupBy("id", "rule", "word", "ord").agg(F.min(F.struct("k", "evidence"))["evidence"].alias("evidence"))
    links = first.groupBy("id", "evidence").agg(F.min(F.struct("ord", "rule", "word")).alias("r")).select("id", "evidence", "r.rule", "r.word")
    empty = fired.join(first.select("id", "rule"), ["id", "rule"], "left_anti")
    whys = F.create_map(*[x for name, (i, r) in place.items() for x in (F.lit(name), F.struct(F.lit(i).alias("ord"), F.lit(r.none).alias("none")))])
    unfound = empty.groupBy("id").agg(F.min(F.element_at(whys, F.col("rule")))["none"].alias("none"))
    lone = marks.select("id", "foreign").join(links.select("id").distinct(), "id", "left_anti").join(unfound, "id", "left")
    return links, lone.select("id", F.when(F.col("foreign"), FOREIGN).otherwise(F.coalesce("none", F.lit(NONE))).alias("reason"))
