"""The five components of a score, the score and its range. Rules are parameters; defaults are the fixed values below."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of relevance, impact, urgency, novelty and evidence.
WEIGHTS = {"r": 30, "i": 25, "u": 20, "n": 15, "e": 10}
#: Base impact of a topic.
IMPACT_BASE = {"logistica_canal": 0.6, "economia": 0.6, "servicios_publicos": 0.5, "eventos_naturales": 0.5, "regulacion": 0.5, "turismo": 0.4, "sin_tema": 0.1}
#: Fixed values: (hours under which it holds, urgency), then the rest.
AGES, OLD = ((24, 1.0), (48, 0.8), (72, 0.6), (168, 0.4), (336, 0.2)), 0.1
RANGES, TOP = ((40, "bajo"), (70, "medio")), "alto"


def relevance(has_topic: Column, place: Column) -> Column:
    """place: 'mention', 'official', 'world' (no own place) or anything else."""
    share = F.when(place.isin("mention", "official"), 1.0).when(place == "world", 0.0).otherwise(0.5)
    return 0.6 * has_topic.cast("int") + 0.4 * share


def impact(base: Column, has_context: Column, has_scale: Column) -> Column:
    return F.least(F.lit(1.0), base + 0.2 * has_context.cast("int") + 0.2 * has_scale.cast("int"))


def urgency(age_s: Column, alert: Column) -> Column:
    step = F.lit(OLD)
    for hours, value in reversed(AGES):
        step = F.when(age_s < hours * 3600, value).otherwise(step)
    return F.least(F.lit(1.0), step + 0.2 * alert.cast("int"))


def novelty(similarity: Column, recirculated: Column) -> Column:
    """1 up to a similarity of 0.5, 0 from 0.9; in decimals, as similarities come rounded to 6 places."""
    fall = (F.lit("0.9").cast("decimal(2,1)") - similarity.cast("decimal(8,6)")) * F.lit("2.5").cast("decimal(2,1)")
    return F.when(recirculated, 0.1).otherwise(F.round(F.greatest(F.lit(0), F.least(F.lit(1), fall)), 4).cast("double"))


def evidence(provenances: Column, primary: Column, text: Column) -> Column:
    return 0.4 * F.least(provenances, F.lit(3)) / 3 + 0.3 * primary.cast("int") + 0.3 * text.cast("int")


def evidence_state(provenances: Column, text: Column, official_text: Column, context: Column) -> Column:
    """What a draft could stand on; independent of the score."""
    return F.when(official_text | ((provenances >= 2) & text), "suficiente_para_borrador").when(text | context | (provenances >= 2), "parcial").otherwise("insuficiente")


def score(r: Column, i: Column, u: Column, n: Column, e: Column) -> Column:
    """Struct of components (4 decimals), score (2 decimals) and range."""
    parts = {k: F.round(c, 4) for k, c in zip("riune", (r, i, u, n, e), strict=True)}
    exact = [F.lit(w) * parts[k].cast("decimal(6,4)") for k, w in WEIGHTS.items()]
    total = F.round(reduce(lambda a, b: a + b, exact), 2).cast("double")
    label = F.lit(TOP)
    for bound, name in reversed(RANGES):
        label = F.when(total < bound, name).otherwise(label)
    return F.struct(*[c.alias(k) for k, c in parts.items()], total.alias("score"), label.alias("range"))


def justifications(topic: Column, mention: Column, official: Column, scale: Column, alert: Column, recirculated: Column, provenances: Column, text: Column) -> Column:
    """Why each component is what it is: a map by its letter."""
    no = F.lit("")
    plus = lambda c, words: F.when(c, f" + {words}").otherwise(no)
    said = {
        "r": F.concat(F.when(topic, "has a topic").otherwise("has no topic"), F.when(mention, ", names the country").when(official, ", official source").otherwise(", place unknown")),
        "i": F.concat(F.lit("base of the topic"), plus(official, "context"), plus(scale, "scale")), "u": F.concat(F.lit("age"), plus(alert, "alert or later date")), "n": F.when(recirculated, "all of it recirculated").otherwise("similarity to earlier groups"),
        "e": F.concat(F.least(provenances, F.lit(3)).cast("string"), F.lit(" of 3 origins"), plus(official, "primary source"), plus(text, "text")),
    }
    return F.create_map(*[x for k, c in said.items() for x in (F.lit(k), c)])
