"""Citable records out of reports, indicators, series points and catalog events, and the texts that stand for them.

Evidence: evidence (id), kind, title, url, moment (nullable), fields (map, no empty ones). Rule lists are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions.text import MONTHS, fold, spanish_number, spanish_period

#: Agencies, by name as written.
AGENCIES = ("EFE", "AFP", "Reuters", "AP", "Europa Press", "ANSA", "DPA", "Xinhua")
#: Words of an alert.
ALERTS = ("aviso", "alerta", "a partir del")
#: Place words (folded) and institutions (as written).
PLACES = ("panama", "panama oeste", "bocas del toro", "cocle", "colon", "chiriqui", "darien", "herrera", "los santos", "veraguas", "comarca", "comarcas", "asamblea", "mulino")
INSTITUTIONS = ("Canal", "ACP", "AMP", "CSS", "Minsa", "MEF", "MICI", "Idaan", "Sinaproc", "ATP")
#: Names of the sources of official records.
SOURCES = {"indicador": "Banco Mundial", "serie_inec": "INEC"}


def exact_word(terms: Sequence[str]) -> str:
    """Pattern of a term as a whole word, letters of any script, case kept; group 1 is the term."""
    return r"(?:^|[^\p{L}\p{N}_])(" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + r")(?:$|[^\p{L}\p{N}_])"


def agency(title: Column, description: Column, agencies: Sequence[str] = AGENCIES) -> Column:
    """The first agency that a report names, NULL if none."""
    return F.nullif(F.regexp_extract(F.concat_ws("\n", title, description), exact_word(agencies), 1), F.lit(""))


def provenance(title: Column, description: Column, outlet: Column, agencies: Sequence[str] = AGENCIES) -> Column:
    """Who made the content: the agency, else the outlet."""
    return F.coalesce(agency(title, description, agencies), outlet)


def rows_text(rows: DataFrame) -> DataFrame:
    """rows: group, id, moment, title, description -> group, text: titles and descriptions by (moment, id), a line each.

    One text a group: for groups that fit a row. Rules over large groups test each row and aggregate the answers.
    """
    row = F.struct("moment", "id", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit(""))).alias("t"))
    return rows.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), "\n").alias("text"))


def document_text(title: Column, description: Column, most: int | None = None) -> Column:
    """Title and description as one text; most: characters of the description (the topic text takes 300)."""
    rest = description if most is None else F.substring(description, 1, most)
    return F.when(F.coalesce(description, F.lit("")) == "", title).otherwise(F.concat(title, F.lit(". "), rest))


def evidence_text(evidence: DataFrame, countries: dict[str, str], home: str) -> DataFrame:
    """evidence and text: the sentence that a record is embedded as. countries: names by the code in an indicator's id."""
    field = lambda name: F.element_at("fields", F.lit(name))
    names = F.create_map(*[F.lit(x) for pair in countries.items() for x in pair])
    code = F.split("evidence", "-")[1]
    country = F.when(F.col("kind") == "indicador", F.coalesce(F.try_element_at(names, code), code)).otherwise(home)
    source = F.element_at(F.create_map(*[F.lit(x) for pair in SOURCES.items() for x in pair]), F.col("kind"))
    quake = F.concat(F.lit("Sismo de magnitud "), field("valor"), F.lit(" en "), field("lugar"), F.lit(", "), field("periodo"), F.lit(" (USGS)"))
    official = F.concat(F.coalesce(field("indicador"), field("serie")), F.lit(" de "), country, F.lit(" en "), spanish_period(field("periodo")), F.lit(": "), field("valor"), F.lit(" "), field("unidad"), F.lit(" ("), source, F.lit(")"))
    text = F.when(F.col("kind") == "noticia", document_text(field("titulo"), field("descripcion"))).when(F.col("kind") == "sismo", quake).otherwise(official)
    return evidence.select("evidence", text.alias("text"))


def _record(rows: DataFrame, identity: Column, kind: str, title: Column, fields: dict[str, Column], moment: Column | None = None) -> DataFrame:
    named = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    return rows.select(identity.alias("evidence"), F.lit(kind).alias("kind"), title.alias("title"), F.col("url"), (F.lit(None).cast("long") if moment is None else moment).alias("moment"), named.alias("fields"))


def news_evidence(rows: DataFrame) -> DataFrame:
    """rows: id (text), title, url, outlet, moment (epoch seconds), published (text), detected (nullable), description (nullable)."""
    return _record(rows, F.col("id"), "noticia", F.col("title"), {"titulo": F.col("title"), "medio": F.col("outlet"), "fecha_publicacion": F.col("published"), "fecha_deteccion": F.nullif("detected", F.lit("")), "descripcion": F.nullif("description", F.lit(""))}, F.col("moment"))


def indicator_evidence(rows: DataFrame) -> DataFrame:
    """rows: country, indicator, label, year (text), value (NULL: an empty field, never zero), unit, url."""
    value = F.coalesce(spanish_number(F.col("value")), F.lit(""))
    return _record(rows, F.concat_ws("-", F.lit("WB"), "country", "indicator", "year"), "indicador", F.concat("label", F.lit(" ("), "country", F.lit(", "), "year", F.lit(")")), {"indicador": F.col("label"), "periodo": F.col("year"), "valor": value, "unidad": F.col("unit")})


def series_evidence(rows: DataFrame) -> DataFrame:
    """rows: series_id, series, period, value, unit, base, frequency, url."""
    value = F.coalesce(spanish_number(F.col("value")), F.lit(""))
    return _record(rows, F.concat_ws("-", F.lit("INEC"), "series_id", "period"), "serie_inec", F.concat("series", F.lit(" ("), "period", F.lit(")")), {"serie": F.col("series"), "periodo": F.col("period"), "valor": value, "unidad": F.col("unit"), "base": F.col("base"), "frecuencia": F.col("frequency")})


def quake_evidence(rows: DataFrame) -> DataFrame:
    """rows: id (text), place, magnitude, moment (epoch seconds), time (ISO text), status, latitude and longitude (both or neither count), url."""
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    fields = {"lugar": F.col("place"), "periodo": F.substring("time", 1, 10), "valor": spanish_number(F.col("magnitude"), 1), "unidad": F.lit("magnitud"), "hora_utc": F.col("time"), "estado": F.col("status"), "latitud": F.when(both, F.col("latitude").cast("string")), "longitud": F.when(both, F.col("longitude").cast("string"))}
    return _record(rows, F.concat(F.lit("USGS-"), "id"), "sismo", F.concat(F.lit("Sismo "), "place"), fields, F.col("moment"))


def mentions_place(text: Column, places: Sequence[str] = PLACES, institutions: Sequence[str] = INSTITUTIONS) -> Column:
    """Whether a text names a place (accents and case aside) or an institution (as written)."""
    return F.coalesce(fold(text).rlike(exact_word(places)) | text.rlike(exact_word(institutions)), F.lit(False))


DATE = r"\b([0-9]{1,2}) de (" + "|".join(MONTHS) + r")(?: de ([0-9]{4}))?\b"


def future_or_alert(text: Column, cutoff: Column, alerts: Sequence[str] = ALERTS) -> Column:
    """Whether a text has an alert word or a date after the cutoff (a date column); a missing year is the cutoff's, impossible dates are skipped."""
    plain = fold(text)
    parts = [F.regexp_extract_all(plain, F.lit(DATE), F.lit(k)) for k in (1, 2, 3)]
    months = F.array(*[F.lit(m) for m in MONTHS])
    dates = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "dmy", strict=True)]), lambda x: F.try_to_timestamp(F.concat_ws("-", F.when(x["y"] == "", F.year(cutoff).cast("string")).otherwise(x["y"]), F.array_position(months, x["m"]).cast("string"), x["d"]), F.lit("yyyy-M-d")))
    return F.coalesce(plain.rlike(exact_word(alerts)) | F.exists(dates, lambda d: F.coalesce(d.cast("date") > cutoff, F.lit(False))), F.lit(False))


#: What shows the scale of an event, over folded text.
SCALE = (r"\$\s?[0-9]|\b[0-9][0-9.,]*\s+(?:millones|dolares|balboas)\b|b/\.", r"[0-9]+(?:[.,][0-9]+)?\s?(?:%|por ciento)", r"\btodo el pais\b", r"\b[0-9][0-9.,]*\s+(?:personas|viviendas|casas|familias|hogares|afectad\w+|damnificad\w+)\b")


def shows_scale(text: Column) -> Column:
    """A sum, a share, a nation-wide scope (not that of the national assembly) or people and homes affected."""
    plain = fold(text)
    nation = F.regexp_replace(plain, "asamblea nacional", "").rlike(r"\bnacional\b")
    return F.coalesce(plain.rlike("|".join(SCALE)) | nation, F.lit(False))


def own_sources(members: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """members: group, id; links: group, evidence -> group, evidence: members and context that exist as evidence, each once."""
    both = members.select("group", F.col("id").alias("evidence")).union(links.select("group", "evidence")).distinct()
    return both.join(evidence.select("evidence"), "evidence", "left_semi").select("group", "evidence")


def altered_fields(evidence: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """evidence, field: fields whose text has angle brackets, which prompts replace."""
    flat = evidence.select("evidence", F.explode("fields").alias("field", "text"))
    chosen = flat if fields is None else flat.where(F.col("field").isin(*fields))
    return chosen.where(F.col("text").rlike("[<>]")).select("evidence", "field")


def reused_vectors(texts: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts: id, text; known: text, v -> (id, v of an equal text; id, text of those still to embed). Joined by the texts' hash, compared by text."""
    have = known.groupBy("text").agg(F.min("v").alias("v")).withColumn("_h", F.xxhash64("text"))
    both = texts.withColumn("_h", F.xxhash64("text")).join(have.withColumnRenamed("text", "_t"), "_h", "left")
    hit = F.col("text") == F.col("_t")
    return both.where(hit).select("id", "v"), texts.join(have.select("text"), "text", "left_anti").select("id", "text")


def labelled_vectors(labels: DataFrame, vectors: DataFrame, strict: bool = False) -> DataFrame:
    """labels: id, label; vectors: id, v -> id, label, v. strict (evaluation): a label without a vector raises; else (training) it is left out."""
    if strict:
        lost = labels.join(vectors.select("id"), "id", "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"no vector for {lost[0]['id']!r}")
    return labels.join(vectors, "id").select("id", "label", "v")


def source_catalog(sources: DataFrame, captures: DataFrame, kept: DataFrame) -> DataFrame:
    """sources: source, ...; captures: source, channel, fetched; kept: source -> sources with channels, records kept (0 if none) and latest fetch (NULL if none)."""
    seen = captures.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channels"), F.max("fetched").alias("fetched"))
    counts = kept.groupBy("source").agg(F.count("*").alias("records"))
    return sources.join(seen, "source", "left").join(counts, "source", "left").withColumn("records", F.coalesce("records", F.lit(0)))
