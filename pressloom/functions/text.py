"""Text columns: folding, word match, tokens, numbers, dates, markup. Rule tables are parameters."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain forms, for the path without Python.
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"
#: Spanish words that carry no topic, question words among them.
STOPWORDS = tuple(
    """a al algo algun alguna algunas alguno algunos ante antes aqui asi aun cada como con contra cual cuales cuando cuanta cuantas cuanto cuantos
    de del desde donde dos e el ella ellas ellos en entre era eran es esa esas ese eso esos esta estaba estan estar este esto estos
    fue fueron ha han hasta hay la las le les lo los mas me mi mis muy ni no nos o otra otras otro otros para pero poco por porque que quien quienes
    se ser si sin sobre son su sus tambien tan tanto te tiene todo todos tu tus un una uno unos y ya yo""".split()
)
#: Month names in order.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
QUARTERS = ("primer", "segundo", "tercer", "cuarto")


def fold(c: Column) -> Column:
    """Lower case without the accents of Western European letters."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def fold_any(c: Column) -> Column:
    """Case-folded text of any script without combining marks, in Arrow batches; fold() does the same for Western letters in generated code."""

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFD", t.casefold()) if not unicodedata.combining(x)))

    return folded(c)


def word_pattern(terms: Sequence[str]) -> str:
    """A pattern that finds any of the terms as a whole word of folded text."""
    return "(?:^|[^a-z0-9_])(" + "|".join(re.sub(r"([^a-z0-9 ])", r"\\\1", t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")(?:$|[^a-z0-9_])"


def matched_word(c: Column, terms: Sequence[str]) -> Column:
    """The first term that stands in folded text as a whole word, NULL if none."""
    return F.nullif(F.regexp_extract(fold(c), word_pattern(terms), 1), F.lit(""))


def tokens(c: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Runs of a-z and 0-9 of folded text, without stopwords, with the plural ending left out."""
    words = F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*stopwords))
    return F.transform(kept, stem)


def stem(w: Column) -> Column:
    """Light plural stem: -ciones to -cion; else -es after a consonant; else -s, but not of -sis."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return (
        F.when(w.endswith("ciones"), cut(2)).when((n > 4) & w.endswith("es") & ~F.substring(w, n - 2, F.lit(1)).isin(*"aeiou"), cut(2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("sis"), cut(1)).otherwise(w)
    )


def clean_text(c: Column) -> Column:
    """Text of markup: tags out, the common entities decoded, white space to one space, NULL if nothing is left."""
    bare = F.regexp_replace(c, "<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.nullif(F.trim(F.regexp_replace(bare, r"[ \t\r\n\f]+", " ")), F.lit(""))


def clean_any(c: Column) -> Column:
    """As clean_text(), for every named and numbered entity, in Arrow batches."""

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html.unescape(t))

    return F.nullif(F.trim(F.regexp_replace(decoded(F.regexp_replace(c, "<[^>]*>", " ")), r"[\s\u00a0]+", " ")), F.lit(""))


def parse_number(c: Column) -> Column:
    """A statistics cell: 1,234.5 or 1.234,5 or 12,5; dashes, dots and blanks are NULL, never zero."""
    t = F.trim(c)
    both = t.contains(",") & t.contains(".")
    comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    plain = F.when(both & comma_last, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(both, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    return F.when(plain.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), plain.try_cast("double"))


def spanish_number(c: Column, decimals: int = 2) -> Column:
    """Fixed decimals with a comma."""
    return F.when(c.isNotNull(), F.replace(F.format_string(f"%.{decimals}f", c), F.lit("."), F.lit(",")))


def spanish_period(c: Column) -> Column:
    """2026-08 -> agosto de 2026; 2026-T2 -> segundo trimestre de 2026; anything else as it is."""
    year = F.substring(c, 1, 4)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.substring(c, 6, 2).try_cast("int"))
    quarter = F.element_at(F.array(*[F.lit(q) for q in QUARTERS]), F.substring(c, 7, 1).try_cast("int"))
    return F.when(c.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), F.concat(month, F.lit(" de "), year)).when(c.rlike("^[0-9]{4}-T[1-4]$"), F.concat(quarter, F.lit(" trimestre de "), year)).otherwise(c)


def comparable(c: Column) -> Column:
    """A question without accents, question marks, case and extra spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), "[¿?]", ""), r"\s+", " "))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def spoken_seconds(c: Column, words_per_second: float = 2.5) -> Column:
    return F.ceil(word_count(c) / F.lit(words_per_second)).cast("long")


def neutralize(c: Column) -> Column:
    """Angle brackets replaced by harmless quotes."""
    return F.translate(c, "<>", "‹›")


def near_identical(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Jaccard similarity of two token arrays at or over the threshold; two empty ones are not alike."""
    union = F.size(F.array_union(a, b))
    return (union > 0) & (F.size(F.array_intersect(a, b)) >= F.lit(threshold) * union - F.lit(1e-9))


def unit(v: Column) -> Column:
    """A vector over its length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
