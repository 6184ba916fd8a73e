"""Line dedup with DataFrame functions alone: equal lines, and lines within one word edit, keep their earliest.

The edit bound is one word replaced, inserted or left out (lines here have 58 words on average: single characters
would give several hundred variants a line, and a changed character changes one word). In lines of under near_words
words the bound is none: there one word is over a fifth of the line (titles, numbered headings), a similarity under the
0.8 that near duplicates take, and such lines are compared for equality alone. Lines of under min_chars characters are
never dropped.

The variants within the bound are the line with each one of its words left out:
- the same place left out of two lines of equal length leaves the same rest: they differ in that word alone;
- a line that equals another with one word left out.
A variant's key is the XOR of the hashes of (place, word) of what is left, taken from the whole line's by running XORs,
so that all variants of a line cost little more than its length. Words are left out of the half that a line does not share
(below). Keys are grouped; the candidate and the earliest line
of its group are then compared word by word. Whole groups are never paired: a line is dropped if one earlier line is
within the bound, and any other line of its group is within the bound of the earliest.

Before variants are made, a filter that loses nothing: lines within one word edit share their first or last half.
Lines without a half that another line shares make no variants. Up to MAX_SHARED shared halves go to the tasks as a
bitmap of 64 to 128 bits a half; more are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import few_of, staged

#: Defaults of the parameters, see above.
MIN_CHARS, NEAR_WORDS = 20, 5
MAX_SHARED = 1 << 19
#: Which bit of its slot a key marks.
BIT = "cast((key >> 40) & 63 as int)"


def _text_id() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _half(n: Column) -> tuple[Column, Column]:
    """Lengths of the halves that a line of n words and one within one edit of it may share."""
    return F.ceil((n - 1) / 2).cast("int"), F.ceil(n / 2).cast("int")


def _halves() -> Column:
    """Hashes of the first and last halves of either length: places 0 and 2 are first halves, 1 and 3 last ones."""
    words, n, keys = F.col("words"), F.col("n"), []
    for h in _half(n):
        keys += [F.xxhash64(F.lit("first"), h, F.slice(words, 1, h)), F.xxhash64(F.lit("last"), h, F.slice(words, n - h + 1, h))]
    return F.array(*keys)


def _lines(docs: DataFrame, min_chars: int, near_words: int) -> DataFrame:
    """occ (place: doc_id, text_id, line number), line (outer spaces left out), its 128-bit hash h1, h2, and halves (null: no near test)."""
    lines = docs.select("doc_id", _text_id().alias("text_id"), F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    lines = lines.select(F.struct("doc_id", "text_id", "no").alias("occ"), F.trim("raw").alias("line")).where(F.length("line") >= min_chars)
    worded = lines.withColumn("words", F.split("line", " ")).withColumn("n", F.size("words"))
    # halves stand under no condition, so that what they share is computed once
    hashed = worded.select("occ", "line", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), _halves().alias("_halves"))
    return hashed.select("occ", "line", "h1", "h2", F.slice("_halves", 1, F.when(F.col("n") < near_words, 0).when(F.col("n") % 2 == 0, 2).otherwise(4)).alias("halves"))


def _suspects(lines: DataFrame, most: int) -> DataFrame:
    """Distinct lines that share a half with another line: h1, h2, words, n, first place, and whether a first or a last half is shared. Few others may pass."""
    halves = lines.select("h1", F.explode("halves").alias("key"))
    shared = halves.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high")
    shared = staged(shared.select("key"))
    n = shared.count()
    side = (F.col("k") % 2).alias("side")
    if n > most:
        marked = lines.select("h1", "h2", F.posexplode("halves").alias("k", "key")).join(shared.hint("merge"), "key", "left_semi").select("h1", "h2", side).distinct()
        asked = lines.join(marked.hint("merge"), ["h1", "h2"])
    else:
        slots = 1 << max(6, n.bit_length())
        slot = F.pmod(F.col("key"), F.lit(slots)).cast("int")
        bits = shared.select(slot.alias("slot"), F.expr(f"shiftleft(1L, {BIT})").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
        asked = lines.select("occ", "line", "h1", "h2", F.posexplode("halves").alias("k", "key")).withColumn("slot", slot)
        asked = asked.join(F.broadcast(bits), "slot").where(F.expr(f"(shiftright(bits, {BIT}) & 1) = 1")).withColumn("side", side)  # at most 2 * most rows of two numbers
    found = asked.groupBy("h1", "h2").agg(F.min("occ").alias("occ"), F.min("line").alias("line"), F.min("side").alias("low"), F.max("side").alias("high"))
    words = F.split("line", " ")
    return staged(found.select("h1", "h2", "occ", words.alias("words"), F.size(words).alias("n"), (F.col("low") == 0).alias("first"), (F.col("high") == 1).alias("last")))


def _added(array: Column, value: Column) -> Column:
    return F.concat(array, F.array(value).cast("array<bigint>"))


def _running(values: str, n: str) -> tuple[Column, Column]:
    """Blocks of about the square root of n values with the XOR of those before each place of the block (and after the last); XOR of all blocks before each."""
    zero, width = F.array(F.lit(0)).cast("array<bigint>"), F.ceil(F.sqrt(n)).cast("int")
    step = lambda acc, x: _added(acc, F.element_at(acc, -1).bitwiseXOR(x))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.col(n) / width).cast("int") - 1), lambda b: F.aggregate(F.slice(values, b * width + 1, width), zero, step))
    return blocks, F.aggregate("blocks", zero, lambda acc, part: step(acc, F.element_at(part, -1)))


def _variants(lines: DataFrame) -> DataFrame:
    """key, role, h1: a row for each word left out with the place kept (role 0) or closed (2), and one for the whole line (1).

    Words are left out of the other half than the one that is shared: that is where the edit is.
    """
    place = lambda i, w: F.xxhash64(i, w)
    here, moved = F.transform("words", lambda w, i: place(i, w)), F.transform("words", lambda w, i: place(i - 1, w))  # moved: once an earlier word is out
    half = _half(F.col("n"))[0]
    low, high = F.when(F.col("last"), 0).otherwise(half), F.when(F.col("first"), F.col("n")).otherwise(F.col("n") - half)
    at = lines.select("h1", "n", low.alias("low"), (high - low).alias("gaps"), here.alias("here"), moved.alias("moved"))
    at = at.withColumn("both", F.zip_with("here", "moved", lambda x, y: x.bitwiseXOR(y)))
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    blocks, base = _running("both", "n")
    at = at.withColumns({"blocks": blocks, "all_here": whole("here"), "all_moved": whole("moved")}).withColumn("base", base)
    before = F.flatten(F.zip_with(F.slice("base", 1, F.size("blocks")), "blocks", lambda p, part: F.transform(F.slice(part, 1, F.size(part) - 1), lambda x: p.bitwiseXOR(x))))
    asked = lambda c: F.slice(c, F.col("low") + 1, F.col("gaps"))
    rest = F.zip_with(asked(before), asked("moved"), lambda p, m: p.bitwiseXOR(m))
    replaced = F.transform(asked("here"), lambda x, i: F.struct(F.xxhash64(F.lit("replaced"), "n", i + F.col("low"), F.col("all_here").bitwiseXOR(x)).alias("key"), F.lit(0).alias("role")))
    shorter = F.transform(rest, lambda x: F.struct(F.xxhash64(F.lit("left out"), F.col("n") - 1, F.col("all_moved").bitwiseXOR(x)).alias("key"), F.lit(2).alias("role")))
    same = F.array(F.struct(F.xxhash64(F.lit("left out"), "n", "all_here").alias("key"), F.lit(1).alias("role")))
    return at.select("h1", F.inline(F.concat(replaced, shorter, same))).select("key", "role", "h1")


def near_lines(lines: DataFrame, most: int = MAX_SHARED) -> DataFrame:
    """h1, h2 of lines that have an earlier line within one word edit."""
    lines = _suspects(lines, most)
    variants = staged(_variants(lines))  # read twice
    met = variants.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.min("role").alias("r0"), F.max("role").alias("r1"))
    met = met.where("low <> high and (r0 = 0 or r0 < r1)").select("key")
    found = staged(variants.join(met, "key").distinct().join(lines, "h1").select("key", "role", "h1", "h2", "occ", "words"))
    line = F.struct("occ", "h1", "h2", "words")
    heads = found.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, line)).alias(f"head{r}") for r in (0, 1, 2)])
    both = found.join(heads, "key").withColumn("head", F.when(F.col("role") == 0, F.col("head0")).when(F.col("role") == 1, F.col("head2")).otherwise(F.col("head1")))
    both = both.where(F.col("head.occ") < F.col("occ"))
    return both.where(within_one_word(F.col("words"), F.col("head.words"))).select("h1", "h2").distinct()


def within_one_word(a: Column, b: Column) -> Column:
    """Whether word lists differ by one word replaced, inserted or left out at most."""

    def drops_to(long: Column, short: Column) -> Column:
        # the words before the first difference agree; those after it must agree shifted by one
        first = F.coalesce(F.array_position(F.zip_with(F.slice(long, 1, F.size(short)), short, lambda x, y: x == y), False), F.lit(0)).cast("int")
        at = F.when(first == 0, F.size(long)).otherwise(first)
        return F.slice(long, at + 1, F.size(long)) == F.slice(short, at, F.size(short) + 1)

    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: ~x)) <= 1
    return F.when(F.size(a) == F.size(b), same).when(F.size(a) == F.size(b) + 1, drops_to(a, b)).when(F.size(b) == F.size(a) + 1, drops_to(b, a)).otherwise(False)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, text_id, gone: the lines that go as bits, 64 lines a number."""
    lines = staged(_lines(docs, min_chars, near_words), "zstd")  # read four times; mostly text
    again = lines.groupBy("h1", "h2").agg(F.min("occ").alias("head"), F.count("*").alias("times")).where("times > 1").select("h1", "h2", "head", F.lit(False).alias("near"))
    near = near_lines(lines).select("h1", "h2", F.lit(None).cast(again.schema["head"].dataType).alias("head"), F.lit(True).alias("near"))
    # written, so that the join shuffles both sides and a line that a third of all documents hold can be split
    rules = staged(again.union(near).groupBy("h1", "h2").agg(F.max("head").alias("head"), F.max("near").alias("near")))
    gone = lines.select("occ", "h1", "h2").join(rules, ["h1", "h2"]).where(F.col("near") | (F.col("occ") != F.col("head")))
    marks = gone.select("occ.doc_id", "occ.text_id", F.expr("cast(occ.no div 64 as int)").alias("slot"), F.expr("shiftleft(1L, cast(occ.no % 64 as int))").alias("bit"))
    marks = marks.groupBy("doc_id", "text_id", "slot").agg(F.bit_or("bit").alias("bits"))
    marks = marks.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("slot", "bits")).alias("marks"))
    return marks.select("doc_id", "text_id", F.expr("transform(sequence(0, array_max(marks).slot), s -> coalesce(try_element_at(filter(marks, m -> m.slot = s), 1).bits, 0L))").alias("gone"))


def _rebuilt(docs: DataFrame, min_chars: int, near_words: int) -> DataFrame:
    """docs with text less its dropped lines, and _n_lines (before), _n_removed."""
    both = few_of(docs, dropped_lines(docs, min_chars, near_words).withColumnRenamed("gone", "_gone"), "left")
    kept = F.expr("array_join(filter(split(text, '\n'), (x, i) -> (shiftright(coalesce(get(_gone, cast(i div 64 as int)), 0L), cast(i % 64 as int)) & 1L) = 0L), '\n')")
    out = both.withColumn("_n_removed", F.expr("coalesce(aggregate(_gone, 0L, (n, x) -> n + bit_count(x)), 0L)"))
    out = out.withColumn("_n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
    return out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).drop("_gone")


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with text less its dropped lines, and n_lines (before), n_removed.

    docs: doc_id, text and any other columns (kept as they are, but for n_lines and n_removed, which are replaced). The
    earliest place is the least (doc_id, text_id, line number), null ids first. Null and empty texts have no lines to
    drop; rows with the same doc_id and text are one document: they share their decisions.
    """
    return _rebuilt(docs, min_chars, near_words).drop("n_lines", "n_removed").withColumnsRenamed({"_n_lines": "n_lines", "_n_removed": "n_removed"})


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the text that stays (null: empty)."""
    return deduplicate(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def keep_new(docs: DataFrame, min_chars: int = MIN_CHARS, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with their dropped lines gone and n_chars set anew where there is one; documents that lose all their words go."""
    done = _rebuilt(docs, min_chars, near_words)
    done = done.where((F.col("_n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


SQL = f"""
with lines as (
  select doc_id, no - 1 as no, trim(string_split(text, chr(10))[no]) as line
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as no from documents)
), good as (select * from lines where length(line) >= {MIN_CHARS}),
firsts as (
  select line, min(struct_pack(d := doc_id, n := no)) as occ, string_split(line, ' ') as w, len(string_split(line, ' ')) as n from good group by line
), near as (select * from firsts where n >= {NEAR_WORDS}),
gaps as (
  select line, occ, n, i, md5(array_to_string(list_concat(w[1:i-1], w[i+1:n]), ' ')) as rest
  from (select *, unnest(range(1, n + 1)) as i from near)
), replaced as (
  select line from (select line, occ, min(occ) over (partition by n, i, rest) as head from gaps) where head < occ
), longer as (
  select a.line from gaps a join near b on a.n = b.n + 1 and a.rest = md5(b.line) where b.occ < a.occ
), shorter as (
  select b.line from gaps a join near b on a.n = b.n + 1 and a.rest = md5(b.line) where a.occ < b.occ
), gone_lines as (select line from replaced union select line from longer union select line from shorter),
gone as (
  select g.doc_id, g.no from good g join firsts f using (line)
  where struct_pack(d := g.doc_id, n := g.no) <> f.occ or line in (select line from gone_lines)
), raw as (
  select doc_id, no - 1 as no, string_split(text, chr(10))[no] as raw
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as no from documents)
), kept as (
  select r.doc_id, count(*) as n_lines, count(g.no) as n_removed,
         coalesce(string_agg(r.raw, chr(10) order by r.no) filter (where g.no is null), '') as text
  from raw r left join gone g using (doc_id, no) group by r.doc_id
)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.text, d.text, '')) as kept_sha256
from documents d left join kept k using (doc_id)
"""
