"""Document fingerprints by consistent weighted sampling, with DataFrame functions alone.

A term is a word, its weight how often the text has it. For sample k a term draws r and c from Gamma(2, 1) and b from
[0, 1) by hashing (term, k); with t = floor(ln(weight) / r + b) its rank is ln(c) - r * (t - b + 1), and the sample is
the (term, t) of least rank (Ioffe, 2010). The rank depends on (term, t, k) alone, so two texts agree in sample k just
when their least ranks are equal, with probability equal to the generalised Jaccard similarity of their word counts.
That makes a signature K minima of doubles: an ordinary hash aggregate, and no rank is ever shuffled.

The neighbour in descending doc_id is found without a global sort: ids are dealt into ranges of about RANGE rows, lead()
runs inside a range, and what follows a range is found among the ranges' greatest ids in the same way.

K samples estimate the similarity with a standard error of at most 0.09 (K = 32; it falls with the root of K).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType

from pressloom.llm.common import staged

K, RANGE, SMALL = 32, 100, 10_000
#: Ids that the cuts between pieces are taken from, and pieces; further ids are dealt inside a piece.
SAMPLE, PIECES = 16_384, 256
SPACE = r"[\x20\x09-\x0D]+"


class Dealing:
    """Ranges of ids in ascending order, of about size rows each.

    Ids are cut into PIECES at the quantiles of a bounded sample (the SAMPLE least hashes), so that far or crowded ids
    take one piece at most with them. Integers of a piece are then cut into equal widths; ids of other types are not.
    """

    def __init__(self, ids: DataFrame, size: int):
        drawn = sorted(r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect())  # at most SAMPLE ids
        self.kind = ids.schema["doc_id"].dataType
        self.cuts = sorted({drawn[len(drawn) * k // PIECES] for k in range(1, PIECES)}) if drawn else []
        edges = ids.groupBy(self.piece().alias("piece")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).collect()  # a row a piece
        self.n = sum(r["n"] for r in edges)
        self.whole = isinstance(self.kind, IntegralType)
        self.lows, self.widths = [0] * (len(self.cuts) + 1), [1] * (len(self.cuts) + 1)
        if self.whole:
            for r in edges:
                self.lows[r["piece"]], self.widths[r["piece"]] = r["low"], max(1, -(-(r["high"] - r["low"] + 1) * size // r["n"]))

    def piece(self) -> Column:
        """How many cuts are at or below the id."""
        if not self.cuts:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(c) for c in self.cuts]).cast(ArrayType(self.kind)), lambda c: c <= F.col("doc_id")))

    def bucket(self) -> Column:
        """Number of the range; a null id is in none: -1."""
        piece = self.piece()
        inside = F.lit(0)
        if self.whole:
            at = lambda values: F.element_at(F.array(*[F.lit(v).cast("decimal(38,0)") for v in values]), piece + 1)
            inside = F.floor((F.col("doc_id").cast("decimal(38,0)") - at(self.lows)) / at(self.widths))
        return F.when(F.col("doc_id").isNull(), -1).otherwise(piece * (1 << 32) + inside).cast("long")


def following(ids: DataFrame, size: int = RANGE, small: int = SMALL, dealing: Dealing | None = None) -> DataFrame:
    """doc_id, next_id for distinct non-null doc_id of any orderable type: the next in descending order, the first after the last."""
    dealing = dealing or Dealing(ids, size)
    if dealing.n <= max(small, 2 * PIECES):
        order = Window.orderBy(F.desc("doc_id"))  # at most SMALL rows
        return ids.withColumn("next_id", F.coalesce(F.lead("doc_id").over(order), F.max("doc_id").over(order)))
    dealt = ids.withColumn("bucket", dealing.bucket())
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    after = heads.join(following(heads.select("doc_id"), size, small), "doc_id").select("bucket", F.col("next_id").alias("after"))
    inside = dealt.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("bucket").orderBy(F.desc("doc_id"))))
    return inside.join(after, "bucket").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def ranked(term: Column, weight_log: Column, k: int) -> Column:
    """Rank of a term (64-bit hash) in sample k."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    u1 = (F.shiftrightunsigned(one, 32) + 0.5) / float(1 << 32)
    u2 = (one.bitwiseAND(F.lit((1 << 32) - 1)) + 0.5) / float(1 << 32)
    u3 = (F.shiftrightunsigned(two, 40) + 0.5) / float(1 << 24)
    u4 = (F.shiftrightunsigned(two, 16).bitwiseAND(F.lit((1 << 24) - 1)) + 0.5) / float(1 << 24)
    b = two.bitwiseAND(F.lit((1 << 16) - 1)) / float(1 << 16)
    r, c = -F.ln(u1 * u2), -F.ln(u3 * u4)
    return F.ln(c) - r * (F.floor(weight_log / r + b) - b + 1)


def signatures(texts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """keys, samples (array of k 32-bit hashes) for texts of keys, text; texts with equal keys are taken together, those without words left out."""
    words = texts.select(*keys, F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    counts = words.groupBy(*keys, F.xxhash64("word").alias("term")).count()
    weighed = counts.select(*keys, "term", F.ln(F.col("count").cast("double")).alias("weight"))
    # the ranks stand under no condition, so that what they share is computed once a term and sample
    least = weighed.groupBy(*keys).agg(*[F.min(ranked(F.col("term"), F.col("weight"), i)).alias(f"s{i}") for i in range(k)])
    hashed = F.array(*[F.xxhash64(f"s{i}").bitwiseAND(F.lit((1 << 32) - 1)) for i in range(k)])
    return least.select(*keys, hashed.alias("samples"))


def nothing(k: int = K) -> Column:
    """The samples of a text without words, equal for all of them."""
    return F.array_repeat(F.lit(0).cast("long"), k)


def as_text(samples: str) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: str, b: str, k: int = K) -> Column:
    """Share of equal samples, an estimate of generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(k))


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows by range of ids: bucket, edge (a copy of the row that follows the range), doc_id, text."""
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = read.select("doc_id").where("doc_id is not null").distinct()
    dealing = Dealing(ids, RANGE)
    rows = read.select(dealing.bucket().alias("bucket"), F.lit(False).alias("edge"), "doc_id", "text")
    if not dealing.n:
        return rows
    heads = ids.groupBy(dealing.bucket().alias("bucket")).agg(F.max("doc_id").alias("doc_id"))
    # one row a range, written, so that Spark knows its size before it plans the join: small enough it is broadcast and texts stay in place
    after = staged(heads.join(following(heads.select("doc_id")), "doc_id").select("bucket", F.col("next_id").alias("doc_id")))
    return rows.union(read.join(after, "doc_id").select("bucket", F.lit(True), "doc_id", "text"))


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    docs: doc_id (of an orderable type), text; other columns are not read. Null text is empty. A lone document follows itself. Rows with
    one doc_id follow each other by text; rows without an id are a range of their own whose last row has no next
    (an empty text).
    """
    order = Window.partitionBy("bucket").orderBy("edge", F.desc("doc_id"), F.desc("text"))
    # bucket is never null; said here, the optimizer adds it to neither reading alone and both share one shuffle of texts
    rows = _in_order(docs).where("bucket is not null").withColumn("pos", F.row_number().over(order)).withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), edited.alias("text")))
    texts = rows.select("bucket", "pos", F.inline(sides))
    signed = signatures(texts, ["bucket", "pos", "side"], k).groupBy("bucket", "pos").agg(*[F.max(F.when(F.col("side") == i, F.col("samples"))).alias(name) for i, name in enumerate(("own", "other"))])
    base = rows.select("bucket", "pos", "edge", "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))
    both = base.join(signed, ["bucket", "pos"], "left").withColumns({c: F.coalesce(c, nothing(k)) for c in ("own", "other")}).withColumn("after", F.lead("own").over(Window.partitionBy("bucket").orderBy("pos")))
    return both.where("not edge").select(
        "doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"),
        likeness("own", "other", k).alias("near_edited"), F.coalesce(likeness("own", "after", k), F.lit(0.0)).alias("near_next"),
    )
