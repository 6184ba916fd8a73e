"""Pairs in a time window, exact set-similarity pairs and containment, each with a blocking key that loses nothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions.storage import staged
from pressloom.functions.text import near_identical

WINDOW_S, BLOCK = 72 * 3600, 2000


def window_tiles(items: DataFrame, window_s: int, block: int, within: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """items: id, v, moment and more -> rows with side (0, 1), and the columns that name a tile: each pair of items at most
    window_s apart (and alike in the columns within) meets in one tile, on both sides of it or once.

    Time is cut into buckets as long as the window, so a pair lies in one bucket (shift 0) or in two that follow each
    other (shift 1): the left side stands in its bucket, the right side in its own and the one before. Buckets of more
    than block items are split into square tiles.
    """
    own = list(within)
    placed = items.withColumn("bucket", F.floor(F.col("moment") / window_s).cast("long"))
    sizes = placed.groupBy(*own, "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    around = sizes.join(sizes.select(*own, (F.col("bucket") - 1).alias("bucket"), F.col("parts").alias("after")), [*own, "bucket"], "left")
    around = around.join(sizes.select(*own, (F.col("bucket") + 1).alias("bucket"), F.col("parts").alias("before")), [*own, "bucket"], "left")
    rows = placed.join(around, [*own, "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def tiles(shift: int, side: int, parts: str):
        """Tiles that a row joins: as left side in its own bucket, as right side there (shift 0) or in the one before (shift 1)."""
        others = F.when(F.col(parts).isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))
        at = F.col("bucket") - (1 if side and shift else 0)
        return F.transform(others, lambda o: F.struct(at.alias("bucket"), F.lit(shift).alias("shift"), (o if side else F.col("part")).alias("r"), (F.col("part") if side else o).alias("c"), F.lit(side).alias("side")))

    stands = F.concat(tiles(0, 0, "parts"), tiles(1, 0, "after"), tiles(0, 1, "parts"), tiles(1, 1, "before"))
    return rows.select(*items.columns, F.explode(stands).alias("s")).select(*items.columns, "s.*"), [*own, "bucket", "shift", "r", "c"]


def cosines(x: pd.DataFrame, y: pd.DataFrame, digits: int) -> np.ndarray:
    """Cosine of every row of x with every row of y, rounded."""
    m, n = (np.stack(p["v"].to_numpy()).astype(float) for p in (x, y))
    m, n = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (m, n))
    return np.round(m @ n.T, digits)


def window_pairs(items: DataFrame, least: float, below: float | None = None, window_s: int = WINDOW_S, block: int = BLOCK) -> DataFrame:
    """items: id, v, moment -> a < b, cosine of pairs at most window_s apart with least <= cosine (< below). A task holds
    two blocks of vectors and multiplies them once."""
    rows, keys = window_tiles(items.select("id", "v", "moment"), window_s, block)

    def multiply(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        x, y = both[both["side"] == 0], both[both["side"] == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        dots = cosines(x, y, 6)
        ok = (dots >= least) & (np.abs(x["moment"].to_numpy()[:, None] - y["moment"].to_numpy()[None]) <= window_s)
        if below is not None:
            ok &= dots < below
        i, j = x["id"].to_numpy(), y["id"].to_numpy()
        if key[1] == 0:
            ok &= i[:, None] < j[None]
        at = np.nonzero(ok)
        a, b = i[at[0]], j[at[1]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": dots[at]})

    kind = items.schema["id"].dataType.simpleString()
    return rows.groupBy(*keys).applyInPandas(multiply, f"a {kind}, b {kind}, cosine double")


def with_verdicts(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """pairs a, b, cosine and verdicts a, b, same (nullable) -> distance: 0 or 1 by verdict, else 1 - cosine; forbidden."""
    joined = pairs.join(verdicts, ["a", "b"], "left")
    return joined.select("a", "b", F.when(F.col("same"), 0.0).when(~F.col("same"), 1.0).otherwise(F.round(1 - F.col("cosine"), 6)).alias("distance"), F.coalesce(~F.col("same"), F.lit(False)).alias("forbidden"))


def alike_sets(items: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """items: id, tokens (array) -> (id, set: the least id with the same tokens; a < b: sets with Jaccard >= threshold).

    Exact prefix filter: tokens are ordered by rising frequency, and sets that share k tokens or more share k of their first
    n - ceil(threshold * n) + k. Keys are pairs of tokens (k = 2), which few sets share where single tokens are frequent;
    single ones serve the sets of LONG tokens or more, whose pairs are too many, and those so small that one shared token
    is enough. Equal sets are one set, whatever their number; items without tokens are in none.
    """
    sets = items.select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens")).where(F.size("tokens") > 0)
    distinct = staged(sets.groupBy("tokens").agg(F.min("id").alias("set")))
    members = sets.join(distinct.hint("merge"), "tokens").select("id", "set")
    counts = distinct.select("set", F.explode("tokens").alias("token"))
    frequency = counts.groupBy("token").agg(F.count("*").alias("df"))
    ranked = counts.join(frequency, "token").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))
    heads = staged(ranked.select("set", F.size("order").alias("n"), F.explode(head_keys(F.transform("order", lambda x: x["token"]), threshold)).alias("key")))
    other = heads.select("key", F.col("set").alias("b"), F.col("n").alias("n2"))
    near_size = (F.col("n2") >= F.lit(threshold) * F.col("n") - 1e-9) & (F.col("n") >= F.lit(threshold) * F.col("n2") - 1e-9)
    candidates = heads.withColumnRenamed("set", "a").join(other, "key").where((F.col("a") < F.col("b")) & near_size).select("a", "b").distinct()
    one, two = distinct.select(F.col("set").alias("a"), F.col("tokens").alias("t1")), distinct.select(F.col("set").alias("b"), F.col("tokens").alias("t2"))
    return members, candidates.join(one, "a").join(two, "b").where(near_identical(F.col("t1"), F.col("t2"), threshold)).select("a", "b")


#: Sets of so many tokens are looked up by single tokens.
LONG = 128


def head_keys(order: Column, threshold: float) -> Column:
    """Keys (hashes) of a set, of which alike sets share one; order: its tokens in an order common to all sets."""
    n = F.size(order)
    spare = n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int")
    first = lambda k: F.slice(order, F.lit(1), F.least(spare + k, n))
    pairs = F.flatten(F.transform(first(2), lambda x, i: F.transform(F.slice(order, F.lit(1), i), lambda y: F.xxhash64(y, x))))
    none = F.array().cast("array<bigint>")
    by_two = F.when(F.lit(threshold) * n <= LONG + 1e-9, pairs).otherwise(none)
    by_one = F.when((n >= LONG) | (F.lit(threshold) * n <= 1 + 1e-9), F.transform(first(1), lambda x: F.xxhash64(x))).otherwise(none)
    return F.array_distinct(F.concat(by_two, by_one))


def set_pairs(items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """items: id, tokens (array) -> a < b whose token sets have Jaccard >= threshold: all pairs, spelled out from classes of
    equal sets. For hot sets use alike_sets(), whose output grows with the items."""
    members, links = alike_sets(items, threshold)
    ids = staged(members)
    across = links.join(ids.select(F.col("id").alias("x"), F.col("set").alias("a")), "a").join(ids.select(F.col("id").alias("y"), F.col("set").alias("b")), "b").select("x", "y")
    within = ids.select(F.col("id").alias("x"), "set").join(ids.select(F.col("id").alias("y"), "set"), "set").where("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def containment(short: DataFrame, long: DataFrame, pattern: str = "[a-z0-9]+") -> DataFrame:
    """short: id, text; long: doc, text -> id, doc where the folded short text stands in the long one (empty: never).

    A text of three tokens or more is looked up by the rarest of its LOOKED longest inner tokens, which must be whole
    tokens of the long text, and the next two rarest must be there too before texts are fetched; shorter ones are looked
    up by their first characters.
    """
    words = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    tokened = short.where(F.length("text") > 0).withColumn("words", words)
    inner = F.slice("words", F.lit(2), F.greatest(F.size("words") - 2, F.lit(0)))
    longest = F.slice(F.sort_array(F.transform(F.array_distinct(inner), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), 1, LOOKED)
    asked = staged(tokened.where(F.size("words") >= 3).select("id", F.length("text").alias("least"), F.explode(F.transform(longest, lambda x: x["w"])).alias("token")))
    # only (doc, token) meets the tokens that are asked for; texts are fetched for the pairs that are left. A text that is shorter holds none
    held = staged(long.select("doc", F.length("text").alias("size"), F.explode(F.array_distinct(words)).alias("token")).join(asked.select("token").distinct(), "token", "left_semi").select("doc", "size", "token"))
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    rare = asked.join(df, "token", "left").groupBy("id", "least").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("t")).where(F.col("t")[0]["df"] > 0)
    keys = rare.select("id", "least", *(F.coalesce(F.get("t", F.lit(k))["token"], F.col("t")[0]["token"]).alias(f"token{k}") for k in range(3)))
    candidates = held.join(keys, (F.col("token") == F.col("token0")) & (F.col("least") <= F.col("size"))).select("doc", "id", "token1", "token2")
    for k in (1, 2):
        candidates = candidates.join(held.select(F.col("doc").alias("_d"), F.col("token").alias("_t")), (F.col("doc") == F.col("_d")) & (F.col(f"token{k}") == F.col("_t")), "left_semi")
    needles = tokened.select("id", F.col("text").alias("needle"))
    found = candidates.select("doc", "id").join(needles.hint("merge"), "id").join(long.hint("merge"), "doc").where(F.contains("text", "needle")).select("id", "doc")
    few = tokened.where(F.size("words") < 3).select("id", F.col("text").alias("needle"))
    return found.union(_by_grams(few, long))


#: Inner tokens of a text that it may be looked up by.
LOOKED = 6
#: Characters of the piece that a text of under three tokens is looked up by.
GRAM = 4


def _by_grams(few: DataFrame, long: DataFrame) -> DataFrame:
    """Short texts by their first GRAM characters (all, if fewer), which the long text must have somewhere."""
    size = F.least(F.length("needle"), F.lit(GRAM))
    keyed = few.select("id", "needle", F.substring("needle", F.lit(1), size).alias("gram"))
    sizes = sorted(r[0] for r in few.select(size.alias("n")).distinct().collect())  # GRAM values at most
    grams = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]))) if sizes else F.array().cast("array<string>")
    held = long.select("doc", F.explode(grams).alias("gram")).join(keyed.select("gram").distinct(), "gram", "left_semi")
    candidates = held.join(keyed, "gram").select("doc", "id", "needle")
    return candidates.join(long.hint("merge"), "doc").where(F.contains("text", "needle")).select("id", "doc").distinct()
