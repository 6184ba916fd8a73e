"""Members of a group: dates moved back to the original, and one origin for copies of one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions.storage import staged
from pressloom.operators.similarity import alike_sets

METADATA_GAP_S, GROUP_GAP_S = 7 * 86400, 3 * 86400


def metadata_recirculation(rows: DataFrame, gap_s: int = METADATA_GAP_S) -> DataFrame:
    """rows: moment, modified (nullable), trusted -> moment unchanged, republished: set where a trusted date was modified more than gap_s later."""
    moved = F.col("trusted") & ((F.col("modified") - F.col("moment")) > gap_s)
    return rows.withColumn("republished", F.when(moved, F.col("modified")))


def _neighbours(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, set: sets of equal tokens within a group; set, near: each set with itself and those alike to it.

    The group is part of every token, so that only sets of one group meet, by their rare tokens. Whatever follows joins
    classes of equal headlines, never all pairs of a group.
    """
    tokens = F.transform("tokens", lambda t: F.concat_ws("\u0001", F.col("group").cast("string"), t))
    sets, links = alike_sets(members.select("id", tokens.alias("tokens")))
    sets, links = staged(sets), staged(links)
    every = sets.select("set", F.col("set").alias("near")).distinct()
    return sets, every.union(links.select("a", "b")).union(links.select("b", "a"))


def group_recirculation(members: DataFrame, gap_s: int = GROUP_GAP_S) -> DataFrame:
    """members: group, id, outlet, tokens, moment, republished -> original: the least date of an alike headline of the same outlet more than gap_s earlier, NULL if none. Members already moved are left alone."""
    sets, near = _neighbours(members)
    placed = members.join(sets, "id")
    first = placed.groupBy("set", "outlet").agg(F.min("moment").alias("first"))
    reach = near.join(first.withColumnRenamed("set", "near"), "near").groupBy("set", "outlet").agg(F.min("first").alias("first"))
    moved = placed.where("republished is null").join(reach, ["set", "outlet"]).where(F.col("first") < F.col("moment") - gap_s).select("id", F.col("first").alias("original"))
    return members.join(moved, "id", "left")


def merge_provenances(members: DataFrame) -> DataFrame:
    """members: group, id, outlet, provenance, tokens, moment -> id, provenance.

    In order of (moment, id) a member takes the resolved provenance of the first earlier alike member of another outlet.
    The first of each outlet in a class stands for it, the two first of other outlets for a neighbourhood; what a member
    takes its provenance from is then followed to its end by joins of pairs, which halve the way each round.
    """
    sets, near = _neighbours(members)
    placed = members.join(sets, "id")
    first = placed.groupBy("set", "outlet").agg(F.min(F.struct("moment", "id")).alias("f"))
    around = near.join(first.withColumnRenamed("set", "near"), "near").groupBy("set", "outlet").agg(F.min("f").alias("f"))
    one = around.groupBy("set").agg(F.min(F.struct("f", "outlet")).alias("one"))
    two = around.join(one, "set").where(F.col("outlet") != F.col("one.outlet")).groupBy("set").agg(F.min("f").alias("two"))
    best = one.join(two, "set", "left").select("set", F.col("one.outlet").alias("o1"), F.col("one.f").alias("f1"), F.col("two").alias("f2"))
    parent = F.when(F.col("o1") != F.col("outlet"), F.col("f1")).otherwise(F.col("f2"))
    links = placed.join(best, "set").select("id", "moment", parent.alias("p")).where(F.col("p") < F.struct("moment", "id")).select("id", F.col("p.id").alias("parent"))
    links = staged(links)
    while True:
        further = links.select(F.col("id").alias("parent"), F.col("parent").alias("_next"))
        moved = staged(links.join(further, "parent", "left").select("id", F.coalesce("_next", "parent").alias("parent"), F.col("_next").isNotNull().alias("moved")))
        links = moved.select("id", "parent")
        if moved.where("moved").isEmpty():
            break
    root = members.select(F.col("id").alias("parent"), F.col("provenance").alias("_root"))
    resolved = links.join(root, "parent").select("id", "_root")
    return members.select("id", "provenance").join(resolved, "id", "left").select("id", F.coalesce("_root", "provenance").alias("provenance"))
