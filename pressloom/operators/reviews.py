"""Review decisions over versioned content. Decisions: case_id, state, us, seq, version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States and the moves between them.
STATES = ("nuevo", "en_revision", "requiere_evidencia", "aprobado_como_borrador", "descartado")
MOVES = {
    "nuevo": ("en_revision", "requiere_evidencia", "descartado"),
    "en_revision": ("requiere_evidencia", "aprobado_como_borrador", "descartado"),
    "requiere_evidencia": ("en_revision", "descartado"),
    "aprobado_como_borrador": ("en_revision", "descartado"),
    "descartado": ("en_revision",),
}
FIRST = "nuevo"


def current_state(decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, state: the latest by (us, seq), the first state where there is none."""
    last = decisions.groupBy("case_id").agg(F.max(F.struct("us", "seq", "state"))["state"].alias("state"))
    return cases.select("case_id").join(last, "case_id", "left").select("case_id", F.coalesce("state", F.lit(FIRST)).alias("state"))


def transition_errors(decisions: DataFrame, moves: dict[str, tuple[str, ...]] = MOVES) -> DataFrame:
    """case_id, seq, previous, state of moves that are not allowed; only the first decision may be the first state."""
    order = Window.partitionBy("case_id").orderBy("us", "seq")
    moved = decisions.withColumn("previous", F.lag("state").over(order))
    allowed = F.lit(False)
    for a, targets in moves.items():
        allowed = allowed | ((F.col("previous") == a) & F.col("state").isin(*targets))
    return moved.where(F.col("previous").isNotNull() & ~allowed).select("case_id", "seq", "previous", "state")


def version_bound(decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """cases: case_id, version (a case may have several) -> the latest decision made on that version, NULL if none."""
    bound = decisions.join(cases, ["case_id", "version"])
    return cases.join(bound.groupBy("case_id", "version").agg(F.max(F.struct("us", "seq", "state"))["state"].alias("state")), ["case_id", "version"], "left").select("case_id", "version", "state")


def timeline(decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: case_id, us, version -> decisions and changes by (us desc), each with its place; a change supersedes if an earlier version was decided on."""
    first = decisions.groupBy("case_id").agg(F.min("version").alias("decided"))
    a = decisions.select("case_id", "us", F.lit("decision").alias("kind"), F.col("state").alias("what"), F.lit(False).alias("supersedes"), "seq")
    b = changes.join(first, "case_id", "left").select("case_id", "us", F.lit("change").alias("kind"), F.concat(F.lit("v"), "version").alias("what"), F.coalesce(F.col("decided") < F.col("version"), F.lit(False)).alias("supersedes"), F.col("version").cast("long").alias("seq"))
    order = Window.partitionBy("case_id").orderBy(F.desc("us"), "kind", "seq")
    return a.unionByName(b).withColumn("place", F.row_number().over(order)).drop("seq")


def snapshots(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """cases: case_id, content; evidence: case_id, evidence_id, text -> case_id, hash over content and sorted evidence."""
    parts = evidence.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "evidence_id", "text"))), "|").alias("parts"))
    return cases.join(parts, "case_id", "left").select("case_id", F.sha2(F.concat_ws("#", "content", F.coalesce("parts", F.lit(""))), 256).alias("hash"))


def reconcile(decisions: DataFrame, hashes: DataFrame) -> DataFrame:
    """decisions with the hash they were made on; hashes: case_id, hash -> archived where it is not the current one."""
    now = hashes.withColumnRenamed("hash", "current")
    return decisions.join(now, "case_id", "left").withColumn("archived", ~F.col("hash").eqNullSafe(F.col("current"))).drop("current")
