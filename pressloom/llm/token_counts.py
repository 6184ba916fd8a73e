"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A batch of changes is insert, delete or revise rows. Committing it writes, in a folder of the batch's own, the
ledger entries it adds (+1) and takes back (-1), then their sums by group. The sums are written last and Spark's
_SUCCESS file beside them is the commit: a batch with one is skipped when sent again, a batch without one is
written over. Totals are the sum of all committed sums, so no batch reads the text of another.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm.tokens import loaded, tokenizer_path

GROUP = ["source", "lang", "tokenizer"]


def default_tokenizers() -> dict[str, str]:
    return {name.split(".")[0]: tokenizer_path(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken")}


def _counted(batches, tokenizers: dict[str, str]):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        kept = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        for version, path in tokenizers.items():
            counts = loaded(path).counts(texts)
            yield pa.RecordBatch.from_arrays([*kept, pa.array([version] * len(texts), pa.string()), pa.array(counts, pa.int64())], [*names, "tokenizer", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens: a row a document and tokenizer. A null text has no tokens."""
    versions = tokenizers or default_tokenizers()
    read = docs.select("doc_id", "source", "lang", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema if f.name != "text")
    return read.mapInArrow(lambda it: _counted(it, versions), f"{kept}, tokenizer string, n_tokens bigint")


class TokenTotals:
    """The rollup in one shared folder.

    Null source, lang and text are values of their own (null text: 0 tokens). Inserting a document twice counts it
    twice; deleting or revising takes back every entry that earlier batches left for its doc_id; a revise of a doc_id
    that they left nothing for is an insert; a null doc_id has no entries to take back. The rows of one batch do not
    see each other: a document that a batch both inserts and deletes loses its earlier entries and keeps the new one,
    and every insert and revise row of a batch adds an entry. Rows with another op, or none, do nothing. One batch is
    committed at a time: two writers at once do not see each other's entries.
    """

    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict[str, str] | None = None):
        self.spark, self.folder, self.tokenizers = spark, folder, tokenizers or default_tokenizers()

    def _batches(self) -> list[str]:
        """Committed batches: their folders of sums have Spark's _SUCCESS file."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/sums/*/_SUCCESS")
        found = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(hadoop)
        return sorted(str(f.getPath().getParent().getName()) for f in found or [])

    def _read(self, kind: str) -> DataFrame | None:
        paths = [f"{self.folder}/{kind}/{b}" for b in self._batches()]
        return self.spark.read.parquet(*paths) if paths else None

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes: op ('insert', 'delete' or 'revise'), doc_id, source, lang, text. False: it was committed before."""
        if batch in self._batches():
            return False
        added = count_tokens(changes.where("op in ('insert', 'revise')"), self.tokenizers).withColumn("sign", F.lit(1))
        ledger = self._read("entries")
        if ledger is not None:
            gone = changes.where("op in ('delete', 'revise')").select("doc_id").distinct()
            # only entries of the batch's own documents are added up, however long the history is
            current = ledger.join(gone.hint("merge"), "doc_id", "left_semi").groupBy("doc_id", *GROUP, "n_tokens").agg(F.sum("sign").cast("int").alias("sign"))
            taken = current.where("sign > 0").withColumn("sign", -F.col("sign"))
            added = added.unionByName(taken)
        entries = f"{self.folder}/entries/{batch}"
        added.write.mode("overwrite").parquet(entries)
        sums = self.spark.read.schema(added.schema).parquet(entries).groupBy(*GROUP)
        sums.agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")).write.mode("overwrite").parquet(f"{self.folder}/sums/{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; groups that are empty again go."""
        sums = self._read("sums")
        if sums is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint")
        return sums.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
