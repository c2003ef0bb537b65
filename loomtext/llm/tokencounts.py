"""Token counts as rollups that signed deltas maintain.

A delta row says that a document's tokens under one tokenizer version join (+1) or leave (-1) the
totals; a revised count is the old one with -1 and the new one with +1. A batch of deltas is summed by
source, language and version before anything else moves, and stored as one folder of partial sums;
sums are additive, so totals are the sum of all committed batches. Spark's committer puts a _SUCCESS
file into a folder only when all its tasks ended: that is the commit. A batch whose folder has it is
skipped when it comes again, one that broke off is written anew; so replays and lost executors
change nothing. `compact` folds committed batches into one and keeps their names in a ledger.

Defined results: null source, lang and text (0 tokens) are values like others; a group whose sums are
all zero is dropped; repeated rows count as often as they occur; no batch, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import materialize, scratch_path, sliced, texts_of
from loomtext.llm.mixing import size_of
from loomtext.llm.tokens import default_path, encoder

KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def count_documents(docs: DataFrame, path: str | None = None, version: str = "word_bpe_49k") -> DataFrame:
    """doc_id, source, lang, n_words and n_tokens of whole texts under the tokenizer in `path`."""
    model = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2048):
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(encoder(model).lengths(texts_of(batch, 4)))], ["doc_id", "source", "lang", "n_words", "n_tokens"])

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), size_of(F.col("text")).alias("n_words"), "text")
    return chosen.mapInArrow(count, "doc_id bigint, source string, lang string, n_words bigint, n_tokens bigint").withColumn("tokenizer", F.lit(version))


def deltas(counts: DataFrame, sign: int, tokens: str = "n_tokens", tokenizer: str | None = None) -> DataFrame:
    """Delta rows of counts: source, lang, tokenizer, sign, n_tokens."""
    version = F.lit(tokenizer) if tokenizer else F.col("tokenizer")
    return counts.select("source", "lang", version.alias("tokenizer"), F.lit(sign).alias("sign"), F.col(tokens).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts leave, new ones join."""
    return deltas(old, -1).unionByName(deltas(new, 1))


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _folders(self) -> list[str]:
        fs, at = self._fs(self.path)
        if not fs.exists(at):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if self._exists(f"{self.path}/{x.getPath().getName()}/_SUCCESS"))

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        out: list[str] = []
        for name in self._folders():
            kind, _, rest = name.partition("=")
            if kind == "batch":
                out.append(rest)
            elif kind == "ledger":
                out += [r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{name}").collect()]
        return sorted(set(out))

    def apply(self, batch: str, rows: DataFrame) -> bool:
        """Commit a batch of delta rows; False if it has been committed before."""
        if not batch or not all(x.isalnum() or x in "-_." for x in batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        sums = rows.groupBy(*KEYS).agg(F.sum("sign").cast("bigint").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("bigint").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        names = [x for x in self._folders() if x.startswith(("batch=", "base="))]
        bases = [x for x in names if x.startswith("base=")]
        if bases:  # the newest base holds every batch that its ledger names
            done = {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/ledger={bases[-1][5:]}").collect()}
            names = [bases[-1], *(x for x in names if x.startswith("batch=") and x[6:] not in done)]
        if not names:
            return self.spark.createDataFrame([], SUMS)
        parts = self.spark.read.schema(SUMS).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{x}" for x in names))
        out = parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold the committed batches into one base. The ledger is written first, so a base never lacks one; folders stay until the next base is complete."""
        old = self._folders()
        number = f"{1 + max([-1, *(int(x[5:]) for x in old if x.startswith('base='))]):09d}"
        done, totals = self.batches(), self.totals()
        fs, _ = self._fs(self.path)
        self.spark.createDataFrame([(x,) for x in done], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger={number}")
        totals.write.mode("overwrite").parquet(f"{self.path}/base={number}")
        for name in old:
            fs.delete(self._fs(f"{self.path}/{name}")[1], True)


def document_totals(docs: DataFrame, path: str | None = None, whole: bool = False) -> DataFrame:
    """Totals of all documents, through five batches, or six.

    All texts are inserted under two versions: white-space words, and the tokenizer. Then each count
    under the tokenizer is revised to include an end token (version kept), the insert is delivered a
    second time, which changes nothing, and documents without a word are withdrawn. With
    `whole` these are inserted again in the end, so that the totals cover every document.
    """
    spark = docs.sparkSession
    counts = materialize(count_documents(docs, path), "token-counts")
    rollup = Rollup(spark, scratch_path(spark, "token-totals"))
    rollup.apply("insert-words", deltas(counts, 1, "n_words", "words"))
    rollup.apply("insert-tokens", deltas(counts, 1))
    ended = counts.withColumn("n_tokens", F.col("n_tokens") + 1)
    rollup.apply("revise-tokens", revisions(counts, ended))
    rollup.apply("insert-tokens", deltas(counts, 1))
    bare = ended.where("n_words = 0")
    rollup.apply("withdraw-bare", deltas(bare, -1).unionByName(deltas(bare, -1, "n_words", "words")))
    if whole:
        rollup.apply("insert-bare", deltas(bare, 1).unionByName(deltas(bare, 1, "n_words", "words")))
    return rollup.totals()
