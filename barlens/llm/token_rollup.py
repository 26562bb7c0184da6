"""Token counts as delta-maintained rollups.

A rollup is a folder. A batch of changes (``insert``, ``revise``, ``delete``) is counted once for every tokenizer version and
committed as two sets of files: signed rows for each document (what the batch takes back, and what it adds) and, from them,
signed additive totals by source, language and tokenizer version. Totals of the corpus are the sum of the committed deltas;
no commit reads more of the past than the signed rows of its own documents.

Commits are idempotent. A batch has a name; its totals are written last, and their success marker is the commit. A batch
that has it is left alone; one that broke off is written anew over its own files. Readers see committed batches only.

In a batch the last change of a document counts (by ``seq``; of equal ones, the last by kind and text). Inserting a known
document replaces it, deleting an unknown one changes nothing. Defined results: null text has no tokens; null source and
language are values of their own; a null ``doc_id`` is ignored; other columns are ignored; an empty batch commits nothing to
sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlens.llm.common import bound_batches, settle
from barlens.llm.packing import Encoder

SIGNED = "doc_id bigint, source string, lang string, tokenizer string, docs bigint, tokens bigint"
KEYS = ("source", "lang", "tokenizer")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Rollup:
    """The rollup in ``folder`` for ``tokenizers``: version name to the file of a ``tokenizers`` vocabulary, or None for plain words."""

    def __init__(self, spark: SparkSession, folder: str, tokenizers: Mapping[str, str | None]) -> None:
        self.spark, self.folder, self.tokenizers = spark, folder.rstrip("/"), dict(tokenizers)

    def _at(self, kind: str, batch: str) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def _committed(self, kind: str, batches: list[str], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self._at(kind, b) for b in batches))

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals/batch=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(f.getPath().getParent().getName().removeprefix("batch=") for f in found)

    def _counted(self, changes: DataFrame) -> DataFrame:
        """A row of SIGNED for each document and tokenizer version."""
        tokenizers = self.tokenizers

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ready = {v: Encoder(p) if p else None for v, p in tokenizers.items()}
            for b in batches:
                text = b.pop("text")
                for version, encode in ready.items():
                    n = [len(encode(t)) // 4 for t in text] if encode else [len((t or "").encode("utf-8", "surrogatepass").split()) for t in text]
                    yield b.assign(tokenizer=version, docs=1, tokens=n)

        bound_batches(self.spark)
        return changes.select("doc_id", "source", "lang", "text").mapInPandas(run, SIGNED)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (``doc_id, change, text, source, lang, seq``); False if the batch was committed before."""
        if _exists(self.spark, f"{self._at('totals', batch)}/_SUCCESS"):
            return False
        past = self.batches()
        c = changes.where("doc_id is not null").select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("change").alias("change"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "seq"
        )
        # Ids that a batch changes twice need an order; the texts of the rest are not moved, and none where there are no such ids.
        twice = settle(c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
        last = c
        if not twice.isEmpty():
            order = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("seq"), F.desc("change"), F.desc_nulls_last("text"))
            repeated = c.join(twice, "doc_id", "left_semi").withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")
            last = c.join(twice, "doc_id", "left_anti").unionByName(repeated)
        new = self._counted(last.where("change <> 'delete'"))
        if past:
            ids = c.select("doc_id").distinct()
            old = self._committed("signed", past, SIGNED).join(ids, "doc_id", "left_semi")
            old = old.groupBy("doc_id", *KEYS).agg((-F.sum("docs")).alias("docs"), (-F.sum("tokens")).alias("tokens")).where("docs <> 0 or tokens <> 0")
            new = new.unionByName(old)
        new.write.mode("overwrite").parquet(self._at("signed", batch))
        signed = self.spark.read.schema(SIGNED).parquet(self._at("signed", batch))
        totals = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        totals.coalesce(1).write.mode("overwrite").parquet(self._at("totals", batch))
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)`` over all committed batches."""
        d = self._committed("totals", self.batches(), "source string, lang string, tokenizer string, docs bigint, tokens bigint")
        return d.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
