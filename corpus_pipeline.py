"""From raw documents to packed sequences: the stages in order, each over all rows that its predecessor kept.

Every stage but the last returns the columns of ``documents``; rows whose ``doc_id`` is null pass the stages that compare
documents by id. A stage carries a document's columns along with its verdict, so texts are moved by the stage that removes
near copies only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.llm import minhash, mixing, ordinal, packing, risk_rules
from barlens.llm.common import settle, table
from barlens.llm.queries import domain

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The mixture: domains two to one, the language with most text not above its share, nine tenths of all tokens, no document twice.
WEIGHTS = {"domain": {"d0": 2.0}, "lang": {"en": 2.0}}
SHARE, SEED = 0.9, 29
#: Documents of this similarity or more, in percent, are near copies.
SIMILAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or the cutoffs certified for their language, go."""
    return risk_rules.judged(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).where("kept").select("_row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely poor than sound go, and those less likely clean than nearly all clean ones."""
    model = ordinal.fit(docs, ordinal.ratings(table(spark, sf_dir, "labels")))
    return ordinal.scored(docs, model, carry=COLUMNS).where("kept").select("_row.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id."""
    kept = minhash.near_duplicates(docs, percent=SIMILAR).where("kept and doc_id is not null")
    kept = settle(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")))
    out = docs.select(*COLUMNS).join(kept.where("rows = 1"), "doc_id", "left_semi").select(*COLUMNS)
    several = kept.where("rows > 1")
    if not several.isEmpty():  # an id that stands for several rows keeps the one whose columns sort first
        rest = docs.select(*COLUMNS).join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("_row"))
        out = out.unionByName(rest.select("doc_id", "_row.*"))
    return out.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each domain, language and source gives the tokens that the weights ask of it."""
    leaves = settle(mixing.plan(docs, domain=domain(), weights=WEIGHTS, share=SHARE, max_epochs=1, seed=SEED))
    return mixing.mixed(docs.select(*COLUMNS), leaves, domain=domain(), seed=SEED).select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("minhash_near_dedup", minhash_near_dedup),
    ("mix_sources", mix_sources), ("pack_sequences", pack_sequences),
]

#: Sketches, a fitted classifier and a tokenizer are beyond SQL; tests/llm holds stages against verdicts made anew from their input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
