"""Cleaning a corpus in five stages. Each takes (spark, docs, sf_dir) and returns the documents it keeps.

``docs`` needs doc_id and text, for the last stage also source and lang. All its columns, of whatever type or name, pass through
unchanged; only ``n_chars`` follows the text where lines are dropped, if there is such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cabledger.llm.decontaminate import drop_contaminated
from cabledger.llm.line_dedup import dedup_lines
from cabledger.llm.mixing import mix
from cabledger.llm.quality import quality
from cabledger.llm.simhash import near_groups
from cabledger.session import materialize

#: Documents scoring below it go.
GOOD_FROM = 0.3
#: What the last stage adds; columns of these names are replaced by it.
DRAWN = ["topic", "weight", "copies"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns a stage uses and all others in one, where its own columns can't clash with them."""
    others = [c for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(F.lit(None).cast("int").alias("__none"), *others).alias("__row"))


def _unpacked(packed: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    return packed.select(*[F.col(c) if c in used else F.col("__row")[c].alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    scored = quality(_packed(docs, "doc_id", "text"), _table(spark, sf_dir, "labels"))
    return _unpacked(scored.filter(F.col("score") >= GOOD_FROM), docs, "doc_id", "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that an earlier one has; ``n_chars`` follows the text."""
    cleaned = _unpacked(dedup_lines(_packed(docs, "doc_id", "text")), docs, "doc_id", "text")
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that fingerprints link, with the operator's own three-word shingles and two bits: the one with the
    least id (nulls last), then the least hash of its text, then the least other columns as text.

    Null and blank texts are one group. Rows without an id, or with one id and unlike texts, are documents of their own.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    found = materialize(near_groups(docs.select(key.alias("key"), "text"), "key", "text").select("id", "root"))
    kept = found.groupBy("root").agg(F.min("id").alias("__keep")).select("__keep")
    again = found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("__keep"), F.lit(True).alias("__again"))
    kept = kept.join(again, "__keep", "left").select(F.struct(F.col("__keep.id").alias("id"), F.col("__keep.digest").alias("digest")).alias("__keep"), "__again")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.struct(F.col("doc_id").alias("id"), F.md5("text").alias("digest")).alias("__key"))
    met = rows.join(kept, rows["__key"].eqNullSafe(kept["__keep"]))
    text = F.to_json("__row", {"ignoreNullFields": "false"})
    repeated = met.filter("__again").groupBy("__key").agg(F.min_by("__row", text).alias("__row"))
    return met.filter("__again is null").select("__row").unionByName(repeated.select("__row")).select("__row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents with their topic, the expected number of draws and how often each is drawn."""
    used = ("doc_id", "text", "source", "lang")
    drawn = mix(_packed(docs, *used)).filter("copies > 0")
    return drawn.select(*[F.col(c) if c in used else F.col("__row")[c].alias(c) for c in docs.columns if c not in DRAWN], *DRAWN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: SQL can't express the fitted classifier, so the pipeline is tested against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written before the next reads it."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
