"""A training corpus from documents: five operators, one after the other.

Each stage works on all that its predecessor kept, is written as Parquet and read
again. All but the last return the columns of documents, extra ones included.
An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .decontaminate import PART, without_overlaps
from .ngram_join import jaccard_components
from .packing import pack_documents, public_tokenizer
from .quality import quality_scores, text_key
from .substring_dedup import ADDED, dedup_substrings

#: Numbers of rows or texts that may be broadcast: 16 MB.
FEW = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast while it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by all labels, takes for good ones.

    The score depends on the text alone, so rejected texts leave, in whatever rows
    they are: rows that repeat an id or have none are judged one by one. A null
    text is judged as an empty one.
    """
    scratch = Scratch(spark, "pipeline-quality")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = quality_scores(docs, labels, F.lit(True), scratch)
    bad = _small(scratch.write(score.where("predicted = 0").select(F.col("row").alias("rejected")).distinct(), "rejected"))
    return docs.join(bad, text_key(docs["text"]) == bad["rejected"], "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8): the one with the smallest id, null last.

    Of rows that repeat that id one stays, the first by text; rows without
    words belong to no group and stay.
    """
    scratch = Scratch(spark, "pipeline-groups")
    n, with_id, ids = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).head()
    if n == ids:
        groups = jaccard_components(docs, n=5, num=80, den=100)
        copies = _small(scratch.write(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies"))
        return docs.join(copies, "doc_id", "left_anti").select(docs.columns)
    # ids are missing or repeated: number the rows, and judge them by number
    place = "_row"
    while place in docs.columns:
        place += "_"
    rows = scratch.write(docs.withColumn(place, F.monotonically_increasing_id()), "rows")
    groups = jaccard_components(rows, n=5, num=80, den=100, id_=place).where("n_shingles > 0").select(F.col("doc_id").alias(place), F.col("component_id").alias("_group"))
    named = rows.select(place, F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.col(place).alias("row")).alias("_order")).join(groups, place)
    first = named.groupBy("_group").agg(F.min("_order")["row"].alias("kept"))
    copies = scratch.write(groups.join(first, (groups["_group"] == first["_group"]) & (groups[place] == first["kept"]), "left_anti").select(place), "copies")
    return rows.join(_small(copies), place, "left_anti").select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a smaller id has too; n_chars follows the text.

    Rows without an id, and null texts, stay as they are.
    """
    added, null = list(ADDED), "_null"
    while {null, *added} & set(docs.columns):
        added, null = [f"_{c}" for c in added], f"_{null}"
    out = dedup_substrings(docs.withColumn(null, F.col("text").isNull()), added=tuple(added))
    out = out.withColumn("text", F.when(~F.col(null), F.col(added[0])))
    removed = added[2]
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark and no longer part of one (stage 3 may have left a part).

    Texts are judged, in whatever rows they are; null and empty ones stay.
    """
    return without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), part=PART)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths of at most 2048 tokens, with their ids.

    A null text is the end token alone; a null id stays null; repeated rows are
    packed each; other columns are left out.
    """
    return pack_documents(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("n-gram jaccard join", near_duplicates), ("suffix-array dedup", substrings), ("benchmark decontamination", decontaminate), ("packing", packing)]

#: The classifier, the suffix arrays and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
