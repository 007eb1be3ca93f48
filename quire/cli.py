"""spark-submit entry: converts a folder of HTML or text files to Markdown, text or the model's tables.

    spark-submit quire/cli.py INPUT OUTPUT --to markdown|text|model [--from html|text]

Files are rows (binaryFile); one that can't be decoded is reported, not fatal.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import build, markup, model
from quire.plans.session import ship


def sources(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, error): the path's files, decoded as UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(F.col("path").alias("doc_id"), text.alias("text"), F.when(text.isNull(), "not UTF-8").alias("error"))


def convert(spark: SparkSession, path: str, target: str, to: str, kind: str = "html") -> DataFrame:
    """Writes the conversion and returns (doc_id, error) of the files left out."""
    rows = sources(spark, path)
    good = rows.where("error is null")
    if to == "model":
        blocks = build.page_blocks(good.select("doc_id", F.col("text").alias("html")), "doc_id") if kind == "html" else model.line_blocks(good)
        build.write(build.build_model(blocks), target)
    else:
        value = F.col("text") if kind == "text" else markup.to_markdown(F.col("text")) if to == "markdown" else None
        out = good.select("doc_id", value.alias("value")) if value is not None else markup.text_of(good.select("doc_id", F.col("text").alias("html")), "doc_id").withColumnRenamed("text", "value")
        out.write.mode("overwrite").parquet(target)
    return rows.where("error is not null").select("doc_id", "error")


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--to", choices=("markdown", "text", "model"), default="markdown")
    parser.add_argument("--from", dest="kind", choices=("html", "text"), default="html")
    args = parser.parse_args()
    spark = ship(SparkSession.builder.appName("quire-convert").getOrCreate())
    for row in convert(spark, args.input, args.output, args.to, args.kind).toLocalIterator():
        print(f"{row.doc_id}: {row.error}")


if __name__ == "__main__":
    main()
