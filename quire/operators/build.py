"""From web pages or texts to the model's tables, and those tables to disk."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import classify as K
from quire.functions import text as T
from quire.operators import markup, model


def page_blocks(pages: DataFrame, id_: str = "page_id", html: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
    """Blocks of web pages: headings, paragraphs, list items, captions and code, in order, with inline text only.

    An element's text is that of the nodes under it; paragraphs without text are no
    blocks. Everything is on page 1. references: those decoded in texts, as in markup.nodes.
    """
    # Fixed kinds of elements.
    kinds = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "para", "li": "list_item", "figcaption": "caption", "pre": "code", "blockquote": "para"}
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    nodes = markup.nodes(pages, id_, html, references).withColumnRenamed(id_, "doc_id").select("doc_id", "ord", "depth", "tag", "text", kind[F.col("tag")].alias("kind"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    # a text belongs to the last block element before it
    n = nodes.withColumn("owner", F.last(F.when(F.col("kind").isNotNull(), F.struct("ord", "kind", "tag")), ignorenulls=True).over(w))
    parts = n.where("tag is null and owner is not null").groupBy("doc_id", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("text"))
    made = parts.select("doc_id", F.col("owner.ord").alias("at"), F.col("owner.kind").alias("kind"), F.col("owner.tag").alias("tag"), T.normalize_ws(F.col("text")).alias("text")).where("text <> '' or kind = 'list_item'")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    level = F.when(F.col("kind") == "heading", F.substring("tag", 2, 1).cast("int"))
    return made.withColumn("ord", place).select("doc_id", "ord", F.format_string("b%04d", "ord").alias("id"), "kind", F.lit(1).alias("page"), "text", level.alias("heading_level"))


def build_model(blocks: DataFrame) -> dict[str, DataFrame]:
    """The model's tables: blocks (with section), sections, chunks and a row of totals for each document."""
    named = model.sections(blocks)
    ids = named.select("doc_id", F.col("ord").alias("section_ord"), F.col("id").alias("section"))
    whole = model.attribute_sections(blocks).join(ids, ["doc_id", "section_ord"], "left").drop("section_ord")
    return {"blocks": whole, "sections": named, "chunks": model.derive_chunks(whole), "documents": model.info(blocks)}


def write(tables: dict[str, DataFrame], target: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")


def read(spark: SparkSession, target: str, names: tuple[str, ...] = ("blocks", "sections", "chunks", "documents")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{target}/{n}") for n in names}


def ocr_plan(pages: DataFrame, images: DataFrame, producer: str = "producer", n_text: Column | None = None, garbled: Column | None = None) -> DataFrame:
    """(doc_id, page, decision): pages(doc_id, page, text, area, producer) with the largest of images(doc_id, page, area) on each.

    n_text and garbled are other measures of the pages' texts than the trimmed length and is_garbled.
    """
    largest = images.groupBy("doc_id", "page").agg(F.max("area").alias("image_area"))
    p = pages.join(largest, ["doc_id", "page"], "left")
    t = T.trim_ws(F.coalesce("text", F.lit("")))
    return p.select("doc_id", "page", K.ocr_decision(F.col("image_area").isNotNull(), F.col("image_area") / F.greatest(F.col("area"), F.lit(1.0)), F.length(t) if n_text is None else n_text, F.col(producer), K.is_garbled(t) if garbled is None else garbled).alias("decision"))


def nest_sections(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with each heading and what follows it in a <section id=...>, nested by level and closed before </body>."""
    head = re.compile(r"<h([1-6])>(.*?)</h\1>|</body>", re.S)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(source):
            if source is None:
                return None
            taken = set(re.findall(r'id="([^"]*)"', source))
            start = source.find("</header>")
            out, open_, at = [], [], 0
            for m in head.finditer(source, max(start, 0)):
                if m[1] is None:
                    out += [source[at : m.start()], "</section>" * len(open_)]
                    open_, at = [], m.start()
                    continue
                label = re.sub(r"<[^>]*>", "", m[2]).strip()
                if not label:
                    continue
                base = re.sub(r"[^A-Za-z0-9._-]", "-", "sec-" + label.lower()).strip("-")
                name, k = base, 2
                while name in taken:
                    name, k = f"{base}-{k}", k + 1
                taken.add(name)
                out.append(source[at : m.start()])
                while open_ and open_[-1] >= int(m[1]):
                    out.append("</section>")
                    open_.pop()
                out.append(f'<section id="{name}">')
                open_.append(int(m[1]))
                at = m.start()
            return "".join(out) + source[at:]

        return s.map(one)

    return pages.withColumn(html, run(F.col(html)))
