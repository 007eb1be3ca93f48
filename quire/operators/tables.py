"""Operators over table cells: expansion of spans, header paths, pipe and HTML forms, OTSL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def expand_row(cells: Column) -> Column:
    """An array of structs (text, colspan) as one text per column; a spanning cell repeats its trimmed text."""
    return F.flatten(F.transform(cells, lambda c: F.array_repeat(T.trim_ws(c["text"]), F.greatest(c["colspan"], F.lit(1)))))


def lay_out(cells: DataFrame) -> DataFrame:
    """(table, r, c, text): every slot that a cell(table, row, col, rowspan, colspan, text) covers."""
    rows = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)))
    return rows.withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1))).select("table", "r", "c", "text")


def header_paths(cells: DataFrame) -> DataFrame:
    """(table, row, col, path): of each body cell the texts of the header cells above it, from the top.

    cells need role (header or body). Columns are joined one by one, so the range
    join is an equi join on (table, column).
    """
    head = cells.where("role = 'header'").withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1))).select("table", "c", F.col("row").alias("hrow"), F.col("text").alias("htext"))
    body = cells.where("role = 'body'")
    hit = body.join(head, [body["table"] == head["table"], body["col"] == head["c"], F.col("hrow") < body["row"]]).select(body["table"], "row", "col", "hrow", "htext")
    paths = hit.groupBy("table", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hrow", "htext"))), lambda x: x["htext"]), " > ").alias("path"))
    return body.select("table", "row", "col").join(paths, ["table", "row", "col"], "left")


def grid_cells(rows: DataFrame, by: list[str], row: str, value: Column) -> DataFrame:
    """One array<array<string>> for each key from rows in order; value is the array of a row's texts."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), value.alias("v")))), lambda x: x["v"]).alias("cells"))


def table_html(cells: Column, header_rows: Column | int = 1) -> Column:
    n = header_rows if isinstance(header_rows, Column) else F.lit(header_rows)
    row = lambda tag: lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), T.esc(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    head, body = F.slice(cells, 1, n), F.slice(cells, n + 1, F.size(cells))
    part = lambda name, tag, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"<{name}>"), F.array_join(F.transform(rows, row(tag)), ""), F.lit(f"</{name}>"))).otherwise("")
    return F.concat(F.lit("<table>"), part("thead", "th", head), part("tbody", "td", body), F.lit("</table>"))


def has_semantic_spans(cells: Column) -> Column:
    return F.exists(cells, lambda c: (c["rowspan"] > 1) | (c["colspan"] > 1))


def table_style(h_rules: Column, v_rules: Column) -> Column:
    """full-grid, column-ruled, booktabs or borderless, the first that fits."""
    return F.when((h_rules >= 3) & (v_rules >= 2), "full_grid").when(v_rules >= 2, "column_ruled").when(h_rules >= 2, "booktabs").otherwise("borderless")


_OTSL = re.compile(r"<(fcel|ecel|ched|rhed|srow|lcel|ucel|xcel|nl)>([^<]*)")


def otsl_cells(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, col, rowspan, colspan, header, text) of OTSL: lcel widens the cell to its left, ucel and xcel the one above, nl ends a row."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key, t in zip(pdf[id_], pdf[text], strict=True):
                grid: list[list[dict]] = [[]]
                for tag, body in _OTSL.findall(t or ""):
                    line = grid[-1]
                    if tag == "nl":
                        grid.append([])
                    elif tag == "lcel" and line:
                        cell = line[-1]
                        if cell["row"] == len(grid) - 1:
                            cell["colspan"] += 1
                        line.append(cell)
                    elif tag in ("ucel", "xcel") and len(grid) > 1 and len(line) < len(grid[-2]):
                        cell = grid[-2][len(line)]
                        cell["rowspan"] = len(grid) - cell["row"]
                        line.append(cell)
                    else:
                        line.append({"row": len(grid) - 1, "col": len(line), "rowspan": 1, "colspan": 1, "header": tag in ("ched", "rhed", "srow"), "text": body.strip()})
                seen = set()
                for line in grid:
                    for cell in line:
                        if id(cell) not in seen:
                            seen.add(id(cell))
                            rows.append({id_: key, **cell})
            yield pd.DataFrame(rows, columns=[id_, "row", "col", "rowspan", "colspan", "header", "text"])

    return docs.select(id_, text).mapInPandas(run, f"{id_} {dict(docs.dtypes)[id_]}, row int, col int, rowspan int, colspan int, header boolean, text string")
