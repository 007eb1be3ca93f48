from __future__ import annotations

import random

import corpus_pipeline as C
from quire.llm import queries
from quire.llm.packing import public_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    v = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(2500)]
    clean = lambda n: " ".join((w := rng.choice(v), w.capitalize() + ".")[rng.random() < 0.1] for _ in range(n))
    passage, item = clean(60), clean(25)
    texts = {i: clean(rng.randint(80, 200)) for i in range(120)}
    for i in range(0, 120, 6):
        texts[i] = rng.choice(["BUY NOW!! " * 80, " | ".join(rng.choice(v) for _ in range(150)), " ".join(rng.choice(v) + "###" for _ in range(150))])
    near = texts[1].split()
    near[40] = "changed"
    texts |= {200: texts[1], 201: " ".join(near), 202: texts[2] + " " + passage, 203: passage + " " + texts[3], 204: texts[4] + " " + item + " " + clean(30), 205: ""}
    for i in (202, 203, 204):
        texts[i] = clean(150) + " " + (item if i == 204 else passage) + " " + clean(150)
    return texts, passage, item


def test_every_stage(spark, tmp_path):
    texts, passage, item = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(None, None, None, None, None)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(120)], "doc_id long, quality int").selectExpr("*", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert docs.columns == columns, name
            seen.append({r.doc_id: r for r in docs.collect()})
    good = {i for i in texts if i >= 200 or i % 6} - {205}
    assert good <= seen[0].keys() | {205} and not [i for i in range(0, 120, 6) if i in seen[0]]
    assert seen[0].keys() - seen[1].keys() == {200, 201}
    assert seen[2].keys() == seen[1].keys()
    assert sum(passage[20:-20] in (r.text or "") for r in seen[2].values()) == 1
    assert all(r.n_chars == len(r.text) for i, r in seen[2].items() if i is not None)
    assert seen[2].keys() - seen[3].keys() == {204}
    tokens = docs.groupBy("doc_id").sum("length").count()
    assert tokens == len(seen[3])
    got = C.run(spark, str(tmp_path))
    assert got.count() == docs.count() and set(got.columns) == set(docs.columns)


def test_odd_rows_at_every_stage(spark, tmp_path):
    texts, passage, item = corpus()
    bad, copy, near = texts[0], texts[1], texts[201]
    rows = [(i, t) for i, t in texts.items() if i < 120]
    rows += [(None, bad), (1, bad), (None, copy), (1, copy), (1, copy), (None, near), (500, near), (None, texts[204]), (1, texts[204]), (2, ""), (None, ""), (3, None), (None, None), (4, "w " * 200_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), k, "x", 7, "r") for k, (i, t) in enumerate(rows)], f"{SCHEMA}, n_bytes long, kept_text string, _null int, _row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(120)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, columns, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), None, []
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert docs.columns == columns, name
            seen.append({r.n_bytes: r for r in docs.collect()})
    one, two, three, four = seen
    # equal texts, equal decisions, whatever the id
    by_text = {}
    for k, (_, t) in enumerate(rows):
        by_text.setdefault(t or "", set()).add(k in one)
    assert all(len(x) == 1 for x in by_text.values()) and by_text[bad] == {False} and by_text[copy] == {True}
    # one row of each group, with the smallest id
    group = [k for k, (_, t) in enumerate(rows) if t in (copy, near) and k in one]
    assert [rows[k] for k in group if k in two] == [(1, copy)]
    assert {k for k in one if k not in two} <= {*group, *(k for k, (_, t) in enumerate(rows) if t == texts[204])}
    assert sum(rows[k][1] == texts[204] for k in two) == 1
    assert three.keys() == two.keys() and all((three[k].text is None) == (rows[k][1] is None) and three[k].kept_text == "x" for k in three)
    assert {k for k in three if k not in four} == {k for k in three if rows[k][1] == texts[204]}
    assert docs.select("doc_id").where("doc_id is not null").distinct().count() == len({rows[k][0] for k in four if rows[k][0] is not None})


def test_empty_tables_at_every_stage(spark, tmp_path):
    for table, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in C.STAGES[:4]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() == 0
    assert C.run(spark, str(tmp_path)).count() == 0


def test_names_and_parts():
    names = queries.queries()
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert len(C.STAGES) == 5 and public_tokenizer("word_bpe_49k.json").endswith(".json")
