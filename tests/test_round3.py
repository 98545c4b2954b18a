import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrix import durable
from papyrix.functions import chunk
from papyrix.llm import license_scan
from papyrix.operators import dupes, lexical, stats, vector
from papyrix.plans import oracles, queries


def test_pages_agree_with_their_sql_on_references_without_an_end(spark, tmp_path):
    page = "<html><head><title> {0} </title></head><body><nav>&amp</nav><article><h1>{0}</h1><p>a&b &copy; {0}</p></article></body></html>"
    rows = [(i, page.format(t)) for i, t in enumerate(["one &amp;&amp", "&quot two", "&am three &amp;amp;", "&middot;&copy four", "five &"])]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for f in (queries.page_meta, queries.page_text):
        want = con.execute(oracles.ORACLES[f.__name__]).fetchall()
        assert sorted(map(tuple, f(spark, str(tmp_path)).collect())) == sorted(want), f.__name__


@pytest.mark.parametrize("cell", [3000, 1 << 20])
def test_near_copies_link_in_as_many_rows_as_documents(spark, monkeypatch, cell):
    """60 near copies of three days: each set goes to its cells and no set to a pair; links are fewer than documents of a cell."""
    monkeypatch.setattr(dupes, "CELL", cell)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"d{i:02d}", f"s{i % 4}", i % 3, " ".join([*words[: 40 - i % 7], f"x{i}"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "id string, source string, day int, text string").withColumn("published", F.timestamp_seconds(F.col("day") * 86400))
    sets = durable.Scratch(spark, "test").keep(dupes.shingle_table(docs), "sets")
    w = {r[0]: r[3].split() for r in rows}
    held = {i: {tuple(x[j : j + 5]) for j in range(len(x) - 4)} for i, x in w.items()}
    want = {(a[0], b[0]): round(len(held[a[0]] & held[b[0]]) / len(held[a[0]] | held[b[0]]), 9) for a in rows for b in rows if a[1] < b[1]}
    assert {(r.a, r.b): round(r.score, 9) for r in dupes.set_pairs(sets).collect()} == {k: v for k, v in want.items() if v >= 0.5} and len(want) == 1350
    links = dupes.set_links(sets).collect()
    assert len(links) < (60 if cell > 3000 else 180) and {(min(r), max(r)) for r in links} <= {(min(k), max(k)) for k, v in want.items() if v >= 0.5}
    assert {r.root for r in dupes.components(dupes.set_links(sets), durable.Scratch(spark, "test")).collect()} == {"d00"}


def test_a_crowded_slab_moves_each_hash_about_once(spark, monkeypatch):
    """300 documents of one day, of which 40 are near copies, in cells of a 50th of them: no set goes to all cells of its slab."""
    monkeypatch.setattr(dupes, "CELL", 1000)
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join([*words[: 100 - i % 9], f"x{i}"]) if i < 40 else " ".join(f"y{i}-{j}" for j in range(90)) for i in range(300)]
    docs = spark.createDataFrame([(f"d{i:03d}", f"s{i % 4}", t) for i, t in enumerate(texts)], "id string, source string, text string").withColumn("published", F.timestamp_seconds(F.lit(864000)))
    sets = durable.Scratch(spark, "test").keep(dupes.shingle_table(docs), "sets")
    moved, made = spark.sparkContext.accumulator(0), dupes._cell

    def counting(*args):
        run = made(*args)

        def both(table):
            moved.add(sum(map(len, table.column("h").to_pylist())))
            return run(table)

        return both

    monkeypatch.setattr(dupes, "_cell", counting)
    found = {(r.a, r.b) for r in dupes.set_pairs(sets).collect()}
    assert found == {(f"d{i:03d}", f"d{j:03d}") for i in range(40) for j in range(40) if i % 4 < j % 4}
    total = sets.agg(F.sum("size")).first()[0]
    assert total > 20 * dupes.CELL and moved.value < 2 * total


def test_a_table_of_queries_is_scored_where_slots_are(spark, monkeypatch, tmp_path):
    """In rounds of two queries and a few passages and hits at a time: what each query finds, and no table of slots or hits beside the terms."""
    for name, value in (("ROUND", 2), ("CELLS", 64), ("HELD", 10)):
        monkeypatch.setattr(lexical, name, value)
    rng, scratch = random.Random(4), durable.Scratch(spark, "test")
    rows = [(f"s{n % 2}", f"d{n // 3}", n % 3, " ".join(["the", *(f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.choice([1, 3, 20])))])) for n in range(400)]
    made = lexical.build_index(spark.createDataFrame(rows, "source string, doc_id string, index int, indexed string"), scratch, slot=16)
    index = lexical.Index(scratch.keep(made.blocks.sortWithinPartitions("term", "slot"), "blocks"), scratch.keep(made.terms, "terms"))
    sizes, mine = lexical.sizes_of(index), durable.Scratch(spark, "test")
    asking = {i: " ".join(["the"] * (i % 2) + [f"w{rng.randrange(90)}" for _ in range(1 + i)]) for i in range(7)}
    got = lexical.bm25_many(index, sizes, spark.createDataFrame([*asking.items()], "query_id long, text string"), 9, mine).orderBy("query_id", "rank").collect()
    for q, words in asking.items():
        want = [(r.source, r.doc_id, r["index"], r["rank"]) for r in lexical.bm25(index, sizes, words, 9).orderBy("rank").collect()]
        assert [(r.source, r.doc_id, r["index"], r["rank"]) for r in got if r.query_id == q] == want
    assert os.listdir(mine.root.removeprefix("file://")) == ["asked"]


def test_vectors_of_one_file_are_scanned_by_every_core(spark, monkeypatch):
    seen, scanned = [], vector._scanned
    monkeypatch.setattr(vector, "_scanned", lambda vectors, *x: seen.append(vectors.rdd.getNumPartitions()) or scanned(vectors, *x))
    rows = spark.createDataFrame([("s", n, 0, [float(n % 5), 1.0]) for n in range(50)], "source string, doc_id long, index int, embedding array<float>").coalesce(1)
    assert vector.cosine_many(rows, rows.select(F.col("doc_id").alias("query_id"), "embedding"), 3).count() == 150
    assert seen == [spark.sparkContext.defaultParallelism]


def test_products_by_tiles_have_the_bits_of_one_sum(monkeypatch):
    monkeypatch.setattr(vector, "TILE", 3)
    rng = np.random.default_rng(1)
    rows, queries = rng.standard_normal((5, 9), np.float32), rng.standard_normal((8, 9), np.float32)
    want = np.zeros((5, 8), np.float32)
    for d in range(9):
        want += rows[:, d, None] * queries[None, :, d]
    assert vector.dots(rows, queries).tobytes() == want.tobytes()


def test_an_index_moves_passages_and_no_posting(spark):
    """Blocks take one exchange, of whole passages to their slots, beside the classes that are sent to all."""
    rows = spark.createDataFrame([("s", n, 0, "a b a " + "c" * (n % 3 + 1)) for n in range(50)], "source string, doc_id long, index int, indexed string")
    made = lexical.build_index(rows, durable.Scratch(spark, "test"), slot=8)
    plan = made.blocks._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert ["slot" in x for x in moved] == [True, False] and plan.count("REPARTITION_BY_COL") == 1, plan
    assert sorted((r.term, r.df, r.cf) for r in made.terms.collect()) == [("a", 50, 100), ("b", 50, 50), ("c", 17, 17), ("cc", 17, 17), ("ccc", 16, 16)]
    assert sum(len(r.entries) for r in made.blocks.collect()) == 150


def test_a_spread_reads_its_values_once(spark, tmp_path):
    spark.range(50).select(F.lit("s").alias("source"), (F.col("id") % 7).alias("v")).write.parquet(f"{tmp_path}/values")
    got = stats.spread(spark.read.parquet(f"{tmp_path}/values"), "v")
    assert {tuple(r) for r in got.collect()} == {(name, 0, 3, 6, 6, 6, 2) for name in ("s", "all")}
    assert str(tmp_path) not in got._jdf.queryExecution().optimizedPlan().toString() and got.inputFiles() and not any(str(tmp_path) in f for f in got.inputFiles())


def test_passages_are_cut_before_they_are_rows(spark, tmp_path):
    """Rows of passages carry no whole text, and paragraphs are cut at every 400 characters of a line, wherever a line ends."""
    docs = spark.createDataFrame([("d", "s", " one\n\n" * 900)], "id string, source string, text string")
    plan = chunk.chunks(docs)._jdf.queryExecution().executedPlan().toString()
    carried = re.findall(r"Generate posexplode\(.*\), \[([^\]]*)\], false", plan)
    assert [re.sub(r"#\d+", "", c) for c in carried] == ["doc_id, source"]
    texts = ["x" * n + "\n" + "\U0001f600b" * n + "\n\nend" for n in (0, 1, 199, 200, 399, 400, 401, 800, 1000, 1201)]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.text for r in queries._paragraphs(spark, str(tmp_path)).collect()}
    assert got == {str(i): re.sub("([^\n]{400})", "\\1\n\n", t.replace("\n", "\n\n")) for i, t in enumerate(texts)}


def test_only_grams_of_templates_become_rows(spark):
    """The license scan filters k-grams within a row; words are the runs between other characters, at either end too."""
    texts = ["", None, " a", "MIT License.", "..x-y é ", "\U0001f600 0z", " ".join(f"w{i}" for i in range(3000)) + " licensed under the MIT license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in docs.select("text", license_scan.words(F.col("text")).alias("w")).collect():
        assert r.w == re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), r.text or ""))
    plan = license_scan.license_spans(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode\(.*filter\(", plan)
    got = {r.doc_id: (r.n_words, [(s.label, s["first"], s["last"]) for s in r.spans]) for r in license_scan.license_spans(docs).collect()}
    assert got[6] == (3005, [("mit", 3000, 3004)]) and got[0] == got[1] == (0, []) and got[3] == (2, [])
