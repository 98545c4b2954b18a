"""What the fourth round's findings asked for."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from papyrix import durable
from papyrix.functions import text
from papyrix.operators import dupes, lexical, vector


def _passages(spark):
    rng = random.Random(9)
    rows = [(f"s{n % 2}", n // 3, n % 3, " ".join(["the", *(f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.choice([1, 3, 20])))])) for n in range(300)]
    return spark.createDataFrame([*rows, ("s1", 900, 0, "")], "source string, doc_id long, index int, indexed string").repartition(3)


def test_a_table_of_queries_moves_hits_alone(spark):
    """Passages are scored as they are read, without blocks and without an exchange below the scoring; hits are those of single queries."""
    scratch = durable.Scratch(spark, "test")
    whole = lexical.build_index(_passages(spark), scratch, slot=16)
    sizes, asking = lexical.sizes_of(whole), {1: "the", 2: "w1 w2 w7 the", 3: "w70 w3", 4: "unheard", 5: ""}
    few = lexical.Index(None, whole.terms, whole.counted)
    got = lexical.bm25_many(few, sizes, spark.createDataFrame([*asking.items()], "query_id long, text string"), 9, scratch)
    below = got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1].splitlines()
    assert any("Repartition" in x for x in below) and not any("Repartition" in x and "true" in x or "RepartitionByExpression" in x for x in below), below
    rows = got.orderBy("query_id", "rank").collect()
    for q, words in asking.items():
        want = [(r.source, r.doc_id, r["index"], r["rank"]) for r in lexical.bm25(whole, sizes, words, 9).orderBy("rank").collect()]
        assert [(r.source, r.doc_id, r["index"], r["rank"]) for r in rows if r.query_id == q] == want


def test_sums_and_hits_of_a_task_are_bounded(monkeypatch):
    """However many passages a batch has, sums are made of CELLS at a time and hits are numbers, few more than HELD; results are exact
    by matrices and one by one alike."""
    monkeypatch.setattr(lexical, "CELLS", 1 << 10)
    monkeypatch.setattr(lexical, "HELD", 1 << 9)
    rng, n, terms, limit = np.random.default_rng(2), 64, 40, 5
    asks = rng.random((n, terms)) < 0.2
    term, of = np.nonzero(asks.T)
    first = np.searchsorted(term, np.arange(terms + 1))
    weight = rng.random(terms) + 0.1
    texts = [rng.choice(terms + 5, 8, replace=False) for _ in range(3000)]
    rows = pa.table({
        "source": [f"s{i % 2}" for i in range(3000)], "doc_id": list(range(3000)), "index": pa.array([0] * 3000, pa.int32()), "length": pa.array([8] * 3000, pa.int32()),
        "terms": pa.array([[{"term": f"t{x}", "tf": 1 + i % 3} for x in t] for i, t in enumerate(texts)], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))),
    })
    cells, held, made, add = [], [], lexical._sums, lexical.Best.add
    monkeypatch.setattr(lexical, "_sums", lambda *x: cells.append(n * x[3]) or made(*x))
    monkeypatch.setattr(lexical.Best, "add", lambda self, *x: add(self, *x) or held.append(sum(len(h[0]) for h in self.hits)))
    part = np.zeros((terms, 3000), np.int64)
    for i, t in enumerate(texts):
        tf = 1.0 + i % 3
        t = t[t < terms]
        part[t, i] = np.floor(weight[t] * tf * (lexical.K1 + 1) / (tf + lexical.K1) * lexical.STEPS + 0.5)
    scores = asks.astype(np.int64) @ part
    for share in (np.zeros(terms), np.linspace(0, 1, terms)):
        run = lexical._best(lexical._of_rows(pa.array([f"t{x}" for x in range(terms)])), lexical._Asking(of, first, weight, share, n), 8.0, limit)
        got = pa.Table.from_batches(list(run(iter(rows.to_batches())))).to_pylist()
        for q in range(n):
            want = sorted(np.flatnonzero(scores[q]).tolist(), key=lambda i: (-scores[q, i], f"s{i % 2}", i))[:limit]
            assert [(r["doc_id"], r["score"]) for r in got if r["q"] == q] == [(i, scores[q, i] / lexical.STEPS) for i in want]
    assert max(cells) <= 1 << 10 and max(held) <= (1 << 9) + n * limit


def test_vectors_are_scored_bit_by_bit_only_where_it_matters(monkeypatch):
    """Products of matrices choose the candidates; what comes out has the bits and ties of ``dots`` over all pairs."""
    exact, of = [], vector._dots_of
    monkeypatch.setattr(vector, "_dots_of", lambda rows, queries, p, q: exact.append(len(p)) or of(rows, queries, p, q))
    rng = np.random.default_rng(3)
    for ties in (False, True):
        rows = rng.standard_normal((3000, 9)).astype(np.float32)
        rows = np.round(rows) if ties else rows
        rows[5], rows[7], rows[9, 0], rows[11] = 1e25, 3e38, np.inf, 0
        queries = rng.standard_normal((200, 9)).astype(np.float32)
        queries = np.round(queries) if ties else queries
        batches = [
            pa.RecordBatch.from_pydict({"source": [f"s{i % 3}" for i in range(at, at + 500)], "doc_id": list(range(at, at + 500)), "index": [0] * 500, "e": pa.array(list(rows[at : at + 500]), pa.list_(pa.float32()))})
            for at in range(0, 3000, 500)
        ]
        schema = pa.schema([("query", pa.int64()), ("source", pa.string()), ("doc_id", pa.int64()), ("index", pa.int64()), ("score", pa.float32())])
        got = pa.Table.from_batches(list(vector._scan(queries, 4, schema)(iter(batches)))).to_pylist()
        with np.errstate(all="ignore"):
            every = vector.dots(rows, queries)
        for q in range(200):
            met = np.flatnonzero(~np.isnan(every[:, q])).tolist()
            want = sorted(met, key=lambda i: (-every[i, q], f"s{i % 3}", i))[:4]
            assert [(r["doc_id"], np.float32(r["score"])) for r in got if r["query"] == q] == [(i, every[i, q]) for i in want]
    assert sum(exact) < 2 * 200 * 3000 / 10


def test_folding_reads_texts_for_their_sets_alone(spark):
    """Who is folded under whom is what ``members`` says, without words, titles or scores; texts need not be tidy."""
    rng = random.Random(6)
    words = [f"w{n}" for n in range(30)]
    rows = []
    for n in range(60):
        x = list(words) if n % 3 else rng.sample(words, 30)
        x[rng.randrange(30)] = f"x{n}"
        rows.append((f"d{n:02d}", f"s{n % 4}", 1577836800 + n % 5 * 86400, " ".join(x)))
    docs = spark.createDataFrame(rows, "id string, source string, at long, text string").withColumn("published", F.timestamp_seconds("at"))
    first = spark.createDataFrame([("s2", 5), ("s3", 7)], "source string, priority int")
    whole = dupes.members(docs.withColumn("words", F.lit(30)).withColumn("title", F.lit("")), first)
    untidy = docs.withColumn("text", F.concat(F.lit("\r\n\t"), F.regexp_replace("text", "w2", "w​﻿2"), F.lit(" \n\n\n")))
    got = dupes.folded(untidy, first)
    columns = ["group_id", "id", "winner", "winner_id"]
    assert got.columns == columns and got.count() > 20
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in whole.select(*columns).collect()}
    one, other = (docs.limit(0).union(t).select("id", text.shingle_words(text.tidy(F.col("text")) if k else F.col("text")).alias("w")).collect() for k, t in enumerate((untidy, untidy)))
    assert one == other
