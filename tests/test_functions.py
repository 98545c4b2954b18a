import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrix import durable
from papyrix.functions import chunk, html, quote, text
from papyrix.operators import digest, dupes, fusion, lexical, stats, timeline, vector
from papyrix.plans import render
from papyrix.sources import parsers, store, vectors
from papyrix.sources.matcher import NOISE, Matcher


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("a\r\nb\rc", "a\nb\nc"), ("  \n a \n\n\n\n b c ​\n", "a\n\n b c"), ("é", "é"), ("", ""), ("　x﻿", "x")])
def test_normalise(spark, raw, want):
    assert one(spark, text.normalise(F.lit(raw))) == want
    assert one(spark, text.normalise(F.lit(want))) == want


def test_tokenisers_differ_on_apostrophes(spark):
    assert one(spark, text.search_tokens(F.lit("Don’t STOP, it's 5.5"))) == ["dont", "stop", "its", "5", "5"]
    assert one(spark, text.shingle_words(F.lit("Don’t stop"))) == ["don't", "stop"]
    assert one(spark, text.shingles(F.array(*map(F.lit, "a b c d e f".split())))) == ["a b c d e", "b c d e f"]
    assert one(spark, text.shingles(F.array(F.lit("a"), F.lit("b")))) == ["a b"]
    assert one(spark, text.shingles(F.array().cast("array<string>"))) == []


def test_small_rules(spark):
    assert one(spark, text.repair_mojibake(F.lit("cafÃ©"))) == "café"
    assert one(spark, text.repair_mojibake(F.lit("café"))) == "café"
    assert one(spark, text.host(F.lit("HTTP://me@WWW.Example.org:80/x"))) == "example.org:80"
    assert not one(spark, text.usable_url(F.lit("ftp://x/y")))
    assert one(spark, text.slug_title(F.lit("a/2001.2.3-my_page copy.html"))) == "my page"
    assert str(one(spark, text.filename_date(F.lit("a/2001.2.3-x.html")))) == "2001-02-03"
    assert one(spark, text.filename_date(F.lit("2021-2-30.html"))) is None
    assert one(spark, text.review_title(F.lit("T"), F.lit("A"), F.lit("2.5"))) == "T by A ★★★☆☆"
    assert one(spark, text.day_number(F.expr("timestamp_seconds(-1)"))) == 0
    assert one(spark, text.snippet(F.lit("aa bb cc dd"), 7)) == "aa bb..."
    for value, want in (("2020-01-02", "2020-01-02 00:00:00"), ("Mon, 02 Jan 2006 15:04:05 -0700", "2006-01-02 22:04:05"), ("January 2, 2006", "2006-01-02 00:00:00"), ("2006-01-02T15:04:05.5Z", "2006-01-02 15:04:05.500000"), ("2006-01-02T15:04:05.123456+02:00", "2006-01-02 13:04:05.123456"), ("Mon, 02 Jan 2006 15:04:05 MST", "2006-01-02 15:04:05"), ("Mon, 02 Jan 2006 15:04:05 GMT", "2006-01-02 15:04:05"), ("2006/01/02", "2006-01-02 00:00:00"), ("2006-1-2", None), ("soon", None)):
        got = one(spark, text.strict_timestamp(F.lit(value)))
        assert (None if got is None else str(got)) == want, value


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("Be well. - Ann Lee", True), ("be well ~ ann", True), ("Be well - Ann Lee", False), ("Well.\n- Ann", False), ("Well?\n~ ann", True), ("Be. - ann", False), ("x ~ who?", False),
        ("Well.\n~ Ann", True), ("Be well. ~ Ann RT @me https://x.y via @you", True), ("Be. ~ a b c d e f g https://x.y", False), ("Be. ~ a b c d e f g", True), ("Be well.” — Émile Zola", True), ("Say ~ no. - Ann", True), ("Say ~ 5. - Ann", False),
        ("Be well. ~ Ann https://x.y", True), ("Be well. - Ann https://x.y", False), ("Be well. -- Ann", True), ("", False), ("One. - A B C D E F G", False),
    ],
)
def test_quotes(spark, body, want):
    assert one(spark, quote.quote_flag(F.lit(body), F.lit(len(body.split())))) is want
    assert not one(spark, quote.quote_flag(F.lit(body), F.lit(100)))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é.\n", max_size=6000))
def test_chunks_cover_without_overlap(body):
    raw, got = body.encode(), chunk.spans(body)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    inside = set().union(*[range(a, b) for a, b in got]) if got else set()
    assert not body.strip() or all(raw[i : i + 1] in b" \n" for i in range(len(raw)) if i not in inside)


def test_chunk_limits():
    assert chunk.spans("a" * 1199 + "\n\n" + "b" * 900) == [(0, 1199), (1201, 2101)]
    assert chunk.spans("a" * 1199 + "\n\n" + "b" * 50) == [(0, 1251)]
    long = ("x" * 98 + ". ") * 50
    assert all(b - a <= 2201 for a, b in chunk.spans(long)) and all(a % 100 == 0 for a, _ in chunk.spans(long))


def test_html():
    root = html.parse("<html><head><title> T </title><meta property='og:url' content='u'></head><body><nav>no</nav><article><h1>H</h1><p>a<br>b<script>x</script><!-- c --></article>after")
    assert html.metadata(root)["title"] == "T" and html.metadata(root)["url"] == "u"
    assert html.raw_text(html.content(html.parse("<p>a<svg/>hello</p>"))).split() == ["ahello"]
    assert html.raw_text(html.content(html.parse("<head><title>T</title><p>text"))).split() == ["text"]
    assert html.raw_text(html.content(html.parse("<head><title>T</title>plain words"))).split() == ["plain", "words"]
    assert html.raw_text(html.parse("<svg><path/><g/><text>x</text></svg>out</nope>")).split() == ["out"]
    meta = html.metadata(html.parse("<meta property='date' content='soon'><meta NAME='author' content=' A '><title> </title><title>P</title><link rel=Canonical href=c><meta property='og:url' content=u><time datetime=2020-01-02>"))
    assert meta == {"title": "P", "author": "A", "url": "c", "dates": ["soon", "2020-01-02"]}
    assert html.raw_text(html.content(root)).split() == ["H", "a", "b"]
    page = html.site_page("<body><h1>Title</h1><h2>1.2.2003</h2><p>one\ntwo\n\nthree", lambda s: s == "1.2.2003")
    assert page["title"] == "" and page["date_line"] == "1.2.2003" and "one two\n\nthree" in page["text"]


def test_matcher():
    m = Matcher([*NOISE, "drafts/", "a/*.txt", "**/k?.md", "bad["])
    assert m.match_file("x/y.png") and m.match_file("a/b.txt") and not m.match_file("a/b/c.txt") and m.match_file("q/k1.md") and not m.match_file("q/k12.md")
    assert m.match_dir("x/drafts") and not m.match_dir("x/draftsy") and not Matcher(None).match_file("a")


def test_vector_file():
    blob = store.pack_vectors([[1.0, 2.0], [3.0, 4.0]])
    assert store.unpack_vectors(blob).tolist() == [[1.0, 2.0], [3.0, 4.0]] and store.vector_dims(blob[:16]) == (2, 2)
    for bad in (blob[:-1], b"x" + blob[1:], blob + b"0"):
        with pytest.raises(ValueError):
            store.unpack_vectors(bad)


def test_page_dates(spark):
    page = "<head><meta property='article:published_time' content='soon'><meta name=date content='Mon, 02 Jan 2006 15:04:05 -0700'></head><body>x"
    got = spark.createDataFrame([(page,), ("no date",), (None,)], "m string").select(parsers.page_struct(F.col("m")).alias("p")).collect()
    assert [str(r.p.published) for r in got] == ["2006-01-02 22:04:05", "None", "None"] and got[0].p.text == "x"


def brute_pairs(rows, window, threshold):
    sets = {}
    for i, source, day, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    out = {}
    for i, s, d, _ in rows:
        for j, t, e, _ in rows:
            both = len(sets[i] & sets[j])
            if s < t and d is not None and e is not None and abs(d - e) <= window and both and both / len(sets[i] | sets[j]) >= threshold:
                out[(i, j)] = round(both / len(sets[i] | sets[j]), 9)
    return out


@pytest.mark.parametrize(("window", "threshold"), [(2, 0.5), (0, 0.5), (1, 0.9), (5, 0.2), (3, 1.0)])
def test_pairs_by_hand(spark, window, threshold):
    import random

    rng = random.Random(window)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 40))] for _ in range(12)]
    rows = []
    for n in range(90):
        words = [w if rng.random() > 0.04 else f"x{rng.randrange(9)}" for w in rng.choice(base)]
        rows.append((f"d{n:03d}", f"s{rng.randrange(3)}", rng.choice([None, *range(-4, 5)]), " ".join(words)))
    docs = spark.createDataFrame(rows, "id string, source string, day int, text string").withColumn("published", F.timestamp_seconds(F.col("day") * 86400))
    got = {(r.a, r.b): round(r.score, 9) for r in dupes.pairs(docs, window, threshold).collect()}
    assert got == brute_pairs(rows, window, threshold)


def test_spread_by_hand(spark):
    import random

    rng = random.Random(3)
    rows = [(f"s{rng.randrange(3)}", rng.choice([rng.randrange(10), rng.randrange(10**9)])) for _ in range(400)] + [("one", 5)]
    got = {r.source: tuple(r)[1:] for r in stats.spread(spark.createDataFrame(rows, "source string, v long"), "v").collect()}
    for source in ("s0", "s1", "s2", "one", "all"):
        v = sorted(x for s, x in rows if source in (s, "all"))
        assert got[source] == (v[0], v[len(v) * 50 // 100], v[len(v) * 90 // 100], v[len(v) * 99 // 100], v[-1], sum(v) // len(v))


def test_bm25_and_roll_up_by_hand(spark):
    import math
    import random

    rng = random.Random(4)
    docs = [(f"d{n:02d}", f"s{n % 2}", "\n\n".join(" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(20, 260))) for _ in range(rng.randrange(1, 5))), rng.choice(["", "w3 Title"])) for n in range(30)]
    table = spark.createDataFrame(docs, "id string, source string, text string, title string")
    rows = digest.passages(table, chunk.chunks(table))
    held = [(r.source, r.doc_id, r["index"], r.indexed.lower().split()) for r in rows.collect()]
    scratch = durable.Scratch(spark, "test")
    made = lexical.build_index(rows, scratch, slot=2)
    stored = lexical.Index(scratch.keep(made.blocks, "blocks"), scratch.keep(made.terms, "terms"))
    for source in (None, "s1"):
        some = [h for h in held if source in (None, h[0])]
        mean, terms = sum(len(h[3]) for h in some) / len(some), ["w1", "w3", "w7"]
        score = {}
        for s, d, i, w in some:
            for t in terms:
                df = sum(t in h[3] for h in some)
                f = w.count(t)
                if f:
                    score[(s, d, i)] = score.get((s, d, i), 0) + math.log(1 + (len(some) - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
        ranked = sorted(score, key=lambda k: (-score[k], k))[:200]
        best, want = set(), []
        for n, (s, d, i) in enumerate(ranked):
            if d not in best:
                best.add(d)
                want.append((d, i, n + 1))
        sizes = (len(some), sum(len(h[3]) for h in some))
        got = fusion.search(stored, sizes, None, "w7 W3, w1 w1", None, "lexical", 10, source=source)
        assert [(r.doc_id, r["index"], r.lexical_rank) for r in got.orderBy("place").collect()] == want[:10]
    assert len({h[1] for h in held}) < len(held) and lexical.sizes_of(stored) == (len(held), sum(len(h[3]) for h in held))
    assert lexical.bm25(stored, (5, 50), "nothing here").count() == 0 == lexical.bm25(stored, (5, 50), "nothing here", 3).count()


@pytest.fixture(scope="module")
def lines(spark):
    """Passages of two sources: a rare term, one in every passage, copies, an empty one, very unlike lengths."""
    import random

    rng = random.Random(8)
    rows = []
    for n in range(900):
        words = ["the", *(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.choice([1, 3, 20, 150])))]
        rows.append((f"s{n % 2}", n // 3, n % 3, " ".join(words + ["rare"] * (n in (7, 500)) * 2)))
    rows += [("s1", 1000 + n, 0, "the w1 w2") for n in range(40)] + [("s0", 2000, 0, "")]
    return spark.createDataFrame(rows, "source string, doc_id long, index int, indexed string").repartition(5)


@pytest.fixture(scope="module")
def index(spark, lines):
    scratch = durable.Scratch(spark, "test")
    made = lexical.build_index(lines, scratch, slot=16)
    return lexical.Index(scratch.keep(made.blocks, "blocks"), scratch.keep(made.terms, "terms"))


QUERIES = {1: "the", 2: "rare the", 3: "w1 w2 w7 the the", 4: "w250 w99 rare", 5: "unheard of", 6: "", 7: "w3"}


def test_blocks_hold_all_postings(index, lines):
    rows = {tuple(r) for r in lexical.postings(lines).select("source", "doc_id", "index", "term", "tf", "length").collect()}
    blocks = index.blocks.collect()
    held = [(b.source, e.doc_id, e["index"], b.term, e.tf, e.length) for b in blocks for e in b.entries]
    assert set(held) == rows and len(held) == len(rows)
    assert all(b.best_tf == max(e.tf for e in b.entries) and b.least_length == min(e.length for e in b.entries) for b in blocks)
    hot = [len(b.entries) for b in blocks if b.term == "the"]
    assert len(hot) > 40 and max(hot) < 50  # a term in every passage is many blocks
    assert lexical.sizes_of(index) == (940, sum(r[4] for r in rows))


def test_pruned_search_finds_what_a_full_scan_finds(index):
    sizes = lexical.sizes_of(index)
    for query in QUERIES.values():
        every = lexical.top(lexical.bm25(index, sizes, query), 25).collect()
        assert lexical.bm25(index, sizes, query, 25).collect() == every
        assert lexical.bm25(index.of("s1"), sizes, query, 5).select("doc_id", "index").collect() == lexical.top(lexical.bm25(index.of("s1"), sizes, query), 5).select("doc_id", "index").collect()


def test_a_rare_term_spares_the_common_ones_blocks(index, monkeypatch):
    """Few of the blocks of a term that is everywhere are scored beside a rare term."""
    seen, scores = [], lexical._scores

    def counted(blocks, mean, *by):
        seen.append(blocks.filter("term = 'the'").count())
        return scores(blocks, mean, *by)

    monkeypatch.setattr(lexical, "_scores", counted)
    monkeypatch.setattr(lexical, "FIRST", 4)
    assert lexical.bm25(index, lexical.sizes_of(index), "rare the", 2).count() == 2
    assert max(seen) <= 4 < index.blocks.filter("term = 'the'").count() / 10


@pytest.mark.parametrize("sent", [200_000, 0])
def test_a_table_of_queries_finds_what_each_finds(spark, index, monkeypatch, sent):
    monkeypatch.setattr(lexical, "SENT", sent)
    sizes, scratch = lexical.sizes_of(index), durable.Scratch(spark, "test")
    asking = spark.createDataFrame([*QUERIES.items(), (None, "the")], "query_id long, text string")
    got = {}
    for r in lexical.bm25_many(index, sizes, asking, 25, scratch).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.source, r.doc_id, r["index"], pytest.approx(r.score), r["rank"]))
    for q, query in QUERIES.items():
        assert [(r.source, r.doc_id, r["index"], r.score, r["rank"]) for r in lexical.bm25(index, sizes, query, 25).orderBy("rank").collect()] == got.get(q, [])
    assert set(got) <= set(QUERIES)


def test_many_vectors_find_what_each_finds(spark, index):
    import random

    rng = random.Random(5)
    rows = [(f"s{n % 2}", n, 0, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for n in range(400)]
    rows += [("s0", 900, 0, None), ("s0", 901, 0, [1.0]), ("s0", 902, 0, [None, 1.0, 1.0, 1.0]), ("s0", 903, 0, [float("nan"), 1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "source string, doc_id long, index int, embedding array<float>").repartition(7)
    asking = table.filter("source = 's1'").select(F.col("doc_id").alias("query_id"), "embedding").union(spark.createDataFrame([(5000, None)], "query_id long, embedding array<float>"))
    got = {}
    for r in vector.cosine_many(table, asking, 9, round_bytes=16 * 60).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.source, r.doc_id, r["rank"], r.score))
    assert set(got) == {r[1] for r in rows[:400] if r[0] == "s1"}
    for q in sorted(got)[::40]:
        unit = vector.unit_list(rows[q][3])
        by_hand = sorted((-float(vector.dots(np.array([v], np.float32), np.array([unit], np.float32))[0, 0]), s, i) for s, i, _, v in rows[:400])[:9]
        assert [(s, i) for s, i, _, _ in got[q]] == [(s, i) for _, s, i in by_hand]
        assert [(r.source, r.doc_id) for r in vector.cosine_top(table, rows[q][3], 9).orderBy("rank").collect()] == [(s, i) for s, i, _, _ in got[q]]
    with pytest.raises(ValueError, match="widths"):
        vector.cosine_many(table, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "query_id long, embedding array<float>"), 3)


def test_hybrid_table_finds_what_each_query_finds(spark, index):
    sizes, scratch = lexical.sizes_of(index), durable.Scratch(spark, "test")
    table = spark.createDataFrame([(f"s{n % 2}", n // 3, n % 3, [float(n % 7), float(n % 5), 1.0]) for n in range(900)], "source string, doc_id long, index int, embedding array<float>")
    asking = [(1, "rare the", [1.0, 0.0, 0.0]), (2, "", [0.0, 1.0, 0.0]), (3, "w1 w7", None), (4, "nothing known", None)]
    got = fusion.search_many(index, sizes, table, spark.createDataFrame(asking, "query_id long, text string, embedding array<float>"), scratch, hits=6, depth=30).orderBy("query_id", "place").collect()
    for q, words, asked in asking:
        mine = [(r.source, r.doc_id, r["index"], r.place) for r in got if r.query_id == q]
        if not words:
            want = fusion.search(None, sizes, table, "x", asked, "vector", 6, 30)
        else:
            want = fusion.search(index, sizes, table, words, asked, "hybrid", 6, 30)
        assert mine == [(r.source, r.doc_id, r["index"], r.place) for r in want.orderBy("place").collect()]


def test_least_overlap_is_the_least(spark):
    """For sizes up to 120 and thresholds in hundredths: the smallest count whose share passes, as shares are compared."""
    sizes = spark.range(1, 121).select(F.col("id").cast("int").alias("size"))
    for percent in range(1, 101):
        t = percent / 100
        for r in sizes.select("size", dupes.least_overlap(F.col("size"), t).alias("n")).collect():
            assert r.n == next(n for n in range(1, r.size + 1) if n / r.size >= t), (r, t)


@pytest.mark.parametrize(("size", "both"), [(25, 14), (50, 29), (100, 57)])
def test_pairs_at_the_very_threshold(spark, size, both):
    words = [f"w{n}" for n in range(size + 4)]
    rows = [("a", "s0", " ".join(words)), ("b", "s1", " ".join(words[: both + 4]))]
    docs = spark.createDataFrame(rows, "id string, source string, text string").withColumn("published", F.timestamp_seconds(F.lit(0)))
    assert [r.score for r in dupes.pairs(docs, 2, both / size).collect()] == [both / size]


def test_a_group_of_many_copies(spark):
    """One group of 100,000: winner by priority, source and id; copies as ordered rows, no row or task with all of them."""
    n = 100_000
    docs = spark.range(n).select(F.format_string("d%06d", "id").alias("id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.lit("text").alias("source_type"), F.lit("t <b>").alias("title"), F.lit("").alias("url"), F.timestamp_seconds(F.col("id") * 0).alias("published"), F.lit(3).alias("words"), F.lit("a b c").alias("text"), F.lit(False).alias("quote"))
    rows = docs.select(F.lit("d000000").alias("root"), "id", "source", "published", "words", "title", F.when(F.col("source") == "s2", 5).otherwise(1).alias("priority"))
    held = dupes.with_winners(rows)
    assert {r.winner_id for r in held.select("winner_id").distinct().collect()} == {"d000002"}
    members = held.select("id", "winner_id", "source", "title", "published", (F.col("id") == F.col("winner_id")).alias("winner"), ((F.hash("id") % 7) / 7).alias("score"))
    members = durable.Scratch(spark, "test").keep(members, "members")
    entries, copies = timeline.entries(docs, members), timeline.copies(docs, members)
    assert [(r.id, r.copies) for r in entries.collect()] == [("d000002", n - 1)]
    page = json.loads("".join(render.timeline_json(entries, copies)))
    assert page["counts"]["folded"] == n - 1 and len(page["entries"]) == 1
    told = [(-c["score"], c["source"], c["id"]) for c in page["entries"][0]["copies"]]
    assert len(told) == n - 1 and told == sorted(told)


def test_exports_join_ranges(spark, monkeypatch):
    """Entries and copies over many small chunks: the same text as by hand, JSON and HTML."""
    monkeypatch.setattr(render, "CHUNK", 40)
    rows = [(f"d{i:02d}", f"s{i % 3}", "text", f"T{i} & <x>", "", None if i % 5 == 0 else f"20{10 + i % 4}-0{1 + i % 3}-02 03:04:05", 300 * (i % 4), f"body '{i}'", i % 2 == 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "id string, source string, source_type string, title string, url string, published string, words int, text string, quote boolean").withColumn("published", F.col("published").cast("timestamp")).repartition(6)
    members = spark.createDataFrame([(f"d{i:02d}", "d03" if i < 9 else "d20", i in (3, 20), i / 40) for i in (3, 4, 7, 8, 20, 21, 22)], "id string, winner_id string, winner boolean, score double")
    entries, copies = timeline.entries(docs, members), timeline.copies(docs, members)
    page = json.loads("".join(render.timeline_json(entries, copies)))
    by_hand = sorted((r for r in rows if r[0] not in ("d04", "d07", "d08", "d21", "d22")), key=lambda r: (r[5] is None, [-ord(c) for c in r[5] or ""], r[1], r[0]))
    assert [e["id"] for e in page["entries"]] == [r[0] for r in by_hand]
    assert {e["id"]: [c["id"] for c in e["copies"]] for e in page["entries"] if e["copies"]} == {"d03": ["d08", "d07", "d04"], "d20": ["d22", "d21"]}
    got = "".join(render.timeline_html(entries, copies))
    assert got.count("<article") == got.count("</article>") == 35 and got.index("<h2>Undated</h2>") < got.index("<h2>2013</h2>") < got.index("<h2>2010</h2>") and got.count("<h2>") == 5
    assert "also in s2, s1, s1</p></article>" in got and "T1 &amp; &lt;x&gt;" in got and "body &#x27;1&#x27;" in got and "T8 " not in got
    none = docs.limit(0)
    assert json.loads("".join(render.timeline_json(timeline.entries(none, members.limit(0)), timeline.copies(none, members.limit(0)))))["entries"] == []


def test_components_of_hubs_and_chains(spark):
    """Two stars joined by a long chain, a triangle and a pair: each id under the least of its component."""
    edges = [("h000", f"l{i:03d}") for i in range(150)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(130)] + [("c130", "h000"), ("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("y1", "y0")]
    got = {r.id: r.root for r in dupes.components(spark.createDataFrame(edges, "a string, b string").repartition(4), durable.Scratch(spark, "test")).collect()}
    big = {f"l{i:03d}" for i in range(150)} | {f"c{i:03d}" for i in range(131)} | {"h000"}
    assert got == {k: "c000" for k in big} | {"z1": "z1", "z2": "z1", "z3": "z1", "y0": "y0", "y1": "y0"}


def test_members_of_exact_copies_stand_for_each_other(spark):
    """Copies of one source and day are one class; those whose class has no partner elsewhere are no duplicates."""
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(f"a{i}", "s0", 0, words) for i in range(6)] + [("b0", "s1", 1, words), ("b1", "s1", 1, words), ("c0", "s2", 3, words + " more"), ("d0", "s0", 0, "alone " * 9), ("d1", "s0", 0, "alone " * 9), ("e", "s1", None, words), ("f", "s1", 9, words)]
    docs = spark.createDataFrame(rows, "id string, source string, day int, text string").withColumn("published", F.timestamp_seconds(F.col("day") * 86400)).withColumn("words", F.lit(1)).withColumn("title", F.lit(""))
    got = dupes.members(docs).collect()
    assert {(r.id, r.group_id, r.winner_id) for r in got} == {(i, "a0", "a0") for i in ("a0", "a1", "a2", "a3", "a4", "a5", "b0", "b1", "c0")}
    assert {r.id: round(r.score, 3) for r in got}["c0"] == round(26 / 27, 3) and all(r.score == 1 for r in got if r.id != "c0")


def test_vector_files_by_parts(spark, tmp_path, monkeypatch):
    """Ordered rows over several files and ranges come back in order; what has no one width is refused and leaves what was there."""
    path = f"file://{tmp_path}/vectors"
    rows = spark.range(1000).select(F.col("id"), F.array(F.col("id").cast("float"), (F.col("id") / 7).cast("float"), F.lit(-1.0).cast("float")).alias("embedding")).repartition(9)
    vectors.write_vectors(rows, ["id"], path, 5)
    names = sorted(p.name for p in (tmp_path / "vectors").iterdir())
    assert names == [f"part-{i:06d}.vec" for i in range(len(names))] and len(names) > 1
    assert np.vstack([store.unpack_vectors((tmp_path / "vectors" / n).read_bytes()) for n in names])[:, 0].tolist() == list(range(1000))
    monkeypatch.setattr(vectors, "SPLIT_BYTES", 12 * 70)
    monkeypatch.setattr(vectors, "BATCH_BYTES", 12 * 32)
    reader = vectors.VectorReader(path)
    parts = reader.partitions()
    got = [(r["row"], r["embedding"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    want = [(i, [np.float32(i), np.float32(i / 7), -1.0]) for i in range(1000)]
    assert len(parts) > 14 and got == want
    assert [(r.row, r.embedding) for r in vectors.read_vectors(spark, path).orderBy("row").collect()] == want
    for bad in ([1.0], None, [1.0, None, 2.0]):
        odd = rows.union(spark.createDataFrame([(5000, bad)], "id long, embedding array<float>"))
        with pytest.raises(Exception, match="one width"):
            vectors.write_vectors(odd, ["id"], path)
    assert vectors.read_vectors(spark, path).count() == 1000 and sorted(p.name for p in (tmp_path / "vectors").iterdir()) == names
    vectors.write_vectors(rows.limit(0), ["id"], path)
    assert vectors.read_vectors(spark, path).count() == 0
    one = tmp_path / "one.vec"
    one.write_bytes(store.pack_vectors(np.ones((3, 2))))
    assert vectors.read_vectors(spark, str(one)).count() == 3
    one.write_bytes(one.read_bytes()[:-1])
    with pytest.raises(Exception, match="wrong length"):
        vectors.read_vectors(spark, str(one)).count()
