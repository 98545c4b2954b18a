"""The training-data operators against brute force on small fixtures with nulls, empties, ties, repeats and clashes."""

import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrix.llm import exact_dedup, license_scan, line_dedup, near_dedup, packing, quality_classifier, quality_rules, simple8b, unigram, warc
from papyrix.llm.components import connected_components
from papyrix.llm.common import Scratch
from papyrix.llm.tokens import encoder, vocabulary
from papyrix.llm.words import repeated_window_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3
ROWS = [
    (1, "a  b\tc"), (2, "a b c"), (3, "a b\nc "), (4, None), (5, ""), (6, "   "), (7, BASE), (8, BASE + "end"), (9, BASE.upper()), (10, "x " * 3000),
    (11, "Released under the MIT license.\nMIT License here"), (12, "é ü — 日本語 text <|endoftext|> \x1c z"), (13, "a b c"), (13, "a b c"), (None, "lost id"),
]
SCHEMA = "doc_id long, text string, lang string, kept string, n_words string, keep_id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "own", "own", "own") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(values):
    words, offsets = simple8b.encode_blocks(np.array(values, np.uint64))
    assert simple8b.decode_blocks(words, offsets, len(values)).tolist() == values


def test_token_output(spark, docs, empty):
    got = sorted(simple8b.encode_documents(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *range(1, 14), 13]
    tok, at = encoder(vocabulary("byte_bpe_50k.json")).tokenizer, 0
    for r, t in zip(got, ["lost id", *[t for _, t in ROWS[:-1]]]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert simple8b.encode_documents(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 .,'s\n\t\xa0é日", max_size=40))
def test_chunked_encoding_equals_whole(t):
    e = encoder(vocabulary("byte_bpe_50k.json"))
    assert e.encode([t, "x", t])[2].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.length(c).cast("string")])
def test_exact_dedup(docs, empty, digest):
    """The second digest clashes for all texts of one length, so contents must decide."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    got = exact_dedup.exact_dedup(docs, digest).select("doc_id", "text", "keep_id", "group_size", "kept", "lang")
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        g = groups[norm(r.text)]
        least = min((i for i in g if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (least, len(g), r.doc_id == least)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_copies(docs).count() == len(groups)


def test_license_scan(spark, docs, empty):
    got = by_id(license_scan.license_scan(docs))
    assert (got[11].n_base, got[11].first_word, got[11].last_word, got[11].base_labels) == (2, 3, 5, "mit")
    assert got[4].n_words == 0 and got[4].first_word is None and got[4].labels == "" and got[4].score == 0.0
    body = "noise words before " + license_scan.TEMPLATES["bsd"][0].replace("source and binary", "source or perhaps binary") + " and after"
    one = spark.createDataFrame([(1, body.title()), (2, "redistribution and use in"), (2, "redistribution and use in")], "doc_id long, text string")
    rows = license_scan.license_spans(one).collect()
    assert len(rows) == 3
    span = next(r for r in rows if r.doc_id == 1).spans
    assert len(span) == 1 and span[0].label == "bsd" and span[0].first == 3 and span[0].cover > 0.7
    assert all(not r.spans for r in rows if r.doc_id == 2)
    assert license_scan.license_scan(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=20), min_size=1, max_size=5))
def test_repeated_windows(texts):
    want = []
    for w in texts:
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        n = Counter(grams)
        want.append(len({k for j, g in enumerate(grams) if n[g] > 1 for k in range(j, j + 5)}))
    got = repeated_window_words(np.array([x for w in texts for x in w], np.int64), np.array([len(w) for w in texts], np.int64))
    assert got.tolist() == want


def test_quality_rules(docs, empty):
    got = by_id(quality_rules.quality_rules(docs))
    assert got[4].base_failed and not got[4].kept and got[6].n_words == 0 and got[10].base_failed
    assert got[12].word_chars == sum(map(len, WORD.findall(ROWS[11][1]))) and got[12].n_symbols == 4
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.drop_rejected(docs).columns == docs.columns


def test_a_long_document_alone_in_its_class_is_judged(spark):
    rng = np.random.default_rng(3)
    words = ["tea", "house", "river", "stone", "light", "walk", "green", "often", "the", "and", "winter", "morning"] + [f"{a}{b}" for a in "abcdefgh" for b in ("and", "ing", "ter", "al")]
    text = lambda n: " ".join(rng.choice(words, n))
    odd = " ".join("".join(chr(0x13000 + c) for c in rng.integers(0, 900, 3)) for _ in range(900))
    docs = spark.createDataFrame([(i, text(n), "xx") for i, n in enumerate([90] * 40 + [180] * 40 + [360] * 40)] + [(900, odd, "xx"), (901, text(4000), "xx")], "doc_id long, text string, lang string")
    got = by_id(quality_rules.quality_rules(docs))
    assert not got[900].base_failed and not got[900].kept
    assert sum(got[i].kept for i in range(120)) >= 114


def test_unigram_matches_the_library(docs, empty):
    """The public file's model type is switched from BPE to unigram, and its own scores are used."""
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    raw = open(path, "rb").read()
    kind = raw.rindex(b"\x18\x02")  # trainer's model_type: 2 is BPE
    sp = sentencepiece.SentencePieceProcessor()
    sp.LoadFromSerializedProto(raw[:kind] + b"\x18\x01" + raw[kind + 2 :])
    assert sp.encode("hello world") != sentencepiece.SentencePieceProcessor(model_file=path).encode("hello world")  # the type was switched
    model = unigram.load_model(path, "model")
    texts = ["hello world", "  two  spaces ", "naïve 日本語 \x07 ♞", "a", "", "line\nfeed\ttab", "supercalifragilistic " * 30]
    for t, ids in zip(texts, unigram.encode(model, texts)):
        assert unigram.decode(model, ids.tolist()) == t
        theirs = sp.encode(t)
        # Over long texts the library's single-precision sums lose the better path by rounding.
        assert ids.tolist() == theirs or len(t) > 100 and model.scores[ids].sum() > model.scores[theirs].sum(), t
    got = by_id(unigram.encode_documents(docs))
    assert all(r.round_trip for r in got.values()) and got[4].n_tokens == 0
    assert unigram.encode_documents(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc ", max_size=12))
def test_viterbi_is_best(t):
    pieces = ["<unk>", " a", "a", "b", "ab", "abc", " ", "ca", "bc", "  ", " ab"]
    scores = [0, -1.5, -2, -2.5, -3, -4.2, -1, -3.1, -3, -1.2, -2.9]
    model = unigram.build_model([p.replace(" ", unigram.MARK) for p in pieces], scores, [False] + [True] * 10, [], 0)
    s = (" " + t) if t else ""
    best = {0: 0.0}
    for end in range(1, len(s) + 1):
        best[end] = max(best[a] + (scores[pieces.index(s[a:end])] if s[a:end] in pieces[1:] else -14.2 if end - a == 1 else -1e9) for a in range(end))
    ids = unigram.encode(model, [t])[0].tolist()
    assert abs(sum(scores[i] if i else -14.2 for i in ids) - best[len(s)]) < 1e-9


def test_double_array():
    keys = {k: i for i, k in enumerate([b"a", b"ab", b"b\xff", b"\x00", b"abc" * 9])}
    trie = unigram.DoubleArray(keys)
    assert all(trie.find(k) == i for k, i in keys.items()) and trie.find(b"abca") == -1 and trie.find(b"zz") == -1


def test_classifier(spark):
    rng = np.random.default_rng(0)
    words = ["tea", "house", "river", "stone", "light", "walk", "green", "often"]
    good = [" ".join(rng.choice(words, 40)) + "." for _ in range(60)]
    rows = [(i, t if i % 3 else " ".join(w.upper() + "!!" for w in t.split())) for i, t in enumerate(good)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = by_id(quality_classifier.quality_classifier(docs, labels))
    held = [r for r in got.values() if r.held_out and r.doc_id < 60]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held) and 0 <= got[90].score <= 1 and got[90].score == got[91].score
    assert quality_classifier.drop_poor(docs.filter("doc_id < 60"), labels).count() == 40
    assert quality_classifier.quality_classifier(docs, labels.limit(0)).count() == 62


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_packing_holds_all_and_is_near_the_bound(sizes):
    counts = dict(Counter(sizes))
    got, held = packing.solve(counts, 64), Counter()
    for p in got:
        assert sum(s * c for s, c in p.items) <= 64
        for s, c in p.items:
            held[s] += c * p.times
    bins = sum(p.times for p in got)
    assert held == Counter(sizes) and packing.lower_bound(counts, 64) <= bins <= sum(p.times for p in packing.best_fit(counts, 64))


def test_pack_documents(docs, empty):
    rows = packing.pack_documents(docs).collect()
    spots = defaultdict(list)
    for r in rows:
        spots[r.sequence_id].append((r.offset, r.length))
    for s in spots.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.doc_id == 13 for r in rows) == 2 and next(r for r in rows if r.doc_id == 4).length == 1
    assert packing.pack_documents(empty).count() == 0 and packing.cut_pieces(2049) == [(0, 1), (1, 1024), (1025, 1024)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}


def test_near_dedup(spark, empty):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(w if rng.random() > 0.006 else f"z{rng.integers(99)}" for w in base)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "just four words here"), (103, "Just FOUR words\there"), (104, " ".join(base)), (104, " ".join(base)), (105, " ".join(base).upper()), (None, "x y"), (107, "x y")]
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = set(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and sets[a]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_dup_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert (r.component_id, r.kept) == ((find(r.doc_id), find(r.doc_id) == r.doc_id) if r.doc_id is not None else (None, False))
    assert near_dedup.near_dup_components(empty).count() == 0
    assert {r.doc_id for r in near_dedup.drop_near_copies(docs).collect()} == {find(i) for i in ids} | {None}


@pytest.mark.parametrize("n", range(8))
def test_shingles_of_a_batch_of_few_words(n):
    text = " ".join(f"w{i}" for i in range(n)).encode()
    alone, beside = near_dedup.shingle_sets([text]), near_dedup.shingle_sets([b"", text, b"more words than a shingle has here"])
    assert len(alone[0]) == (max(n - 4, 1) if n else 0) and alone[0].tolist() == beside[1].tolist()


def test_near_dedup_of_three_words(spark):
    docs = spark.createDataFrame([(1, "only three words"), (2, None), (3, "")], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, r.n_shingles, r.kept) for r in near_dedup.near_dup_components(docs).collect()) == [(1, 1, True), (2, 0, True), (3, 0, True)]


def test_line_dedup(spark, empty):
    long = "the quick brown fox jumps over the lazy dog and then walks slowly home along the river bank"
    rows = [(1, f"{long}\nunique line of one\n\n"), (2, f"intro line here\n{long}!\n{long}"), (3, long.replace("slowly", "slowlx")), (4, None), (5, "short\nshort"), (6, "other words entirely in this one line")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.kept) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {(1, 0): (1, True), (1, 1): (1, True), (2, 0): (2, True), (2, 1): (1, False), (2, 2): (1, False), (3, 0): (1, False), (5, 0): (5, True), (5, 1): (5, False), (6, 0): (6, True)}
    texts = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert texts == {1: f"{long}\nunique line of one\n\n", 2: "intro line here", 3: "", 4: None, 5: "short", 6: rows[5][1]}
    assert line_dedup.line_dedup(empty).count() == 0


def line_links(lines):
    """Brute force: components of lines by Jaccard of all 8-character shingles, each by its least number."""
    sets = [{x[i : i + 8] for i in range(max(len(x) - 7, 1))} for x in lines]
    root = list(range(len(lines)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(lines)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(lines))]


def kept_lines(spark, lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(2)
    return [k for _, k in sorted((r.doc_id, r.keep_doc_id) for r in line_dedup.line_dedup(docs).collect())]


def sparse_lines():
    """Lines without spaces, and short lines one word apart."""
    rng = np.random.default_rng(5)
    thai = "".join(chr(0xE01 + c) for c in rng.integers(0, 46, 120))
    code = "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, 200))
    lines = [thai, "\u0e2e" + thai[1:], code, "f" + code, "=" * 40 + "+-" * 20, "#" + "=" * 39 + "+-" * 20]
    for n in [*range(4, 14)] * 4:
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n)]
        lines += [" ".join(words), " ".join(words[:-1] + ["".join(chr(97 + c) for c in rng.integers(0, 26, 2))])]
    return lines


def template_lines(n=120):
    """Variants of one template with a near copy of each."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    shared = [word() for _ in range(60)]
    lines = []
    for _ in range(n):
        own = [word() for _ in range(8)]
        lines += [" ".join(shared + own), " ".join(shared + own[:-1] + [word()])]
    return lines


@pytest.mark.parametrize("make", [sparse_lines, template_lines])
def test_line_dedup_loses_no_link(spark, make):
    lines = make()
    assert kept_lines(spark, lines) == line_links(lines)


def test_warc(spark, tmp_path):
    page = "<html>" + "ü" * 100
    pages = spark.createDataFrame([(1, "http://a", page), (2, "http://b", page), (3, None, None), (4, "http://c", "tiny"), (5, "http://d", "tiny"), (None, "u", page)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    assert (got[2].record_type, got[2].refers_to, got[2].payload_bytes) == ("revisit", 1, 206)
    assert {i: r.record_type for i, r in got.items() if i != 2} == {1: "response", 3: "response", 4: "response", 5: "response", None: "response"}
    assert got[2].payload_digest == got[1].payload_digest and got[3].payload_bytes == 0
    assert warc.archive_pages(pages.limit(0)).count() == 0
    rec = warc.record_bytes({"record_type": "response", "record_id": "<urn:page:1>", "target_uri": "u", "payload": b"abc" * 9999, "payload_digest": "sha256:0", "refers_to": None})
    for blob in (rec + rec, warc.member(rec) * 2, __import__("gzip").compress(rec) * 2):
        heads = [(h["warc-type"], b) for h, b in warc.read_records(io.BytesIO(blob), lambda h: False)]
        full = [warc.split_http(b, h["content-type"])[1] for h, b in warc.read_records(io.BytesIO(blob))]
        assert heads == [("response", None)] * 2 and full == [b"abc" * 9999] * 2
    warc.write_warc(pages, str(tmp_path / "w"))
    some = spark.read.format("warc").schema("record_id string, payload_bytes long").load(str(tmp_path / "w"))
    assert some.count() == 6
    assert [r.record_id for r in spark.read.format("warc").load(str(tmp_path / "w")).filter("record_type = 'revisit'").collect()] == ["<urn:page:2>"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, " ".join(f"word{(i * 7 + j * j) % 97}" for j in range(60)) + f" tail{i}", "en", "s", 1) for i in range(30)]
    rows += [(50, rows[0][1], "en", "s", 1), (51, rows[1][1] + " more", "en", "s", 1), (52, "too short", "en", "s", 1), (53, None, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id for r in p.run(spark, str(tmp_path)).collect()}
    assert got == set(range(30))
    assert [n for n, _ in p.STAGES] == ["quality_rules", "quality_classifier", "exact_dedup", "near_dedup", "packing"]
