"""The training-data operators against brute force, column by column, on fixtures with every odd row."""

import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrix.llm import bytetable, candidates, common, exact_dedup, license_scan, line_dedup, near_dedup, packing, quality_classifier, quality_rules, simple8b, tokens, unigram, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "hello <|endoftext|> there"), (2, "a  <|endoftext|>\n\n<|endof text|> 日本語 \xa0 x"), (3, None), (4, ""), (5, "   "), (6, "word " * 9000), (7, "=" * 30000), (8, "naïve façade " * 700),
    (9, "\n".join(["same line here"] * 4 + ["other"])), (9, "\n".join(["same line here"] * 4 + ["other"])), (None, "lost id"), (10, "Under the MIT License and the GNU general  public-license."),
]
SCHEMA = "doc_id long, text string, lang string, kept string, n_words string, length string, key map<string,string>"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, long texts, special strings, repeats, and columns of other meaning, one of a type without order."""
    return spark.createDataFrame([(i, t, "en", "own", "own", "own", {"a": "b"}) for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))


def ids_of(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_ids_are_the_librarys(docs, library):
    got = sorted(simple8b.encode_documents(docs).collect(), key=lambda r: r.start)
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = ids_of(library, t, 0)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pieces_and_places(docs, library):
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for i, t in ODD:
        ids = ids_of(library, t, 2)
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    spots = defaultdict(list)
    for r in got:
        spots[r.sequence_id].append((r.offset, r.length))
    for s in spots.values():
        ends = [0, *np.cumsum([n for _, n in sorted(s)]).tolist()]
        assert [o for o, _ in sorted(s)] == ends[:-1] and ends[-1] <= 1024
    assert len(spots) == packing.lower_bound(Counter(r.length for r in got))


def optimum(sizes, room):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b + sizes[i] <= room}.values():
            go(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=10))
def test_packing_of_few_pieces_is_optimal(sizes):
    sizes = sorted(sizes, reverse=True)
    got = packing.solve(dict(Counter(sizes)), 24, nodes=10**5, fill_nodes=10**5, keep=10**5)
    assert sum(p.times for p in got) == optimum(sizes, 24)


def test_table_grows_past_any_batch():
    table = bytetable.ByteTable(lambda spans: [np.array([len(s), s[0]], "<i4") for s in spans], 4)
    words = [f"{i:x}".encode() for i in range(5000)]
    for _ in range(2):
        data, bounds = bytetable.concat(words)
        numbers = table.numbers(data, bounds[:-1], bounds[1:])
        rows, lens = table.rows(numbers)
        assert len(set(numbers.tolist())) == 5000 and rows.reshape(-1, 2).tolist() == [[len(w), w[0]] for w in words] and (lens == 2).all()
    assert len(table.numbers(*[np.frombuffer(b"ab", "u1"), np.array([0, 1]), np.array([1, 2])])) == 2


def test_many_distinct_words_in_small_tables(library, monkeypatch):
    """op1, op7: the chunk encoder; op5: units; op4: words; each with tables of a few slots."""
    text = " ".join(f"w{i}" for i in range(3000))
    small = tokens.ChunkEncoder(tokens.vocabulary("byte_bpe_50k.json"), 4)
    assert small.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    path = tokens.vocabulary("piece_bpe_32k.model")
    model = unigram.load_model(path)
    table = bytetable.ByteTable(lambda units: unigram.viterbi_units(model, units), 4)
    ids, _ = unigram.encode_marked([unigram.marked(text)], table)
    assert ids.tolist() == unigram.encode(model, [text])[0].tolist()
    plain = quality_rules.measure_batch([text, text + " " + text], path)
    monkeypatch.setattr(quality_rules._pieces(path), "table", bytetable.ByteTable(quality_rules._pieces(path)._encode, 4))
    again = quality_rules.measure_batch([text, text + " " + text], path)
    assert all((plain[k] == again[k]).all() for k in plain)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=12), st.integers(1, 9))
def test_span_hashes_do_not_depend_on_parts(spans, part):
    data, bounds = bytetable.concat(spans)
    whole = bytetable.span_hashes(data, bounds[:-1], bounds[1:])
    before, bytetable.HASHED_AT_ONCE = bytetable.HASHED_AT_ONCE, part
    try:
        assert whole.tolist() == bytetable.span_hashes(data, bounds[:-1], bounds[1:]).tolist()
    finally:
        bytetable.HASHED_AT_ONCE = before


def test_exact_dedup_of_unordered_columns(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({norm(t) for _, t in ODD})


def license_by_hand(text, k=license_scan.K):
    """Base places, and labels and best cover of diagonal voting, without joins."""
    w = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    base = [(i, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    grams = lambda x: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
    templates = [(label, f"{label}/{i}", t.split()) for label, texts in license_scan.TEMPLATES.items() for i, t in enumerate(texts)]
    found = []
    for label, name, t in templates:
        lines = defaultdict(list)
        for p, g in enumerate(grams(w)):
            for j, h in enumerate(grams(t)):
                if g == h:
                    lines[p - j].append((p, j))
        families: list = []
        for d in sorted(lines):
            if not families or d - families[-1][-1] > license_scan.NEIGHBOURS:
                families.append([])
            families[-1].append(d)
        for family in families:
            spans: list = []
            for first, last, js in sorted((min(lines[d])[0], max(lines[d])[0], [j for _, j in lines[d]]) for d in family):
                if spans and first - spans[-1][1] <= k + license_scan.NEIGHBOURS:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], last), spans[-1][2] + js)
                else:
                    spans.append((first, last, js))
            for first, last, js in spans:
                covered = {x for j in js for x in range(j, j + k)}
                told = all({t[x] for x in covered} - set(v) or not set(t) - set(v) for other, _, v in templates if other != label and set(grams(v)) & set(grams(t)))
                if len(covered) / len(t) >= license_scan.COVER and told:
                    found.append((-len(covered) / len(t), -len(js), -len(t), label, name, first, last + k - 1))
    kept: list = []
    for s in sorted(found):
        if all(2 * (min(s[6], o[6]) - max(s[5], o[5]) + 1) < min(s[6] - s[5], o[6] - o[5]) + 1 for o in kept):
            kept.append(s)
    labels, covers = {b for _, b in base} | {s[3] for s in kept}, [0.0, *(-s[0] for s in kept)]
    starts = [i for i, _ in base]
    return (len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels))), 1.0 if base else max(covers)


def test_license_scan_by_hand(spark):
    rng = np.random.default_rng(4)
    texts = [t for _, t in ODD]
    every = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    for n in range(60):
        words = every[n % len(every)].split()
        for _ in range(n // 6):  # words dropped, put in and changed
            at = int(rng.integers(0, len(words)))
            words[at : at + int(rng.integers(0, 2))] = ["extra", "words"][: int(rng.integers(0, 3))]
        texts.append("before it " + " ".join(words).title() + ", after " + (" ".join(words[:12]) if n % 3 else "mit license"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.license_scan(docs).collect():
        want, score = license_by_hand(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want and abs(r.score - score) < 1e-6, r


def test_each_template_has_its_own_label_alone(spark):
    """Also with a few words lost, between other words, and in one document with its sisters."""
    rows, want = [], {}
    every = [(label, t) for label, texts in license_scan.TEMPLATES.items() for t in texts]
    for label, t in every:
        w = t.split()
        for text in (t, f"so it says {t} and more", " ".join(w[: len(w) // 3] + w[len(w) // 3 + 1 :])):
            want[len(rows)] = {label}
            rows.append((len(rows), text))
    want[len(rows)] = {"gpl", "lgpl", "agpl"}
    rows.append((len(rows), " between them ".join(t for label, t in every if label in ("gpl", "lgpl", "agpl"))))
    for r in license_scan.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert {s.label for s in r.spans} == want[r.doc_id] or (not r.spans and len(rows[r.doc_id][1].split()) < 6), (rows[r.doc_id], r.spans)


def test_verdicts_follow_language_and_null_ids(spark):
    """One text under two languages has two verdicts, and no null id runs into another row's key."""
    from papyrix.llm.common import row_digest

    pairs = spark.createDataFrame([(None, "7|a"), (7, "a"), (None, "a"), (7, None), (7, "")], "i long, t string")
    assert pairs.select(row_digest(F.col("i"), F.col("t"))).distinct().count() == 5
    rng = np.random.default_rng(2)
    plain = "the of and to in that it is was for on are with as his they be at one have this from by hot word but what some we can out other were all there when".split()
    odd = [f"zq{chr(97 + i % 26)}x{i}jv" for i in range(40)]
    say = lambda words: " ".join(rng.permutation(words)[:25])
    rows = [(100 + i, say(plain), "yy") for i in range(60)] + [(200 + i, say(odd), "xx") for i in range(60)]
    rows += [(1, rows[0][1], "xx"), (1, rows[0][1], "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    verdict = {(r.doc_id, r.band[:2]): r.kept for r in quality_rules.quality_verdicts(docs).collect()}
    assert verdict[(1, "xx")] != verdict[(1, "yy")]
    kept = {(r.doc_id, r.lang) for r in quality_rules.drop_rejected(docs).collect()}
    assert kept == {k for k, v in verdict.items() if v}


def test_a_stray_diagonal_splits_no_span(spark):
    t = license_scan.TEMPLATES["bsd"][0].split()
    text = " ".join(t[:9] + t[16:20] + t[9:])  # a run of later words in the middle
    spans = [s for s in license_scan.license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans if s.label == "bsd"]
    assert max(s.cover for s in spans) > 0.95 and max(s.last - s.first for s in spans) >= len(t) - 1


def counts_by_hand(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    n = Counter(grams)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len({k for j, g in enumerate(grams) if n[g] > 1 for k in range(j, j + 5)})


def test_quality_counts_and_verdicts_by_hand(spark, docs):
    import sentencepiece

    rng = np.random.default_rng(5)
    usual = ["tea", "house", "river", "stone", "light", "walk", "green", "often", "the", "and"] + [f"{a}{b}" for a in "abcdefgh" for b in ("and", "ing", "ter", "al")]
    rows = [(i, t, None) for i, t in enumerate([t for _, t in ODD])]
    rows += [(100 + i, " ".join(rng.choice(usual, n)), "xx") for i, n in enumerate([60] * 45 + [200] * 45)]
    rows += [(900, " ".join("qzx" + "%$" * 3 + str(j) for j in range(60)), "xx"), (901, " ".join(rng.choice(usual[:3], 200)), "xx")]
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    measured, bands = {}, defaultdict(list)
    for i, t, lang in rows:
        ids = [x for w in WORD.findall(t or "") for x in sp.encode(w)]
        p = np.array(list(Counter(ids).values())) / max(len(ids), 1)
        chars = sum(map(len, WORD.findall(t or "")))
        measured[i] = (chars / max(len(ids), 1), sum(map(sp.is_byte, ids)) / max(len(ids), 1), 0.75 * np.log2(max(len(ids), 1)) + (p * np.log2(p)).sum())
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == counts_by_hand(t)
        assert got[i].n_tokens == len(ids) and np.allclose((got[i].chars_per_token, got[i].byte_share, got[i].entropy_loss), measured[i])
        assert got[i].base_failed == (got[i].n_words < 10 or 100 * got[i].n_repeat_words > 20 * got[i].n_words)
        bands[got[i].band].append(i)
    large = {b: v for b, v in bands.items() if len(v) >= quality_rules.ENOUGH}
    assert len(large) >= 2
    for members in large.values():  # these tell their own band
        inside = dict.fromkeys(members, True)
        for k, least in enumerate(quality_rules.LEAST.values()):
            middle = lambda v: sorted(v)[-(-len(v) // 2) - 1]
            mid = middle([measured[i][k] for i in members])
            mad = middle([abs(measured[i][k] - mid) for i in members])
            for i in members:
                away = measured[i][k] - mid
                inside[i] &= (away if k == 1 else abs(away)) <= max(least, quality_rules.BAND_SIGMAS * 1.4826 * mad)
        assert all(got[i].kept == (inside[i] and not got[i].base_failed) for i in members)
    assert not got[900].kept and sum(got[100 + i].kept for i in range(90)) >= 84


def test_classifier_minimum_and_accuracy(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(40, 6))
    win, lose = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    w = quality_classifier._ranked(z, win, lose, 0.01)
    loss = lambda v: np.log1p(np.exp(-(z[win] - z[lose]) @ v)).mean() + 0.005 * v @ v
    assert all(loss(w) <= loss(w + 0.01 * rng.normal(size=6)) for _ in range(200))
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    twice = docs.unionByName(docs.filter("doc_id % 7 = 0")).withColumn("score", F.lit("own")).withColumn("label", F.lit("own"))
    got = quality_classifier.quality_classifier(twice, labels)
    held = got.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert held.n > 100 and held.a >= 0.97 and got.count() == twice.count()
    assert got.groupBy("doc_id").agg(F.countDistinct("score").alias("n")).filter("n > 1").isEmpty()
    model = quality_classifier.train_ranker(docs, labels)
    one, two = (quality_classifier.train_ranker(d, labels) for d in (docs.repartition(5), twice))
    assert np.allclose(model.weights, one.weights, atol=1e-4) and np.allclose(model.weights, two.weights, atol=1e-4)
    assert quality_classifier.quality_classifier(docs.limit(0), labels).count() == 0
    assert len({*quality_classifier.feature_matrix(["", "", "a b"])[:2].sum(1).tolist()}) == 1


def lines_by_hand(rows, percent=80):
    """Per line the document and line that stay, by Jaccard of all shingles and union-find."""
    lines = [(i if i is not None else 1 << 62, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    sets = [{x[j : j + 8] for j in range(max(len(x) - 7, 1))} for *_, x in lines]
    root = list(range(len(lines)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(lines)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[x] = y
    best = {}
    for i, line in enumerate(lines):
        best[find(i)] = min(best.get(find(i), line[:2]), line[:2])
    return {line[:2]: best[find(i)] for i, line in enumerate(lines)}


def word_lines():
    """Pairs of lines of 1 to 8 words, of short or very long words, one of them changed a little, and lines without spaces."""
    rng = np.random.default_rng(8)
    made = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    pairs = defaultdict(list)
    for words in range(1, 9):
        for _ in range(14):
            w = [made(30 if rng.random() < 0.5 else int(rng.integers(9, 14))) for _ in range(words)]
            at = int(rng.integers(0, words))
            pairs[words].append((" ".join(w), " ".join([*w[:at], "Q" + w[at][1:], *w[at + 1 :]])))
    for _ in range(14):
        run = made(int(rng.integers(60, 400)))
        thai = "".join(chr(0xE01 + c) for c in rng.integers(0, 46, 120))
        pairs["run"] += [(run, "x" + run), (thai, "ฮ" + thai[1:]), ("".join(f"{c:x}" for c in rng.integers(0, 16, 200)),) * 2]
    return pairs


def test_line_recall_by_words(spark):
    pairs = word_lines()
    rows = [(2 * n + k, x) for n, (_, x2) in enumerate((c, p) for c, ps in pairs.items() for p in ps) for k, x in enumerate(x2)]
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = lines_by_hand(rows)
    assert got.keys() == want.keys()
    at, seen = 0, 0
    for kind, some in pairs.items():
        linked = [2 * n + 1 for n in range(at, at + len(some)) if want[(2 * n + 1, 0)] == (2 * n, 0)]
        hits = sum(got[(i, 0)] == want[(i, 0)] for i in linked)
        assert hits >= 0.9 * len(linked), (kind, hits, len(linked))
        seen, at = seen + len(linked), at + len(some)
    assert seen > 60 and all(got[k] == k for k in want if want[k] == k)


def test_long_lists_of_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL", 3)
    monkeypatch.setattr(candidates, "BLOCK", 8)
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    shared = [word() for _ in range(40)]
    rows = []
    for i in range(40):
        own = [word() for _ in range(7)]
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + own[:-1] + [word()]))]
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lines_by_hand(rows)


def test_a_large_family_of_lines_makes_few_pairs():
    """Near copies that mostly are not linked with each other, or mostly are: what is compared further does not grow with all pairs."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 5))
    shared, some = [word() for _ in range(60)], [word() for _ in range(3)]
    for rate in (0.05, 0.01):
        lines = [" ".join(w if rng.random() > rate else some[rng.integers(0, 3)] for w in shared) for _ in range(150)]
        sets = list(line_dedup._sets(lines))
        sketches = [x[: line_dedup.SKETCH].tobytes() for x in sets]
        reps = np.arange(len(lines))
        sizes = np.array([len(x) for x in sets])
        links = [(a, b) for a in reps for b in reps if a < b and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
        for apart, pairs in ((False, links), (True, [(a, b) for a, b in links if (a + b) % 2])):
            got = candidates.list_pairs(reps, reps, reps % 2, sizes, sketches, apart, line_dedup.PERCENT, line_dedup.SKETCH)
            assert len(got) < len(reps) and {*got} <= {*pairs} and joined(got, len(reps)) == joined(pairs, len(reps))


def joined(pairs, n):
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def test_lines_of_rows_that_share_an_id(spark):
    line = "a line that is long enough to be a line of its own"
    rows = [(13, "only here, in the first row"), (13, f"{line}\nand only here, in the second"), (13, f"{line}\nlast"), (None, f"{line}!\nwithout an id"), (None, None), (14, ""), (15, "x" * 200_000 + "\n" + line)]
    docs = spark.createDataFrame([(*r, {"a": "b"}) for r in rows], "doc_id long, text string, `__own` map<string,string>").coalesce(1)
    got = sorted(str(r.text) for r in line_dedup.drop_repeated_lines(docs).collect())
    assert got == sorted(["only here, in the first row", f"{line}\nand only here, in the second", "last", "without an id", "None", "", "x" * 200_000])
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns


def near_by_hand(rows, percent):
    """Component of each document by full shingle sets."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = set(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
    holds = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holds[g].append(i)
    both = Counter()
    for some in holds.values():
        for a in some:
            for b in some:
                if a < b:
                    both[(a, b)] += 1
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_recall_on_documents(spark, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = near_by_hand([(r.doc_id, r.text) for r in docs.collect()], percent)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dup_components(docs, percent).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_near_long_lists(spark, monkeypatch):
    """All lists are long, blocks are small, and a passage is shared by many documents."""
    monkeypatch.setattr(near_dedup, "LONG", 2)
    monkeypatch.setattr(candidates, "BLOCK", 6)
    rng = np.random.default_rng(2)
    base, passage = [f"w{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.008 else f"z{rng.integers(99)}" for w in base)) for i in range(50)]
    rows += [(100 + i, " ".join(passage + [f"v{i}x{j}" for j in range(60)])) for i in range(40)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_dup_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_by_hand(rows, 85)


def test_warc_appends_and_members(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a", "<html>one"), (2, "http://b", "<html>two")], "page_id long, url string, html string")
    where = str(tmp_path / "w")
    for _ in range(2):
        warc.write_warc(pages, where)
    ids = lambda: sorted(r.page_id for r in warc.read_pages(spark, where).collect())
    assert ids() == [1, 1, 2, 2]
    warc.archive_rows(pages.filter("page_id = 1")).write.format("warc").mode("overwrite").save(where)
    assert ids() == [1]
    rec = warc.record_bytes({"record_type": "response", "record_id": "<urn:page:1>", "target_uri": "u", "payload": b"abc" * 9999, "payload_digest": "sha256:0", "refers_to": None})
    gz = __import__("gzip").compress
    one, two = warc.member(rec), warc.member(rec + rec)
    monkeypatch.setattr(warc, "MOST_STATED", 10)  # as if the lengths did not fit into 32 bits
    large = warc.member(rec)
    for blob, n in ((gz(rec + rec), 2), (two, 2), (two + one, 3), (one + large + gz(rec) + one, 4)):
        heads = [b for _, b in warc.read_records(io.BytesIO(blob), lambda h: False)]
        full = [warc.split_http(b, h["content-type"])[1] for h, b in warc.read_records(io.BytesIO(blob))]
        assert heads == [None] * n and full == [b"abc" * 9999] * n
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(rec[:-9999])))


def test_long_units_have_the_same_path():
    model = unigram.load_model(tokens.vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(6)
    for _ in range(60):
        unit = "".join(rng.choice(list("abcdetion日本xก♞=-"), int(rng.integers(1, 300)))).encode()
        assert unigram._long_path(model, unit).tolist() == unigram._viterbi(model, [unit])[0].tolist()
    text = "".join(chr(0x4E00 + c) for c in rng.integers(0, 3000, 40_000))
    assert unigram.decode(model, unigram.encode(model, [text])[0].tolist()) == text


def test_every_operator_takes_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    n = len(ODD)
    assert unigram.encode_documents(docs).filter("round_trip").count() == n
    assert license_scan.license_scan(docs).count() == n and quality_rules.quality_rules(docs).count() == n
    assert quality_classifier.quality_classifier(docs, labels).filter("score between 0 and 1").count() == n
    assert near_dedup.near_dup_components(docs).count() == n and near_dedup.drop_near_copies(docs).columns == docs.columns
    assert quality_rules.drop_rejected(docs).columns == docs.columns == quality_classifier.drop_poor(docs, labels).columns


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, getCheckpointDir = "yarn", staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_pipeline_by_hand(spark, tmp_path, library):
    import corpus_pipeline as p

    rng = np.random.default_rng(7)
    usual = ["tea", "house", "river", "stone", "light", "walk", "green", "often", "the", "and"] + [f"{a}{b}" for a in "abcdefgh" for b in ("and", "ing", "ter", "al")]
    texts = [" ".join(rng.choice(usual, 80)) + "." for _ in range(60)]
    texts += [texts[0], texts[1].replace(" ", "  "), texts[2] + " more", None, "", "too short", "again and again " * 40, "x" * 5000]
    texts += [" ".join(w.upper() + "!!" for w in t.split()) for t in texts[40:60]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0), (None, texts[4], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in [*range(60), *range(68, 88)]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, labels = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    # The decisions of the two learned stages are read from their operators, the others are made by hand.
    verdict = {(r.doc_id, r.n_words): r.kept for r in quality_rules.quality_verdicts(docs).collect()}
    left = [r for r in rows if verdict[(r[0], len(WORD.findall(r[1] or "")))]]
    assert all(len(WORD.findall(r[1])) >= 10 for r in left) and not {63, 64, 65, 66, 67} & {r[0] for r in left}
    ruled = spark.createDataFrame(left, docs.schema)
    model = quality_classifier.train_ranker(ruled, labels)
    left = [r for r, s in zip(left, model.score(quality_classifier.feature_matrix([r[1] for r in left]).astype(np.float32))) if s >= model.threshold]
    assert left and max(r[0] or 0 for r in left) < 68
    norm, first = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t), {}
    for r in sorted(left, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(norm(r[1]), r)
    left = list(first.values())
    roots = near_by_hand([(r[0], r[1]) for r in left if r[0] is not None], 80)
    left = [r for r in left if r[0] is None or roots[r[0]] == r[0]]
    want = Counter()
    for i, t, *_ in left:
        ids = ids_of(library, t, 2)
        want[(i, 0, 0, len(ids), zlib.crc32(ids.tobytes()))] += 1
    got = p.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    labels.write.parquet(str(empty / "labels.parquet"))
    assert p.run(spark, str(empty)).count() == 0


def test_lines_are_compared_without_python(spark, tmp_path):
    """The steps of op8 are DataFrame functions, very long lines among them, whose sets are rows."""
    rng = np.random.default_rng(3)
    made = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    long, other = made(70_000), made(70_000)
    lines = [long, "x" + long[1:], other, "ü" * 9 + "abcdefgh", "ü" * 10 + "abcdefgh", "tiny", "tinx", long[:40_000] + other[:30_000]]
    texts = spark.createDataFrame([(i, x, len(x) > line_dedup.CHUNK) for i, x in enumerate(lines)], "node long, line string, long boolean")
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 8)], "a long, b long")
    scratch = common.Scratch(spark, "lines")
    near = line_dedup.near_pairs(pairs, line_dedup.bitmaps(texts), 80)
    links = line_dedup.verified(near, texts, 80, scratch, "links")
    assert sorted((r.a, r.b) for r in links.collect()) == [(0, 1), (3, 4)]
    for made in (line_dedup.visible_lines(texts.selectExpr("node as row", "node as doc_id", "line as text")), line_dedup.band_keys(texts), near):
        assert not any(x in made._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
