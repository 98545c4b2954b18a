import json
import os
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from papyrix.operators import digest
from papyrix.plans import cli, serve
from papyrix.sources import files as exports
from papyrix.sources import manifests, parsers, store
from papyrix.streaming import incremental


@pytest.fixture()
def sources(tmp_path):
    for name, kind in (("notes", "text"), ("site", "htmlsite"), ("posts", "facebook"), ("books", "goodreads"), ("letters", "substack")):
        os.makedirs(tmp_path / name)
        manifests.write_source_starter(str(tmp_path / name), name, kind)
    same = "one two three four five six seven eight nine ten eleven twelve"
    (tmp_path / "notes/a.md").write_text("# Title\nplain body of a note")
    (tmp_path / "notes/logo.png").write_bytes(b"x")
    (tmp_path / "site/2020-01-02-my_page.html").write_text(f"<body><h1>title</h1><p>{same}</p></body>")
    (tmp_path / "posts/your_posts_1.json").write_text(json.dumps([{"timestamp": 1577923200, "data": [{"post": same}], "attachments": [{"data": [{"external_context": {"url": "https://www.x.org/a", "name": "X"}}, {"external_context": {"url": "nowhere"}}]}]}, {"timestamp": 5}]))
    (tmp_path / "books/goodreads_library_export.csv").write_text('Book Id,Title,Author,My Rating,My Review,Date Read\n7,T,A,4,"<p>good, ""very""</p>",\n8,U,B,1,,2020/01/01\n')
    os.makedirs(tmp_path / "letters/posts")
    (tmp_path / "letters/posts.csv").write_text("post_id,post_date,is_published,title,subtitle\n1.hello,2021-01-01T00:00:00Z,true,,Sub\n2.draft,,false,D,\n")
    for n in ("1.hello", "2.draft", "3.lost"):
        (tmp_path / f"letters/posts/{n}.html").write_text("<p>letter body</p>")
    return tmp_path


def test_digest_search_dupes_export(spark, sources):
    base = str(sources / "digested")
    lines = [json.loads(x) for x in cli.run(["digest", "--source", str(sources), "--digested", base], spark).splitlines()]
    reports = {r["source"]: r for r in lines[:-1]}
    assert {k: v["documents"] for k, v in reports.items()} == {"notes": 1, "site": 1, "posts": 1, "books": 1, "letters": 1}
    assert reports["letters"]["errors"] == ["newsletter: posts/3.lost.html has no row in posts.csv"]
    total = lines[-1]
    assert (total["sources"], total["documents"], total["embedded"], total["reused"], total["errors"]) == (5, 5, 5, 0, 1)
    again = [json.loads(x) for x in cli.run(["digest", "--source", str(sources), "--digested", base], spark).splitlines()]
    assert [(r["documents"], r["embedded"], r["reused"]) for r in again[:-1]] == [(1, 0, 1)] * 5
    held = manifests.load_store_manifest(base)
    assert {s["version"] for s in held.sources} == {2} and all(s["digested_at"] for s in held.sources) and held.sizes() == (5, sum(s["tokens"] for s in held.sources))
    assert sorted(os.listdir(f"{base}/documents/source=notes")) == ["version=2"]
    found = json.loads(cli.run(["search", "--digested", base, "--json", "seven", "eight"], spark))  # hashed vectors are not fused unasked
    assert found["mode"] == "lexical" and {r["source"] for r in found["results"]} == {"site", "posts"} and found["results"][0]["place"] == 1
    assert "site" in cli.run(["search", "--digested", base, "--mode", "hybrid", "eleven"], spark)
    only = json.loads(cli.run(["search", "--digested", base, "--source", "posts", "--json", "seven"], spark))
    assert [r["source"] for r in only["results"]] == ["posts"]
    groups = json.loads(cli.run(["dupes", "--digested", base, "--json"], spark))
    assert (groups["compared"], groups["duplicated"], groups["groups"]) == (4, 2, 1) and groups["found"][0]["members"] == 2 and groups["found"][0]["lowest"] == 1.0
    assert "4 documents compared, 2 in 1 group" in cli.run(["dupes", "--digested", base], spark)
    line = json.loads(cli.run(["export", "--digested", base], spark))
    assert len(line["entries"]) == 4 and sum(len(e["copies"]) for e in line["entries"]) == 1 and line["counts"]["documents"] == 5 and len(line["sources"]) == 4
    page = cli.run(["export", "--digested", base, "--format", "html"], spark)
    assert page.count("<article") == 4 and "1 copy folded away" in page and "#short:not(:checked)~main .short{display:none}" in page
    assert "all" in cli.run(["stats", "--digested", base], spark) and len(cli.run(["stats", "--digested", base, "--sample", "2"], spark).splitlines()) == 3
    text = cli.run(["links", "--source", str(sources / "posts")], spark)
    assert "https://www.x.org/a" in text and "1 link to 1 page from 2020-01-02 to 2020-01-02; 1 unusable" in text
    assert json.loads(cli.run(["links", "--source", str(sources / "posts"), "--json"], spark))["dropped"] == 1
    assert "notes" in cli.run(["sources", "--digested", base], spark)
    with pytest.raises(ValueError):
        cli.run(["dupes", "--digested", base, "--threshold", "0"], spark)
    with pytest.raises(ValueError, match="nope"):
        cli.run(["search", "--digested", base, "--source", "nope", "x"], spark)


def test_one_bad_file_costs_no_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parsers, "LARGEST_FILE", 200)
    os.makedirs(tmp_path / "books/drafts")
    manifests.write_source_starter(str(tmp_path / "books"), "books", "goodreads")
    head = "Book Id,Title,Author,My Rating,My Review,Date Read\n"
    (tmp_path / "books/goodreads_library_export1.csv").write_text(head + '7,T,A,4,"<p>a good\nbook</p>",2020/01/02\n')
    (tmp_path / "books/goodreads_library_export2.csv").write_text("Book Id,Title\n1,T\n")
    (tmp_path / "books/goodreads_library_export3.csv").write_text(head + ",T,A,4,lost,\n8,U,B,1,kept no more,\n")
    (tmp_path / "books/goodreads_library_export4.csv").write_text(head + "9,T,A,4," + "long " * 100 + ",\n")
    (tmp_path / "books/goodreads_library_export[5].csv").write_text(head + "5,T,A,4,odd name,\n")
    manifest = manifests.load_source(str(tmp_path / "books"), parsers.types())
    raw, files = parsers.parse_source(spark, str(tmp_path / "books"), manifest)
    got = raw.collect()
    assert {(r.native_key, r.text.strip(), str(r.published)[:10]) for r in got if r.error is None} == {("7", "a good\nbook", "2020-01-02"), ("5", "odd name", "2012-01-01")}
    assert sorted(r.error for r in got if r.error) == [
        "goodreads: goodreads_library_export4.csv is too large", "reviews: goodreads_library_export2.csv: missing column Author, My Rating, My Review, Date Read", "reviews: goodreads_library_export3.csv has a review with no Book Id",
    ]
    assert files.count() == 5 and files.filter("too_large").count() == 1


def test_an_unreadable_file_is_reported_and_excluded_folders_are_not_listed(spark, tmp_path, monkeypatch):
    root = tmp_path / "notes"
    for d in ("a/b/c", "drafts/deep", ".git/x", "a/drafts"):
        os.makedirs(root / d)
    manifests.write_source_starter(str(root), "notes", "text")
    for n in ("top.md", "a/one.txt", "a/b/c/deep.md", "drafts/deep/no.md", ".git/x/no.md", "a/drafts/no.md", "a/no.png", "a/corpus.yaml.txt"):
        (root / n).write_text(f"text of {n}")
    os.symlink(root / "nowhere", root / "a/gone.md")
    os.symlink(root / "a", root / "a/b/loop.md")  # a folder's link is a file that cannot be read
    (root / "big.md").write_text("x" * 500)
    monkeypatch.setattr(parsers, "LARGEST_FILE", 200)
    manifest = manifests.load_source(str(root), parsers.types())
    manifest.exclude = ["drafts/"]
    want = {"top.md", "a/one.txt", "a/b/c/deep.md", "a/corpus.yaml.txt", "a/gone.md", "a/b/loop.md", "big.md"}
    for planned in (1, 2, 256):  # folders that the driver plans, the rest walked by tasks
        monkeypatch.setattr(exports, "PLANNED", planned)
        reader = exports.FolderReader({"path": str(root), "exclude": json.dumps([*manifest.exclude, *manifests.NOISE]), "include": '["*.md", "*.txt"]'})
        parts = reader.partitions()
        listed = []
        monkeypatch.setattr(exports.FolderReader, "_list", (lambda f: lambda self, fs, base, rel: (listed.append(rel), f(self, fs, base, rel))[1])(exports.FolderReader._list))
        assert {name for p in parts for name, _ in reader.read(p)} == want and len(parts) == {1: 2, 2: 3, 256: 4}[planned]
        assert sorted(listed) == ["", "a", "a/b", "a/b/c"]
        monkeypatch.undo()
        monkeypatch.setattr(parsers, "LARGEST_FILE", 200)
    raw, files = parsers.parse_source(spark, f"file://{root}", manifest, workers=3)
    got = raw.collect()
    assert {r.file for r in got if r.error is None} == want - {"a/gone.md", "a/b/loop.md", "big.md"}
    assert sorted(r.error for r in got if r.error) == ["text: a/b/loop.md cannot be read: OSError", "text: a/gone.md cannot be read: No such file or directory", "text: big.md is too large"]
    assert {r.file for r in files.collect()} == want
    plain = tmp_path / "plain"  # without links, which Spark's own reader follows without end
    os.makedirs(plain / "drafts")
    for n in ("x [1].md", "drafts/y.md", "corpus.yaml", "z.txt"):
        (plain / n).write_text("text")
    (plain / "big.md").write_text("x" * 500)
    through_spark = parsers._through_spark(spark, f"file://{plain}", manifest, ["*.md"]).collect()
    assert {(r.file, r.error) for r in through_spark} == {("x [1].md", None), ("big.md", "big.md is too large")}
    report = digest.digest_source(spark, str(root), str(tmp_path / "store"))
    assert (report["n_errors"], report["walked"], report["too_large"]) == (3, 9, 1)  # the folder's own rules: drafts are read


def test_digests_at_once_do_not_lose_each_other(spark, sources):
    """Two sources committed from one state both stay, one source twice is a conflict, and states before can be read."""
    base = f"file://{sources}/digested"
    claimed = [store.claim(spark, base, "notes", 0) for _ in range(3)]
    assert claimed == [1, 2, 3]
    failures = []

    def one(name):
        try:
            digest.digest_source(spark, str(sources / name), base, keep=True)
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    threads = [threading.Thread(target=one, args=(n,)) for n in ("notes", "posts")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    held = manifests.load_store_manifest(base)
    assert not failures and {s["name"]: s["version"] for s in held.sources} == {"notes": 4, "posts": 1}
    before = manifests.log.states(base)
    (sources / "notes/b.md").write_text("another note")
    digest.digest_source(spark, str(sources / "notes"), base, keep=True)
    assert store.read(spark, base, "documents").count() == 3 and store.read(spark, base, "documents", at=before[-1]).count() == 2
    mine = manifests.StoredSource("notes", "text", version=9)
    with pytest.raises(manifests.Conflict, match="meanwhile"):
        manifests.commit_source(base, held, mine)  # from a state that another digest of it has replaced
    now = manifests.load_store_manifest(base)
    with pytest.raises(manifests.Conflict, match="settings"):
        manifests.commit_source(base, manifests.StoreManifest(embed={"model": "other"}, chunking=now.chunking), manifests.StoredSource("new", "text"))
    assert manifests.load_store_manifest(base) == now and manifests.log.states(base) == [1, 2, 3]
    with pytest.raises(ValueError, match="no state 7"):
        manifests.load_store_manifest(base, 7)


@pytest.mark.parametrize("through_hadoop", [False, True])
def test_a_state_is_created_once(spark, tmp_path, monkeypatch, through_hadoop):
    if through_hadoop:
        monkeypatch.setattr(manifests.log, "_local", lambda base: None)
    base = f"file://{tmp_path}/store"
    assert manifests.log.states(base) == [] and manifests.load_store_manifest(base).sources == []
    assert manifests.log.create(base, 1, "first ü") and not manifests.log.create(base, 1, "second")
    assert manifests.log.read(base, 1) == "first ü" and manifests.log.states(base) == [1]
    assert [n for n in os.listdir(tmp_path / "store/_log") if not n.endswith(".crc")] == ["00000000000000000001.yaml"]
    tries = []
    create = manifests.log.create

    def beaten(at, number, content):
        """Someone else is first at the first try."""
        tries.append(number)
        if len(tries) == 1:
            create(at, number, "sources: [{name: other, version: 1}]")
        return create(at, number, content)

    monkeypatch.setattr(manifests.log, "create", beaten)
    other = f"file://{tmp_path}/beaten"
    manifests.commit_source(other, manifests.StoreManifest(), manifests.StoredSource("mine", "text", version=1))
    assert tries == [1, 2] and [s["name"] for s in manifests.load_store_manifest(other).sources] == ["mine", "other"]


def test_a_failed_digest_leaves_the_store(spark, sources, monkeypatch):
    base = str(sources / "digested")
    digest.digest_source(spark, str(sources / "notes"), base)

    class Broken(digest.HashEmbedder):
        def embed(self, texts):
            return []

    (sources / "notes/b.md").write_text("another note")
    with pytest.raises(Exception, match="wrong number"):
        digest.digest_source(spark, str(sources / "notes"), base, Broken())
    assert store.read(spark, base, "documents").count() == 1 and store.read(spark, base, "vectors", "notes").count() == 1
    assert store.read(spark, base, "documents", "site") is None


def test_embedding_goes_on_after_failures(spark, tmp_path, monkeypatch):
    """Batches in passage order, tried again; after a digest that gave up, the next one embeds only what is left."""

    class Flaky(digest.HashEmbedder):
        """Keeps a file of the batches it was asked for; every third call fails, and with ``last`` all after so many texts."""

        def __init__(self, log, last=None):
            digest.HashEmbedder.__init__(self, 8)
            self.log, self.last = log, last

        def embed(self, texts):
            with open(self.log, "a") as f:
                f.write(json.dumps(texts) + "\n")
            with open(self.log) as f:
                calls = [json.loads(x) for x in f]
            if len(calls) % 3 == 0 or self.last is not None and sum(map(len, calls)) > self.last:
                raise ConnectionError("unreachable")
            return digest.HashEmbedder.embed(self, texts)

    monkeypatch.setattr(digest, "PAUSE", 0.01)
    monkeypatch.setattr(digest, "WAVE", 40)
    monkeypatch.setattr(digest, "AT_ONCE", 1)
    docs = spark.createDataFrame([(f"d{i:03d}", "") for i in range(200)], "id string, title string")
    chunks = spark.createDataFrame([(f"d{i:03d}#0", f"d{i:03d}", f"text {i % 180}") for i in range(200)], "id string, doc_id string, text string").repartition(3)
    log, safe = str(tmp_path / "calls"), f"file://{tmp_path}/safe"
    one = digest.embed_chunks(docs, chunks, None, Flaky(log)).orderBy("chunk_id").collect()
    calls = [json.loads(x) for x in open(log)]
    asked = [t for n, c in enumerate(calls) if (n + 1) % 3 for t in c]
    assert asked == [f"text {i}" for i in range(180)] and {len(c) for c in calls} == {16, 4} and len(one) == 200
    with pytest.raises(Exception, match="unreachable"):
        digest.embed_chunks(docs, chunks, None, Flaky(str(tmp_path / "more"), 100), safe)
    saved = digest._held(spark, safe).count()
    assert 30 <= saved < 110
    again = digest.embed_chunks(docs, chunks, None, Flaky(str(tmp_path / "last")), safe).orderBy("chunk_id").collect()
    calls = [json.loads(x) for x in open(tmp_path / "last")]
    assert sum(len(c) for n, c in enumerate(calls) if (n + 1) % 3) == 180 - saved and again == one


class _Server(BaseHTTPRequestHandler):
    def do_GET(self):
        self._send({"models": [{"name": "tiny:latest", "digest": "abc"}]})

    def do_POST(self):
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        self._send({"embeddings": [[float(len(t)), 1.0, 0.0] for t in texts]})

    def _send(self, body):
        raw = json.dumps(body).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *args):
        pass


def test_embedding_server(spark, sources):
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        with pytest.raises(ValueError, match="no model"):
            digest.HttpEmbedder(url, "other")
        made = digest.embedder_of(manifests.EmbedConfig(url, "tiny"))
        assert (made.name, made.digest, made.dimensions) == ("tiny", "abc", 3)
        base = str(sources / "digested")
        report = digest.digest_source(spark, str(sources / "notes"), base, made)
        vector = store.read(spark, base, "vectors").first().embedding
        assert report["embedded"] == 1 and abs(sum(x * x for x in vector) - 1) < 1e-5
        (sources / "config.yaml").write_text(f"embed: {{base_url: '{url}', model: tiny}}")
        found = json.loads(cli.run(["--config", str(sources / "config.yaml"), "search", "--digested", base, "--json", "plain"], spark))
        assert found["mode"] == "hybrid" and found["results"][0]["vector_rank"] == 1
    finally:
        server.shutdown()


def test_serve(tmp_path):
    (tmp_path / "t.json").write_text("[]")
    (tmp_path / "t.html").write_text("<p>page")
    server = serve.server(str(tmp_path / "t.json"), str(tmp_path / "t.html"))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        with urllib.request.urlopen(url + "/") as got:
            assert got.read() == b"<p>page" and "default-src" in got.headers["Content-Security-Policy"]
        assert urllib.request.urlopen(url + "/api/writing.json").read() == b"[]"
        for path, host in (("/other", "127.0.0.1"), ("/", "evil.example")):
            with pytest.raises(urllib.error.HTTPError):
                urllib.request.urlopen(urllib.request.Request(url + path, headers={"Host": host}))
    finally:
        server.shutdown()


def test_manifest_rules(tmp_path):
    (tmp_path / "corpus.yaml").write_text("type: text\nname: ok\nsurprise: 1\n")
    with pytest.raises(ValueError, match="surprise"):
        manifests.load_source(str(tmp_path), ["text"])
    with pytest.raises(FileExistsError):
        manifests.write_source_starter(str(tmp_path), "x", "text")
    with pytest.raises(ValueError):
        manifests.SourceManifest("text", "Bad Name").validate(["text"])
    store = manifests.StoreManifest(embed={"model": "a", "dimensions": 2, "digest": ""}, sources=[{"name": "x"}])
    with pytest.raises(ValueError):
        store.check_embed("b", 2, "")


def test_stream(spark, tmp_path, monkeypatch):
    """Batches are found by a search, a failed one is run again, a committed one is not, and many become one version."""
    os.makedirs(tmp_path / "in")
    base, args = f"file://{tmp_path}/store", (str(tmp_path / "in"), "s", f"file://{tmp_path}/store", str(tmp_path / "cp"))

    def arrive(name, body):
        (tmp_path / f"in/{name}.txt").write_text(body)

    arrive("first", "the first text of a harbour")
    incremental.digest_stream(spark, *args).awaitTermination(120)
    arrive("second", "the second text of a lighthouse")
    commit = manifests.commit_source
    monkeypatch.setattr(manifests, "commit_source", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        incremental.digest_stream(spark, *args).awaitTermination(120)
    assert store.read(spark, base, "documents").count() == 1

    def committed_then_lost(*a):
        commit(*a)
        raise OSError("late")

    monkeypatch.setattr(manifests, "commit_source", committed_then_lost)
    with pytest.raises(Exception, match="late"):
        incremental.digest_stream(spark, *args).awaitTermination(120)
    monkeypatch.setattr(manifests, "commit_source", commit)
    incremental.digest_stream(spark, *args).awaitTermination(120)  # the same batch again: passed over
    (held,) = manifests.load_store_manifest(base).entries()
    assert sorted(r.text for r in store.read(spark, base, "documents").collect()) == ["the first text of a harbour", "the second text of a lighthouse"]
    assert (held.documents, held.chunks, len(held.segments)) == (2, 2, 1) and held.batch >= 1
    for word, n in (("harbour", 1), ("lighthouse", 1), ("text", 2)):
        assert len(json.loads(cli.run(["search", "--digested", base, "--json", word], spark))["results"]) == n
    digest.compact(spark, base, "s")
    (after,) = manifests.load_store_manifest(base).entries()
    assert (after.documents, after.tokens, after.segments) == (2, held.tokens, []) and after.version > max(held.versions)
    assert len(json.loads(cli.run(["search", "--digested", base, "--json", "text"], spark))["results"]) == 2
    arrive("third", "a third text")
    incremental.digest_stream(spark, *args).awaitTermination(120)
    assert store.read(spark, base, "documents").count() == 3


def test_the_streams_state_expires(spark, tmp_path):
    """Ids come once while they are remembered, and what is older than the expiry is dropped from the state."""
    os.makedirs(tmp_path / "in")
    seen = []

    def batch(name, *rows):
        with open(tmp_path / f"in/{name}.json", "w") as f:
            f.writelines(json.dumps({"id": i, "arrived": t}) + "\n" for i, t in rows)
        stream = spark.readStream.schema("id string, arrived timestamp").json(str(tmp_path / "in"))
        query = incremental.once(stream, "1 day").writeStream.foreachBatch(lambda b, n: seen.extend(r.id for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return max((s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]), default=0), query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    batch("a", ("x", "2024-01-01T00:00:00Z"), ("x", "2024-01-01T00:00:00Z"), ("y", "2024-01-01T01:00:00Z"))
    batch("b", ("x", "2024-01-01T02:00:00Z"), ("z", "2024-01-10T00:00:00Z"))
    assert sorted(seen) == ["x", "y", "z"]
    _, left = batch("c", ("w", "2024-01-20T00:00:00Z"))
    assert left < 4 and sorted(seen) == ["w", "x", "y", "z"]
