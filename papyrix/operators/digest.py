"""The write path: parse, build, chunk, embed or reuse, index, store, report."""

from __future__ import annotations

import hashlib
import json
import logging
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import replace
from datetime import UTC, datetime
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import durable
from ..functions import chunk, text
from ..sources import manifests, parsers, store
from . import documents, lexical, vector

LOG = logging.getLogger("papyrix")
#: Texts handed to an embedder at a time, batches that are out at once, and texts after which vectors are put in safety.
BATCH, AT_ONCE, WAVE = 16, 8, 20_000
#: How often a batch is tried, and seconds before the second try; later pauses double.
TRIES, PAUSE = 5, 0.5
#: Errors of a source that a report names; all are counted.
NAMED_ERRORS = 1000
#: Tasks that read a source's files at least, unless the configuration says otherwise.
WORKERS = 8
#: A source is quiet when this share of its records (or files) held no text.
QUIET = 0.8


class Embedder(Protocol):
    name: str
    dimensions: int
    digest: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors from hashes of the text; for tests and for machines without a model. Like texts are no nearer."""

    digest = ""

    def __init__(self, dimensions: int = 64):
        self.name, self.dimensions = "hash-embedder", dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = b"".join(hashlib.sha256(f"{i}:{t}".encode()).digest() for i in range(-(-self.dimensions // 32)))
            out.append([b / 128 - 1 for b in raw[: self.dimensions]])
        return out


class HttpEmbedder:
    """A local embedding server: GET api/tags lists its models, POST api/embed embeds a list of texts in order."""

    #: Seconds that a cold model may take.
    TIMEOUT = 300

    def __init__(self, base_url: str, model: str):
        self.base_url = base_url.rstrip("/")
        served = {m["name"]: m.get("digest", "") for m in self._ask("api/tags").get("models", [])}
        named = next((n for n in (model, f"{model}:latest") if n in served), None)
        if named is None:
            raise ValueError(f"{self.base_url} serves no model {model!r}, but {', '.join(sorted(served)) or 'none'}")
        self.name, self.digest = model, served[named]
        self.dimensions = len(self.embed(["probe"])[0])

    def _ask(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        asked = urllib.request.Request(f"{self.base_url}/{path}", data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(asked, timeout=self.TIMEOUT) as got:
            return json.load(got)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._ask("api/embed", {"model": self.name, "input": texts})["embeddings"]


def embedder_of(config: manifests.EmbedConfig) -> Embedder:
    """The configured embedder; there is no fallback from a server that fails."""
    return HttpEmbedder(config.base_url, config.model) if config.base_url else HashEmbedder()


def _tried(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    """The vectors of a batch, asked for again after growing pauses where the embedder cannot be reached."""
    for n in range(TRIES):
        try:
            return embedder.embed(texts)
        except OSError:
            if n + 1 == TRIES:
                raise
            time.sleep(PAUSE * 2**n)
    return []


def _embed(embedder: Embedder):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, rows = frame["indexed"].tolist(), []
            for at in range(0, len(texts), BATCH):
                got = _tried(embedder, texts[at : at + BATCH])
                if len(got) != len(texts[at : at + BATCH]) or any(len(v) != embedder.dimensions for v in got):
                    raise ValueError("the embedder gave vectors of the wrong number or width")
                rows += got
            yield pd.DataFrame({"embed_key": frame["embed_key"], "embedding": rows})

    return run


def _held(spark: SparkSession, safe: str | None) -> DataFrame | None:
    """The vectors of a folder of waves, if any wave was written whole."""
    if safe is None:
        return None
    fs, folder = durable.file_system(spark, safe)
    return spark.read.schema("embed_key string, embedding array<float>").parquet(safe) if fs.exists(folder) and any(f.getPath().getName().startswith("part-") for f in fs.listStatus(folder)) else None


def embed_chunks(docs: DataFrame, chunks: DataFrame, stored: DataFrame | None, embedder: Embedder, safe: str | None = None) -> DataFrame:
    """Vectors of ``chunks``: those stored under the same indexed text are reused, each other text is embedded once.

    Texts are embedded in the order of passages, BATCH at a time, by AT_ONCE tasks. With ``safe``, a folder, they go in waves whose
    vectors are written there as they come, so that one who tries again after a failure embeds only what is left.
    """
    titles = docs.select(F.col("id").alias("doc_id"), "title")
    rows = chunks.join(titles, "doc_id", "left").select(F.col("id").alias("chunk_id"), text.indexed_text(F.coalesce("title", F.lit("")), F.col("text")).alias("indexed"))
    rows = rows.withColumn("embed_key", text.content_hash(F.col("indexed")))
    parts = [t.select("embed_key", "embedding") for t in (stored, _held(chunks.sparkSession, safe)) if t is not None]
    known = parts[0] if parts else None
    for more in parts[1:]:
        known = known.unionByName(more)
    known = None if known is None else known.dropDuplicates(["embed_key"])
    todo = rows.groupBy("embed_key").agg(F.min("chunk_id").alias("first"), F.min("indexed").alias("indexed"))  # alike under one key
    todo = todo if known is None else todo.join(known.select("embed_key"), "embed_key", "left_anti")

    def vectors(some: DataFrame) -> DataFrame:
        ordered = some.repartitionByRange(AT_ONCE, "first").sortWithinPartitions("first").select("embed_key", "indexed")
        made = ordered.mapInPandas(_embed(embedder), "embed_key string, embedding array<double>")
        return made.select("embed_key", vector.unit(F.col("embedding").cast("array<float>")).alias("embedding"))

    if safe is None:
        made = vectors(todo)
    else:
        todo = durable.Scratch(chunks.sparkSession, "todo").keep(todo, "texts")
        waves = -(-todo.count() // WAVE)
        for wave in range(waves):
            vectors(todo.filter(F.pmod(F.xxhash64("embed_key"), F.lit(waves)) == wave)).write.mode("append").parquet(safe)
        made = _held(chunks.sparkSession, safe)
        made = None if made is None else made.dropDuplicates(["embed_key"])
        made = made if made is None or stored is None else made.join(stored.select("embed_key").distinct(), "embed_key", "left_anti")
        known = None if stored is None else stored.select("embed_key", "embedding").dropDuplicates(["embed_key"])
    every = known if made is None else made if known is None else made.unionByName(known)
    if every is None:  # no passage at all
        return rows.select("chunk_id", "embed_key", F.lit(None).cast("array<float>").alias("embedding"))
    return rows.select("chunk_id", "embed_key").join(every, "embed_key").select("chunk_id", "embed_key", "embedding")


def passages(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """What retrievers see: (source, doc_id, index, indexed) of ``chunks``, with their document's title."""
    titles = docs.select(F.col("id").alias("doc_id"), "title")
    return chunks.join(titles, "doc_id", "left").select("source", "doc_id", "index", text.indexed_text(F.coalesce("title", F.lit("")), F.col("text")).alias("indexed"))


def write_version(spark: SparkSession, base: str, source: str, version: int, docs: DataFrame, old: DataFrame | None, embedder: Embedder, scratch: durable.Scratch) -> dict[str, DataFrame]:
    """Write all tables that follow from stored ``docs`` as a version of ``source``; vectors of texts in ``old`` are reused."""
    pieces = scratch.keep(chunk.chunks(docs), "chunks")
    safe = f"{base.rstrip('/')}/_embedding/{source}-{hashlib.sha256(f'{embedder.name} {embedder.digest} {embedder.dimensions}'.encode()).hexdigest()[:12]}"
    vectors = embed_chunks(docs, pieces, old, embedder, safe)
    index = lexical.build_index(passages(docs, pieces), scratch)
    kept = store.write(spark, base, source, version, documents=docs, chunks=pieces, vectors=vectors, postings=index.blocks, terms=index.terms)
    store.check(kept["chunks"], kept["vectors"])
    durable.delete(spark, safe)
    return kept


def counts_of(kept: dict[str, DataFrame]) -> tuple[int, int, int]:
    """Documents, passages and tokens of a version."""
    return kept["documents"].count(), kept["chunks"].count(), kept["terms"].agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("n")).first().n


def append_batch(spark: SparkSession, base: str, source: str, made: DataFrame, stream: str, number: int, embedder: Embedder | None = None) -> bool:
    """Add the documents of a micro-batch to ``source`` as a version beside those that count: documents, passages, vectors, postings.

    A batch that is committed already, as after a restart, changes nothing and gives False; so does one without documents. Either
    way all of it is read, for the stream's own state is written as its rows are.
    """
    embedder, scratch = embedder or HashEmbedder(), durable.Scratch(spark, "stream")
    made = scratch.keep(made, "batch")
    held = manifests.load_store_manifest(base)
    before = next(iter(held.entries(source)), manifests.StoredSource(source, "text"))
    if before.stream == stream and before.batch >= number or made.isEmpty():
        return False
    held.check_chunking(chunk.TARGET, chunk.LONGEST, chunk.SHORTEST)
    held.check_embed(embedder.name, embedder.dimensions, embedder.digest)
    version = store.claim(spark, base, source, held.version_of(source))
    docs = scratch.keep(documents.unique_ids(made), "documents")
    n, chunks, tokens = counts_of(write_version(spark, base, source, version, docs, store.read(spark, base, "vectors", source), embedder, scratch))
    added = dict(documents=before.documents + n, chunks=before.chunks + chunks, tokens=before.tokens + tokens, digested_at=datetime.now(UTC).isoformat(timespec="seconds"), stream=stream, batch=number)
    added |= dict(segments=[*before.segments, version]) if before.version else dict(version=version)
    manifests.commit_source(base, held, replace(before, **added))
    return True


def compact(spark: SparkSession, base: str, source: str, embedder: Embedder | None = None) -> None:
    """Write the versions that make up ``source`` as one, embedding nothing anew; of an id in several of them one document stays."""
    held = manifests.load_store_manifest(base)
    (before,) = held.entries(source)
    scratch, version = durable.Scratch(spark, "compact"), store.claim(spark, base, source, held.version_of(source))
    docs = scratch.keep(documents.unique_ids(store.read(spark, base, "documents", source)), "documents")
    n, chunks, tokens = counts_of(write_version(spark, base, source, version, docs, store.read(spark, base, "vectors", source), embedder or HashEmbedder(), scratch))
    manifests.commit_source(base, held, replace(before, documents=n, chunks=chunks, tokens=tokens, version=version, segments=[]))
    store.remove_older(spark, base, source, version)


def digest_source(spark: SparkSession, folder: str, base: str, embedder: Embedder | None = None, force: bool = False, workers: int = 0, keep: bool = False) -> dict:
    """Digest one source folder into the store at ``base`` and return its report. With ``keep`` the versions before stay readable."""
    embedder = embedder or HashEmbedder()
    manifest = manifests.load_source(folder, parsers.types())
    held = manifests.load_store_manifest(base)
    held.check_chunking(chunk.TARGET, chunk.LONGEST, chunk.SHORTEST)
    held.check_embed(embedder.name, embedder.dimensions, embedder.digest)
    scratch, version = durable.Scratch(spark, "digest"), store.claim(spark, base, manifest.name, held.version_of(manifest.name))
    raw, files = parsers.parse_source(spark, folder, manifest, workers or WORKERS)
    raw = scratch.keep(raw, "raw")
    built = scratch.keep(documents.build(raw.filter("error is null"), manifest.name, manifest.type, manifest.author), "built")
    docs = scratch.keep(documents.unique_ids(built), "documents")
    old = None if force else store.read(spark, base, "vectors", manifest.name)
    kept = write_version(spark, base, manifest.name, version, docs, old, embedder, scratch)
    n = files.agg(F.count("*").alias("walked"), F.count_if("too_large").alias("large")).first()
    parsed = raw.agg(F.countDistinct("file").alias("parsed"), F.count_if(F.col("error").isNull()).alias("seen"), F.count_if(F.col("error").isNull() & (text.tidy(F.coalesce("text", F.lit(""))) == "")).alias("blank")).first()
    failed = raw.filter("error is not null").select("error").distinct()
    n_errors, errors = failed.count(), [r.error for r in failed.orderBy("error").limit(NAMED_ERRORS).collect()]
    stored, total, tokens = counts_of(kept)
    keys = kept["vectors"].select("embed_key").distinct()
    reused = 0 if old is None else keys.join(old.select("embed_key").distinct(), "embed_key", "left_semi").count()
    report = {"source": manifest.name, "walked": n.walked, "parsed": parsed.parsed, "too_large": n.large, "documents": stored, "chunks": total, "texts": keys.count(), "reused": reused, "duplicates": built.count() - stored, "records_seen": parsed.seen, "records_empty": parsed.blank, "errors": errors, "n_errors": n_errors}
    report["embedded"] = report["texts"] - reused
    report["quiet"] = is_quiet(parsed.seen, parsed.blank)
    if report["quiet"]:
        LOG.warning("%s: %d of %d records held no text; is its type right?", manifest.name, parsed.blank, parsed.seen)
    for error in errors:
        LOG.warning("%s: %s", manifest.name, error)
    if n_errors > len(errors):
        LOG.warning("%s: and %d more errors", manifest.name, n_errors - len(errors))
    manifests.commit_source(base, held, manifests.StoredSource(manifest.name, manifest.type, manifest.priority, stored, total, folder, datetime.now(UTC).isoformat(timespec="seconds"), version, tokens))
    if not keep:
        store.remove_older(spark, base, manifest.name, version)
    return report


def totals(reports: list[dict]) -> dict:
    """The sums of several sources' reports, and how many of their files or records failed."""
    out = {k: sum(r[k] for r in reports) for k in ("walked", "parsed", "too_large", "documents", "chunks", "texts", "embedded", "reused", "duplicates", "records_seen", "records_empty")}
    return {"sources": len(reports)} | out | {"errors": sum(r["n_errors"] for r in reports), "quiet": [r["source"] for r in reports if r["quiet"]]}


def is_quiet(seen: int, empty: int) -> bool:
    return seen > 0 and empty / seen >= QUIET
