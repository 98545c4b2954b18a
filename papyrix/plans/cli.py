"""Commands: digest, search, dupes, export, serve, stats, links, sources, initsource, initconfig, version, examples."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import durable
from ..operators import digest, documents, dupes, fusion, lexical, stats, timeline
from ..sources import manifests, parsers, store
from . import render, serve

VERSION = "0.2.0"
#: Groups that a table shows; JSON holds all.
TABLE_ROWS = 1000


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="papyrix")
    out.add_argument("--config")
    out.add_argument("--verbose", action="store_true")
    sub = out.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple, positional: str | None = None) -> None:
        p = sub.add_parser(name)
        if positional:
            p.add_argument(positional, nargs="*")
        for flag, kw in options:
            p.add_argument(flag, **kw)

    base, source = ("--digested", {}), ("--source", {})
    add("digest", base, source, ("--force", {"action": "store_true"}))
    add("search", base, source, ("--mode", {}), ("--hits", {"type": int}), ("--json", {"action": "store_true"}), positional="query")
    add("dupes", base, ("--window", {"type": int, "default": dupes.WINDOW_DAYS}), ("--threshold", {"type": float, "default": dupes.THRESHOLD}), ("--json", {"action": "store_true"}))
    add("export", base, ("--format", {"choices": ["json", "html"], "default": "json"}), ("--out", {}))
    add("serve", base, ("--port", {"type": int, "default": 8080}))
    add("stats", base, source, ("--sample", {"type": int, "help": "list so many documents at even steps instead"}))
    add("links", ("--source", {"required": True}), ("--json", {"action": "store_true"}))
    add("sources", base)
    add("initsource", ("--dir", {"default": "."}), ("--name", {}), ("--type", {"default": "text"}))
    add("initconfig", ("--path", {"default": manifests.CONFIG_FILE}))
    add("version")
    add("examples")
    return out


def _tables(spark: SparkSession, base: str, source: str | None = None):
    docs, chunks = store.read(spark, base, "documents"), store.read(spark, base, "chunks")
    if docs is None:
        raise ValueError(f"nothing is digested at {base}")
    if source is not None:
        docs, chunks = docs.filter(F.col("source") == source), chunks.filter(F.col("source") == source)
        if docs.isEmpty():
            raise ValueError(f"no source {source!r} at {base}")
    return docs, chunks


def _search(spark, base, args, config) -> str:
    docs, chunks = _tables(spark, base, args.source)
    query, held = " ".join(args.query), manifests.load_store_manifest(base)
    hashed = held.embed.get("model") == digest.HashEmbedder().name
    # Ranks of hashed vectors say nothing, so they are fused only if asked for.
    mode = fusion.parse_mode(args.mode or ("lexical" if hashed else "hybrid"))
    vectors = asked = None
    if mode != "lexical":
        vectors = store.read(spark, base, "vectors").drop("source").join(chunks.select(F.col("id").alias("chunk_id"), "source", "doc_id", "index"), "chunk_id").select("source", "doc_id", "index", "embedding")
        asked = digest.embedder_of(config.embed).embed([query])[0]
    tables = [store.read(spark, base, name, args.source) for name in ("postings", "terms")]
    found = fusion.search(None if None in tables else lexical.Index(*tables), held.sizes(args.source), vectors, query, asked, mode, args.hits or config.defaults.hits)
    rows = render.search_rows(found, docs, chunks, render.JSON_SNIPPET if args.json else render.TABLE_SNIPPET)
    return render.search_json(query, mode, rows) if args.json else render.search_table(rows)


def _members(spark, base, window=dupes.WINDOW_DAYS, threshold=dupes.THRESHOLD):
    docs, _ = _tables(spark, base)
    order = spark.createDataFrame(list(manifests.load_store_manifest(base).priorities().items()) or [("", 0)], "source string, priority int")
    return docs, dupes.members(docs, order, window, threshold)


def log(verbose: bool) -> None:
    """Messages go to the error stream, so that output stays clean."""
    logging.basicConfig(stream=sys.stderr, format="%(asctime)s %(levelname)s %(message)s", force=True)
    digest.LOG.setLevel(logging.DEBUG if verbose else logging.INFO)


def run(argv: list[str], spark: SparkSession | None = None) -> str:
    """``command`` as one text."""
    return "".join(command(argv, spark))


def command(argv: list[str], spark: SparkSession | None = None) -> str | Iterable[str]:
    """One command; its output as text, or a long one by parts. An explicit option goes before the configuration, and that
    before the default."""
    args = parser().parse_args(argv)
    if args.command == "version":
        return VERSION
    if args.command == "examples":
        return "papyrix initsource --dir posts --type text\npapyrix digest --source posts\npapyrix search --mode lexical a phrase\npapyrix dupes\npapyrix export --format html --out writing.html"
    if args.command == "initsource":
        manifests.write_source_starter(args.dir, args.name or manifests.suggest_name(args.dir), args.type)
        return f"wrote {args.dir}/{manifests.SOURCE_FILE}"
    if args.command == "initconfig":
        manifests.write_config_starter(args.path)
        return f"wrote {args.path}"
    config = manifests.load_config(args.config)
    log(args.verbose or config.defaults.verbose)
    base = getattr(args, "digested", None) or config.defaults.digested
    if args.command == "sources":
        return "\n".join(f"{s['name']}  {s['type']}  {render.comma(s['documents'])} documents" for s in manifests.load_store_manifest(base).sources)
    spark = spark or SparkSession.builder.appName("papyrix").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "digest":
        embedder = digest.embedder_of(config.embed)
        reports = [digest.digest_source(spark, folder, base, embedder, args.force, config.defaults.workers) for folder in manifests.discover(args.source or config.defaults.source)]
        return "\n".join(json.dumps(r) for r in [*reports, digest.totals(reports)])
    if args.command == "search":
        return _search(spark, base, args, config)
    if args.command == "dupes":
        dupes.check_options(args.window, args.threshold)
        docs, members = _members(spark, base, args.window, args.threshold)
        if docs.select("source").distinct().count() < 2:
            raise ValueError("duplicates are looked for between two sources or more")
        found, held = dupes.groups(members), dupes.summary(docs, members).first()
        if args.json:
            return "".join(render.groups_json(held, found))
        return f"{render.comma(held.compared)} documents compared, {render.comma(held.duplicated)} in {render.plural(held.groups, 'group', 'groups')}\n{render.table(found.limit(TABLE_ROWS))}" + (f"\nand {render.comma(held.groups - TABLE_ROWS)} more; --json lists all" if held.groups > TABLE_ROWS else "")
    if args.command == "stats":
        docs, chunks = _tables(spark, base, args.source)
        if args.sample:
            return render.table(documents.even_sample(docs.select("id", "source", "title", "words"), args.sample))
        return "\n\n".join(render.table(t) for t in (stats.by_source(docs, chunks), stats.spread(docs, "words"), stats.years(docs), stats.vocabulary(chunks)))
    if args.command == "links":
        manifest = manifests.load_source(args.source, parsers.types())
        kind = parsers.parser_of(manifest.type)
        if kind.links is None:
            raise ValueError(f"sources of type {manifest.type} list no links")
        shared = durable.Scratch(spark, "links").keep(kind.links(parsers.enumerate_files(spark, args.source, manifest, kind.include, config.defaults.workers).filter("error is null")), "links")
        return "".join(render.links_json(shared)) if args.json else "\n".join(render.links_markdown(shared))
    docs, members = _members(spark, base)
    scratch = durable.Scratch(spark, "timeline")
    entries, copies = scratch.keep(timeline.entries(docs, members), "entries"), scratch.keep(timeline.copies(docs, members), "copies")
    if args.command == "serve":
        for name, lines in (("json", render.timeline_json(entries, copies)), ("html", render.timeline_html(entries, copies))):
            with open(f"{base}/timeline.{name}", "w", encoding="utf-8") as f:
                f.writelines(lines)
        serve.server(f"{base}/timeline.json", f"{base}/timeline.html", args.port).serve_forever()
    lines = render.timeline_json(entries, copies) if args.format == "json" else render.timeline_html(entries, copies)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.writelines(lines)
        return f"wrote {args.out}"
    return lines


def main() -> int:
    try:
        sys.stdout.writelines(command(sys.argv[1:]))
        print()
    except (ValueError, OSError) as e:
        print(f"papyrix: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
