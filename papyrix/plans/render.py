"""Sinks for people and programs: search results, the timeline, links and tables."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import links as link_ops
from ..operators import timeline as line_ops

JSON_SNIPPET, TABLE_SNIPPET, TOP_DOMAINS = 400, 150, 25


def comma(n: int) -> str:
    return f"{n:,}"


def percent(n: int, of: int) -> str:
    return f"{100 * n / of:.0f}%" if of else "0%"


def plural(n: int, one: str, many: str) -> str:
    return f"{comma(n)} {one if n == 1 else many}"


def bar(score: float, top: float, width: int = 10) -> str:
    filled = round(width * score / top) if top > 0 else 0
    return "█" * max(0, min(width, filled)) + "░" * (width - max(0, min(width, filled)))


def search_rows(results: DataFrame, docs: DataFrame, chunks: DataFrame, limit: int = JSON_SNIPPET) -> DataFrame:
    """Results with their document's fields and a snippet of the passage, in order."""
    d = docs.select(F.col("id").alias("doc_id"), "title", "author", "url", "published", "file")
    c = chunks.select("doc_id", "index", F.col("id").alias("chunk_id"), text.snippet(F.col("text"), limit).alias("snippet"))
    return results.join(d, "doc_id").join(c, ["doc_id", "index"]).select("place", "doc_id", "chunk_id", "source", "title", "author", "url", "published", "file", "score", "lexical_rank", "vector_rank", "snippet").orderBy("place")


def search_json(query: str, mode: str, rows: DataFrame) -> str:
    return json.dumps({"query": query, "mode": mode, "results": [r.asDict() for r in rows.collect()]}, default=str, ensure_ascii=False, indent=2)


def search_table(rows: DataFrame) -> str:
    got = rows.collect()
    top = max((r.score for r in got), default=0)
    return "\n".join(f"{r.place:>3} {bar(r.score, top)} [{r.source}] {r.title or r.file}\n      {r.snippet}" for r in got)


#: Characters of output that one row carries to the driver, about.
CHUNK = 1 << 20
_CHUNKS = "first_kind string, first_at timestamp, last_kind string, last_at timestamp, text string"


def _stitch(seam):
    """Rows (kind, published, body) in order to chunks of text, with ``seam`` between two rows; ends are left to who joins chunks."""

    def run(frames):
        for frame in frames:
            first, last, held, size = None, None, [], 0
            for kind, at, body in zip(frame["kind"], frame["published"], frame["body"]):
                now = (kind, None if pd.isna(at) else at)
                held += [seam(last, now), body] if last else [body]
                first, last, size = first or now, now, size + len(body)
                if size >= CHUNK:
                    yield pd.DataFrame([[*first, *last, "".join(held)]], columns=["first_kind", "first_at", "last_kind", "last_at", "text"])
                    first, last, held, size = None, None, [], 0
            if held:
                yield pd.DataFrame([[*first, *last, "".join(held)]], columns=["first_kind", "first_at", "last_kind", "last_at", "text"])

    return run


def _stitched(lines: DataFrame, seam) -> Iterable[str]:
    """The text of ordered ``lines``. Tasks render and join their ranges; the driver passes on chunks of text, one range at a time, and
    puts the seams between them."""
    last = None
    for r in lines.mapInPandas(_stitch(seam), _CHUNKS).toLocalIterator():
        yield seam(last, (r.first_kind, r.first_at)) + r.text
        last = (r.last_kind, r.last_at)
    yield seam(last, None)


def _json_seam(last, now) -> str:
    if last is None:
        return ""
    if now is None:
        return "]}"
    return "]},\n" if now[0] == "entry" else ", " if last[0] == "copy" else ""


def timeline_json(entries: DataFrame, copies: DataFrame) -> Iterable[str]:
    """The timeline as JSON, an entry a line, without gathering it: counts, sources, then entries newest first, each with its copies."""
    counts = line_ops.counts(entries).first().asDict()
    sources = [r.asDict() for r in line_ops.counts_by_source(entries).collect()]  # a row a source
    yield json.dumps({"counts": counts | {"documents": counts["entries"] + counts["folded"]}, "sources": sources}, ensure_ascii=False)[:-1] + ', "entries": ['
    open_entry = F.concat(F.regexp_replace(F.to_json(F.struct(*[c for c in entries.columns if c != "copies"])), r"\}$", ""), F.lit(', "copies": ['))
    yield from _stitched(line_ops.lines(entries, copies, open_entry, F.to_json(F.struct(*[c for c in copies.columns if c != "winner_id"]))), _json_seam)
    yield "]}"


def _filters(sources: list[dict]) -> str:
    """Boxes whose state hides entries by style alone: one a source and a length, and one for quotations."""
    boxes = [(f"s{i}", f"{r['source']} ({comma(r['entries'])})", f".s{i}") for i, r in enumerate(sources)] + [(n, n, f".{n}") for n in ("short", "medium", "long")] + [("quote", "quotations", ".quote"), ("plain", "other texts", ".plain")]
    style = "".join(f"#{box}:not(:checked)~main {which}{{display:none}}" for box, _, which in boxes)
    return f"<style>{style}</style>" + "".join(f"<input type=checkbox checked id={box}><label for={box}>{html.escape(name)}</label>" for box, name, _ in boxes)


def _html_seam(last, now) -> str:
    """Ends of the row before, and the year and month where they change; undated entries come first."""
    out = "" if last is None else "</p></article>" if last[0] == "copy" else "</article>"
    if now is None:
        return out
    if now[0] == "copy":
        return ", " if last and last[0] == "copy" else "<p class=copies>also in "
    month = lambda at: (at.year, at.month) if at is not None else ("Undated", None)
    (y, m), (last_y, last_m) = month(now[1]), month(last[1]) if last else (None, None)
    if y != last_y:
        out += f"<h2>{y}</h2>"
    return out + (f"<h3>{now[1]:%B}</h3>" if m and (y, m) != (last_y, last_m) else "")


def _escaped(column) -> F.Column:
    """Text for HTML: the five characters that markup uses."""
    out = F.coalesce(column, F.lit(""))
    for raw, sign in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(sign))
    return out


def timeline_html(entries: DataFrame, copies: DataFrame, title: str = "Writing") -> Iterable[str]:
    """A page on its own: undated entries first, then years and months, newest first; sources, lengths and quotations are
    filtered by style alone."""
    sources = [r.asDict() for r in line_ops.counts_by_source(entries).collect()]  # a row a source
    counts = line_ops.counts(entries).first()
    place = F.create_map(*[F.lit(x) for i, r in enumerate(sources) for x in (r["source"], f"s{i}")]) if sources else F.create_map(F.lit(""), F.lit(""))
    yield f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>body{{font:16px serif;max-width:40em;margin:auto}}.copies{{color:#666}}</style><h1>{html.escape(title)}</h1>"
    yield f"<p>{plural(counts.entries, 'entry', 'entries')}, {plural(counts.folded, 'copy', 'copies')} folded away</p>{_filters(sources)}<main>"
    classes = F.concat_ws(" ", place[F.col("source")], "length", F.when(F.col("quote"), "quote").otherwise("plain"))
    entry = F.concat(F.lit("<article class='"), classes, F.lit("'><h4>"), _escaped(F.col("title")), F.lit("</h4><p>"), _escaped(text.preview(F.col("text"))), F.lit("</p>"))
    yield from _stitched(line_ops.lines(entries, copies, entry, _escaped(F.col("source")), undated_last=False), _html_seam)
    yield "</main>"


def links_markdown(links: DataFrame) -> Iterable[str]:
    """All extracted links: how many and over what time, the domains shared most, then shares newest first under years."""
    shares, held = link_ops.unique_shares(links), link_ops.summary(links).first()
    span = f" from {held.earliest:%Y-%m-%d} to {held.latest:%Y-%m-%d}" if held.earliest else ""
    yield f"# Links\n\n{plural(held.links, 'link', 'links')} to {plural(held.unique, 'page', 'pages')}{span}; {comma(held.dropped)} unusable\n\n## Domains\n"
    for r in link_ops.domains(shares).limit(TOP_DOMAINS).collect():
        yield f"- {r.domain}: {comma(r['count'])} ({percent(r['count'], held.links)})"
    year = None
    for r in link_ops.newest_first(shares).toLocalIterator():
        y = r.published.year if r.published else "Undated"
        if y != year:
            yield f"\n## {y}\n"
            year = y
        yield f"- [{(r.title or r.url).replace('[', '(').replace(']', ')')}]({r.url})" + "".join(f"\n  > {line}" for line in (r.comment or "").splitlines())


def links_json(links: DataFrame) -> Iterable[str]:
    """The same as JSON, a share a line."""
    held = link_ops.summary(links).first().asDict()
    domains = [r.asDict() for r in link_ops.domains(link_ops.unique_shares(links)).limit(TOP_DOMAINS).collect()]
    yield json.dumps(held | {"domains": domains}, default=str, ensure_ascii=False)[:-1] + ', "shares": ['
    first = True
    for r in link_ops.newest_first(link_ops.unique_shares(links)).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        yield ("\n" if first else ",\n") + r.j
        first = False
    yield "]}"


def groups_json(held, groups: DataFrame) -> Iterable[str]:
    """Duplicate groups as JSON, a group a line, after the counts."""
    yield json.dumps(held.asDict())[:-1] + ', "found": ['
    first = True
    for r in groups.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        yield ("\n" if first else ",\n") + r.j
        first = False
    yield "]}"


def table(rows: DataFrame) -> str:
    """A small report as aligned text."""
    got = [rows.columns, *[["" if v is None else comma(v) if isinstance(v, int) and not isinstance(v, bool) else str(v) for v in r] for r in rows.collect()]]
    width = [max(len(x[i]) for x in got) for i in range(len(rows.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in got)
