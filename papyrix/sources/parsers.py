"""Parsers of the six export formats: files of a source to raw documents, links and per-file errors."""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..durable import Scratch
from ..functions import html, text
from . import files as exports
from .manifests import SourceManifest
from .matcher import NOISE, Matcher

#: Larger files are an error of their own, found before their bytes are read.
LARGEST_FILE = 64 << 20
#: Columns of raw documents.
RAW = ["file", "native_key", "title", "author", "url", "published", "text"]


@dataclass(frozen=True)
class Parser:
    include: tuple[str, ...]
    parse: Callable[[SparkSession, str, DataFrame, SourceManifest], DataFrame]
    links: Callable[[DataFrame], DataFrame] | None = None


def enumerate_files(spark: SparkSession, folder: str, manifest: SourceManifest, include: tuple[str, ...], workers: int = 1) -> DataFrame:
    """Rows (file, length, content, error) of the files a source holds: included, not excluded, in no excluded folder.

    Files are listed and read on the executors, once: contents go to the shared folder, so that parsers and reports see the same
    bytes. A file above LARGEST_FILE is not read, and one that cannot be read costs no other: either has an error instead. A store
    that only Spark reaches is left to Spark's own reader, whose driver holds the paths.
    """
    scratch, wanted = Scratch(spark, "files"), list(manifest.include or include)
    if not exports.reachable(folder):
        return scratch.keep(_through_spark(spark, folder, manifest, wanted), "contents")
    listed = scratch.keep(exports.listing(spark, folder, [*manifest.exclude, *NOISE], wanted), "listing")
    return scratch.keep(exports.contents(listed, folder, LARGEST_FILE, workers), "contents")


def _through_spark(spark: SparkSession, folder: str, manifest: SourceManifest, wanted: list[str]) -> DataFrame:
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    bare = lambda p: F.regexp_replace(p, "^[a-z0-9]+:/*(?=/)", "")
    root = re.sub("^[a-z0-9]+:/*(?=/)", "", folder).rstrip("/")
    rel = F.regexp_replace(bare(F.col("path")), "^\\Q" + root + "\\E/", "")
    out, some, path = manifest.matcher(), Matcher(wanted), F.col("file")
    listed = listed.select("path", rel.alias("file"), "length").filter(some.file_column(path) & ~out.file_column(path) & ~out.inside_excluded(path) & (path != exports.SETTINGS))
    paths = [r.path for r in listed.filter(F.col("length") <= LARGEST_FILE).select("path").toLocalIterator()]
    if not paths:
        read = spark.createDataFrame([], "path string, content binary")
    else:
        escaped = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in sorted(paths)]
        read = spark.read.format("binaryFile").option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(escaped).select("path", "content")
    why = F.when(F.col("length") > LARGEST_FILE, F.concat("file", F.lit(" is too large"))).when(F.col("content").isNull(), F.concat("file", F.lit(" cannot be read")))
    return listed.join(read, "path", "left").select("file", "length", "content", why.alias("error"))


def _utf8(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def parse_text(spark, folder, files: DataFrame, manifest) -> DataFrame:
    """Plain text and Markdown: a first line "# ..." is the title."""
    body = F.regexp_replace(_utf8(F.col("content")), r"\A[\r\n \t]+|[\r\n \t]+\z", "")
    first = F.regexp_extract(body, r"\A# ([^\n]*)", 1)
    rest = F.regexp_replace(body, r"\A# [^\n]*\n?", "")
    titled = body.startswith("# ") & (F.trim(first) != "")
    return files.select(
        "file", F.col("file").alias("native_key"), F.when(titled, F.trim(first)).otherwise(text.filename_title(F.col("file"))).alias("title"), F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("timestamp").alias("published"), F.when(titled, rest).otherwise(body).alias("text"), F.lit(None).cast("string").alias("error"),
    )


_PAGE = "struct<title:string,author:string,url:string,dates:array<string>,text:string>"


def _page(markup: pd.Series) -> pd.DataFrame:
    rows = []
    for m in markup:
        root = html.parse(m or "")
        rows.append({**html.metadata(root), "text": html.raw_text(html.content(root))})
    return pd.DataFrame(rows, columns=["title", "author", "url", "dates", "text"])


def page_struct(markup: Column, ended: bool = False) -> Column:
    """Metadata and raw content text of a page; its date is the first that a known layout fits.

    HTML reads some references also without the semicolon at their end; with ``ended`` those stay as they are written."""
    page = F.pandas_udf(_page, _PAGE)(F.regexp_replace(markup, r"&(?!#?\w+;)", "&amp;") if ended else markup)
    dates = F.filter(F.transform(page["dates"], text.strict_timestamp), lambda d: d.isNotNull())
    return F.struct(page["title"].alias("title"), page["author"].alias("author"), page["url"].alias("url"), F.get(dates, F.lit(0)).alias("published"), page["text"].alias("text"))


def parse_html(spark, folder, files: DataFrame, manifest) -> DataFrame:
    got = files.withColumn("p", page_struct(_utf8(F.col("content"))))
    title = F.coalesce(F.nullif(F.col("p.title"), F.lit("")), text.filename_title(F.col("file")))
    return got.select("file", F.col("file").alias("native_key"), title.alias("title"), F.nullif(F.col("p.author"), F.lit("")).alias("author"), "p.url", "p.published", "p.text", F.lit(None).cast("string").alias("error"))


def _is_site_date(line: str) -> bool:
    from datetime import datetime

    for layout in ("%m.%d.%Y", "%m-%d-%Y"):
        try:
            return bool(datetime.strptime(line.strip(), layout))
        except ValueError:
            continue
    return False


def _site(markup: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([html.site_page(m or "", _is_site_date) for m in markup], columns=["title", "date_line", "text"])


def parse_htmlsite(spark, folder, files: DataFrame, manifest) -> DataFrame:
    """A hand-built site: dates from file names, else from the second heading."""
    got = files.withColumn("p", F.pandas_udf(_site, "struct<title:string,date_line:string,text:string>")(_utf8(F.col("content"))))
    day = F.coalesce(text.filename_date(F.col("file")), text.heading_date(F.col("p.date_line")))
    title = F.coalesce(F.nullif(F.col("p.title"), F.lit("")), text.slug_title(F.col("file")))
    none = F.lit(None).cast("string")
    return got.select("file", F.col("file").alias("native_key"), title.alias("title"), none.alias("author"), none.alias("url"), day.cast("timestamp").alias("published"), "p.text", none.alias("error"))


def post_records(files: DataFrame) -> DataFrame:
    """Records of a posts export: (file, r). A file that is not such JSON yields one row with a null record."""
    return files.select("file", F.explode_outer(F.from_json(_utf8(F.col("content")), schemas.POSTS)).alias("r"))


def post_text(record: Column) -> Column:
    """Distinct non-empty posts and captions in order, each repaired, joined by blank lines."""
    empty = F.array().cast("array<string>")
    posts = F.coalesce(F.transform(record["data"], lambda d: d["post"]), empty)
    media = F.flatten(F.coalesce(F.transform(record["attachments"], lambda a: F.coalesce(F.transform(a["data"], lambda d: d["media"]["description"]), empty)), F.array(empty)))
    parts = F.transform(F.concat(posts, media), lambda t: text.repair_mojibake(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\A\s+|\s+\z", "")))
    return F.array_join(F.array_distinct(F.filter(parts, lambda t: t != "")), "\n\n")


def parse_posts(spark, folder, files: DataFrame, manifest) -> DataFrame:
    """A JSON posts export: no titles; the key is the time and a hash of the text."""
    got = post_records(files).withColumn("text", post_text(F.col("r")))
    key = F.concat(F.col("r.timestamp").cast("string"), F.lit(":"), F.substring(text.content_hash(text.normalise(F.col("text"))), 1, 12))
    none = F.lit(None).cast("string")
    error = F.when(F.col("r").isNull(), F.concat(F.lit("posts: "), "file", F.lit(" holds no records")))
    return got.select("file", key.alias("native_key"), F.lit("").alias("title"), none.alias("author"), none.alias("url"), F.timestamp_seconds("r.timestamp").alias("published"), "text", error.alias("error"))


def post_links(files: DataFrame) -> DataFrame:
    """Shared links of a posts export, textless records included: url, title, comment, published, file."""
    rec = post_records(files)
    posts = F.filter(F.transform("r.data", lambda d: F.regexp_replace(F.coalesce(d["post"], F.lit("")), r"(?U)\A\s+|\s+\z", "")), lambda t: t != "")
    rows = rec.select("file", F.timestamp_seconds("r.timestamp").alias("published"), text.repair_mojibake(F.try_element_at(posts, F.lit(1))).alias("comment"), F.explode("r.attachments").alias("a"))
    rows = rows.select("file", "published", "comment", F.explode("a.data.external_context").alias("c"))
    return rows.select(F.trim("c.url").alias("url"), text.repair_mojibake(F.trim("c.name")).alias("title"), "comment", "published", "file").filter("coalesce(url, '') <> ''")


def read_csv(spark: SparkSession, path, required: list[str]) -> DataFrame:
    """A CSV table of strings with quoted line feeds; its header must have the required columns, by trimmed name."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    rows = rows.toDF(*[c.strip().removeprefix("\ufeff") for c in rows.columns])
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path}: missing column {', '.join(missing)}")
    return rows.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in rows.columns])


def parse_newsletter(spark, folder, files: DataFrame, manifest) -> DataFrame:
    """Post bodies beside a table of posts: drafts are left out, bodies without a row are errors, subtitles lead the text."""
    posts = read_csv(spark, os.path.join(folder, "posts.csv"), ["post_id", "post_date", "is_published", "title", "subtitle"])
    posts = posts.withColumn("at", F.monotonically_increasing_id()).filter("post_id <> ''")
    last = posts.groupBy("post_id").agg(F.max_by(F.struct("title", "subtitle", "post_date", "is_published"), "at").alias("m"))
    got = files.withColumn("post_id", F.regexp_replace(text.base_name(F.col("file")), r"\.[^.]*\z", "")).join(last, "post_id", "left")
    got = got.filter("m is null or m.is_published <> 'false'").withColumn("p", page_struct(_utf8(F.col("content"))))
    body = text.normalise(F.col("p.text"))
    whole = F.when((F.col("m.subtitle") != "") & (body != ""), F.concat("m.subtitle", F.lit("\n\n"), body)).otherwise(body)
    slug = text.squeeze(F.translate(F.regexp_replace("post_id", r"^\d+\.", ""), "_-", "  "))
    none = F.lit(None).cast("string")
    error = F.when(F.col("m").isNull(), F.concat(F.lit("newsletter: "), "file", F.lit(" has no row in posts.csv")))
    return got.select("file", F.col("post_id").alias("native_key"), F.coalesce(F.nullif(F.col("m.title"), F.lit("")), slug).alias("title"), none.alias("author"), none.alias("url"), text.strict_timestamp(F.col("m.post_date")).alias("published"), whole.alias("text"), error.alias("error"))


#: Columns of a book library's table.
REVIEW_COLUMNS = ["Book Id", "Title", "Author", "My Rating", "My Review", "Date Read"]
#: Fixed value: the date of a review without one.
UNDATED_REVIEW = "2012-01-01"
_REVIEWS = "file string, book string, title string, author string, rating string, review string, read string, error string"


def _reviews(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with a review of each library table; a table that cannot be used is one row with the error."""
    names = ["file", "book", "title", "author", "rating", "review", "read", "error"]
    for frame in frames:
        rows = []
        for file, content in zip(frame["file"], frame["content"]):
            table = csv.DictReader(io.StringIO(bytes(content).decode("utf-8-sig", "replace"), newline=""))
            heads = {(h or "").strip(): h for h in table.fieldnames or []}
            if missing := [c for c in REVIEW_COLUMNS if c not in heads]:
                rows.append([file, *[None] * 6, f"reviews: {file}: missing column {', '.join(missing)}"])
                continue
            got = [[file, *[(r[heads[c]] or "").strip() for c in ("Book Id", "Title", "Author", "My Rating", "My Review", "Date Read")], None] for r in table]
            got = [r for r in got if r[5]]
            if any(not r[1] for r in got):
                got = [[file, *[None] * 6, f"reviews: {file} has a review with no Book Id"]]
            rows += got
        yield pd.DataFrame(rows, columns=names)


def parse_reviews(spark, folder, files: DataFrame, manifest) -> DataFrame:
    """A book-library table: reviews only; a table without a needed column, or with a review without an id, is an error of its
    own; undated reviews count as 2012-01-01."""
    rows = files.select("file", "content").mapInPandas(_reviews, _REVIEWS)
    page, none = page_struct(F.col("review")), F.lit(None).cast("string")
    read = F.coalesce(text.strict_timestamp(F.col("read")), F.lit(UNDATED_REVIEW).cast("timestamp"))
    return rows.select("file", F.col("book").alias("native_key"), text.review_title(F.col("title"), F.col("author"), F.col("rating")).alias("title"), none.alias("author"), none.alias("url"), read.alias("published"), page["text"].alias("text"), "error")


#: Source types by name, and the files that each reads.
PARSERS: dict[str, Parser] = {
    "text": Parser(("*.txt", "*.md", "*.markdown"), parse_text),
    "html": Parser(("*.html", "*.htm", "*.xhtml"), parse_html),
    "htmlsite": Parser(("*.html", "*.htm"), parse_htmlsite),
    "facebook": Parser(("your_posts*.json",), parse_posts, post_links),
    "substack": Parser(("posts/*.html",), parse_newsletter),
    "goodreads": Parser(("goodreads_library_export*.csv",), parse_reviews),
}


def types() -> list[str]:
    return sorted(PARSERS)


def parser_of(kind: str) -> Parser:
    if kind not in PARSERS:
        raise ValueError(f"unknown source type {kind!r}: one of {', '.join(types())}")
    return PARSERS[kind]


def parse_source(spark: SparkSession, folder: str, manifest: SourceManifest, workers: int = 1) -> tuple[DataFrame, DataFrame]:
    """Raw documents (RAW columns and error) of a source, and its files (file, length, too_large). A file that was not read, being
    above the ceiling or unreadable, gives an error of its own."""
    parser = parser_of(manifest.type)
    found = enumerate_files(spark, folder, manifest, parser.include, workers)
    none = F.lit(None).cast("string")
    lost = found.filter("error is not null").select("file", none.alias("native_key"), none.alias("title"), none.alias("author"), none.alias("url"), F.lit(None).cast("timestamp").alias("published"), none.alias("text"), F.concat(F.lit(f"{manifest.type}: "), "error").alias("error"))
    read = found.filter("error is null").select("file", "length", "content")
    return parser.parse(spark, folder, read, manifest).unionByName(lost), found.select("file", "length", (F.col("length") > LARGEST_FILE).alias("too_large"))
