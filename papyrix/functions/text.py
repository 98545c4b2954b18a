"""Text, identity and formatting rules as Catalyst expressions. Columns in, columns out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body's own lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tidy(text: Column) -> Column:
    """Line ends, zero-width characters, other spaces, blank-line runs and outer blanks put in order; no composition."""
    x = F.regexp_replace(text, "\r\n?", "\n")
    x = F.regexp_replace(x, "[\u200b\u200c\u200d\ufeff]", "")
    x = F.regexp_replace(x, r"(?U)[\s&&[^\n]]", " ")
    x = F.regexp_replace(x, " +(?=\n|\\z)", "")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return F.regexp_replace(x, r"\A[\n ]+|[\n ]+\z", "")


def normalise(text: Column) -> Column:
    """NFC (only where a character beyond ASCII makes it matter), then ``tidy``."""
    return tidy(F.when(text.rlike(r"[^\x00-\x7F]"), F.pandas_udf(_nfc, "string")(text)).otherwise(text))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def document_id(source: Column, native_key: Column, text: Column) -> Column:
    """16 hex digits of source and key; without a key the content's hash stands in."""
    key = F.when(F.coalesce(native_key, F.lit("")) != "", native_key).otherwise(F.concat(F.lit("sha256:"), content_hash(text)))
    return F.substring(F.sha2(F.concat(source, F.lit("\0"), key).cast("binary"), 256), 1, 16)


def word_count(text: Column) -> Column:
    """Words of a normalised text, in which only spaces and line feeds are left as white space."""
    return F.size(F.filter(F.split(text, "[ \n]+"), lambda w: w != ""))


def lowered(text: Column) -> Column:
    """Lower case character by character: a final sigma and a dotted I are not special."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def search_tokens(text: Column) -> Column:
    """Tokens of retrieval: runs of letters and decimal digits, apostrophes dropped."""
    return F.regexp_extract_all(lowered(F.regexp_replace(text, "['\u2019]", "")), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def shingle_words(text: Column) -> Column:
    """Words of duplicate detection: typographic quotes, dashes and no-break spaces folded, apostrophes kept. Zero-width characters
    are dropped, so a text has the same words before ``tidy`` as after it, which changes white space besides."""
    folded = F.translate(text, "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0\u200b\u200c\u200d\ufeff", "''\"\"-- ")
    return F.regexp_extract_all(lowered(folded), F.lit(r"[\p{L}\p{Nd}']+"), F.lit(0))


def shingles(words: Column, size: int = 5) -> Column:
    """The set of runs of ``size`` words; all words as one if there are fewer, nothing if there are none."""

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    return let(words, of)


def shingle_hashes(words: Column, size: int = 5) -> Column:
    """``shingles`` as 64-bit hashes, made from those of the words."""

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, F.array(F.xxhash64(w))).otherwise(F.array_distinct(runs))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def indexed_text(title: Column, text: Column) -> Column:
    """What retrievers see of a passage: the title before it, where there is one."""
    return F.when(F.coalesce(title, F.lit("")) == "", text).otherwise(F.concat(title, F.lit("\n\n"), text))


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, put right; anything else as it was."""
    latin = text.rlike(r"\A[\x{00}-\x{FF}]*\z") & text.rlike(r"[\x{80}-\x{FF}]")
    raw = F.encode(F.when(latin, text), "ISO-8859-1")
    return F.when(latin & F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of the squeezed text, cut back to a space of the last twenty and marked with dots."""
    flat = squeeze(text)
    # A cut within a character leaves the replacement character there.
    short = F.make_valid_utf8(F.substring(flat.cast("binary"), 1, limit).cast("string"))
    space = F.octet_length(short) - F.octet_length(F.substring_index(short, " ", -1)) - 1
    kept = F.when(space > limit - 20, F.expr("NULL").cast("string")).otherwise(short)
    trimmed = F.coalesce(kept, F.regexp_replace(short, " [^ ]*\\z", ""))
    return F.when(F.octet_length(flat) <= limit, flat).otherwise(F.concat(trimmed, F.lit("...")))


def preview(text: Column, over: int = 1000, keep: int = 500) -> Column:
    """Texts of more than ``over`` characters as ``keep`` of them, back to a space of the second half, with an ellipsis."""
    flat = F.substring(squeeze(text), 1, keep)
    tail = F.length(F.substring_index(flat, " ", -1))
    back = F.when((tail < F.length(flat)) & (F.length(flat) - tail - 1 > keep // 2), F.expr("NULL").cast("string")).otherwise(flat)
    cut = F.coalesce(back, F.regexp_replace(flat, " [^ ]*\\z", ""))
    return F.when(F.length(text) <= over, text).otherwise(F.concat(F.rtrim(cut, F.lit(" ,.;:-")), F.lit("…")))


def length_class(words: Column) -> Column:
    """short below 250 words, medium below 1000, else long."""
    return F.when(words < 250, "short").when(words < 1000, "medium").otherwise("long")


def usable_url(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(r"^https?://[^/?#]+") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))


def host(url: Column) -> Column:
    """Lower-case host with its port, without user information or a leading www."""
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    return F.regexp_replace(F.lower(F.regexp_replace(authority, "^.*@", "")), r"^www\.", "")


#: Fixed value: the date that a file name may start with.
DATE_PREFIX = r"^(\d{4})[.\-_](\d{1,2})[.\-_](\d{1,2})[.\-_]*"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def _spaced(name: Column) -> Column:
    return squeeze(F.translate(name, "_-", "  "))


def filename_title(path: Column) -> Column:
    return _spaced(_stem(base_name(path)))


def slug_title(path: Column) -> Column:
    """A site page's title from its file name: without the date before and the word copy after."""
    name = _spaced(F.regexp_replace(_stem(base_name(path)), DATE_PREFIX, ""))
    bare = F.regexp_replace(name, r" copy\z", "")
    return F.when(bare == "", name).otherwise(bare)


def filename_date(path: Column) -> Column:
    """The date that a site page's file name starts with, where it is one of the calendar."""
    name = base_name(path)
    parts = [F.regexp_extract(name, DATE_PREFIX, i) for i in (1, 2, 3)]
    return F.try_to_date(F.when(parts[0] != "", F.concat_ws("-", *parts)), "yyyy-M-d")


def heading_date(text: Column) -> Column:
    """A page's date line: month.day.year or month-day-year."""
    t = F.trim(text)
    dotted, dashed = F.when(t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), t), F.when(t.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), t)
    return F.coalesce(F.try_to_date(dotted, "M.d.yyyy"), F.try_to_date(dashed, "M-d-yyyy"))


#: The date layouts accepted, in order (pattern that a text must have, layout to read it by).
LAYOUTS = [
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]XXX"),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d{4})$", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XX"),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"),
    (r"^\d{4}/\d\d/\d\d$", "yyyy/MM/dd"),
    (r"^[A-Z][a-z]{2}, \d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d{4}$", "dd MMM yyyy HH:mm:ss Z"),
    (r"^[A-Z][a-z]{2}, \d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d ([A-Z]{3}|[A-Z]{3,4}T)$", "dd MMM yyyy HH:mm:ss"),
    (r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]+ \d{4}$", "d MMMM yyyy"),
]


def strict_timestamp(text: Column) -> Column:
    """The first layout that fits, in UTC; null where none does. A zone by name alone counts as UTC."""
    t = F.trim(text)
    tries = []
    for shape, layout in LAYOUTS:
        value = F.regexp_replace(t, "^[A-Z][a-z]{2}, |(?<=:\\d\\d) ([A-Z]{3}|[A-Z]{3,4}T)$", "") if layout.startswith("dd MMM") else t
        tries.append(F.try_to_timestamp(F.when(t.rlike(shape), value), F.lit(layout)))
    return F.coalesce(*tries)


def stars(rating: Column) -> Column:
    """One to five filled stars of five, rounded half up; nothing for other ratings."""
    n = F.round(rating.try_cast("double")).cast("int")
    return F.when(n.between(1, 5), F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n))).otherwise("")


def review_title(title: Column, author: Column, rating: Column) -> Column:
    t, a = squeeze(F.coalesce(title, F.lit(""))), squeeze(F.coalesce(author, F.lit("")))
    named = F.when(t == "", a).when(a == "", t).otherwise(F.concat(t, F.lit(" by "), a))
    return F.trim(F.concat_ws(" ", named, F.nullif(stars(rating), F.lit(""))))


def day_number(published: Column) -> Column:
    """Days since 1970, truncated towards zero."""
    return F.call_function("div", F.unix_seconds(published), F.lit(86400))
