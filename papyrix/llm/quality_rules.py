"""Operator 4: quality rules with tokeniser fertility.

Beside the base rules each document is measured with a public vocabulary: characters per token, share of byte-fallback
tokens, and entropy of its tokens. A language (or, where none is named, a script) has a band for each measure and length
class (powers of two of the tokens), taken from the medians and median absolute deviations of all its documents, and a
document outside a band is rejected. A class of few documents takes its band from the language's nearest larger one,
widened by what a straight line through the medians of its classes adds on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetable import SPACE, ByteTable, concat, sums, word_spans
from .common import Scratch, prepare, row_digest
from .tokens import vocabulary
from .words import SPACES, repeated_window_words

SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS.encode())] = 1
WINDOW = 5
#: Base rule: fewer words, or a larger share of repeated-window words in percent, fail.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Band half-width in robust standard deviations of the language and length class.
BAND_SIGMAS = 4.0
#: Least half-widths: a class whose documents hardly differ does not reject on noise.
LEAST = {"chars_per_token": 0.1, "byte_share": 0.05, "entropy_loss": 0.3}
#: A class of fewer documents does not tell its own band.
ENOUGH = 30
#: Bands (a hundred bytes each) that are broadcast to the documents; more, as of a column with endless languages, are shuffled.
BROADCAST_BANDS = 100_000

_SCRIPTS = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai"]
_SCRIPT = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in _SCRIPTS]

METRICS = (
    "row_key string, doc_id long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, entropy_loss double"
)


def script_of(text: str) -> str:
    """The script of most letters of ``text``, or none."""
    counts = [(len(p.findall(text)), s) for s, p in _SCRIPT]
    return "script:" + (max(counts)[1] if max(counts)[0] else "none")


class _Pieces:
    """Word to piece ids; byte pieces are those of the byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.table = ByteTable(self._encode, 21)

    def _encode(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(x, "<i4") for x in self.model.encode([w.decode() for w in words], num_threads=1)]


@lru_cache(maxsize=2)
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def duplicate_lines(text: str) -> int:
    """Lines (split at \\n) with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def measure_batch(texts: list[str], path: str) -> dict[str, np.ndarray]:
    """All measures of a batch of texts."""
    pieces = _pieces(path)
    data, bounds = concat([t.encode() for t in texts])
    starts, ends_of, n_words = word_spans(data, bounds)
    numbers = pieces.table.numbers(data, starts, ends_of)
    ids, per_word = pieces.table.rows(numbers)
    n_tokens = sums(per_word, n_words)
    ends = np.cumsum(n_tokens)
    entropy = np.zeros(len(texts))
    for d, (end, n) in enumerate(zip(ends.tolist(), n_tokens.tolist())):
        if n:
            count = np.bincount(ids[end - n : end])
            p = count[count > 0] / n
            entropy[d] = -(p * np.log2(p)).sum()
    # Code points are bytes that continue no other.
    chars = sums((~SPACE[data] & ((data & 0xC0) != 0x80)).astype(np.int64), np.diff(bounds))
    least_one = np.maximum(n_tokens, 1)
    return {
        "n_words": n_words, "word_chars": chars,
        "n_symbols": sums(_IS_SYMBOL[data], np.diff(bounds)),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated_window_words(numbers, n_words, WINDOW),
        "n_tokens": n_tokens, "chars_per_token": chars / least_one,
        "byte_share": sums(pieces.is_byte[ids].astype(np.int64), n_tokens) / least_one,
        # Bits below the entropy of as many tokens drawn from a Zipf-like text: grows as a text repeats itself.
        "entropy_loss": np.log2(least_one) * 0.75 - entropy,
    }


def _measurer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column(2).to_pylist()]
            got = measure_batch(texts, path)
            named = [b if b else script_of(t) for b, t in zip(batch.column(3).to_pylist(), texts)]
            bands = [f"{b}/{n.bit_length()}" for b, n in zip(named, got["n_tokens"].tolist())]
            yield pa.RecordBatch.from_pydict({"row_key": batch.column(0), "doc_id": batch.column(1), "band": pa.array(bands)} | {k: pa.array(v) for k, v in got.items()})

    return run


def _lang(docs: DataFrame) -> F.Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def _row_key(docs: DataFrame) -> F.Column:
    """Equal for rows alike in doc_id and in all that a verdict depends on, text and lang: they have one verdict."""
    return row_digest(F.col("doc_id"), F.col("text"), _lang(docs))


def fertility_metrics(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """The measures of every row of ``docs`` (doc_id, text and, if there is one, lang)."""
    prepare(docs.sparkSession)
    rows = docs.select(_row_key(docs).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text", _lang(docs).alias("lang"))
    return rows.mapInArrow(_measurer(vocab or vocabulary("piece_bpe_32k.model")), METRICS)


def _small(bands: DataFrame) -> DataFrame:
    """A stored table of bands, broadcast if it is known to be small."""
    return F.broadcast(bands) if bands.count() <= BROADCAST_BANDS else bands


def fertility_bands(metrics: DataFrame, scratch: Scratch) -> DataFrame:
    """Per band key and measure: the median, and the robust deviation of all documents that have words.

    Where fewer than ENOUGH documents share a band, both come from the nearest larger class of the language (or script), or
    from all its classes if none is larger. How medians change with the length class is a line through them, and the band
    reaches from the nearest class's median to where the line would lead (slack: half of that way).
    """
    names = list(LEAST)
    some = metrics.filter("n_tokens > 0").select("band", *names)
    mid = some.groupBy("band").agg(F.count("*").alias("n_docs"), *[F.percentile_approx(n, 0.5, 1000).alias(f"{n}_mid") for n in names])
    mid = scratch.keep(mid, "medians")
    off = some.join(_small(mid), "band").groupBy("band").agg(*[F.percentile_approx(F.abs(F.col(n) - F.col(f"{n}_mid")), 0.5, 1000).alias(f"{n}_mad") for n in names])
    own = mid.join(off, "band").withColumn("named", F.regexp_extract("band", "(?s)^(.*)/", 1)).withColumn("x", F.regexp_extract("band", r"(\d+)$", 1).cast("double"))
    # From here on a row is a class.
    weight = F.when((F.col("n_docs") >= ENOUGH) | (F.col("most") < ENOUGH), F.col("n_docs")).otherwise(F.lit(0)).cast("double")
    rows = own.join(own.groupBy("named").agg(F.max("n_docs").alias("most")), "named").withColumn("w", weight)
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    x = F.col("x")
    line = rows.groupBy("named").agg(
        mean(x).alias("mx"), mean(x * x).alias("mxx"),
        *[f for n in names for f in (mean(F.col(f"{n}_mid")).alias(f"{n}_my"), mean(x * F.col(f"{n}_mid")).alias(f"{n}_mxy"), mean(F.col(f"{n}_mad")).alias(f"{n}_spread"))],
    )
    across = F.col("mxx") - F.col("mx") * F.col("mx")
    slope = lambda n: F.when(across > 1e-9, (F.col(f"{n}_mxy") - F.col("mx") * F.col(f"{n}_my")) / across).otherwise(F.lit(0.0))
    # Every class beside its nearest one that tells a band: itself, if it does.
    given = rows.filter("w > 0").select("named", F.col("x").alias("at"), *[F.col(f"{n}_{k}").alias(f"at_{n}_{k}") for n in names for k in ("mid", "mad")])
    near = own.select("band", "named", "n_docs", "x").join(given, "named").groupBy("band", "named", "n_docs", "x")
    near = near.agg(F.min_by(F.struct(*[c for c in given.columns if c != "named"]), F.struct(F.abs(x - F.col("at")), "at")).alias("g")).join(line, "named")
    away = x - F.col("g.at")
    mids = [(F.col(f"g.at_{n}_mid") + slope(n) * away / 2).alias(f"{n}_mid") for n in names]
    mads = [F.when(away == 0, F.col(f"g.at_{n}_mad")).otherwise(F.greatest(F.col(f"g.at_{n}_mad"), F.col(f"{n}_spread"))).alias(f"{n}_mad") for n in names]
    return near.select("band", "n_docs", *mids, *mads, *[F.abs(slope(n) * away / 2).alias(f"{n}_slack") for n in names])


def quality_verdicts(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """Measures and verdicts of every row of ``docs``; other columns than doc_id, text and lang are not read.

    Null texts have no words and fail the base rule. Documents without lang are banded by script. Repeated rows get
    repeated verdicts, and count repeatedly in their band. Texts of any length are measured whole. A document on the edge of
    its band is inside. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    metrics = scratch.keep(fertility_metrics(docs, vocab), "metrics")
    # A band holds up to all documents, so they are not dealt out by it: the bands go to them.
    judged = metrics.join(_small(scratch.keep(fertility_bands(metrics, scratch), "bands")), "band", "left")
    inside = F.lit(True)
    for name, least in LEAST.items():
        width = F.greatest(F.lit(least), BAND_SIGMAS * 1.4826 * F.col(f"{name}_mad")) + F.col(f"{name}_slack")
        away = F.col(name) - F.col(f"{name}_mid")
        # Few byte-fallback tokens are no fault; the other measures reject on either side.
        inside &= F.coalesce((away if name == "byte_share" else F.abs(away)) <= width, F.lit(True))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.select(*metrics.columns, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``quality_verdicts``, with the fertility measures after them."""
    return quality_verdicts(docs).drop("row_key", "band")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, repeated rows included, with their columns as they were."""
    kept = quality_verdicts(docs).filter("kept").select(F.col("row_key").alias("__row"))
    return docs.withColumn("__row", _row_key(docs)).join(kept, "__row", "left_semi").select(*docs.columns)
