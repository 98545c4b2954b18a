"""Whether a short text is a quotation with its attribution, as one Catalyst expression.

Texts are normalised, so blanks are plain spaces and line feeds, and each condition is one anchored pattern on the last line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word limits of a quotation and of its attribution (after a tilde, after a dash, with a link).
QUOTE_WORDS, ATTRIBUTION_WORDS, DASH_WORDS, LINKED_WORDS = 100, 10, 6, 6
#: What may follow a quotation (links and re-share credits), closing marks, and dashes.
CREDITS = r"(?:\s*(?:https?://\S+|(?:RT|via)\s+@\w+))+\s*\z"
CLOSING, DASHES = "[.!?\"'\u201d\u2019]", "[-\u2013\u2014]"


def attribution(first: str, never: str, words: int) -> str:
    """The pattern of at most ``words`` words up to the end that begin with ``first`` and hold none of ``never``."""
    return rf" *{first}[^ {never}]*(?: +[^ {never}]+){{0,{words - 1}}} *\z"


def quote_flag(text: Column, words: Column) -> Column:
    """A tilde before a name at the end of the last line, or a dash there between a closing mark and a capitalised name.

    Links and credits at the end are set aside first; with a link only the tilde counts, and fewer words. A line with a tilde is
    judged by its last tilde alone, and a dash needs its closing mark on the same line.
    """
    body = F.trim(F.regexp_replace(F.trim(text), CREDITS, ""))
    linked = F.contains(F.regexp_extract(F.trim(text), CREDITS, 0), F.lit("http"))
    line = F.substring_index(body, "\n", -1)
    named = F.when(linked, line.rlike("~" + attribution(r"\p{L}", "~?!", LINKED_WORDS))).otherwise(line.rlike("~" + attribution(r"\p{L}", "~?!", ATTRIBUTION_WORDS)))
    dashed = ~linked & line.rlike(CLOSING + " *-*" + DASHES + attribution(r"\p{Lu}", "?!", DASH_WORDS))
    return F.when((words < QUOTE_WORDS) & text.rlike("[~\u2013\u2014-]"), F.when(F.contains(line, F.lit("~")), named).otherwise(dashed)).otherwise(False)
