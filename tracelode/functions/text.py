"""Scalar functions on text, all of them column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIG

# The mark of an unmapped glyph, and signs that tell a formula.
GLYPH = r"⟦PDF_GLYPH_U\+([0-9A-F]{4,6})⟧"
FORMULA_SIGNS = r"[=±×÷∑∏∫√∂∇≤≥≈≠∈∞αβγδεθλμσφω^_{}\\|<>+*/]"


def join_hyphenated(text: Column) -> Column:
    """Words that a soft hyphen breaks at the end of a line, in one piece."""
    return F.regexp_replace(text, "­\n", "")


def glyphs(text: Column) -> Column:
    """Code points of unmapped glyphs, as hexadecimal digits."""
    return F.regexp_extract_all(text, F.lit(GLYPH), F.lit(1))


def has_replacement(text: Column) -> Column:
    """Whether a character was lost in decoding: never allowed in a zone."""
    return F.contains(text, F.lit("�"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def retrieval_text(title: Column, body: Column) -> Column:
    return F.concat_ws("\n", title, body)


def evidence_id(doc_id: Column, zone: Column, section: Column, number: Column) -> Column:
    return F.format_string("%s-Z%s-S%s-C%03d", doc_id.cast("string"), zone, section, number)


def tokens(text: Column, pattern: str = CONFIG.token_pattern) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def quote_offset(text: Column, quote: Column) -> Column:
    """Code points before the first occurrence of ``quote``; -1 where there is none, null for an empty quote."""
    return F.when(quote != "", F.instr(text, quote) - 1)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Zero-based code points, the end exclusive."""
    return F.substring(text, start + 1, end - start)


def without_thinking(content: Column) -> Column:
    return F.regexp_replace(content, r"(?s)<think>.*?</think>", "")


def json_object(content: Column) -> Column:
    """The JSON object of a completion, without thoughts and fences; null where there is none."""
    found = F.regexp_extract(without_thinking(content), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def payload_hash(*columns: str) -> Column:
    """One hash of named columns, whatever their order in the call."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def formula_density(text: Column) -> Column:
    """Mathematical signs in a thousand characters."""
    return F.when(F.char_length(text) > 0, 1000.0 * F.regexp_count(text, F.lit(FORMULA_SIGNS)) / F.char_length(text)).otherwise(0.0)


def formula_risk(text: Column, per_mille: float = CONFIG.formula_per_mille) -> Column:
    return formula_density(text) >= per_mille


def keyword_trap(text: Column, keyword: str, around: int = 40) -> Column:
    """What stands around a keyword that must not decide a label by itself; null where it does not occur."""
    at = F.instr(F.lower(text), keyword.lower())
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(keyword))))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and comments go first, then tags; white space is folded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
