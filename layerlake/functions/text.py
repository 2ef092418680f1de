"""Text expressions: everything stays in the JVM's generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folding() -> tuple[str, str]:
    """Letters that Unicode decomposes into an ASCII letter and one mark, with that letter; marks alone have none."""
    plain = {}
    for c in map(chr, (*range(0x80, 0x250), *range(0x1E00, 0x1F00))):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.combining(parts[1]) and c == c.lower():
            plain[c] = parts[0]
    marks = "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c))
    return "".join(plain) + marks, "".join(plain.values())


#: What ``translate`` folds; what has no counterpart is deleted.
ACCENTED, PLAIN = _folding()


def search_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without accents (search index)."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def similarity_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores (similarity merge)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).cast("long")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def middle_cut(text: Column, limit: int, marker: str = "\n[...]\n", reserve: int = 50) -> Column:
    """Keeps the head and tail of a text longer than ``limit`` around a marker."""
    keep = limit - reserve
    head = keep // 2
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(keep - head)))
    )


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), " ", "-")


def render(template: str, **columns: Column) -> Column:
    """Single-pass template: ``{name}`` is replaced by a column; inserted text is never scanned again."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[columns[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def content_id(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))
