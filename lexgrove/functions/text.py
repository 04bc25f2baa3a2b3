"""Scalar functions: escapes, lemma keys, checksums and path templates, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the file formats: what stands for a mark inside a field.
FIELD_ESCAPES = ((",", "COMMA"), (";", "SEMICOLON"), (":", "COLON"))
QUOTES = (('"', "QQUOT0"), ("'", "QQUOT1"), ("`", "QQUOT2"))
XML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("``", "&quot;"), ('"', "''"), ("'", "&apos;"))


def _replace_all(value: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escape_field(value: Column) -> Column:
    """Marks that separate fields, spelled out."""
    return _replace_all(value, FIELD_ESCAPES)


def quote_literal(value: Column) -> Column:
    return _replace_all(value, QUOTES)


def unquote_literal(value: Column) -> Column:
    return _replace_all(value, tuple((new, old) for old, new in QUOTES))


def escape_xml(value: Column) -> Column:
    """Attribute-safe text; a double quote becomes two apostrophes, two backticks an entity."""
    return _replace_all(value, XML_ESCAPES[:4] + (('"', "&apos;&apos;"), ("'", "&apos;")))


def unescape_xml(value: Column) -> Column:
    return _replace_all(value, (("&lt;", "<"), ("&gt;", ">"), ("&quot;", "``"), ("&apos;", "'"), ("&amp;", "&")))


def safe_value(value: Column) -> Column:
    """A feature value without the separators of the table format."""
    return _replace_all(value, ((",", "COMMA"), ("\\", "BACK")))


def classifier_value(value: Column) -> Column:
    """A feature value for learners: punctuation is named, spaces are joined."""
    return F.regexp_replace(F.regexp_replace(value, r"[.\"';():!?,]", "_PUNCT_"), r"\s", "_")


def lemma_pos(lemma: Column, pos: Column) -> Column:
    """lemma.pos, with dots of the part of speech spelled out."""
    return F.concat(lemma, F.lit("."), F.replace(pos, F.lit("."), F.lit("DOT")))


def split_lemma_pos(key: Column) -> tuple[Column, Column]:
    """Lemma and part of speech: apart at the last dot."""
    return F.regexp_replace(key, r"\.[^.]*$", ""), F.substring_index(key, ".", -1)


def letters_checksum(text: Column) -> Column:
    """MD5 of the lower-cased letters a-z alone."""
    return F.md5(F.regexp_replace(F.lower(text), "[^a-z]", ""))


def lemma_before_bar(lemma: Column, word: Column) -> Column:
    """The lemma up to a bar; the word where the lemma is missing or unknown."""
    usable = F.when(lemma.isNull() | lemma.isin("", "<unknown>"), None).otherwise(F.substring_index(lemma, "|", 1))
    return F.coalesce(usable, word)


def is_punctuation(word: Column) -> Column:
    return F.coalesce(word.rlike(r"^[^\p{L}\p{N}]+$"), F.lit(False))


def from_entities(text: str) -> str:
    """Numeric character references as characters."""
    return re.sub(r"&#(?:x([0-9a-fA-F]+)|(\d+));", lambda m: chr(int(m[1], 16) if m[1] else int(m[2])), text)


def to_entities(text: str) -> str:
    """Characters beyond ASCII as hexadecimal references."""
    return "".join(c if ord(c) < 128 else f"&#x{ord(c):x};" for c in text)


class Template:
    """A pattern with ``<name>`` holes: fill it, or match a text and get the names' values."""

    def __init__(self, pattern: str) -> None:
        self.parts = re.split(r"<(\w+)>", pattern)
        self.names = self.parts[1::2]

    def fill(self, **values: object) -> str:
        return "".join(str(values[p]) if i % 2 else p for i, p in enumerate(self.parts))

    def match(self, text: str, **fixed: object) -> dict[str, str] | None:
        seen: set[str] = set()
        out = ""
        for i, part in enumerate(self.parts):
            if not i % 2:
                out += re.escape(part)
            elif part in fixed:
                out += re.escape(str(fixed[part]))
            else:
                out += f"(?P={part})" if part in seen else f"(?P<{part}>.+?)"
                seen.add(part)
        found = re.fullmatch(out, text)
        return None if found is None else found.groupdict() | {k: str(v) for k, v in fixed.items() if k in self.names}
