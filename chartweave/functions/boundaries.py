"""Patterns with ASCII word borders for Java's and Python's regex engines.

Some engines know word characters, digits and white space of ASCII only, others of Unicode.
Classes and borders written out mean the same everywhere, so one pattern serves Spark,
Python workers and engines that have the ASCII meaning anyway."""

from __future__ import annotations

import re

WORD = "0-9A-Za-z_"
#: A border between an ASCII word character and anything else.
BORDER = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
#: A border in Unicode's sense, for the stated intent of patterns over Cyrillic words.
UNICODE_BORDER = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
_SPACES = r"\t\n\f\r "


def spelled(pattern: str) -> str:
    """``pattern`` without its leading (?i), with \\b, \\w, \\d and \\s spelled out. A border that
    a digit or a Cyrillic letter follows, or that ends the pattern behind a digit, needs one
    look only."""
    body = pattern.removeprefix("(?i)")
    body = re.sub(r"\\b(?=(?:\(\?:)?\\d)", f"(?<![{WORD}])", body)
    body = re.sub(r"\\b(?=\(\?:[^A-Za-z()]*\)|[А-Яа-яЁё])", f"(?<=[{WORD}])", body)
    body = re.sub(r"(\\d(?:\{[0-9,]+\}|\+)?(?:\)\?)?\)?)\\b$", lambda m: f"{m[1]}(?![{WORD}])", body)
    body = body.replace(r"\b", BORDER).replace(r"\w", f"[{WORD}]")
    body = body.replace(r"[\d", "[0-9").replace(r"\d", "[0-9]")
    return body.replace(r"[\s", f"[{_SPACES}").replace(r"\s", f"[{_SPACES}]")


def java(pattern: str, ignore_case: bool = False, boundary: str = "ascii") -> str:
    """``pattern`` for Spark's functions; case folding, by ``ignore_case`` or a leading (?i),
    covers Cyrillic. With ``boundary`` "unicode" borders and word characters are Unicode's."""
    fold = "(?iu)" if ignore_case or pattern.startswith("(?i)") else ""
    if boundary == "ascii":
        return fold + spelled(pattern)
    return fold + pattern.removeprefix("(?i)").replace(r"\b", UNICODE_BORDER).replace(r"\w", r"[\p{L}\p{N}_]")


def compiled(pattern: str, boundary: str = "ascii") -> re.Pattern:
    """``pattern`` for Python workers, where \\b and \\w of str are Unicode's."""
    body = spelled(pattern) if boundary == "ascii" else pattern.removeprefix("(?i)")
    return re.compile(body, re.IGNORECASE if pattern.startswith("(?i)") else 0)
