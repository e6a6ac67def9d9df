"""Sentences of narratives in Python workers, alike to Spark's expressions: white space, digits
and word characters are spelled out as Java's patterns have them. What a sentence tells depends
on it alone and is remembered within a bound, as sentences of forms come again and again."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentences that a worker remembers.
REMEMBERED = 50_000
# white space in Unicode's sense, as Java has it
_SPACE = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE = f"[{_SPACE}]"
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if re.match(SPACE, c))
_BREAK = re.compile(r"\.[ \t\n\x0b\f\r]+|\n")


def trim(text: str) -> str:
    return text.strip(_BLANKS)


def split(text: str) -> list[str]:
    """Sentences as ``stays.split_sentences`` gives them."""
    ends = [m.end() for m in _BREAK.finditer(text)]
    return [s for a, b in zip([0, *ends], [*ends, len(text)]) if (s := text[a:b].strip(_BLANKS))]


def by_sentence(kind: str, told: Callable[[str], list[tuple]], whole: Callable[[list[tuple]], list[tuple]] = list) -> Callable[[Column], Column]:
    """A column function from narratives to array<``kind``>: what ``told`` gives for each of the
    sentences, in order; null for a null narrative. ``whole`` sees all that a
    narrative tells and gives what stays of it."""

    @F.pandas_udf(f"array<{kind}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = functools.lru_cache(REMEMBERED)(told)
        for texts in batches:
            yield pd.Series([None if t is None else whole([x for s in split(t) for x in known(s)]) for t in texts], dtype=object)

    return run
