"""Exact token counts at every prefix, by dynamic programming.

For a word s of the vocabulary's alphabet, ``last[i]`` is the one token that can end the
encoding of s[:i]: it ends at i and fits the token that ends the encoding before it. So
``count[i] = count[start of last[i]] + 1``. A word that ends at i carries the end mark on its
last token; that token is found the same way among the tokens with the mark. A text's
counts are sums over its words. The table of a text has, for each character, by how much the
count of the prefix that ends there differs from the one before (two bytes a character), and
everything is read from it: the count of any prefix, of the whole text, the longest prefix
within a budget. Tables of words are remembered, so a text's table is theirs end to end.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.llm._shared import append_columns, texts_of
from chartweave.llm.bpe import Splitter

#: Entries of the per-worker memories of words and of token pairs; a full memory starts anew
#: (of words the one before is kept as well).
WORD_MEMORY = 400_000
PAIR_MEMORY = 1_000_000


#: Lower-case letters that differ from Python's. Sigma has no final form, the
#: others are of Unicode 16 and 17.
LOWER_CASE = {0x03A3: 0x03C3, 0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
LOWER_CASE |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def byte_letters() -> dict[int, str]:
    """The usual printable letter of each byte in byte-level vocabularies: visible Latin-1
    characters stand for themselves, the others for code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for a BPE vocabulary with an end-of-word mark, in the tokenizer file's format:
    NFC, white space collapsed, lower case; split by the file's pattern, matches kept."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merge_rank = {m: i for i, m in enumerate(merges)}
        vocab = model["vocab"]
        self.inner = {t for t in vocab if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)] for t in vocab if t.endswith(self.end)}
        self.longest = max(map(len, self.inner | self.final))
        self.letters = byte_letters()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = Splitter(pattern)
        self.finditer = self.split.full.finditer
        self.special = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.fit: dict[tuple[str, str, bool], bool] = {}
        self.counts: dict[str, int] = {}
        self.steps: dict[str, bytes] = {}
        self.older_steps: dict[str, bytes] = {}
        self.older: dict[str, int] = {}  # what the memory held before it was full

    def merged(self, parts: list[str]) -> list[str]:
        """Merging by the lowest-ranked, leftmost pair until none is left."""
        rank = self.merge_rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str, ends: bool) -> bool:
        """Whether ``right`` can follow ``left`` ('' : starts the word)."""
        key = (left, right, ends)
        known = self.fit.get(key)
        if known is None:
            parts = list(left + right)
            if ends:
                parts[-1] += self.end
            tail = right + self.end if ends else right
            known = self.merged(parts) == ([left, tail] if left else [tail])
            if len(self.fit) >= PAIR_MEMORY:
                self.fit.clear()
            self.fit[key] = known
        return known

    def _inner_table(self, s: str, upto: int) -> tuple[list[str], list[int]]:
        """last[i] and count[i] for i up to ``upto``, without the end mark."""
        last, count = [""] * (upto + 1), [0] * (upto + 1)
        inner, fits, longest, known = self.inner, self.fits, self.longest, self.fit.get
        for i in range(1, upto + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = s[j:i]
                if t in inner:
                    ok = known((last[j], t, False))
                    if ok or (ok is None and fits(last[j], t, False)):
                        last[i], count[i] = t, count[j] + 1
                        break
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return last, count

    def _closed(self, s: str, last: list[str], count: list[int], i: int) -> int:
        """Tokens of s[:i] as a whole word."""
        for j in range(max(0, i - self.longest), i):
            t = s[j:i]
            if t in self.final and self.fits(last[j], t, True):
                return count[j] + 1
        raise ValueError("the vocabulary lacks single bytes with the end mark")

    def spell(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() and " " not in word else "".join(self.letters[b] for b in word.encode("utf-8"))

    def word_count(self, word: str) -> int:
        """Tokens of one whole word (memoised)."""
        known = self.counts.get(word) or self.older.get(word)
        if known is None:
            s = self.spell(word)
            if s in self.final and self.fits("", s, True):
                known = 1
            else:
                last, count = self._inner_table(s, len(s) - 1)
                known = self._closed(s, last, count, len(s))
            if len(self.counts) >= WORD_MEMORY:
                self.older, self.counts = self.counts, {}
            self.counts[word] = known
        return known

    def word_prefix_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a word, 0 to len(word) characters, each prefix standing
        as a text of its own (a cut contraction, of three characters at most, falls into two
        words). One pass finds for each end the token inside the word and the one that ends it."""
        s = self.spell(word)
        n, longest, inner, final, fits, known = len(s), self.longest, self.inner, self.final, self.fits, self.fit.get
        last, count, closed = [""] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            inside = ends = False
            for j in range(i - longest if i > longest else 0, i):
                t = s[j:i]
                if not inside and t in inner:
                    ok = known((last[j], t, False))
                    if ok or (ok is None and fits(last[j], t, False)):
                        last[i], count[i], inside = t, count[j] + 1, True
                if not ends and t in final:
                    ok = known((last[j], t, True))
                    if ok or (ok is None and fits(last[j], t, True)):
                        closed[i], ends = count[j] + 1, True
                if inside and ends:
                    break
        if n == len(word):
            out = closed
        else:
            out, at = [0], 0
            for ch in word:
                at += len(ch.encode("utf-8"))
                out.append(closed[at])
        if 0 in out[1:]:
            raise ValueError("the vocabulary lacks single bytes with the end mark")
        if len(word) <= 4:
            for k in range(1, len(word) + 1):
                again = self.split(word[:k])
                if again != [word[:k]]:
                    out[k] = sum(map(self.word_count, again))
        return out

    def word_steps(self, word: str) -> bytes:
        """The table of one word (memoised)."""
        known = self.older_steps.get(word)
        if known is None:
            counts = self.word_prefix_counts(word)
            known = array("h", map(sub, counts[1:], counts)).tobytes()
        if len(self.steps) >= WORD_MEMORY:
            self.older_steps, self.steps = self.steps, {}
        self.steps[word] = known
        return known

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(LOWER_CASE)
        return text.lower()

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens; the flag tells these."""
        if self.special_at is None or not self.special_at.search(text):
            return [(text, False)]
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def total(self, text: str) -> tuple[np.ndarray, int]:
        """Running token counts at the ends of the text's words, and the whole count."""
        counts: list[int] = []
        for part, special in self.parts(text):
            if special:
                counts.append(1)
                continue
            words = self.split(self.normal(part))
            known = self.counts.get
            counts += [known(w) or self.word_count(w) for w in words]
        sums = np.cumsum(np.array(counts, np.int64)) if counts else np.zeros(0, np.int64)
        return sums, int(sums[-1]) if counts else 0

    def text_steps(self, text: str) -> bytes:
        """The table of a text, a step for each character of the normalised text (a cut special
        token is ordinary text)."""
        out: list[bytes] = []
        for part, special in self.parts(text):
            if special:
                inside = [self.total(part[:k])[1] for k in range(len(part))] + [1]
                out.append(np.diff(inside).astype(STEP).tobytes())
                continue
            s, at = self.normal(part), 0
            known, find, add, fresh = self.steps.get, s.find, out.append, self.word_steps
            for word in self.split(s):
                # only white space stands between words, most often one blank
                start = find(word, at)
                if start > at:
                    add(_BLANK if start == at + 1 else bytes((start - at) * WIDTH))
                add(known(word) or fresh(word))
                at = start + len(word)
            out.append(bytes((len(s) - at) * WIDTH))
        return b"".join(out)

    def prefix_counts(self, text: str) -> np.ndarray:
        """The count of every prefix, 0 to n characters, of the normalised text: entry i is
        what encoding the first i characters gives."""
        return counts_of(self.text_steps(text))


#: Type of a table's steps.
STEP = np.dtype(np.int16)
WIDTH = STEP.itemsize
_BLANK = bytes(WIDTH)


def counts_of(table: bytes) -> np.ndarray:
    """Counts of all prefixes, 0 to n characters, from a table."""
    return np.r_[0, np.cumsum(np.frombuffer(table, STEP), dtype=np.int64)]


@functools.lru_cache(maxsize=2)
def load(path: str) -> PrefixCounter:
    with open(path, encoding="utf-8") as f:
        return PrefixCounter(json.load(f))


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``df`` with ``prefix_steps`` (binary), the table of every prefix of the normalised text,
    and what is read from it: ``n_tokens``, ``over_limit``, and ``chars_within_limit``, the
    characters of the longest prefix of at most ``limit`` tokens before any prefix exceeds it
    (counts of prefixes may fall again inside a word). ``n_bytes`` is of the text as it is.

    A null or empty text has 0 bytes, 0 tokens and an empty table. Whole texts of any length
    count; repeated rows count alike; columns of the new names (any case) are replaced. No shuffle."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        counter = load(path)
        tables = [counter.text_steps(t) for t in texts_of(batch, text)]
        read = [read_table(t, limit) for t in tables]
        return [pa.array(tables, pa.binary()), pa.array([n for n, _ in read], pa.int64()), pa.array([k for _, k in read], pa.int64())]

    fields = [T.StructField("prefix_steps", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("chars_within_limit", T.LongType())]
    counted = append_columns(df, fields, run)
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    return counted.withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > F.lit(limit)})


def read_table(table: bytes, budget: int) -> tuple[int, int]:
    """Tokens of the whole text, and characters within the budget, from its table alone."""
    counts = counts_of(table)
    total = int(counts[-1])
    return total, truncation_point(counts, budget)


def truncation_point(counts: np.ndarray | list[int], budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens before any prefix
    exceeds it."""
    over = np.flatnonzero(np.asarray(counts) > budget)
    return int(over[0]) - 1 if len(over) else len(counts) - 1
