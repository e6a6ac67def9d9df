"""Byte-level BPE encoding and decoding.

A pre-token's bytes are read as Latin-1 characters, so that one Aho-Corasick automaton over
all tokens finds, for every position, the longest token that starts there. The encoder takes
the longest token, goes on, and backtracks to shorter ones where two neighbours could not
stand side by side. Two tokens are compatible if merging their joined bytes gives these two
again; a sequence in which all neighbours are compatible is the one that the merges give, as
no merge can be the first to cross one of its borders. Compatibility is memoised, positions
found to be dead ends are never entered twice, and so a pre-token takes linear time.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chartweave.llm._shared import append_columns, list_array, texts_of

#: Entries of the per-worker memories of pre-tokens and of token pairs; a full memory starts anew
#: (of pre-tokens the one before is kept as well).
PIECE_MEMORY = 150_000
PAIR_MEMORY = 250_000
#: Characters below this code point are split by a pattern of explicit ranges.
_PLAIN_TOP = 0x250
_BEYOND_PLAIN = re.compile(f"[^\\x00-\\u{_PLAIN_TOP - 1:04x}]")
#: White space below _PLAIN_TOP in Unicode's sense.
_PLAIN_SPACE = "\\t-\\r \\x85\\xa0"


#: Code points that became letters or numbers after Unicode 16, whose tables the
#: tokenizer libraries have. To them these are neither, whatever newer tables here say.
LATER = (
    "\\u0558\\u058b\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb"
    "\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3"
    "\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191"
    "\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96"
    "\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4"
    "\\U0001e6fe\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)


def plain_ranges(kind: str) -> str:
    """The members below _PLAIN_TOP of a general category's class, as ranges for ``re``."""
    codes = [c for c in range(_PLAIN_TOP) if unicodedata.category(chr(c))[0] == kind]
    breaks = [i for i in range(1, len(codes)) if codes[i] != codes[i - 1] + 1]
    runs = [codes[a:b] for a, b in zip([0, *breaks], [*breaks, len(codes)])]
    return "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian int32 bytes."""
    return struct.pack(f"<{len(ids)}i", *ids)


class Splitter:
    """findall() of a pattern of the ``regex`` dialect, with the letters and numbers that the
    tokenizer libraries know. Texts whose characters are all below
    U+0250 go through the same pattern written with explicit ranges, several times faster."""

    def __init__(self, pattern: str):
        full = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}][{LATER}]]".replace("\\p", "\\P?"))
        full = full.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
        full = full.replace("\\p{L}", f"[\\P?{{L}}--[{LATER}]]").replace("\\p{N}", f"[\\P?{{N}}--[{LATER}]]").replace("\\P?", "\\p")
        self.full = regex.compile(full, regex.V1)
        letters, numbers = plain_ranges("L"), plain_ranges("N")
        plain = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{_PLAIN_SPACE}{letters}{numbers}]")
        plain = plain.replace("[\\p{L}]", f"[{letters}]").replace("[\\p{N}]", f"[{numbers}]")
        plain = plain.replace("\\p{L}", f"[{letters}]").replace("\\p{N}", f"[{numbers}]")
        plain = plain.replace("\\s", f"[{_PLAIN_SPACE}]").replace("\\S", f"[^{_PLAIN_SPACE}]")
        self.plain = re.compile(plain) if "\\p" not in plain else None

    def __call__(self, text: str) -> list[str]:
        if self.plain is None or _BEYOND_PLAIN.search(text):
            return self.full.findall(text)
        return self.plain.findall(text)


class ByteBPE:
    """The encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = Splitter(pattern)
        self.rank = {k.decode("latin-1"): v for k, v in ranks.items()}
        top = max(ranks.values()) + 1
        self.token: list[str] = [""] * top
        for s, r in self.rank.items():
            self.token[r] = s
        self.length = [len(s) for s in self.token]
        self.automaton = ahocorasick.Automaton()
        for s, r in self.rank.items():
            self.automaton.add_word(s, r)
        self.automaton.make_automaton()
        #: the longest proper prefix that is a token too, or -1
        self.shorter = [-1] * top
        for s, r in self.rank.items():
            for cut in range(len(s) - 1, 0, -1):
                if (p := self.rank.get(s[:cut])) is not None:
                    self.shorter[r] = p
                    break
        self.bytes_of = [s.encode("latin-1") for s in self.token]
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what the memory held before it was full

    def merged(self, s: str) -> list[int]:
        """What repeated merging of the lowest-ranked, leftmost pair makes of ``s``."""
        parts, rank = list(s), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` (-1: starts the pre-token)."""
        key = (left + 1) << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if left < 0:
                known = self.merged(self.token[right]) == [right]
            else:
                known = self.merged(self.token[left] + self.token[right]) == [left, right]
            if len(self.pairs) >= PAIR_MEMORY:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_piece(self, s: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 characters of its bytes."""
        if (whole := self.rank.get(s)) is not None:
            return [whole]
        n, length, shorter, fits, known = len(s), self.length, self.shorter, self.fits, self.pairs.get
        longest = [-1] * n
        for end, tok in self.automaton.iter(s):
            longest[end + 1 - length[tok]] = tok  # ends ascend, so the longest stays
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, tok = 0, longest[0]
        while True:
            prev = out[-1] if out else -1
            before = (prev + 1) << 32
            while tok >= 0:
                if not dead[pos + length[tok]]:
                    ok = known(before | tok)
                    if ok or (ok is None and fits(prev, tok)):
                        break
                tok = shorter[tok]
            if tok >= 0:
                out.append(tok)
                pos += length[tok]
                if pos == n:
                    return out
                tok = longest[pos]
            else:
                if not out:
                    raise ValueError("the rank table lacks single bytes")
                dead[pos] = 1
                tok = out.pop()
                pos -= length[tok]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian int32 bytes."""
        pieces, found = self.pieces, self.split(text)
        try:
            return b"".join([pieces[p] for p in found])
        except KeyError:
            pass
        parts = []
        for p in found:
            ids = pieces.get(p)
            if ids is None:
                ids = self.older.get(p)
                if ids is None:
                    letters = p if p.isascii() else p.encode("utf-8").decode("latin-1")
                    ids = pack(self.encode_piece(letters))
                if len(pieces) >= PIECE_MEMORY:
                    self.older, pieces = pieces, {}
                    self.pieces = pieces
                pieces[p] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids) -> bytes:
        """Bytes of a sequence of ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 token and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@functools.lru_cache(maxsize=2)
def load_bytes(path: str) -> list[bytes]:
    """The bytes of every id, all that decoding needs."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """The codec of a rank file, once per Python worker."""
    return ByteBPE(read_ranks(path), pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """``df`` with a column ``tokens`` (array<int>): the ids of each whole text.

    A null or empty text has no tokens; lone white space, repeated rows and very long texts
    are encoded like any other; an empty table stays empty; a column named like ``tokens``
    (any case) is replaced. ``path`` is the rank file, readable on every executor. Strings of
    special tokens are ordinary text. No shuffle."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = load(path, pattern)
        rows = [codec.encode(t) for t in texts_of(batch, text)]
        lengths = np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))
        return [list_array(np.frombuffer(b"".join(rows), "<i4"), lengths, pa.int32())]

    return append_columns(df, [T.StructField(tokens, T.ArrayType(T.IntegerType()))], run, load.cache_clear)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``tokens`` and ``decoded``: what encode_documents and then decode_documents
    give, in one pass, so that a task needs one Python worker.

    A null or empty text has no tokens and decodes to no bytes; very long texts are encoded
    whole; repeated rows get equal ids; columns of the two names (any case) are replaced; an
    empty table stays empty. The codec is read once a task and dropped at its end, so that a
    worker's memory does not keep what one task has learnt."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = load(path, pattern)
        rows = [codec.encode(t) for t in texts_of(batch, text)]
        lengths = np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))
        decoded = [codec.decode(np.frombuffer(r, "<i4").tolist()) for r in rows]
        return [list_array(np.frombuffer(b"".join(rows), "<i4"), lengths, pa.int32()), pa.array(decoded, pa.binary())]

    fields = [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return append_columns(df, fields, run, load.cache_clear)


def decode_documents(df: DataFrame, path: str, tokens: str = "tokens", decoded: str = "decoded") -> DataFrame:
    """``df`` with a column ``decoded`` (binary): the bytes of each row's ids. Null ids give
    null, no ids give no bytes, an id outside the table fails the job. No shuffle."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        bytes_of = load_bytes(path)
        column = batch.column(batch.schema.get_field_index(tokens))
        flat, out = column.values.to_numpy(zero_copy_only=False), []
        if len(flat) and (flat.min() < 0 or flat.max() >= len(bytes_of)):
            raise ValueError("token id outside the rank table")
        offsets = column.offsets.to_numpy()
        for i, ok in enumerate(column.is_valid().to_pylist()):
            out.append(b"".join([bytes_of[t] for t in flat[offsets[i] : offsets[i + 1]].tolist()]) if ok else None)
        return [pa.array(out, pa.binary())]

    return append_columns(df, [T.StructField(decoded, T.BinaryType())], run)
