"""Redaction of personal data with a gate that fails closed.

Spark expressions count and flag single detectors. Replacing needs all spans of a text held
against each other (structured data, institutions, names, entities from outside, protected
clinical text), which is one pass in Python over Arrow batches; the gate looks at the result in
the same pass. No step shuffles."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions import personal_data as known
from chartweave.functions.boundaries import compiled, java
from chartweave.functions.places import Markers, Places, lower
from chartweave.operators.text import normalize_text, trim_space


class Span(NamedTuple):
    start: int
    end: int
    kind: str | None  # None: protected


def detector_count(text: Column, name: str, boundary: str = "ascii") -> Column:
    """How often a detector matches, for reports; overlaps between detectors count twice."""
    return F.regexp_count(text, F.lit(java(known.DETECTORS[name][1], boundary=boundary)))


def protected_count(text: Column) -> Column:
    """How often protected clinical text stands in a text; patterns count apart."""
    return functools.reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(java(p))) for p in known.PROTECTED])


def gate_suspicions(text: Column) -> Column:
    """What is left of structured data once placeholders are taken out: kinds in order."""
    rest = F.regexp_replace(text, known.PLACEHOLDER_MARK, " ")
    return F.array_compact(F.array(*[F.when(rest.rlike(java(p)), F.lit(k)) for k, p in known.RESIDUAL.items()]))


def resolve(spans: list[Span]) -> list[Span]:
    """Spans that stay: the earliest start first, of these the longest, then the highest
    priority. A span that overlaps a kept one goes; a protected one takes the place of an
    unprotected one that it overlaps. Protected spans are not among the result."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end, -known.PRIORITY.get(s.kind, 10))):
        if not kept or s.start >= kept[-1].end:
            kept.append(s)
        elif s.kind is None and kept[-1].kind is not None:
            kept[-1] = s
    return [s for s in kept if s.kind is not None]


_CYRILLIC, _MARK = re.compile("[А-Яа-яЁё]"), re.compile(known.PLACEHOLDER_MARK)
_INITIAL = re.compile(r"[А-ЯЁ]\.")  # stands in all names with initials
_TOKEN = re.compile(r"[A-Za-zЀ-ԯ][A-Za-zЀ-ԯ-]*\.?")


class Stems:
    """Names by what a form of them has to share: the common beginning of a word and a name is
    of four letters at least and reaches all but the last two letters of the name and all but
    the last three of the word. Sets of beginnings answer that in a few lookups, however many
    names there are."""

    def __init__(self, names: Iterable[str]):
        names = {n for n in map(plain, names) if len(n) >= 4}
        # names whose own bound decides, and names that end where the word's bound is, or one behind
        self.stems = {n[: max(4, len(n) - 2)] for n in names}
        self.whole = {n[:k] for n in names for k in (len(n), len(n) - 1) if k >= 4}
        self.listed = functools.lru_cache(100_000)(self._listed)

    def _listed(self, word: str) -> bool:
        word = plain(word)
        least = max(4, len(word) - 3)
        return len(word) >= 4 and (any(word[:k] in self.stems for k in range(least, len(word) + 1)) or word[:least] in self.whole)


class Redactor:
    """The compiled form of patterns and word lists, once per worker."""

    def __init__(self, lexicon: known.Lexicon = known.USUAL, clock_time: bool = False, boundary: str = "ascii", structured: bool = False):
        self.structured = structured
        names = [n for n in known.DETECTORS if clock_time or n not in known.ON_REQUEST]
        self.detectors = [(known.DETECTORS[n][0], compiled(known.DETECTORS[n][1], boundary), n in known.NUMERIC) for n in names]
        self.detected = Places([p for _, p, _ in self.detectors], [known.ANCHORS[n] for n in names], boundary)
        self.protected = Places([compiled(p, boundary) for p in known.PROTECTED], list(known.PROTECTED_ANCHORS), boundary)
        # both in one look at the text
        self.sought = Places(self.detected.patterns + self.protected.patterns, self.detected.anchors + self.protected.anchors, boundary)
        self.residual = Places([compiled(p) for p in known.RESIDUAL.values()], [known.RESIDUAL_ANCHORS[k] for k in known.RESIDUAL])
        self.roles = [(k, compiled(p)) for k, p in known.ROLES]
        self.initials = [compiled(known.SURNAME_INITIALS), compiled(known.INITIALS_SURNAME)]
        self.patronymic = re.compile(known.PATRONYMIC)
        tail = compiled(known.INSTITUTION_TAIL if boundary == "ascii" else known.INSTITUTION_TAIL_NAMED).pattern
        capitals = [w for w in lexicon.institutions if w.upper() == w]
        others = [w for w in lexicon.institutions if w.upper() != w]
        self.institutions = [Markers(capitals, re.compile(tail), False), Markers(others, re.compile(tail, re.IGNORECASE), True)]
        self.no_names = {plain(w) for w in lexicon.no_names}
        self.skipped = functools.lru_cache(100_000)(lambda word: plain(word.rstrip(".")) in self.no_names)
        self.listed = Stems([*lexicon.first_names, *lexicon.surnames]).listed

    def role(self, text: str, start: int) -> str:
        """Whose name it is, by the words in the bytes before it."""
        before = text[max(0, start - known.ROLE_BYTES) : start].encode()[-known.ROLE_BYTES :].decode(errors="ignore")
        return next((k for k, p in self.roles if p.search(before)), "person")

    def name_spans(self, text: str) -> Iterator[Span]:
        """Names with initials; and runs of capitalised words next to each other, the whole run
        if a patronymic stands in it, from the first listed name on otherwise."""
        for pattern in self.initials if _INITIAL.search(text) else ():
            for m in pattern.finditer(text):
                yield Span(m.start(), m.end(), self.role(text, m.start()))
        run: list[re.Match] = []
        for m in [*_TOKEN.finditer(text), None]:
            word = m[0] if m else ""
            capital = word[:1].isupper() and word[:1] >= "Ѐ"
            if m and capital and not self.skipped(word) and (len(word) >= 3 or word[1:] in ("", ".")):
                run.append(m)
                continue
            if run:
                anchors = [0] if any(self.patronymic.fullmatch(x[0].rstrip(".")) for x in run) else [i for i, x in enumerate(run) if self.listed(x[0])]
                if anchors:
                    start = run[anchors[0]].start()
                    yield Span(start, run[-1].end(), self.role(text, start))
                run = []

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """What is found, and what is protected."""
        cyrillic = _CYRILLIC.search(text) is not None
        found, protected, low = [], [], lower(text)
        for k, m in self.sought.matches(text, low):
            if k >= len(self.detectors):
                protected.append(Span(m.start(), m.end(), None))
            elif cyrillic or self.detectors[k][2]:
                found.append(Span(m.start(), m.end(), self.detectors[k][0]))
        if cyrillic and not self.structured:
            found += [Span(start, end, "institution") for markers in self.institutions for start, end in markers.spans(text, low)]
            found += self.name_spans(text)
        return found, protected

    def redact(self, text: str, entities: list[Span] = ()) -> tuple[str, dict[str, int]]:
        """The text with placeholders and how many of each kind; never a value."""
        found, protected = self.spans(text)
        found += entities
        if not found:
            return text, {}
        found += protected
        out, at, counts = [], 0, {}
        for s in resolve(found):
            out += [text[at : s.start], known.PLACEHOLDERS[s.kind]]
            counts[s.kind] = counts.get(s.kind, 0) + 1
            at = s.end
        return "".join([*out, text[at:]]), counts

    def suspicions(self, text: str) -> list[tuple[str, int, str]]:
        """(type, position, reason) of what still looks like personal data; placeholders do not
        count. Anything structured is told as a date, names as a person. Clinical text that is never replaced is no name."""
        masked = _MARK.sub(lambda m: " " * len(m[0]), text)
        found = [("date", m.start(), "residual structured pattern") for _, m in self.residual.matches(masked)]
        for m in () if self.structured else _TOKEN.finditer(masked):
            word = m[0]
            if word[0] < "Ѐ" or not word[0].isupper() or self.skipped(word):
                continue
            if self.patronymic.fullmatch(word.rstrip(".")):
                found.append(("person", m.start(), "residual patronymic"))
            elif self.listed(word) and not any(p.fullmatch(word) for p in self.protected.patterns):
                found.append(("person", m.start(), "residual dictionary name"))
        return found


def plain(word: str) -> str:
    return word.strip().lower().replace("ё", "е")


def lexicon_of(words: DataFrame, most_bytes: int = 64 << 20) -> known.Lexicon:
    """The lexicon in a table (kind, word): kinds are first_name, surname, institution and
    no_name; others, nulls and blanks are passed over, repeats count once. Word lists go to
    every worker, so their size is looked at first: more than ``most_bytes`` is an error."""
    kinds = ("first_name", "surname", "institution", "no_name")
    rows = words.where(F.col("kind").isin(*kinds) & (F.trim("word") != "")).select("kind", "word").distinct()
    size = rows.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"word lists of {size} bytes; the bound is {most_bytes}")
    of: dict[str, list[str]] = {k: [] for k in kinds}
    for row in rows.orderBy("kind", "word").collect():
        of[row["kind"]].append(row["word"])
    return known.Lexicon(tuple(of["first_name"]), tuple(of["surname"]), tuple(of["institution"]), frozenset(of["no_name"]))


def plain_word(word: Column) -> Column:
    """A word as names are compared: trimmed, in lower case, ё as е."""
    return F.replace(F.lower(F.trim(word)), F.lit("ё"), F.lit("е"))


def stem_matches(words: DataFrame, names: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """(word, name) for each of the ``words`` and each of the ``names`` that it is a form of:
    their common beginning is of four letters at least and reaches all but the last two letters
    of the name and all but the last three of the word. They meet by their first four letters;
    the names are broadcast if they are small by their bytes, joined by shuffle if not. Nulls,
    shorter words and repeats give nothing more; one result for equal rows."""
    name = plain_word(F.col("name"))
    index = names.where(F.length(name) >= 4).select("name", name.alias("_name"), F.left(name, F.lit(4)).alias("_start")).distinct()
    size = index.agg(F.sum(F.octet_length("_name") + F.octet_length("name"))).first()[0] or 0
    word = plain_word(F.col("word"))
    asked = words.where(F.length(word) >= 4).select("word", word.alias("_word"), F.left(word, F.lit(4)).alias("_start")).distinct()
    met = asked.join(F.broadcast(index) if size <= most_bytes else index, "_start")
    least = F.greatest(F.lit(4), F.length("_name") - 2, F.length("_word") - 3)
    whole = F.least(F.length("_name"), F.length("_word")) >= least
    return met.where(whole & (F.left("_name", least) == F.left("_word", least))).select("word", "name")


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt anew over all cores, in several parts each: what is sequential inside a row
    should not be so for all rows. How many parts a file is read in tells nothing of their rows:
    a row group falls into one of them, and the others are empty."""
    parts = docs._jdf.queryExecution().toRdd().getNumPartitions()
    return docs.repartition(max(4 * docs.sparkSession.sparkContext.defaultParallelism, parts))


_OUT = "text string, counts map<string,int>, suspicions array<struct<type:string,position:int,reason:string>>"


def redact_documents(docs: DataFrame, text: str = "text", lexicon: known.Lexicon | DataFrame = known.USUAL, clock_time: bool = False, boundary: str = "ascii", entities: str | None = None, structured: bool = False) -> DataFrame:
    """``docs`` with the text normalised and redacted, ``removed_count``, ``removed_by_type``
    (map), ``suspicions`` and ``clean`` from the gate. ``entities`` names a column of further
    spans, array<struct<start:int,end:int,type:string>> by characters of the normalised text.
    Null and blank texts are not clean. ``lexicon`` may be a table (see ``lexicon_of``). With
    ``structured`` names and institutions are neither sought nor suspected. No shuffle."""
    lists = docs.sparkSession.sparkContext.broadcast(lexicon_of(lexicon) if isinstance(lexicon, DataFrame) else lexicon)
    whole = F.coalesce(normalize_text(F.col(text)), F.lit(""))
    more = F.col(entities) if entities else F.array().cast("array<struct<start:int,end:int,type:string>>")
    # without a digit, a number sign or a Cyrillic letter nothing can be found: such texts stay here
    asked = whole.rlike("[0-9№°А-Яа-яЁё]") | (F.size(more) > 0)
    found = docs.withColumns({text: whole, "_more": more}).withColumn("_red", _pass(lists, clock_time, boundary, structured)(F.when(asked, whole), F.col("_more")))
    rows = found.withColumns({
        text: F.coalesce("_red.text", text), "removed_by_type": F.coalesce("_red.counts", F.create_map().cast("map<string,int>")),
        "suspicions": F.coalesce("_red.suspicions", F.array().cast("array<struct<type:string,position:int,reason:string>>")),
    }).drop("_red", "_more")
    total = F.aggregate(F.map_values("removed_by_type"), F.lit(0), lambda a, x: a + x)
    return rows.withColumns({"removed_count": total, "clean": (F.size("suspicions") == 0) & F.col(text).rlike(r"(?U)\S")})


_SUSPICIONS = pa.list_(pa.struct([("type", pa.string()), ("position", pa.int32()), ("reason", pa.string())]))


def _entities(column: pa.ListArray) -> Iterator[list[Span]]:
    """The spans of each row."""
    cells, sizes = column.flatten(), column.value_lengths().to_pylist()
    all_spans = iter([Span(*e) for e in zip(*(cells.field(f).to_pylist() for f in ("start", "end", "type")))] if len(cells) else ())
    return (list(itertools.islice(all_spans, n or 0)) for n in sizes)


def _pass(lists: Broadcast[known.Lexicon], clock_time: bool, boundary: str, structured: bool = False):
    @F.arrow_udf(_OUT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        redactor = Redactor(lists.value, clock_time, boundary, structured)
        for texts, entities in batches:
            done, counts, found = [], [], []
            for t, own in zip(texts.to_pylist(), _entities(entities)):
                text, removed = redactor.redact(t, own) if t is not None else (None, {})
                done.append(text)
                counts.append(None if t is None else list(removed.items()))
                found.append(None if t is None else [dict(zip(("type", "position", "reason"), s)) for s in redactor.suspicions(text)])
            yield pa.StructArray.from_arrays([pa.array(done, texts.type), pa.array(counts, pa.map_(pa.string(), pa.int32())), pa.array(found, _SUSPICIONS)], ["text", "counts", "suspicions"])

    return run


def gate_split(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Clean rows, and the quarantine: all others without their text, with the reason. A row
    passes only if its verdict is true and its text is not blank: null verdicts, null and
    blank texts are held back."""
    blank = F.coalesce(trim_space(F.col(text)) == "", F.lit(True))
    passed = F.coalesce(F.col("clean"), F.lit(False)) & ~blank
    return docs.where(passed), docs.where(~passed).withColumn("reason", F.when(blank, "empty").otherwise("residual")).drop(text)


def removed_by_type_report(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("removed_by_type").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("removed"))


def redact_answers(answers: DataFrame, scope: str = "free_text", **options) -> tuple[DataFrame, DataFrame]:
    """Long answers (response_id, qid, idx, kind, code, custom_text) with their texts redacted,
    and a row for each response: ``passed`` and, if not, the ``blocked`` paths. Any text that
    the gate holds back blocks its whole response, whose answers are not among the result.
    ``scope`` "all_strings" redacts codes too. One shuffle, of paths only."""
    if scope not in ("free_text", "all_strings"):
        raise ValueError("scope is free_text or all_strings")
    fields = ["custom_text"] if scope == "free_text" else ["custom_text", "code"]
    out, bad = answers, F.array().cast("array<string>")
    for field in fields:
        path = F.concat(F.col("qid"), F.when(F.col("idx").isNotNull(), F.format_string("[%d]", "idx")).otherwise(""), F.lit(f".{field}" if field == "custom_text" else ""))
        given = F.coalesce(trim_space(F.col(field)) != "", F.lit(False))
        done = redact_documents(out.withColumn("_text", F.when(given, F.col(field))), "_text", **options)
        out = done.withColumns({field: F.when(given, F.col("_text")).otherwise(F.col(field)), f"_bad_{field}": F.when(given & ~F.col("clean"), path)})
        out = out.drop("_text", "removed_by_type", "removed_count", "suspicions", "clean")
        bad = F.concat(bad, F.array_compact(F.array(f"_bad_{field}")))
    verdicts = out.groupBy("response_id").agg(F.array_sort(F.flatten(F.collect_list(bad))).alias("blocked")).withColumn("passed", F.size("blocked") == 0)
    passed = verdicts.where("passed").select("response_id")
    return out.drop(*[f"_bad_{f}" for f in fields]).join(passed, "response_id", "left_semi"), verdicts
