"""Spans of structured personal data, found, held against each other and replaced in Spark
expressions alone: no Python worker, no shuffle.

A pattern's places come from what stands between its matches. Of all spans of a text those
stay that one fold over them in order keeps, and a second fold puts the text together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.functions import personal_data as known
from chartweave.functions.boundaries import java
from chartweave.operators.text import normalize_text

_CUT = "\x01"
SPAN = "struct<start:int,end:int,kind:string,priority:int,nth:int>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def match_spans(text: Column, pattern: str, kind: str | None, nth: int) -> Column:
    """array<SPAN> of a pattern's matches, by characters; ``kind`` null is protected text.
    ``pattern`` is for Spark's functions and matches nothing empty."""
    none = F.array().cast(f"array<{SPAN}>")
    priority = known.PRIORITY.get(kind, 10)

    def add(seen: Column, x: Column) -> Column:
        start = seen["end"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["hit"]).alias("end"), F.lit(kind).cast("string").alias("kind"), F.lit(priority).alias("priority"), F.lit(nth).alias("nth"))
        # behind the last match only text is left
        return F.when(x["hit"].isNull(), seen).otherwise(F.struct((start + x["hit"]).alias("end"), F.concat(seen["spans"], F.array(span)).alias("spans")))

    def placed(hits: Column) -> Column:
        # a pattern that is split by is compiled for every text, one that is replaced is not
        gaps = F.split(F.regexp_replace(F.translate(text, _CUT, " "), F.lit(pattern), F.lit(_CUT)), _CUT, -1)
        lengths = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
        return F.when(F.size(hits) > 0, F.aggregate(lengths, F.struct(F.lit(0).alias("end"), none.alias("spans")), add)["spans"]).otherwise(none)

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def resolve_spans(spans: Column) -> Column:
    """The spans that stay, in order: the earliest start first, of these the longest, then the
    highest priority, then the first found. A span that overlaps a kept one goes; a protected
    one takes the place of an unprotected one that it overlaps. Protected spans are not among
    the result; null spans give null, no spans none."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), (-s["priority"]).alias("under"), s["nth"].alias("nth"), s["kind"].alias("kind"))))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def fold(kept: Column, s: Column) -> Column:
        own = F.struct(s["start"].alias("start"), (-s["less"]).alias("end"), s["kind"].alias("kind"))
        now = lambda held: F.struct(F.concat(held, F.array(own)).alias("spans"), (-s["less"]).alias("end"), s["kind"].isNull().alias("protected"))
        others = F.slice(kept["spans"], 1, F.greatest(F.size(kept["spans"]) - 1, F.lit(0)))
        return F.when(s["start"] >= kept["end"], now(kept["spans"])).when(s["kind"].isNull() & ~kept["protected"], now(others)).otherwise(kept)

    start = F.struct(none.alias("spans"), F.lit(-1).alias("end"), F.lit(False).alias("protected"))
    return F.filter(F.aggregate(order, start, fold)["spans"], lambda s: s["kind"].isNotNull())


def structured_spans(text: Column, clock_time: bool = False, boundary: str = "ascii") -> Column:
    """All spans of the detectors and of protected text, with overlaps. A pattern looks only at
    texts that hold one of its anchors."""
    cyrillic = text.rlike("[А-Яа-яЁё]")
    none = F.array().cast(f"array<{SPAN}>")
    digit = text.rlike("[0-9]" if boundary == "ascii" else r"\p{N}")

    def guarded(found: Column, anchors: list | tuple, more: Column) -> Column:
        held = digit if isinstance(anchors, list) else text.rlike("(?iu)" + "|".join(w.replace(".", "[.]") for w in anchors[0]))
        return F.when(more & held, found).otherwise(none)

    parts = []
    for nth, (name, (kind, pattern)) in enumerate(known.DETECTORS.items()):
        if clock_time or name not in known.ON_REQUEST:
            parts.append(guarded(match_spans(text, java(pattern, boundary=boundary), kind, nth), known.ANCHORS[name], F.lit(True) if name in known.NUMERIC else cyrillic))
    for k, (p, anchors) in enumerate(zip(known.PROTECTED, known.PROTECTED_ANCHORS, strict=True)):
        parts.append(guarded(match_spans(text, java(p, boundary=boundary), None, len(known.DETECTORS) + k), anchors, F.lit(True)))
    return F.flatten(F.array(*parts))


def replace_spans(text: Column, spans: Column) -> Column:
    """``text`` with the placeholders of resolved ``spans``."""
    marks = F.create_map(*[F.lit(x) for pair in known.PLACEHOLDERS.items() for x in pair])

    def add(done: Column, s: Column) -> Column:
        return F.struct(F.concat(done["text"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.element_at(marks, s["kind"])).alias("text"), s["end"].alias("at"))

    return F.aggregate(spans, F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), add, lambda done: F.concat(done["text"], F.substring(text, done["at"] + 1, F.length(text))))


def redact_structured(docs: DataFrame, text: str = "text", clock_time: bool = False, boundary: str = "ascii") -> DataFrame:
    """``docs`` with the text normalised and structured personal data replaced (names and
    institutions need word lists: ``redaction.redact_documents``), and ``removed_count`` and
    ``removed_by_type`` (map). Null texts count as empty ones; columns of the new names are
    replaced. Plain expressions, no shuffle."""
    whole = F.coalesce(normalize_text(F.col(text)), F.lit(""))
    zero = F.create_map().cast("map<string,int>")

    def work(t: Column) -> Column:
        return once(resolve_spans(structured_spans(t, clock_time, boundary)), lambda kept: F.struct(replace_spans(t, kept).alias("text"), kept["kind"].alias("kinds")))

    asked = lambda t: F.when(t.rlike("[0-9№°А-Яа-яЁё]"), work(t)).otherwise(F.struct(t.alias("text"), F.array().cast("array<string>").alias("kinds")))
    done = docs.withColumn("_red", once(whole, asked))
    count = lambda kinds, k: F.size(F.filter(kinds, lambda x: x == k))
    by_type = F.map_from_entries(F.transform(F.array_distinct("_red.kinds"), lambda k: F.struct(k, count(F.col("_red.kinds"), k))))
    return done.withColumns({text: F.col("_red.text"), "removed_count": F.size("_red.kinds"), "removed_by_type": F.when(F.size("_red.kinds") > 0, by_type).otherwise(zero)}).drop("_red")
