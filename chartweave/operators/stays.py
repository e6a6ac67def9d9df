"""Planning stays day by day: periods, day spine, nearest days, phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartweave.operators.history import trim_space

MOST_DAYS = 31


def validate_periods(stays: DataFrame, most: int = MOST_DAYS) -> DataFrame:
    """``stays`` (admission, date_from, date_to as dates or ISO texts) with ``ok`` and
    ``reason``; the three columns become dates, null where they are none. Dates stay as they
    are, without a way through texts."""
    names = ("admission", "date_from", "date_to")
    rows = stays.withColumns({c: F.try_to_date(F.col(c).cast("string"), "yyyy-MM-dd") for c in names if stays.schema[c].dataType != T.DateType()})
    reason = (
        F.when(F.col("admission").isNull() | F.col("date_from").isNull() | F.col("date_to").isNull(), "invalid_date")
        .when(F.col("date_from") < F.col("admission"), "before_admission")
        .when(F.col("date_to") < F.col("date_from"), "reversed")
        .when(F.datediff("date_to", "date_from") + 1 > most, "too_long")
    )
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def plan_days(stays: DataFrame) -> DataFrame:
    """One row a day of every valid stay: ``day``, ``day_number`` from the admission on,
    ``doc_type`` (every tenth day is an exam). Periods are bounded, so rows are too."""
    days = stays.where("ok").select("*", F.explode(F.sequence("date_from", "date_to")).alias("day"))
    number = F.datediff("day", "admission") + F.lit(1)
    return days.withColumn("day_number", number).withColumn("doc_type", F.when((F.col("day_number") > 0) & (F.col("day_number") % 10 == 0), "exam_10d").otherwise("daily"))


def plan_counts(days: DataFrame) -> DataFrame:
    return days.groupBy("stay_id").agg(F.count_if(F.col("doc_type") == "daily").alias("daily"), F.count_if(F.col("doc_type") == "exam_10d").alias("exams"))


def split_sentences(text: Column) -> Column:
    """Sentences: parts after a full stop and white space or after a line end, trimmed, not empty."""
    return F.filter(F.transform(F.split(text, r"(?<=\.)\s+|(?<=\n)"), trim_space), lambda s: s != "")


def sentence_rows(stays: DataFrame, text: str = "narrative") -> DataFrame:
    return stays.select("stay_id", F.posexplode(split_sentences(F.col(text))).alias("pos", "sentence"))


def nearest_days(items: DataFrame, days: DataFrame) -> DataFrame:
    """Items (stay_id, item, anchor) with the nearest planned ``day`` of their stay; of two
    equally near days the earlier. A stay's days are first put into one sorted array, so an
    item meets one row. Where the array has no gap the day follows by arithmetic."""
    spans = days.groupBy("stay_id").agg(F.min("day").alias("_from"), F.max("day").alias("_to"), F.array_sort(F.collect_set("day")).alias("_all"))
    met = items.join(spans, "stay_id")
    inside = F.greatest(F.col("_from"), F.least(F.col("_to"), F.col("anchor")))
    gapless = F.size("_all") == F.datediff("_to", "_from") + F.lit(1)
    near = F.array_min(F.transform("_all", lambda d: F.struct(F.abs(F.datediff(d, F.col("anchor"))).alias("gap"), d.alias("day"))))
    day = F.when(F.col("anchor").isNull(), F.col("_from")).when(gapless, inside).otherwise(near["day"])
    return met.select("stay_id", "item", "anchor", day.alias("day"))


def period_percent(days: DataFrame) -> DataFrame:
    """``days`` with ``place`` in the period and ``percent`` of it, 0 on the first day and 100
    on the last; a single day is at 0."""
    order = Window.partitionBy("stay_id").orderBy("day")
    rows = days.withColumns({"place": F.row_number().over(order), "_days": F.count(F.lit(1)).over(Window.partitionBy("stay_id"))})
    percent = F.when(F.col("_days") > 1, F.round((F.col("place") - 1) * 100.0 / (F.col("_days") - 1))).otherwise(F.lit(0.0))
    return rows.withColumn("percent", percent).drop("_days")


def weekend_recap(days: DataFrame) -> DataFrame:
    """``days`` with ``recap``: a Monday whose Saturday and Sunday belong to the period."""
    before = Window.partitionBy("stay_id").orderBy("day").rowsBetween(-2, -1)
    both = F.array_contains(F.collect_list("day").over(before), F.date_sub("day", 2)) & F.array_contains(F.collect_list("day").over(before), F.date_sub("day", 1))
    return days.withColumn("recap", (F.dayofweek("day") == 2) & both)


def weekend_note(days: DataFrame, first_days: int = 3) -> DataFrame:
    """``days`` with ``weekend_from``: the Saturday of the weekend, for Saturdays and Sundays
    after the first days of the stay."""
    saturday = F.when(F.dayofweek("day") == 7, F.col("day")).when(F.dayofweek("day") == 1, F.date_sub("day", 1))
    return days.withColumn("weekend_from", F.when(F.col("day_number") > first_days, saturday))


def pick_rotated(pool: Column, index: Column, count: int) -> Column:
    """``count`` entries of a pool from ``index`` on, round and round; none from an empty pool."""
    n = F.size(pool)
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.element_at(pool, F.pmod(index + i, n) + F.lit(1)))
    return F.when(n > 0, picks).otherwise(F.array().cast("array<string>"))


def classify_sentences(sentences: DataFrame, rules: list[tuple[str, str]], otherwise: str) -> DataFrame:
    """``sentences`` with ``kind``: that of the first rule (pattern, kind) found in it."""
    ordered = [F.when(F.col("sentence").rlike("(?iu)" + pattern), F.lit(kind)) for pattern, kind in rules]
    return sentences.withColumn("kind", F.coalesce(*ordered, F.lit(otherwise)))


def extract_facts(classified: DataFrame, skip: str = "skip", same: int = 48) -> DataFrame:
    """(stay_id, kind, pos, fact): sentences without their closing marks, the first of those
    of a kind that begin with the same ``same`` characters in any case. Partial minima are
    taken before the shuffle, so repeats do not travel."""
    facts = classified.where(F.col("kind") != skip).withColumn("fact", F.regexp_replace("sentence", r"[.;]+$", ""))
    first = F.min(F.struct("pos", "fact")).alias("f")
    return facts.groupBy("stay_id", "kind", F.lower(F.substring("fact", 1, same)).alias("_key")).agg(first).select("stay_id", "kind", "f.pos", "f.fact")


def dated_snippets(stays: DataFrame, default_year: Column, text: str = "narrative", least: int = 8) -> DataFrame:
    """(stay_id, day, snippet): each day.month[.year] mark with the text up to the next one,
    if longer than ``least``; marks without a year get ``default_year``, no dates go."""
    mark = r"\d{1,2}\.\d{1,2}(?:\.(?:\d{4}|\d{2}))?"
    parts = F.split(F.col(text), rf"(?<![0-9A-Za-zА-Яа-я.])(?={mark}(?![0-9]))")
    rows = stays.select("stay_id", default_year.cast("string").alias("_year"), F.explode(parts).alias("_part"))
    found = F.split(F.regexp_extract("_part", f"^({mark})(?![0-9])", 1), r"\.")
    year = F.coalesce(F.try_element_at(found, F.lit(3)), F.col("_year"))
    whole = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    day = F.try_to_date(F.concat_ws("-", whole, F.lpad(F.try_element_at(found, F.lit(2)), 2, "0"), F.lpad(F.try_element_at(found, F.lit(1)), 2, "0")), "yyyy-MM-dd")
    told = rows.withColumns({"day": day, "snippet": trim_space(F.regexp_replace("_part", f"^{mark}(?![0-9])", ""))})
    return told.where(F.col("day").isNotNull() & (F.length("snippet") > least)).select("stay_id", "day", "snippet")


def take_unused(days: DataFrame, pool: DataFrame) -> DataFrame:
    """(stay_id, day, item): the n-th entry of a stay's pool (item, pos; equal items once) goes
    to its n-th day, so no entry is used twice. A stay has few days and entries."""
    first = pool.groupBy("stay_id", "item").agg(F.min("pos").alias("pos"))
    placed = first.withColumn("_n", F.row_number().over(Window.partitionBy("stay_id").orderBy("pos", "item")))
    numbered = days.select("stay_id", "day").withColumn("_n", F.row_number().over(Window.partitionBy("stay_id").orderBy("day")))
    return numbered.join(placed, ["stay_id", "_n"]).select("stay_id", "day", "item")


def forbidden_items(observed: DataFrame, most: int = 22) -> DataFrame:
    """(stay_id, day, forbidden): what was observed (day, item) on the other days of the stay
    and not on this one, in the order of days, each once, the first ``most`` as the feature
    asks. One shuffle; a stay's rows are bounded by its days."""
    everything = F.sort_array(F.collect_set(F.struct("day", "item")))
    rows = observed.groupBy("stay_id").agg(everything.alias("_all"))
    each = rows.select("stay_id", "_all", F.explode(F.array_distinct(F.transform("_all", lambda x: x["day"]))).alias("day"))
    own = F.transform(F.filter("_all", lambda x: x["day"] == F.col("day")), lambda x: x["item"])
    rest = F.array_distinct(F.transform("_all", lambda x: x["item"]))
    return each.select("stay_id", "day", F.slice(F.array_except(rest, own), 1, most).alias("forbidden"))
