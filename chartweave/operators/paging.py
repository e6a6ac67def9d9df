"""Pages by key, and search of titles by an index of their parts.

A deep page by offset sorts all that stands before it. A directory of pages has the first key
of every page of every group; it is made once, by a range sort and running counts, and then a
page is what a filter by key leaves of the table, cut to its size in each task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from chartweave.operators.history import top_level_only, with_children
from chartweave.sources.scratch import stash

#: (column, whether it descends), the last one an id that no two rows share.
Order = list[tuple[str, bool]]
NEWEST: Order = [("created_at", True), ("id", True)]


def _sorted(order: Order) -> list[Column]:
    """Nulls stand last where a column descends, first where it ascends."""
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]


def behind(order: Order, key: Row | dict, inclusive: bool = False) -> Column:
    """Whether a row stands behind ``key`` (or at it) in ``order``: a filter that reaches the scan."""
    out = F.lit(inclusive)
    for c, down in reversed(order):
        column, value = F.col(c), F.lit(key[c])
        if key[c] is None:
            later, same = (F.lit(False) if down else column.isNotNull()), column.isNull()
        elif down:
            later, same = (column < value) | column.isNull(), column == value
        else:
            later, same = column > value, column == value
        out = later | (same & out)
    return F.coalesce(out, F.lit(False))


def page_after(rows: DataFrame, order: Order, key: Row | dict | None, size: int) -> DataFrame:
    """The ``size`` rows behind ``key`` (null: the first ones). No task keeps more than a page."""
    return (rows if key is None else rows.where(behind(order, key))).orderBy(*_sorted(order)).limit(size)


def page_directory(rows: DataFrame, group: str | None, order: Order, size: int) -> DataFrame:
    """(group, page, total, rows, first key) of all pages of ``size`` rows of every group
    (``group`` null: of the table); ``total`` is the number of the group's rows. Only the keys
    are moved: a range sort deals the rows of one group over tasks, a running count over the
    small table of (group, task) numbers them. Null is a group of its own."""
    names = [c for c, _ in order]
    keys = rows.select(F.col(group).alias("_group") if group else F.lit(0).alias("_group"), *names)
    by = [F.col("_group").asc_nulls_first(), *_sorted(order)]
    lines = stash(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_line", F.monotonically_increasing_id()), "pages")
    lines = lines.withColumn("_part", F.shiftright("_line", 33))
    parts = lines.groupBy("_group", "_part").agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("total"))
    placed = lines.join(starts, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn("_at", F.col("_line") + F.col("_shift"))
    page = F.floor(F.col("_at") / size).cast("long")
    heads = placed.where(F.col("_at") % size == 0).select(*([F.col("_group").alias(group)] if group else []), page.alias("page"), "total", F.least(F.lit(size), F.col("total") - F.col("_at")).alias("rows"), *names)
    return heads


def page_of(rows: DataFrame, order: Order, size: int, first: Row | dict | None) -> DataFrame:
    """The page that begins with the key ``first``, a row of the directory (null: no such page)."""
    if first is None:
        return rows.limit(0)
    return rows.where(behind(order, first, inclusive=True)).orderBy(*_sorted(order)).limit(size)


def history_after(requests: DataFrame, owner=None, key: Row | dict | None = None, size: int = 20) -> DataFrame:
    """The page of newest top-level requests behind ``key``, with their children counted: the
    page is cut first, and only children of its rows are counted. ``size`` is bounded by the caller's
    ``clamp_page``."""
    mine = top_level_only(requests) if owner is None else top_level_only(requests).where(F.col("doctor_id") == F.lit(owner))
    cut = page_after(mine, NEWEST, key, size)
    kids = requests.where("parent_request_id IS NOT NULL").join(F.broadcast(cut.select(F.col("id").alias("parent_request_id"))), "parent_request_id", "left_semi")
    return with_children(cut.unionByName(kids)).orderBy(*_sorted(NEWEST))


#: Characters of the parts that titles are indexed by.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; none of a shorter text."""
    n = F.length(text) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _plain(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def title_index(rows: DataFrame, row_id: str = "id", title: str = "title_safe") -> DataFrame:
    """(gram, id): the distinct runs of 1, 2 and 3 characters of every title, in lower case."""
    text = _plain(F.col(title))
    grams = F.array_distinct(F.flatten(F.array(*[_grams(text, k) for k in range(1, GRAM + 1)])))
    return rows.select(F.col(row_id).alias("id"), F.explode(grams).alias("gram")).select("gram", "id")


def title_candidates(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id): titles that hold the rarest run of each search text (trimmed, lower case).
    A text of less than three characters is its own run; a run that no title has ends the
    search. Texts are distinct; empty ones are left to the caller."""
    asked = queries.select(F.lower(F.trim("query")).alias("query")).where(F.length("query") > 0).distinct()
    size = F.least(F.lit(GRAM), F.length("query"))
    parts = asked.select("query", F.explode(F.transform(F.sequence(F.lit(1), F.length("query") - size + 1), lambda i: F.substring(F.col("query"), i, size))).alias("gram")).distinct()
    often = index.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("titles"))
    known = parts.join(often, "gram", "left").select("query", "gram", F.coalesce("titles", F.lit(0)).alias("titles"))
    rarest = known.groupBy("query").agg(F.min(F.struct("titles", "gram")).alias("r")).select("query", "r.gram", "r.titles").where("titles > 0")
    return index.join(rarest.select("query", "gram"), "gram").select("query", "id")


def search_many_titles(rows: DataFrame, index: DataFrame, queries: DataFrame, row_id: str = "id", title: str = "title_safe") -> DataFrame:
    """(query, id, title) for many search texts at once: candidates of the index that do hold
    the text. Equal to looking for each text in every title; null titles are empty, null search
    texts give nothing, an empty search text every row, as the scan does."""
    found = title_candidates(index, queries)
    text = rows.select(F.col(row_id).alias("id"), F.col(title).alias("title"))
    hits = found.join(text, "id").where(F.contains(_plain(F.col("title")), F.col("query"))).select("query", "id", "title")
    empty = queries.where(F.trim("query") == "").limit(1).select(F.lit("").alias("query"))
    # one row at most stands on the left
    return hits.unionByName(text.join(F.broadcast(empty)).select("query", "id", "title"))
