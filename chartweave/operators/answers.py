"""Answers of questionnaires as a long table: defaults, visibility, phrases, metadata.

``answers`` has a row an entry: response_id, doc_type, qid, idx (place in a multiple choice),
kind (code, custom or text), code, custom_text. A questionnaire is configuration: small
tables of questions (doc_type, ord, qid, label, qtype, required, default, multi_prefix),
options (qid, value, phrase) and conditions (parent_qid, if_value, child_qid). Their joins are
left to the optimizer, which broadcasts them by their size. A response has at most the
entries of its questionnaire, so arrays by response are bounded by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.operators.history import trim_space
from chartweave.operators.text import diagnosis_class_any, normalize_stems


def build_defaults(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """A ``code`` entry for each question with a default; a multiple choice without one is
    the empty list, which has no entries."""
    asked = responses.select("response_id", "doc_type").join(questions.where("default IS NOT NULL"), "doc_type")
    return asked.select("response_id", "doc_type", "qid", F.lit(0).alias("idx"), F.lit("code").alias("kind"), F.col("default").alias("code"), F.lit(None).cast("string").alias("custom_text"))


def question_states(responses: DataFrame, answers: DataFrame, questions: DataFrame, conditions: DataFrame) -> DataFrame:
    """(response_id, doc_type, qid, ord, qtype, required, visible) for every question of every
    response. A question is visible if no condition names it, or if a visible parent has the
    value of one that does. One aggregate by response; the cascade runs inside a row, as
    often as there are conditions at most."""
    entry = F.concat_ws("\u0001", "qid", F.when(F.col("kind") == "custom", "__custom__").otherwise(F.col("code")))
    chosen = answers.groupBy("response_id").agg(F.collect_set(entry).alias("_chosen"))
    rule = F.struct("parent_qid", F.concat_ws("\u0001", "parent_qid", "if_value").alias("entry"), "child_qid")
    parents = questions.select("doc_type", F.col("qid").alias("parent_qid")).distinct()
    rules = conditions.join(parents, "parent_qid").groupBy("doc_type").agg(F.collect_list(rule).alias("_rules"))
    no_rules = F.array().cast("array<struct<parent_qid:string,entry:string,child_qid:string>>")
    config = questions.groupBy("doc_type").agg(F.collect_set("qid").alias("_all")).join(rules, "doc_type", "left").withColumn("_rules", F.coalesce("_rules", no_rules))
    rows = responses.select("response_id", "doc_type").join(chosen, "response_id", "left").join(config, "doc_type")
    own = F.coalesce(F.col("_chosen"), F.array().cast("array<string>"))
    start = F.array_except("_all", F.transform("_rules", lambda r: r["child_qid"]))

    def grown(seen: Column, _: Column) -> Column:
        fired = F.filter("_rules", lambda r: F.array_contains(seen, r["parent_qid"]) & F.array_contains(own, r["entry"]))
        return F.array_union(seen, F.array_intersect("_all", F.transform(fired, lambda r: r["child_qid"])))

    seen = F.aggregate("_rules", start, grown)
    shown = rows.select("response_id", "doc_type", seen.alias("_seen"))
    asked = shown.join(questions.select("doc_type", "qid", "ord", "qtype", "required"), "doc_type")
    return asked.withColumn("visible", F.array_contains("_seen", F.col("qid"))).drop("_seen")


def clear_hidden(answers: DataFrame, states: DataFrame) -> DataFrame:
    """Answers without those to hidden questions; a hidden multiple choice is left empty."""
    return answers.join(states.where("NOT visible").select("response_id", "qid"), ["response_id", "qid"], "left_anti").select(*answers.columns)


def answered() -> Column:
    """Whether an entry counts: customs and texts with more than white space, any code."""
    return F.when(F.col("kind") == "custom", trim_space(F.coalesce("custom_text", F.lit(""))) != "").otherwise(trim_space(F.coalesce("code", F.lit(""))) != "")


def completeness_report(answers: DataFrame, states: DataFrame) -> DataFrame:
    """(response_id, answered, total, missing) over required visible questions; missing ones
    in their order."""
    given = answers.where(answered()).select("response_id", "qid").distinct().withColumn("_given", F.lit(True))
    rows = states.join(given, ["response_id", "qid"], "left")
    due = F.col("required") & F.col("visible")
    lacking = F.when(due & F.col("_given").isNull(), F.struct("ord", "qid"))
    return rows.groupBy("response_id").agg(
        F.count_if(due & F.col("_given").isNotNull()).alias("answered"), F.count_if(due).alias("total"), F.transform(F.sort_array(F.collect_list(lacking)), lambda x: x["qid"]).alias("missing")
    )


def prepare_answers(answers: DataFrame, states: DataFrame) -> DataFrame:
    """Entries that count, of visible questions."""
    return answers.where(answered()).join(states.where("visible").select("response_id", "qid"), ["response_id", "qid"], "left_semi").select(*answers.columns)


def map_answers(answers: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """(response_id, lines, phrases): a line a question in the questionnaire's order, free
    texts last. Codes become their option's phrase, unknown codes go; an own variant reads
    ``label: text.``; a multiple choice is its prefix and its phrases. One shuffle."""
    asked = answers.join(questions.select("doc_type", "qid", "ord", "label", "qtype", "multi_prefix"), ["doc_type", "qid"])
    found = asked.join(options.withColumnRenamed("value", "code"), ["qid", "code"], "left")
    own = F.when(F.col("kind") == "custom", trim_space(F.col("custom_text"))).when(F.col("qtype") == "text", trim_space(F.col("code")))
    part = F.when((F.col("kind") == "custom") | (F.col("qtype") == "text"), own).otherwise(F.col("phrase"))
    rows = found.select("response_id", "qid", "qtype", "ord", "label", "multi_prefix", "idx", part.alias("part"), own.isNotNull().alias("own")).where("part <> ''").repartition("response_id")
    parts = F.sort_array(F.collect_list(F.struct("idx", "part", "own")))
    told = rows.groupBy("response_id", "qid", "qtype", "ord", "label", "multi_prefix").agg(parts.alias("_parts"))
    texts = F.transform("_parts", lambda p: p["part"])
    single = F.when(F.col("_parts")[0]["own"], F.concat("label", F.lit(": "), texts[0], F.lit("."))).otherwise(texts[0])
    line = F.when(F.col("qtype") == "multiselect", F.concat(F.coalesce("multi_prefix", F.lit("")), F.array_join(texts, ", "), F.lit("."))).otherwise(single)
    placed = F.sort_array(F.collect_list(F.struct((F.col("qtype") == "text").alias("last"), "ord", line.alias("line"), texts.alias("texts"))))
    return told.groupBy("response_id").agg(placed.alias("_p")).select("response_id", F.transform("_p", lambda p: p["line"]).alias("lines"), F.flatten(F.transform("_p", lambda p: p["texts"])).alias("phrases"))


def answer_metadata(answers: DataFrame, questions: DataFrame, codes: DataFrame, stems: list[tuple[str, str]], syndrome: str = "syndrome", diagnosis: str = "diagnosis") -> DataFrame:
    """(response_id, dynamics, syndrome, diagnosis_class): ``codes`` (qid, code, field, value)
    tells what codes mean; of several questions on one field the later one holds. A syndrome
    in own words is brought to its canonical form; the class comes from the diagnosis text."""
    placed = answers.join(questions.select("doc_type", "qid", "ord"), ["doc_type", "qid"]).join(codes, ["qid", "code"], "left")
    is_code, is_own = F.col("kind") != "custom", F.col("kind") == "custom"
    moved = F.when(is_code & (F.col("field") == "dynamics"), F.col("value"))
    named = F.when(is_own & (F.col("qid") == syndrome), normalize_stems(F.col("custom_text"), stems)).when(is_code & (F.col("field") == "syndrome"), normalize_stems(F.col("value"), stems))
    told = F.when(F.col("qid") == diagnosis, diagnosis_class_any(F.when(is_own, F.col("custom_text")).otherwise(F.col("code"))))

    def latest(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.struct("ord", "idx")))

    return placed.groupBy("response_id").agg(latest(moved).alias("dynamics"), latest(named).alias("syndrome"), latest(told).alias("diagnosis_class"))


def safe_title(type_label: Column, syndrome: Column, dynamics: Column) -> Column:
    """Type, syndrome and dynamics between middle dots; absent ones are left out."""
    return F.concat_ws(" · ", type_label, F.nullif(syndrome, F.lit("")), F.translate(F.nullif(dynamics, F.lit("")), "_", " "))


def query_text(hint: Column, syndrome: Column, phrases: Column) -> Column:
    """The text a search is made with."""
    return trim_space(F.concat_ws(" ", hint, F.nullif(syndrome, F.lit("")), F.array_join(phrases, " ")))


def free_text_paths(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(response_id, path, text) of all that was written freely: own variants and text fields."""
    rows = answers.join(questions.select("doc_type", "qid", "qtype"), ["doc_type", "qid"])
    place = F.when(F.col("qtype") == "multiselect", F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("]"))).otherwise(F.lit(""))
    own = F.col("kind") == "custom"
    path = F.when(own, F.concat("qid", place, F.lit(".custom_text"))).otherwise(F.col("qid"))
    text = trim_space(F.when(own, F.col("custom_text")).otherwise(F.col("code")))
    return rows.where(own | (F.col("qtype") == "text")).select("response_id", path.alias("path"), text.alias("text")).where("text <> ''")


def check_schema(questions: DataFrame, options: DataFrame, conditions: DataFrame) -> DataFrame:
    """(problem, qid, detail) a fault: duplicate ids, choices without options, conditions on
    unknown children, without a value, or with one that the parent does not offer."""
    ids = questions.select("qid", "qtype").distinct()
    twice = questions.groupBy("doc_type", "qid").count().where("count > 1").select(F.lit("duplicate_id").alias("problem"), "qid", F.col("doc_type").alias("detail"))
    bare = ids.where("qtype IN ('select', 'multiselect')").join(options, "qid", "left_anti").select(F.lit("no_options").alias("problem"), "qid", F.col("qtype").alias("detail"))
    lost = conditions.join(ids.withColumnRenamed("qid", "child_qid"), "child_qid", "left_anti").select(F.lit("dangling_child").alias("problem"), F.col("parent_qid").alias("qid"), F.col("child_qid").alias("detail"))
    empty = F.coalesce("if_value", F.lit("")) == ""
    void = conditions.where(empty).select(F.lit("empty_trigger").alias("problem"), F.col("parent_qid").alias("qid"), F.col("child_qid").alias("detail"))
    offered = options.select(F.col("qid").alias("parent_qid"), F.col("value").alias("if_value"))
    flags = ids.where("qtype = 'boolean'").select(F.col("qid").alias("parent_qid"), F.explode(F.array(F.lit("true"), F.lit("false"))).alias("if_value"))
    odd = conditions.where(~empty).join(offered.unionByName(flags), ["parent_qid", "if_value"], "left_anti").select(F.lit("unknown_trigger").alias("problem"), F.col("parent_qid").alias("qid"), F.col("if_value").alias("detail"))
    return twice.unionByName(bare).unionByName(lost).unionByName(void).unionByName(odd)
