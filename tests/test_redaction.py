import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartweave.functions import personal_data as known
from chartweave.functions.boundaries import java
from chartweave.operators import redaction as r
from chartweave.plans import corpus

R = r.Redactor()


def done(text, **options):
    return (r.Redactor(**options) if options else R).redact(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("с 01.02.2024-05.02.2024, затем 3/4/24, тел. 8 812 123-45-67, карта 20252184, 123-456-789 00", "с [ПЕРИОД], затем [ДАТА], тел. [ТЕЛЕФОН], карта [НОМЕР_ДОКУМЕНТА], [ДОКУМЕНТ]"),
        ("«06» октября 2025 г., 6 мая, 2024-2025 гг., 10 час. 18 мин.", "[ДАТА], [ДАТА], [ДАТА], [ВРЕМЯ]"),
        ("медицинская карта № 2025/7, протокол № 442.3, направление № 15", "[НОМЕР_ДОКУМЕНТА], [НОМЕР_ДОКУМЕНТА], направление [НОМЕР_ДОКУМЕНТА]"),
        ("ей 14 лет, в возрасте до пятнадцати лет, адрес: дом, кв. 7", "ей [ВОЗРАСТ], [ВОЗРАСТ], [АДРЕС]"),
        ("в ГБУЗ № 7 «Первая больница» и в больнице, улучшении и линии", "в [УЧРЕЖДЕНИЕ] и в [УЧРЕЖДЕНИЕ], улучшении и линии"),
        ("врач Петрова А.С. и И.И. Сидоров", "врач [ФИО_ВРАЧА] и [ФИО_ВРАЧА]"),
        ("пациента Иванова Петра Сергеевича, мать: Ольга Петровна", "пациента [ПАЦИЕНТ], мать: [РОДИТЕЛЬ]"),
        ("Кузнецовой дали отдых", "[ФИО] дали отдых"),
        ("Наличие паралича. Различие: Паралич", "Наличие паралича. Различие: Паралич"),
        ("АД 120/80, 18-21, 0.40, 25 мг, F20.0, в 23:00, ЧСС 70", "АД 120/80, 18-21, 0.40, 25 мг, F20.0, в 23:00, ЧСС 70"),
    ],
)
def test_what_is_replaced(text, want):
    assert done(text)[0] == want


def test_counts_never_values_and_options():
    text, counts = done("14 лет и 15 лет, 8 812 123-45-67")
    assert counts == {"age": 2, "phone": 1} and text == "[ВОЗРАСТ] и [ВОЗРАСТ], [ТЕЛЕФОН]"
    assert done("в 23:00", clock_time=True) == ("в [ВРЕМЯ]", {"time": 1})
    # Cyrillic neighbours of a border count only in Unicode's sense
    hidden = "паспорт 4010 123456, с 5 мая по 6 мая, ул. Ленина"
    assert "[ПЕРИОД]" not in done(hidden)[0]
    assert done(hidden, boundary="unicode")[0] == "[ДОКУМЕНТ], [ПЕРИОД], [АДРЕС]"


def test_role_window_is_of_bytes():
    assert done("врач " + "а" * 35 + " Петрова А.С.")[1] == {"doctor": 1}
    assert done("врач " + "а" * 40 + " Петрова А.С.")[1] == {"person": 1}


def test_spans_that_stay():
    s = r.Span
    assert r.resolve([s(5, 30, "address"), s(0, 8, "age"), s(40, 42, "age"), s(40, 42, "person")]) == [s(0, 8, "age"), s(40, 42, "person")]
    assert r.resolve([s(0, 10, "date"), s(4, 12, None), s(11, 20, "age"), s(30, 40, None), s(35, 50, "date")]) == []
    assert r.resolve([s(0, 10, None), s(10, 12, "age")]) == [s(10, 12, "age")]


def test_residues_hold_back():
    kinds = [k for k, _, _ in R.suspicions("осталось 01.02.24, 14 лет, Петрович, Смирнова, [ФИО_ВРАЧА] [X_1] Паралич")]
    assert kinds == ["date", "date", "person", "person"]
    assert R.suspicions("[ДАТА] и [ПЕРИОД], состояние ровное") == []


def test_recall_of_a_note():
    note = "Пациент Иванов Пётр Сергеевич, 14 лет, карта № 2025, тел. 8 812 123-45-67, СНИЛС 123-456-789 00, 6 октября 2025 г., ГБУЗ «Первая», лечащий врач Петрова А.С."
    text, counts = done(note)
    assert set(counts) >= {"patient", "age", "doc_number", "phone", "id_doc", "date", "institution", "doctor"}
    assert not any(x in text for x in ("Иванов", "Пётр", "2025", "8 812", "Первая", "Петрова")) and R.suspicions(text) == []


def test_python_and_spark_agree_on_detectors(spark):
    texts = [f.replace("{date}", "01.02.2024").replace("{key}", "7").replace("{long}", "20000007").replace("{cc}", "05").replace("{c}", "3") for f in corpus.FORMS if f]
    for boundary in ("ascii",):
        rows = spark.createDataFrame([(t,) for t in texts], "text string")
        got = rows.select("text", *[r.detector_count(F.col("text"), n).alias(n) for n in known.DETECTORS]).collect()
        red = r.Redactor(clock_time=True, boundary=boundary)
        for row in got:
            assert [row[n] for n in known.DETECTORS] == [len(p.findall(row.text)) for _, p, _ in red.detectors]
    assert spark.sql("SELECT 'аб' AS x").where(F.col("x").rlike(java(r"\bаб", boundary="unicode"))).count() == 1


def test_documents_fail_closed(spark):
    rows = spark.createDataFrame([(1, "дата 01.02.2024"), (2, ""), (3, None), (4, "чисто"), (5, " \n"), (6, "plain text"), (7, "Петров Иван Петрович")], "doc_id long, text string")
    once = r.redact_documents(rows)
    got = {x.doc_id: x for x in once.collect()}
    assert got[1].text == "дата [ДАТА]" and got[1].removed_count == 1 and got[1].clean and got[4].clean and got[7].text == "[ФИО]"
    clean, quarantine = r.gate_split(once)
    assert {x.doc_id for x in clean.collect()} == {1, 4, 6, 7}
    assert {(x.doc_id, x.reason) for x in quarantine.collect()} == {(2, "empty"), (3, "empty"), (5, "empty")} and "text" not in quarantine.columns
    # a verdict that is missing is no pass
    odd = once.withColumn("clean", F.when(F.col("doc_id") == 4, F.lit(None)).when(F.col("doc_id") == 2, True).otherwise(False))
    assert r.gate_split(odd)[0].count() == 0 and r.gate_split(odd)[1].where("doc_id = 4").first().reason == "residual"
    again = r.redact_documents(clean.select("doc_id", "text"))
    assert again.agg({"removed_count": "sum"}).first()[0] == 0
    assert r.redact_documents(rows.limit(0)).count() == 0


def test_entities_from_outside(spark):
    rows = spark.createDataFrame([(1, "к Зубру пришли", [(2, 7, "person")]), (2, "пусто", [])], "doc_id long, text string, found array<struct<start:int,end:int,type:string>>")
    assert [x.text for x in r.redact_documents(rows, entities="found").orderBy("doc_id").collect()] == ["к [ФИО] пришли", "пусто"]


def test_answers_block_as_a_whole(spark, monkeypatch):
    rows = [(1, "a", 0, "custom", None, "ему 14 лет"), (1, "b", None, "code", "x", None), (2, "a", None, "custom", None, "Петрович 9.9.25"), (2, "c", 3, "custom", None, "чисто")]
    table = spark.createDataFrame(rows, "response_id long, qid string, idx int, kind string, code string, custom_text string")
    passed, verdicts = r.redact_answers(table)
    assert {(x.qid, x.custom_text) for x in passed.where("response_id = 1").collect()} == {("a", "ему [ВОЗРАСТ]"), ("b", None)}
    assert all(x.passed for x in verdicts.collect())
    plain = r.redact_documents
    monkeypatch.setattr(r, "redact_documents", lambda df, text, **o: plain(df, text, **o).withColumn("clean", F.col("clean") & ~F.col(text).contains("чисто")))
    passed, verdicts = r.redact_answers(table)
    assert {x.response_id for x in passed.collect()} == {1}
    assert {(x.response_id, x.passed, tuple(x.blocked)) for x in verdicts.collect()} == {(1, True, ()), (2, False, ("c[3].custom_text",))}
    with pytest.raises(ValueError):
        r.redact_answers(table, scope="none")


def pieces(rng):
    parts = "5 мая|«06» октября|2025 г.|2024-2025 гг.|с 5 мая по 6 июня 2024 г.|x с 12 янв по 3 фев|7мая 2024 г.|+7 812 123-45-67|8-911-123-45-67|8|+7|карта № 7/2|истории болезни №5|протокол ВК № 44.3|N° 15|№|12345678|123-456-789 00|xпаспорт 4010 123456|aполис 1234567|14 лет|14-ти лет|в  возрасте до пяти лет|проживает по адресу: дом, кв. 7|адрес д. 5|aул. Ленина, д. 5|xг. Москва|10 час. 18 мин.|23:00|1.02-9.02.2024|2024-01-09|3/4/24|25 мг|3,5 г|F20.0|Tab. Aspirin|Litii|ЭКГ|T|АД|qtc|\n|  |.|,|, |ГБУЗ|ГБУЗ № 7 «Первая»|больницы №3|больницах|ПНД1|Больница|İ|ß|²|٣ мая"
    words = parts.split("|")
    return "".join(words[k] + [" ", "", "\t", "  "][rng.integers(4)] for k in rng.integers(0, len(words), rng.integers(1, 12)))


@pytest.mark.parametrize("boundary", ["ascii", "unicode"])
def test_places_are_those_of_a_full_search(boundary):
    """What the automaton lets be tried finds what searching everywhere finds."""
    rng = np.random.default_rng(4)
    red = r.Redactor(clock_time=True, boundary=boundary)
    for _ in range(4000):
        text = pieces(rng)
        for places in (red.detected, red.protected, red.residual):
            got = [(k, *m.span()) for k, m in places.matches(text)]
            assert got == [(k, *m.span()) for k, p in enumerate(places.patterns) for m in p.finditer(text)], text


def test_digits_are_tried_where_they_fit():
    """A run of digits is tried with the few patterns that can begin at it."""
    names = [n for n in known.DETECTORS if n not in known.ON_REQUEST]
    led = lambda text: {names[k] for k, _ in R.detected.matches(text)} | {names[k] for m in R.detected.digits.finditer(text) for k, _ in R.detected.led(len(m[0]), m[0][0], text[m.end() : m.end() + 1])}
    assert led("02.") == {"date_range_numeric", "date_numeric"} and led("14") == led("14:") == led("512 мг") == set()
    assert led("14 лет") == {"age_numeric", "time_clinical"} and led("8 812") == {"phone", "age_numeric", "time_clinical"} and led("2024-") == {"date_numeric", "year_abbrev"}


def test_text_is_looked_at_once(monkeypatch):
    """Detectors and protected text are sought in one look at a note, the gate in another."""
    seen, plain = [], r.Places.matches
    monkeypatch.setattr(r.Places, "matches", lambda self, text, *more: (seen.append(text), plain(self, text, *more))[1])
    assert R.redact("Тел. 8 812 123-45-67, F20.0, 14 лет")[0] == "Тел. [ТЕЛЕФОН], F20.0, [ВОЗРАСТ]" and len(seen) == 1


def test_entities_may_be_null(spark):
    rows = spark.createDataFrame([(1, "зубру 14 лет", None), (2, "зубру дали", [(0, 5, "person")]), (3, None, None), (4, "зубр", [])], "k long, text string, found array<struct<start:int,end:int,type:string>>")
    assert [tuple(x) for x in r.redact_documents(rows, entities="found").orderBy("k").select("text", "removed_count").collect()] == [("зубру [ВОЗРАСТ]", 1), ("[ФИО] дали", 1), ("", 0), ("зубр", 0)]


def test_markers_are_those_of_an_alternation():
    rng = np.random.default_rng(6)
    words = ["больница", "больницы", "Дом", "дом отдыха", "дом отдыха мира"]
    tail = re.compile(known.INSTITUTION_TAIL, re.IGNORECASE)
    slow = re.compile(rf"(?<![^\W_])(?:{'|'.join(sorted(map(re.escape, words), key=lambda w: -len(w)))})(?![^\W_])(?:{tail.pattern})", re.IGNORECASE)
    quick = r.Markers(words, tail, True)
    parts = ["больница", "Больницы", "дом", "ДОМ отдыха", "дом отдыха мира", " № 3", "«Мир»", "_", "1", " ", " ", "а", ","]
    for _ in range(3000):
        text = "".join(parts[k] for k in rng.integers(0, len(parts), 8))
        assert list(quick.spans(text, r.lower(text))) == [m.span() for m in slow.finditer(text)]


def slow_listed(names, word):
    word = r.plain(word)
    for name in map(r.plain, names):
        shared = next((i for i, (a, b) in enumerate(zip(name, word)) if a != b), min(len(name), len(word)))  # noqa: B905
        if len(word) >= 4 and shared >= max(4, len(name) - 2, len(word) - 3):
            return True
    return False


def test_stems_equal_the_rule():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("аб"), rng.integers(1, 11)))
    for _ in range(300):
        names = [word() for _ in range(rng.integers(0, 4))]
        stems = r.Stems(names)
        for _ in range(20):
            w = word()
            assert stems.listed(w) == slow_listed(names, w), (names, w)


def test_time_does_not_grow_with_the_lists():
    rng = np.random.default_rng(9)
    made = tuple("".join(rng.choice(list("абвгдежзик"), 9)) for _ in range(100_000))
    notes = [pieces(rng) + " Иванов Пётр и Кабанова" for _ in range(400)]
    took = []
    for names in (made[:1000], made):
        red = r.Redactor(known.Lexicon(names, (), names, frozenset()))
        began = time.perf_counter()
        for note in notes:
            red.redact(note)
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0]


def test_recall_of_made_up_names():
    """Names in all roles and cases, half of them beyond the default lists: most are found."""
    rng = np.random.default_rng(10)
    men, women, sur = known._MEN.split(), known._WOMEN.split(), list(known.made_surnames())
    rare = ["Тимофеев", "Аверин", "Погодин", "Щеглов", "Лаврентьев", "Белозёров", "Кудинов", "Зотов", "Ширяев", "Маклаков"]
    pick = lambda options: options[rng.integers(len(options))]
    found = 0
    for k in range(1000):
        his = bool(k % 2)
        first, last = pick(men if his else women), pick(rare if k % 4 < 2 else sur) + ("" if his else "а")
        middle = pick(["Петрович", "Ильич", "Сергеевич"] if his else ["Петровна", "Ильинична", "Сергеевна"])
        form = pick([f"{first} {last}", f"{last} {first}", f"{last} {first} {middle}", f"{last} {first[0]}.{middle[0]}.", f"{first} {middle}", f"{first[0]}. {middle[0]}. {last}"])
        text, _ = R.redact(pick(["Мать пациента, {}", "врач {} осмотрел", "пациент {}, жалоб нет", "в присутствии: {}."]).format(form))
        found += not any(len(w) > 3 and w in text for w in form.split())
    assert found >= 850, found
    assert R.redact("Мать пациента, Евдокия Тимофеева")[0] == "Мать пациента, [РОДИТЕЛЬ]"


def test_clinical_text_is_no_residue():
    red = r.Redactor(known.Lexicon(("Литии", "F20x"), ("Узиков",), (), frozenset()))
    assert [k for k, *_ in red.suspicions("Узиков") ] == ["person"]
    red.protected.patterns.append(re.compile("Узиков"))
    assert red.suspicions("Узиков") == []


def test_word_lists_as_tables(spark):
    rows = [("first_name", "Зигфрид"), ("first_name", "Зигфрид"), ("surname", "Кнехтов"), ("institution", "НИИ"), ("institution", "лечебница"), ("no_name", "Осмотр"), ("other", "x"), (None, "y"), ("surname", None), ("surname", " ")]
    table = spark.createDataFrame(rows, "kind string, word string")
    assert r.lexicon_of(table) == known.Lexicon(("Зигфрид",), ("Кнехтов",), ("НИИ", "лечебница"), frozenset({"Осмотр"}))
    with pytest.raises(ValueError):
        r.lexicon_of(table, most_bytes=10)
    docs = spark.createDataFrame([(1, "Осмотр. Зигфриду дали отдых в лечебница № 3, а Иванову нет")], "doc_id long, text string")
    assert r.redact_documents(docs, lexicon=table).first().text == "Осмотр. [ФИО] дали отдых в [УЧРЕЖДЕНИЕ], а Иванову нет"
    assert r.lexicon_of(table.limit(0)) == known.Lexicon((), (), (), frozenset())


@pytest.mark.parametrize("most_bytes", [0, 1 << 20])
def test_stem_join_equals_the_rule(spark, most_bytes):
    rng = np.random.default_rng(14)
    make = lambda: "".join(rng.choice(list("абё"), rng.integers(2, 9)))
    names, words = sorted({make() for _ in range(60)}), sorted({make().capitalize() for _ in range(200)})
    got = r.stem_matches(spark.createDataFrame([(w, 1) for w in [*words, None, words[0]]], "word string, name int"), spark.createDataFrame([(n,) for n in [*names, None, names[0]]], "name string"), most_bytes)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(w, n) for w in words for n in names if slow_listed([n], w)}


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    """A file read in many parts may have all its rows in one of them."""
    spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        docs = spark.read.parquet(str(tmp_path / "one"))
        assert docs.rdd.getNumPartitions() >= 4 and max(docs.rdd.glom().map(len).collect()) == 2000
        assert max(r.spread(docs).rdd.glom().map(len).collect()) <= 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
