"""Facts, placed sentences and briefs against plain Python over the narratives of sf0.001."""

import datetime as dt
import math
import re
from collections import defaultdict

import pytest

from chartweave.operators import briefs
from chartweave.operators import timeline as t
from chartweave.plans import timelines
from chartweave.plans.corpus import days_of

SF = "/root/testdata/sf0.001"
MARK = re.compile(r"(?:с\s+|от\s+)?(\d{1,2})[./](\d{1,2})(?:[./](\d{2,4}))?")


def ascii_words(pattern):
    return pattern.replace(r"\w", "[0-9A-Za-z_]")


def sentences(text):
    return [s.strip() for s in re.split(r"(?<=\.)\s+|(?<=\n)", text or "") if s.strip()]


def has(pattern, text):
    return re.search(ascii_words(pattern), text.lower()) is not None


def visit(s):
    return has(t.VISIT_DAY, s) or (has(t.MEETING, s) and has(t.RELATIVE, s))


def kind(s):
    return next((k for p, k in t.KINDS if (visit(s) if p is None else has(p, s))), "laterBehaviors")


def closed(s):
    return re.sub("[.;]+$", "", s)


def once(items):
    seen = {}
    for x in items:
        seen.setdefault(x.lower()[:48], x)
    return list(seen.values())


def listed(s):
    pieces = [closed(re.sub(r"^[а-яё]?\s*", "", p).strip()).strip() for p in re.split(r",\s+(?=[а-яё])", s, flags=re.I)]
    return [p for p in pieces if len(p) > 12]


def facts_of(text):
    out = defaultdict(list)
    for s in sentences(text):
        k = kind(s)
        if k == "contrast":
            first, *rest = re.split(t.LATER, s, flags=re.I)
            lead = lambda x: re.sub(r"^[,.\s]+", "", x).strip()
            out["early"] += [x for x in [closed(lead(re.sub("в первые дни|при поступлении|с первых дней", "", first, flags=re.I)))] if x]
            out["laterBehaviors"] += listed(lead(" ".join(rest)))
        elif k == "laterBehaviors":
            out[k] += listed(s) if len(listed(s)) > 1 else [closed(s)]
        elif k != "skip":
            out[k].append(closed(s))
    return out | {k: once(out[k]) for k in ("laterBehaviors", "traits")}


def marks(text, year):
    found = []
    for m in MARK.finditer(text):
        d, mo, y = int(m[1]), int(m[2]), int(m[3] or year)
        if 1 <= d <= 31 and 1 <= mo <= 12:
            found.append((m.start(), f"{y + 2000 if y < 100 else y}-{mo:02d}-{d:02d}"))
    ends = [a for a, _ in found[1:]] + [len(text)]
    told = [(iso, re.sub(r"[;,.\s]+$", "", text[a:b]).strip()) for (a, iso), b in zip(found, ends)]
    return [x for x in told if len(x[1]) > 8]


def real(iso):
    try:
        return dt.date.fromisoformat(iso)
    except ValueError:
        return None


def place(text, days):
    """{day: sentences}; days are sorted dates."""
    out = defaultdict(list)
    weekday = lambda d: d.isoweekday() % 7 + 1
    for raw in sentences(text):
        if kind(raw) == "therapy":
            continue
        s = closed(raw)
        own, at = marks(s, days[0].year), text.index(s)
        around = text[max(0, at - 140) : at + len(s) + 80]
        if own:
            anchor = real(own[0][0])
        else:
            side = next((d for part in (s, around) for p, d in ((t.FIRST, days[0]), (t.LAST, days[-1])) if has(p, part)), None)
            anchor = side or days[math.floor(at / (len(text) - 1) * (len(days) - 1) + 0.5) if len(days) > 1 else 0]
        near = lambda fits: sorted((d for d in days if fits(d)), key=lambda d: (abs((d - anchor).days) if anchor else 0, d))[:1]
        named = {d for d, p in t.WEEKDAY_STEMS.items() if has(p, s)}
        dated = [d for d in days if d.isoformat() in [iso for iso, _ in own]]
        free = has("выходн", s)
        if dated:
            hit = dated
        elif named:
            hit = near(lambda d: weekday(d) in named)
        elif has(t.VISIT_DAY, s) or (visit(s) and not free):
            hit = near(lambda d: weekday(d) == 4)
        elif free:
            hit = near(lambda d: weekday(d) in (1, 7))
        else:
            hit = days[-2:] if has(t.LAST, s) else []
        if hit and not dated and ({1, 7} <= named or (free and not named and not visit(s)) or (free and not named and visit(s) and not has(t.VISIT_DAY, s))):
            saturday = hit[0] - dt.timedelta(weekday(hit[0]) % 7)
            hit = [d for d in days if d in (saturday, saturday + dt.timedelta(1))]
        for d in hit:
            out[d].append(s)
    return out


def rotate(pool, i, n=1):
    return [pool[(i + j) % len(pool)] for j in range(min(n, len(pool)))] if pool else []


def brief_days(stay, days):
    """(day, observations, forbidden, therapy, final) of one stay; days are rows in order."""
    text, facts, dates = stay.narrative or "", facts_of(stay.narrative), [d.day for d in days]
    timed, n = place(text, dates) if text else {}, len(days)
    later = facts["laterBehaviors"]
    field, free = [x for x in later if has(t.FIELD_ACT, x)], [x for x in later if not has(t.FIELD_ACT, x) and not has(t.OCCUPATION, x)]
    busy = once([x for k in ("laterBehaviors", "traits", "improvement") for x in facts[k] if has(t.OCCUPATION, x)])
    visits = once([x for x in facts["timed"] + sentences(text) if visit(x)])
    doses = marks("\n".join(x for x in [stay.key_medications, *facts["therapy"]] if x), dates[0].year)
    acts = {}
    for x in field:
        acts.setdefault(next((k for p, k in t.FIELD_KEYS if has(p, x)), x.lower()[:32]), x)
    acts, final_state = list(acts.values()), (stay.final_state or "").strip()
    exams = [i for i, d in enumerate(days) if d.doc_type == "exam_10d"]
    middle = exams[0] if exams else min(int(n * 0.4), n - 1)
    out, stops = [], []
    for i, d in enumerate(days):
        percent = 100 if n == 1 else math.floor(i * 100 / (n - 1) + 0.5)
        phase = "admission" if d.day_number <= 3 else next((p for top, p in ((35, "field"), (55, "titration"), (80, "improving")) if percent < top), "residual")
        role = "exam" if i in exams else "event" if i == n - 1 or i % 3 == 0 else "quiet"
        here, iso, late = timed.get(d.day, []), d.day.isoformat(), phase in ("improving", "residual")
        takes = role == "event" and phase in ("admission", "field", "titration")
        act = [acts.pop(0)] if takes and acts else []
        if role == "exam":
            own = [t.FOR_PERIOD + x for x in [v for v in visits if v not in here] + field[:2]] + rotate(free, i)
        elif phase == "admission":
            own = rotate(facts["early"], i) + act
        elif phase == "field":
            own = act if takes else rotate(free, i)
        else:
            own = act + rotate(free, i, 1 if phase == "titration" or role == "quiet" else 2)
        own += rotate(busy, i) if phase != "admission" else []
        own += rotate(facts["traits"], i + 3 * (role == "quiet"))
        own += facts["improvement"][:1] * late + facts["residual"][:1] * (phase == "residual")
        reserved = once(here)
        rest = [x for x in once(here + own) if x not in reserved]
        seen = once(reserved + rest[: 7 if role == "exam" else 2 if role == "quiet" and not here else 3])
        final = i >= n - 2 or (role == "exam" and percent >= 80)
        now, so_far = [x for day, x in doses if day == iso], [x for day, x in doses if day <= iso]
        if now:
            therapy = " ".join(now)
        elif role == "exam" and so_far:
            therapy = t.SO_FAR + "; ".join(so_far)
        else:
            therapy = (" ".join(facts["therapy"]) or None) if not doses and (role == "exam" or i == middle) else None
        told = " ".join(seen)
        no = [stop for (p, stop), on in zip(t.FIELD_STOPS, (True, True, not final)) if on and not has(p, told)]
        no += [final_state] * bool(not final and final_state) + facts["therapy"] * (not therapy) + [x for day, x in doses if day > iso]
        no += [v for v in visits if v not in here] * (role != "exam")
        no += facts["improvement"] + facts["residual"] if phase in ("admission", "field") else field + facts["early"] if late else []
        out.append((d.day, seen, therapy, final))
        stops.append(no)
    return [(day, seen, once(no + [x for j, other in enumerate(out) if j != i for x in other[1]])[:22], therapy, final) for i, ((day, seen, therapy, final), no) in enumerate(zip(out, stops))]


@pytest.fixture(scope="module")
def told(spark):
    stays = {s.stay_id: s for s in timelines.told_stays(spark, SF).collect()}
    days = defaultdict(list)
    for d in days_of(spark, SF).orderBy("stay_id", "day").collect():
        days[d.stay_id].append(d)
    return stays, days


def test_facts(spark, told):
    got = defaultdict(lambda: defaultdict(list))
    for r in t.narrative_facts(timelines.told_stays(spark, SF)).orderBy("stay_id", "pos").collect():
        got[r.stay_id][r.kind].append(r.fact)
    for key, stay in told[0].items():
        assert dict(got[key]) == {k: v for k, v in facts_of(stay.narrative).items() if v}, stay


def test_placed_sentences(spark, told):
    stays, days = told
    got = defaultdict(list)
    for r in t.assign_timed(timelines.told_stays(spark, SF), days_of(spark, SF)).orderBy("pos").collect():
        got[r.stay_id, r.day].append(r.sentence)
    want = {(k, d): xs for k in days if stays[k].narrative for d, xs in place(stays[k].narrative, [x.day for x in days[k]]).items()}
    assert len(want) > 1000 and dict(got) == want


def test_placed_in_any_days(spark):
    """Days before 1970, far apart, over the borders of masks; a stay without a real day has no rows."""
    text = timelines.SENTENCES[6] + " " + " ".join(timelines.SENTENCES[:12] + timelines.SENTENCES[16:]) + "\x0bПеред выпиской 5.12;; ушёл домой.\nВ среду, в субботу и воскресенье дома."
    span = lambda first, n, step=1: [dt.date.fromisoformat(first) + dt.timedelta(i * step) for i in range(n)]
    periods = {1: span("1969-12-20", 20), 2: span("1996-02-25", 31), 3: span("1995-10-30", 200), 4: span("1600-01-01", 40, 9999 // 40), 5: span("1996-03-07", 1), 6: [None]}
    days = spark.createDataFrame([(k, d) for k, ds in periods.items() for d in reversed(ds)] * 2, "stay_id long, day date")
    stays = spark.createDataFrame([(k, text) for k in (*periods, 7)] + [(1, None), (2, "")], "stay_id long, narrative string")
    got = defaultdict(list)
    for r in t.assign_timed(stays, days).orderBy("pos").collect():
        got[r.stay_id, r.day].append(r.sentence)
    assert dict(got) == {(k, d): xs for k in range(1, 6) for d, xs in place(text, periods[k]).items()}


def test_days_are_put_together_before_they_travel(spark):
    """Stays are dealt before they become days; no set of days is gathered row by row."""
    plan = timelines.p8_assign_timed(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_briefs(spark, told):
    stays, days = told
    got = defaultdict(list)
    for r in t.compile_briefs(timelines.told_stays(spark, SF), days_of(spark, SF)).orderBy("day").collect():
        got[r.stay_id].append((r.day, r.observations, r.forbidden, r.therapy_today, r.include_final_state))
    assert set(got) == set(days)
    for k in days:
        assert got[k] == brief_days(stays[k], days[k]), stays[k]


@pytest.mark.parametrize("name", ["p14_brief_texts", "p14_compile_briefs"])
def test_briefs_travel_as_stays(spark, name):
    """What is shuffled and sorted is one row a stay: nothing that stands behind the days' texts, and no narrative."""
    plan = timelines.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    behind = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in behind and "Sort" not in behind and "Window" not in behind
    assert plan.count("Exchange hashpartitioning") == 2 and not any("CASE WHEN" in line for line in plan[plan.index("Exchange hashpartitioning") :].split("\n") if "stay_id" not in line and "hashpartitioning" in line)


def test_briefs_of_odd_stays(spark):
    """Stays without a real day, without a narrative or anything else, days far off, marks that are no days; columns that are kept."""
    text = " ".join(timelines.SENTENCES) + "\nС 3.13 и с 05.01.24 рисперидон 2 мг/сут; с 06.01 3 мг/сут..\n."
    stays = [(1, text, "wavy", "F71", " ровный ", "сонапакс с 10.01 и далее", "a"), (2, None, None, None, None, None, None), (3, "", "odd", "", "", "", "c"), (4, text, "negative", "F72", "x", None, "d"), (5, text, None, None, None, None, "no days")]
    span = lambda first, n: [dt.date.fromisoformat(first) + dt.timedelta(i) for i in range(n)]
    periods = {1: span("2024-01-01", 31), 2: span("1969-12-30", 4), 3: [None], 4: [None, *span("0999-12-30", 12)], 6: span("2024-01-01", 2)}
    days = [(k, d, i + 1, "exam_10d" if (i + 1) % 10 == 0 else "daily") for k, ds in periods.items() for i, d in enumerate(ds)]
    made = t.compile_briefs(
        spark.createDataFrame(stays, "stay_id long, narrative string, overall_dynamics string, diagnosis string, final_state string, key_medications string, note string"),
        spark.createDataFrame(days[::-1], "stay_id long, day date, day_number int, doc_type string"), kept=("note",),
    )
    got = defaultdict(list)
    for r in made.orderBy("stay_id", "place").collect():
        got[r.stay_id].append(r)
    assert {k: len(v) for k, v in got.items()} == {1: 31, 2: 4, 3: 1, 4: 13} and all(r.note == stays[k - 1][-1] and r.periods == len(got[k]) for k in got for r in got[k])
    of_stay = spark.createDataFrame(stays, "stay_id long, narrative string, overall_dynamics string, diagnosis string, final_state string, key_medications string, note string").collect()
    of_days = [spark.createDataFrame([d for d in days if d[0] == k], "stay_id long, day date, day_number int, doc_type string").collect() for k in (1, 2)]
    for k in (1, 2):
        assert [(r.day, r.observations, r.forbidden, r.therapy_today, r.include_final_state) for r in got[k]] == brief_days(of_stay[k - 1], of_days[k - 1])
    assert got[3][0].observations == [] and got[3][0].therapy_today is None and got[4][0].day is None and got[4][0].observations and len({tuple(r.observations) for r in got[4]}) > 3
    assert any(r.therapy_today and "10.01 и далее" in r.therapy_today for r in got[1])


def test_brief_as_text(spark):
    schema = "day_number int, place int, periods int, percent double, phase string, role string, calendar string, weekend_note string, weekend_recap boolean, diagnosis string, speech_level string, patient_sex string, discharge string, observations array<string>, therapy_today string, include_final_state boolean, final_state string, forbidden array<string>, day date"
    full = (5, 2, 9, 12.0, "field", "event", "saturday", "за период выходных", False, "F71.1", "words", "male", "10.02.2024", ["пел", " ", "рисовал"], "рисперидон 2 мг", True, "ровный", [f"{k}" + "я" * 300 for k in range(20)], None)
    bare = (1, 1, 1, 0.0, "odd", "quiet", "monday", None, None, " ", None, None, None, [], None, None, None, None, None)
    first, second = (r.brief.split("\n") for r in briefs.brief_text(spark.createDataFrame([full, bare], schema)).collect())
    assert first[0] == "Сутки в стационаре: 5; день периода: 2 из 9 (12%)." and "Диагноз дословно: F71.1. Других кодов не подставляй." in first
    assert [x for x in first if x.startswith("• ")][:2] == ["• пел", "• рисовал"] and sum(x.startswith("• ") for x in first) == 2 + briefs.FORBIDDEN_ITEMS
    assert max(len(x) for x in first if x.startswith("• ")) == briefs.FORBIDDEN_CHARS + 2
    assert any("«за период выходных»" in x for x in first) and "Состояние к концу периода: ровный." in first and "Назначения сегодня меняются: рисперидон 2 мг." in first
    assert "Фаза: odd." in second and any(briefs.NO_DIAGNOSIS in x for x in second) and "Назначения: см. лист назначений; о смене схемы не пиши." in second
    assert "О выходных не пиши: в этом периоде их ещё не было." in second and not any(x.startswith("• ") or not x for x in second)


@pytest.mark.parametrize("name", ["p14_brief_texts", "p14_compile_briefs", "p20_brief_answers", "p20_day_answers", "p19_context_for_day", "p8_assign_timed"])
def test_stays_are_not_broadcast(spark, name):
    """Stays with their texts grow with the table: no join sends them whole through the driver."""
    plan = timelines.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
