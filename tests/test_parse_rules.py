import csv
import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tesselith.operators import parse_rules as P

GOOD = "1,2,3,4,5,6"
CASES = [
    (GOOD, True),
    (GOOD + "\r", True),
    (GOOD + "\r\r", False),
    (GOOD + "\n", False),
    (None, False),
    ("", False),
    ('"1",2,3,4,5,6', True),
    ('" 1 ",2,3,4,5,"6"\r', True),
    (' "1",2,3,4,5,6', False),
    ('"1"x,2,3,4,5,6', False),
    ('"1,2,3,4,5,6', False),
    ('"1""",2,3,4,5,6', False),
    ('1",2,3,4,5,6', False),
    ("1,2,3,4,5", False),
    ("1,2,3,4,5,6,", False),
    ("1,2,3,4,5,6,7", False),
    (",,,,,", False),
    (" 1 ,\t2,+3,4.,.5e1,6E+0", True),
    ("1,2,3,4,5,.", False),
    ("1,2,3,4,5,1e", False),
    ("1,2,3,4,5,1e400", False),
    ("1,2,3,4,5,1e99999999999", False),
    ("-1e400,2,3,4,5,6", False),
    ("1,2,3,4,5,NaN", False),
    ("1,2,3,4,5,Infinity", False),
    ("1,2,3,4,5,6d", False),
    ("1,2,3,4,5,0x6", False),
    ("1,2,3,4,5,٦", False),
    ("1,2,3,4,5,6 ", False),
    ("4,2,3,1,5,6", False),
    ("1,5,3,4,2,6", False),
    ("1,2,6,4,5,3", False),
    ("4,5,6,4,5,6", True),
    ("1e-400,0,0,0,0,0", True),
    ("1;2;3;4;5;6", False),
    ("1," * 50_000, False),
    ("9" * 100_000 + ",2,3,4,5,6", False),
    ('"' * 100_000, False),
]


def verdict(line):
    """Character by character, without the operator's patterns."""
    if line is None:
        return False
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            text, i = "", i + 1
            while True:
                if i >= len(line):
                    return False
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + line[i], i + 1
            if i < len(line) and line[i] != ",":
                return False
        else:
            end = line.find(",", i)
            end = len(line) if end < 0 else end
            text, i = line[i:end], end
            if '"' in text:
                return False
        fields.append(text.strip(" \t"))
        if i >= len(line):
            break
        i += 1
    if len(fields) != 6 or not all(re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", f) for f in fields):
        return False
    v = [float(f) for f in fields]
    return all(map(math.isfinite, v)) and all(v[k] <= v[k + 3] for k in range(3))


def frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_id bigint, raw_line string")


def test_cases(spark):
    assert [verdict(x) for x, _ in CASES] == [ok for _, ok in CASES]
    df = frame(spark, [x for x, _ in CASES])
    bad = {r["line_id"] for r in P.rejected(df, "raw_line", ["line_id"]).collect()}
    good = {r["line_id"]: r for r in P.loaded(df, "raw_line", ["line_id"]).collect()}
    want = {i for i, (_, ok) in enumerate(CASES) if ok}
    assert set(good) == want and bad == set(range(len(CASES))) - want
    assert good[CASES.index((" 1 ,\t2,+3,4.,.5e1,6E+0", True))][1:] == (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.text('1,."\r e-+\t', max_size=14), st.lists(st.sampled_from(["1", '"2"', "3.", ".", "-1e2", '"4""', " 5\t", ""]), min_size=5, max_size=7).map(",".join)), max_size=60))
def test_against_reading_by_character(spark, lines):
    df = frame(spark, lines)
    bad = {r["line_id"] for r in P.rejected(df, "raw_line", ["line_id"]).collect()}
    assert bad == {i for i, x in enumerate(lines) if not verdict(x)}


def test_reasons(spark):
    df = frame(spark, [None, '"1', "1,2", "a,2,3,4,5,1e999", "2,2,3,1,5,6"])
    got = {r["line_id"]: r["reasons"] for r in P.rejected(df, "raw_line", ["line_id"]).collect()}
    assert got == {0: ["line is null"], 1: ["broken quoting"], 2: ["not 6 fields"], 3: ["t1 is not a number", "y2 is not finite"], 4: ["t1 > t2"]}


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, GOOD, "a"), (1, GOOD, "b"), (1, "x", "c"), (None, "x", "d"), (None, "x", "e"), (None, GOOD, "f"), (2, None, "g")]
    df = spark.createDataFrame(rows, "line_id bigint, raw_line string, reasons string").selectExpr("*", "'z' as t1", "1 as `__line`", "2 as `__cells`", "3 as raw")
    bad = sorted(((r["line_id"], r["raw_line"]) for r in P.rejected(df, "raw_line", ["line_id"]).collect()), key=str)
    assert bad == [(1, "x"), (2, None), (None, "x")]
    good = [r["line_id"] for r in P.loaded(df, "raw_line", ["line_id"]).collect()]
    assert sorted(good, key=str) == [1, 1, None]
    with pytest.raises(ValueError):
        P.loaded(df, "raw_line", ["t1"])


def test_empty_and_counts(spark):
    none = frame(spark, [])
    assert P.rejected(none, "raw_line", ["line_id"]).count() == 0 and P.loaded(none, "raw_line").count() == 0
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "1,2"), (3, None, "y"), (4, "a", GOOD)], "line_id bigint, file_name string, raw_line string")
    got = {(r[0], r[1]): r[2] for r in P.reason_counts(df, "raw_line", ["line_id", "file_name"], ["file_name"]).collect()}
    assert got == {("a", "not 6 fields"): 2, (None, "not 6 fields"): 1}


def test_hot_line(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) line_id", f"if(id % 3 = 0, 'broken', '{GOOD}') raw_line")
    assert P.rejected(df, "raw_line", ["line_id"]).count() == 1
    assert P.loaded(df, "raw_line", ["line_id"]).count() == 2000


def test_only_violations_are_shuffled(spark):
    plan = P.rejected(frame(spark, [GOOD]), "raw_line", ["line_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_oracle_reads_csv_alike():
    assert next(csv.reader(['"1",2'])) == ["1", "2"]
