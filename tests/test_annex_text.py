"""Amounts in annex texts: each rung, its vetoes, number formats and edges."""

import pytest
from pyspark.sql import functions as F

from outlay.functions import annex_text as a

TOTAL, ADDED, SAME = "total_restated", "genuine_increment", "unchanged_restated"
CASES = [
    # before, after, difference, texts, outside the law -> label, restated
    (410000, 925500, 515500, ["стойността на договора ще възлезе на 515 500.00 лв. без ДДС"], None, TOTAL, 515500),
    (150000, 380250.5, 230250.5, ["цената се променя от 150 000,00 лева на 230 250,50 (двеста и тридесет) лева"], None, TOTAL, 230250.5),
    (1000, 3000, 2000, ["Новата обща цена 2.000,00 се приема."], None, TOTAL, 2000),
    (1000, 3000, 2000, ["крайна стойност 2,000.00"], None, TOTAL, 2000),
    (1000, 3000, 2000, ["Възлиза НА 2 000 ЕВРО"], None, TOTAL, 2000),
    (1000, 3000, 2000, ["става 2000 евросметки"], None, None, None),
    (1000, 3000, 2000, ["остатък на 2000 според чл. 5"], None, None, None),
    (1000, 3000, 2000, ["сума в размер на 2000 лв."], None, None, None),
    (1000, 3000, 2000, ["допълнителни работи на обща стойност на 2000 лв."], None, None, None),
    (1000, 3000, 2000, ["от 2000 лв."], None, None, None),
    (1000, 3000, 2000, ["Увеличава се ресурсът с 2 000 евро."], None, ADDED, None),
    (1000, 3000, 2000, ["със 2000 лева, общо става 2000 лв."], True, ADDED, None),
    (100, 300, 200, ["удължава се на 200 дни"], None, None, None),
    (100, 300, 200, ["удължава се на 200 работни дни, стойността е 90 лв."], None, None, None),
    (100, 300, 200, ["удължава се на 200 (двеста) дни, цената остава 90 лв."], None, None, None),
    (100, 300, 200, ["площ на 200 кв.м, цена 90 лв."], None, None, None),
    (100, 300, 200, ["плащане на 200 к.д., цена 90 лв."], None, None, None),
    (100, 300, 200, ["възлиза на 200 лв. и срокът се удължава с 30 работни дни"], None, TOTAL, 200),
    (5000, 10000, 5000, ["Несъществени промени в екипа."], None, SAME, 5000),
    (5000, 10000, 5000, ["Несъществени промени в екипа."], True, None, None),
    (5000, 10000, 5000, ["цените се преобразуват от лева в евро"], False, SAME, 5000),
    (5000, 10000, 5000, ["плаща се в евро по сметка"], None, None, None),
    (5000, 10000, 5000, ["до 7 000 лв."], None, None, None),
    (5000, 10010, 5010, ["общата стойност остава на 5000 лв."], None, TOTAL, 5010),
    (100, 130, 30, ["възлиза на 30 лв."], None, None, None),
    (100, 250, 100, ["възлиза на 100 лв."], None, None, None),
    (100, 1100, 1000, ["възлиза на 1000 лв."], None, None, None),
    (1000, 3000, 2000, [None, "  ", ""], None, None, None),
    (None, 3000, 2000, ["възлиза на 2000 лв."], None, None, None),
    (0, 3000, 2000, ["възлиза на 2000 лв."], None, None, None),
    (1000, 3000, 2000, ["x" * 200_000 + " 17 1.2.3 4,5,6 0 ", "възлиза на", "2000 лв."], None, TOTAL, 2000),
]


def test_labels(spark):
    rows = [(i, b, v, d, *(t + [None] * 3)[:3], o) for i, (b, v, d, t, o, _, _) in enumerate(CASES)]
    df = spark.createDataFrame([(r[0], *(float(x) if x is not None else None for x in r[1:4]), *r[4:]) for r in rows], "i int, value_before double, value_after double, value_delta double, a string, b string, c string, o boolean")
    got = {r["i"]: (r["treatment"], r["value_restated"]) for r in a.with_treatment(df, ["a", "b", "c"], "o").collect()}
    assert [got[i] for i in range(len(CASES))] == [(c[5], c[6]) for c in CASES]
    assert a.with_treatment(df.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize(("token", "value"), [("1 234,56", 1234.56), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1.234", None), ("1,2", 1.2), ("12.345.678,9", 12345678.9), ("1.2,3,4", None), ("0", None), ("0,00", None), ("77 000", 77000.0), ("5", 5.0)])
def test_numbers(token, value, spark):
    assert spark.range(1).select(a.number(F.lit(token)).alias("v")).first()["v"] == value


def test_long_texts_and_numbers(spark):
    """A number beyond a double's range is no amount; long lists of numbers and long endings are walked once."""
    listed = ", ".join(str(i) for i in range(1, 20_000))
    texts = {
        "възлиза на " + "9" * 400 + " лв.": None, "възлиза на " + "0" * 400 + "2000 лв.": TOTAL, listed + " възлиза на 2000 лв.": TOTAL,
        "възлиза на 2000 лв. " + "я" * 200_000: TOTAL, "възлиза на 2000 лв. " + "на " * 60_000: TOTAL, "на 2000 броя, с" + " " * 39 + "2000 лв.": ADDED,
        "възлиза на" + " " * 38 + "2000 лв.": TOTAL, "възлиза на" + " " * 39 + "2000 лв.": None, "на 2000 лв., после с 2000 лв.": ADDED,
    }
    df = spark.createDataFrame([(t, 1000.0, 3000.0, 2000.0) for t in texts], "t string, value_before double, value_after double, value_delta double")
    assert {r["t"]: r["treatment"] for r in a.with_treatment(df, ["t"]).collect()} == texts


def test_numbers_are_taken_out_of_a_text_once(spark):
    df = spark.createDataFrame([("на 2000 лв.", 1000.0, 3000.0, 2000.0)], "t string, value_before double, value_after double, value_delta double")
    plan = a.with_treatment(df, ["t"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "split(" not in plan
