"""Scalar rules on literal cases."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlink.functions import fuzzy, parse, scores, text


def values(spark, rows, *cols):
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(len(rows[0]))))
    return [tuple(r) for r in df.select(*cols).collect()]


def test_dates(spark):
    cases = {"2023-01-15": dt.date(2023, 1, 15), "01/15/2023": dt.date(2023, 1, 15), "25/12/2023": dt.date(2023, 12, 25),
             "2023/12/25": dt.date(2023, 12, 25), "12-25-2023": dt.date(2023, 12, 25), "20231225": dt.date(2023, 12, 25),
             "12/25/98": dt.date(1998, 12, 25), "31/12/23": dt.date(2023, 12, 31), "invalid-date": None, "": None, "2099-01-01": None, " 1/5/2020 ": dt.date(2020, 1, 5)}
    got = values(spark, [(k,) for k in cases], parse.read_date(F.col("c0"), 2025))
    assert [g[0] for g in got] == list(cases.values())


def test_money(spark):
    cases = {"123.45": "123.45", "$1,234.56": "1234.56", "-123.45": "-123.45", "(123.45)": "-123.45", "not-a-number": None, "€ 5": "5.00",
             "2.345": "2.34", "2.355": "2.36", "": None, "USD 7.1": "7.10"}
    got = values(spark, [(k,) for k in cases], parse.read_money(F.col("c0")))
    assert [g[0] for g in got] == [None if v is None else Decimal(v) for v in cases.values()]


def test_numeric_and_date_text(spark):
    rows = [("123.45",), ("$1,234.56",), ("€999.99",), ("ACME Corp",), ("",), ("N/A",), ("2023-1-5 x",)]
    got = values(spark, rows, parse.numeric_text(F.col("c0")), parse.date_like(F.col("c0")))
    assert got == [(True, False)] * 3 + [(False, False)] * 3 + [(False, True)]


def test_names(spark):
    rows = [("  Acme   Corporation ",), ("LLC",), ("O'Brien & Sons, Inc.",), ("Micro-Soft Co",)]
    got = values(spark, rows, text.import_vendor_name(F.col("c0")), text.stored_vendor_name(F.col("c0")), text.duplicate_vendor_name(F.col("c0")))
    assert got == [("ACME", "ACME", "ACME"), ("LLC", "LLC", ""), ("O'BRIEN SONS, INC.", "O'BRIEN SONS", "OBRIEN SONS"), ("MICRO-SOFT", "MICROSOFT", "MICROSOFT")]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("a,b", [("microsoft corp", "microsoft corporation"), ("abc", ""), ("aabbcc", "abcabc"), ("kitten", "sitting"), ("x" * 80 + "y", "y" + "x" * 70)])
def test_common_subsequence(a, b):
    assert fuzzy.common_subsequence(a, b) == lcs(a, b)


def test_ratios_of_many_pairs_equal_single_ones():
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abc\u00e9 _\0") for _ in range(rnd.choice([0, 1, 7, 8, 9, 33, 63, 64, 65, 90]))) for _ in range(300)] + [None] * 5
    a, b = ([rnd.choice(texts) for _ in range(3000)] for _ in range(2))
    assert fuzzy.percent_ratios(a, b).tolist() == [fuzzy.percent_ratio(x, y) for x, y in zip(a, b)]
    assert fuzzy.percent_ratios([], []).tolist() == [] and fuzzy.percent_ratios(["", None], ["x", None]).tolist() == [0, 0]


def test_similarity_methods(spark):
    rows = [("Microsoft Corp", "Microsoft Corporation"), ("Apple Inc.", "apple inc."), ("Sons Miller & Co", "Miller Sons Co"), ("", "x")]
    cols = [fuzzy.similarity(F.col("c0"), F.col("c1"), m) for m in ("levenshtein", "fuzzy_ratio", "fuzzy_token_sort", "fuzzy_token_set", "fuzzy_partial")]
    got = values(spark, rows, *cols)
    assert got[0] == (1 - 7 / 21, 0.8, 0.8, 0.8, 1.0)
    assert got[1] == (1.0,) * 5 and got[3] == (0.0,) * 5
    assert got[2][2:4] == (1.0, 1.0)


def test_ocr_variants(spark):
    got = [r[0] for r in values(spark, [("A0B",), ("ACK",), ("A" * 51,), ("01258OIZ",)], fuzzy.ocr_variants(F.col("c0")))]
    assert got[0] == ["A0B", "AOB", "aob", "AoB", "A08", "a08"]
    assert got[1] == ["ACK"] and got[2] == ["A" * 51]
    assert len(got[3]) == 18 and {"O1258OIZ", "o1258OIZ", "0I258OIZ", "01Z58OIZ", "012S8OIZ", "0125BOIZ", "012580IZ", "01258O1Z", "01258OI2"} <= set(got[3])


def test_tolerances(spark):
    df = spark.createDataFrame([(1000, 1020, 0.05, 10.0), (1000, 1030, 0.01, 50.0), (1000, 1100, 0.01, 10.0), (0, 0, 0.05, 10.0)], "a int, b int, p double, q double")
    assert [r[0] for r in df.select(scores.within_tolerance(F.col("a"), F.col("b"), F.col("p"), F.col("q"))).collect()] == [True, True, False, True]


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        scores.check_weights({"vendor_name": 0.5, "amount": 0.6, "date": 0.0, "reference": 0.0})


def test_lockout_and_delay(spark):
    got = spark.range(1, 14).select(scores.lockout_minutes(F.col("id")), scores.retry_delay_seconds(F.col("id") - 1)).collect()
    assert [r[0] for r in got] == [None] * 4 + [30.0, 60.0, 120.0, 240.0, 480.0, 960.0, 1440.0, 1440.0, 1440.0]
    assert [r[1] for r in got][:8] == [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 30.0, 30.0]
