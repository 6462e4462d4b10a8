import logging

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally.functions import codes as C
from codetally.functions import stats

X = F.col("x")


def test_pad_numeric_label(values):
    cases = {
        "1234": "01234", "1234.0": "01234", "1e3": "01000", "12345.7": "12345", "-5": "-0005", "-9.0": "-0009", "123456": "123456",
        "5432x": "5432x", "12d": "12d", "4+": "4+", "-9": "-9", " 42 ": "00042", "0": "00000", ".5": "00000", "-0.3": "00000",
        "1e400": "1e400", "": "", "99999999999999999999": "99999999999999999999", None: None,
    }
    assert values(list(cases), C.pad_numeric_label(X)) == list(cases.values())


def test_clean_label_nulls_missing_text_first(values):
    inputs = ["", " ", "nan", "None", "Null", "<NA>", "NAN", "1420", None]
    assert values(inputs, C.clean_label(X)) == [None] * 6 + ["NAN", "01420", None]


def test_parse_codes(values):
    cases = {
        "86101": ["86101"],
        "[86101, 86210]": ["86101", "86210"],
        "86101;8602x;4+": ["8602x", "86101"],
        "[8601x, 1410, nan]": ["01410", "8601x"],
        "14+": ["00001"],
        "86x": ["0086x"],
        "86101;86101": ["86101"],
        "12345678": ["12345678"],
        " -9 ": [], "nan": [], "": [], ".": [], None: [],
        "86xX": ["086xX"],
    }
    assert values(list(cases), C.parse_codes(X)) == list(cases.values())


def test_parse_codes_with_broken_pattern_warns(values, caplog):
    with caplog.at_level(logging.WARNING):
        assert values(["86101"], C.parse_codes(X, "([")) == [[]]
    assert "no codes are read" in caplog.text


def test_code_text_keeps_whole_numbers_whole(values):
    assert values([86101.0, 1.5, None], C.code_text(X, T.DoubleType()), "double") == ["86101", "1.5", None]


def test_digit_flags(values):
    inputs = ["86101", "861xx", "86xxx", "8x6x1", "xxxxx", "861XX", "8610", "", None, "86x1a"]
    assert values(inputs, C.is_five_digits(X)) == [i == 0 for i in range(10)]
    assert values(inputs, C.has_unknown_digits(X, 2)) == [i in (1, 3, 5) for i in range(10)]
    assert values(inputs, C.has_unknown_digits(X, 3)) == [i == 2 for i in range(10)]


def test_scores(values):
    inputs = ["0.5", " 1e-1 ", "abc", "12d", "", "inf", None]
    assert values(inputs, C.to_number(X, T.StringType())) == [0.5, 0.1, None, None, None, float("inf"), None]
    assert values([0.5, float("nan"), None], C.to_number(X, T.DoubleType()), "double") == [0.5, None, None]


def test_small_scalars(values):
    assert values(["TRUE", "False", "yes", None], C.text_flag(X)) == [True, False, None, None]
    assert values([0, 3], C.digits_label(X), "int") == ["S", "3"]
    assert values(["4", "2"], C.relabel(X, {"4": "4+"})) == ["4+", "2"]
    assert values(["-9", "4+", "86xxx", "8x", None], C.leading_division(X)) == ["", "", "86", "", ""]


def test_digits_argument():
    assert [C.parse_digits(x) for x in (None, "S", "0", "3")] == [5, 0, 0, 3]
    with pytest.raises(ValueError):
        C.parse_digits("6")


def test_rounding_and_ratios(values):
    inputs = [43.25, 43.35, 2.675, 0.5]
    assert values(inputs, stats.round_half_even(X, 1), "double") == [43.2, 43.4, 2.7, 0.5]
    assert values([0.125, 0.375], stats.round_half_even(X, 2), "double") == [0.12, 0.38]
    assert values([0, 4], stats.ratio(F.lit(1), X), "int") == [0.0, 0.25]
    assert values([0, 4], stats.percent(F.lit(1), X), "int") == [0.0, 25.0]
    half = values([0.5], stats.wald_half_width(X, F.lit(100)), "double")[0]
    assert half == pytest.approx(0.098)
