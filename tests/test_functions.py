import datetime

import pytest
from pyspark.sql import functions as F

from quillfold.functions import text as T


def apply(spark, f, values):
    """f over rows of one or more text columns."""
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    names = [f"c{k}" for k in range(len(rows[0]))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.select(f(*[F.col(n) for n in names])).collect()]


def check(spark, f, cases):
    got = apply(spark, f, list(cases))
    assert [tuple(g) if hasattr(g, "asDict") else g for g in got] == list(cases.values())


def test_null_like(spark):
    check(spark, T.null_if_empty_like, {" N/A ": None, "  a \xa0 b ": "a b", "-": None, None: None, "na": None, "nah": "nah", "​": "​"})


def test_yes_no(spark):
    check(spark, T.yes_no, {"Yes ": (True, "valid", None), "F": (False, "valid", None), "maybe": (None, "invalid", "UNKNOWN_BOOLEAN"), None: (None, "empty", None)})


def test_multiselect(spark):
    check(spark, T.multiselect, {"a; b;;n/a;b": ["a", "b", "b"], "a\r\n\nb": ["a", "b"], None: [], " ; ": []})


def test_email(spark):
    check(spark, T.email, {"A@B.com": ("a@b.com", "valid", None), "write to x.y@z.co.uk, ok": ("x.y@z.co.uk", "valid", None), "none": ("none", "invalid", "INVALID_EMAIL"), "": (None, "empty", None)})


def test_phone(spark):
    check(spark, T.uk_phone, {"+44 20 7946 0958": ("020 7946 0958", "valid", None), "01632960001": ("01632 960001", "valid", None), "0163296000": ("0163296000", "valid", None), "123": ("123", "invalid", "INVALID_PHONE"), None: (None, "empty", None)})


def test_postcode(spark):
    check(spark, T.uk_postcode, {"sw1a1aa": ("SW1A 1AA", "valid", None), "M1 OAA": ("M1 0AA", "valid", "POSTCODE_TYPO_REPAIRED"), "gir 0aa": ("GIR 0AA", "valid", None), "SWIA 1AA": ("SWIA 1AA", "invalid", "INVALID_POSTCODE")})


def test_slug(spark):
    check(spark, T.slug, {"ttps://www.x.gov.uk/courts/Bristol-Crown?a#b": "bristol-crown", "https://x.gov.uk/a/LeedsCourt/": "leeds-court", "Bristol  Crown_Court!": "bristol-crown-court", "courts/abc?x=1": "abc", "https://localhost": "localhost", "!!!": None, None: None})


def test_time_cell(spark):
    check(spark, T.time_cell, {"9": ("09:00", "valid_time", None), "9.30": ("09:30", "valid_time", None), "9:30 PM": ("21:30", "valid_time", None), "12am": ("00:00", "valid_time", None), "25:00": (None, "invalid_time", "INVALID_TIME"), "Closed": (None, "known_text_status", None), "10:00:?": ("10:00", "valid_time", "TIME_FORMAT_RECOVERED"), "10:00: 30 minutes": ("10:00", "valid_time", "TIME_FORMAT_RECOVERED"), None: (None, "empty", None), "²": (None, "invalid_time", "INVALID_TIME")})


def test_time_parts(spark):
    check(spark, T.time_parts, {("9", "30"): ("09:30", "valid_time", None), ("09:30", None): ("09:30", "valid_time", None), ("9:30", "?"): ("09:30", "valid_time", "TIME_FORMAT_RECOVERED"), ("closed", "Closed"): (None, "known_text_status", None), ("9", None): (None, "invalid_time", "INVALID_TIME"), ("12:15", "15"): ("12:15", "valid_time", None), (None, "n/a"): (None, "empty", None), ("24", "00"): (None, "invalid_time", "INVALID_TIME")})


def test_measurement(spark):
    check(spark, lambda c: T.measurement(c, T.WIDTH_UNITS), {"800 mm": 80, "80cm": 80, "90": 90, "3 ft or 80 cm": 80, "1.2m": 120, "wide": None, "-3": None, "0": None})
    check(spark, lambda c: T.measurement(c, T.WEIGHT_UNITS, F.lit(1)), {"650KG": 650, "100 lb": 45, "heavy": 1})


def test_rooms(spark):
    check(spark, lambda c: T.room_count(c, F.lit(True)), {"3": 3, "two rooms and 4 small rooms": 6, "three": 3, "many": 1, "200": 1})


def test_sort_instant(spark):
    got = apply(spark, T.sort_instant, ["45000.5", "2024-03-01T10:00:00", "soon", "", None])
    assert [g["rank"] for g in got] == [2, 2, 1, 0, 0] and got[0]["at"] == datetime.datetime(2023, 3, 15, 12) and got[2]["text"] == "soon"


def test_paths(spark):
    check(spark, T.paths_overlap, {("a[1]", "a[1].b"): True, ("a[1]", "a[10]"): False, ("a", "a"): True, ("a.b", "a"): True, ("ab", "a"): False})
    check(spark, T.rule_name, {"addresses[3].type": "address.type", "contacts[1].phone": "contact.phone", "x": "x"})


def test_hashes(spark):
    df = spark.createDataFrame([(2, None), (1, "x")], "b int, a string")
    text = [r[0] for r in df.select(T.canonical_json(F.struct("b", "a"))).collect()]
    assert text == ['{"a":null,"b":2}', '{"a":"x","b":1}']


def test_api_text(spark):
    check(spark, T.api_text, {"“A” – c/o B & C | n/a": "'A' - care of B  and  C  -  Not applicable"})


@pytest.mark.parametrize(("n", "d", "want"), [(1.0, 3.0, 33.3), (0.0, 0.0, 0.0), (2.0, 2.0, 100.0)])
def test_percentage(spark, n, d, want):
    assert spark.createDataFrame([(n, d)], "n double, d double").select(T.percentage(F.col("n"), F.col("d"))).first()[0] == want
