"""Golden values of the column rules."""


import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leafmill.functions import finance, normalize, parse, validate


def test_annual_income(one):
    row = one(finance.annual_income("a", "p"), a=2500.0, p=" Biweekly")
    assert row["annual_income"] == 65000 and row["error"] is None
    assert one(finance.annual_income("a", "p"), a=1.0, p="daily")["error"].startswith("Unknown")


def test_debt_ratios(one):
    row = one(finance.debt_ratios("i", "m", "t", "h", "c", "d"), i=80000.0, m=2000.0, t=300.0, h=100.0, c=200.0, d=500.0)
    assert (row["gds_ratio"], row["gds_qualified"]) == (37.5, True)
    assert (row["tds_ratio"], row["tds_qualified"], row["fully_qualified"]) == (45.0, False, False)
    zero = one(finance.debt_ratios("i", "m", "t", "h"), i=0.0, m=1.0, t=0.0, h=0.0)
    assert zero["error"] == "division by zero" and zero["gds_ratio"] is None


def test_loan_to_value(one):
    row = one(finance.loan_to_value("l", "v"), l=450000.0, v=500000.0)
    assert (row["ltv_ratio"], row["needs_insurance"], row["premium_rate"]) == (90.0, True, 2.8)
    assert row["premium"] == pytest.approx(12600)
    assert one(finance.loan_to_value("l", "v"), l=1.0, v=0.0)["error"]


def _payment(spark, principal, rate, frequency="monthly"):
    row = spark.createDataFrame([(principal, rate)], "p double, r double")
    return finance.with_payment(row, "p", "r", 25, frequency).first()["payment"]


@pytest.mark.parametrize("frequency, payment", [("monthly", 2383.67), ("biweekly", 1099.53), ("weekly", 549.63),
                                                ("fortnightly", 2383.67)])
def test_loan_payment(spark, frequency, payment):
    row = _payment(spark, 400000.0, 5.25, frequency)
    assert row["payment"] == payment
    if frequency == "monthly":
        assert (row["total_paid"], row["total_interest"], row["interest_percent"]) == (715101.62, 315101.62, 78.78)


def test_loan_payment_edges(spark):
    assert _payment(spark, 300000.0, 0.0)["payment"] == 1000.0
    assert _payment(spark, 0.0, 1.0)["error"] == "Principal must be > 0"
    assert _payment(spark, 1.0, 31.0)["error"].startswith("Interest rate")


def test_validate_sin(one):
    row = one(validate.validate_sin("s"), s="123 456 782")
    assert row["is_valid"] and row["formatted"] == "123-456-782"
    for bad in ("123456789", "012345674", "812345678", "12345678", "x"):
        assert not one(validate.validate_sin("s"), s=bad)["is_valid"]


def test_validate_contacts(one):
    postal = one(validate.validate_postal_code("s"), s="k1a0b1")
    assert (postal["country"], postal["formatted"]) == ("CA", "K1A 0B1")
    assert one(validate.validate_postal_code("s"), s="12345-6789")["country"] == "US"
    assert one(validate.validate_postal_code("s"), s="12")["confidence"] == 0.5
    assert not one(validate.validate_postal_code("s", "us"), s="K1A0B1")["is_valid"]
    assert one(validate.validate_phone("s"), s="514-555-1234")["formatted"] == "(514) 555-1234"
    assert one(validate.validate_phone("s"), s="1 514 555 1234")["formatted"] == "+1 (514) 555-1234"
    assert not one(validate.validate_phone("s"), s="114-555-1234")["is_valid"]
    assert not one(validate.validate_phone("s", "FR"), s="514-555-1234")["is_valid"]
    mail = one(validate.validate_email("s"), s=" John.Doe@Example.COM ")
    assert (mail["normalized"], mail["tld"], mail["is_valid"]) == ("john.doe@example.com", "com", True)


def test_validate_date_range(one):
    as_of = F.expr("TIMESTAMP_NTZ'2024-06-01 00:00:00'")
    row = one(validate.validate_date_range("a", "b", as_of), a="2024-01-01", b="2024-12-31")
    assert (row["days_difference"], row["is_valid"], row["end_in_future"]) == (365, True, True)
    assert one(validate.validate_date_range("a", "b", as_of), a="31/12/2023", b="2023-01-01")["error"] == \
        "End date before start date"
    assert one(validate.validate_date_range("a", "b", as_of), a="soon", b="2023-01-01")["error"].endswith("soon")


@pytest.mark.parametrize("text, amount", [
    ("$15,000.50", 15000.5), ("15 000,50 $", 15000.5), ("(1,234.56)", -1234.56), ("1,234,567", None),
    ("1.234.567", None), ("USD 5", None), ("CAD 12", 12.0), ("1,234", 1234.0), ("1.234,56 €", 1234.56),
    ("", None), ("nan", None), ("-7", -7.0), ("1e3", 1000.0)])
def test_parse_currency(one, text, amount):
    assert one(parse.parse_currency("s"), s=text) == amount


@pytest.mark.parametrize("text, iso", [
    ("16 décembre 2024", "2024-12-16"), ("December 16, 2024", "2024-12-16"), ("2024-12-16", "2024-12-16"),
    ("03/04/2024", "2024-03-04"), ("25/04/2024", "2024-04-25"), ("Le maison", None), ("2024-02-30", None)])
def test_parse_date(one, text, iso):
    assert one(parse.parse_date("s"), s=text)["iso_format"] == iso


def test_normalize(one):
    assert one(normalize.normalize_address("s"), s="123 Avenue North, Montreal") == "123 AVE N MONTREAL"
    assert one(normalize.normalize_address("s"), s="9  Montée du Rang Ouest #4-b") == "9 MTEE DU RG O #4-B"
    assert one(normalize.normalize_name("s"), s="JEAN-FRANÇOIS TREMBLAY") == "Jean-Francois Tremblay"
    assert one(normalize.normalize_name("s", False), s="mary o'brien mcdonald") == "Mary O'Brien McDonald"
    assert one(normalize.split_full_name("s"), s=" Jean Marie Roy ")["last_name"] == "Roy"
    assert one(normalize.split_full_name("s"), s="Cher")["first_name"] == ""
    assert one(normalize.split_full_name("s"), s="  ")["error"] == "Empty name"


def test_white_space_of_any_kind_is_stripped(one):
    for edge in ("\t", "\r\n", "\u00a0", "\u2003", "\x1f", " \u3000 "):
        assert one(parse.parse_currency("s"), s=f"{edge}12.00{edge}") == 12.0
        assert one(parse.parse_date("s"), s=f"{edge}2024-01-31{edge}")["iso_format"] == "2024-01-31"
        assert one(finance.annual_income("a", "s"), a=10.0, s=f"weekly{edge}")["annual_income"] == 520.0
        found = one(validate.validate_email("s"), s=f"{edge}A@b.co{edge}")
        assert (found["is_valid"], found["domain"], found["tld"]) == (True, "b.co", "co")
        assert one(validate.validate_postal_code("s"), s=f"{edge}k1a 0b1{edge}")["formatted"] == "K1A 0B1"
    assert not one(validate.validate_email("s"), s="a@b.co\nx@y.zz")["is_valid"]
    assert one(parse.parse_currency("s"), s="1\u00a02") is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ABC éÉ-#,.'avenuerOest ", max_size=30), min_size=20, max_size=40))
def test_cleaners_are_idempotent(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    once = frame.select(normalize.normalize_address("s").alias("a"), normalize.address_match_key("s").alias("k"))
    twice = once.select("a", "k", normalize.normalize_address("a").alias("aa"),
                        normalize.address_match_key("k").alias("kk"))
    assert twice.filter("a <> aa OR k <> kk").count() == 0
