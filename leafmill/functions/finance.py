"""Income, debt-ratio, loan-to-value and payment rules, all on doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.common import col, first_match, strip

# Pay periods per year.
PERIODS_PER_YEAR = {
    "weekly": 52,
    "biweekly": 26,
    "semi-monthly": 24,
    "monthly": 12,
    "quarterly": 4,
    "annual": 1,
}

# Payments per year and the divisor of the monthly rate.
PAYMENT_FREQUENCIES = {"monthly": (12, 1.0), "biweekly": (26, 2.16667), "weekly": (52, 4.33333)}

# Qualification limits, and insurance premium by loan-to-value above.
GDS_LIMIT, TDS_LIMIT = 39, 44
PREMIUM_STEPS = [(95, 4.00), (90, 3.10), (85, 2.80), (80, 2.40)]


def annual_income(amount: str | Column, period: str | Column) -> Column:
    """Struct(period, periods_per_year, annual_income, monthly_income, weekly_income, error)."""
    key = F.lower(strip(period))
    times = first_match([(key == p, F.lit(n)) for p, n in PERIODS_PER_YEAR.items()])
    income = col(amount) * times
    return F.struct(key.alias("period"), times.alias("periods_per_year"), income.alias("annual_income"),
                    (income / 12).alias("monthly_income"), (income / 52).alias("weekly_income"),
                    F.when(times.isNull(), F.concat(F.lit("Unknown pay period: "), col(period))).alias("error"))


def debt_ratios(income: str | Column, payment: str | Column, tax: str | Column, heating: str | Column,
                condo: str | Column | None = None, debts: str | Column | None = None) -> Column:
    """Housing and total debt as percents of monthly income; limits test the unrounded values."""
    zero = F.lit(0.0)
    housing = col(payment) + col(tax) + col(heating) + (zero if condo is None else col(condo)) * 0.5
    total = housing + (zero if debts is None else col(debts))

    # Flat arithmetic: generated code computes a repeated part once, a lambda would be interpreted.
    monthly = col(income) / 12
    gds, tds = F.try_divide(housing, monthly) * 100, F.try_divide(total, monthly) * 100
    gds_ok, tds_ok = gds <= GDS_LIMIT, tds <= TDS_LIMIT
    return F.struct(
        monthly.alias("monthly_income"), housing.alias("housing_costs"), total.alias("total_debts"),
        F.round(gds, 2).alias("gds_ratio"), F.round(tds, 2).alias("tds_ratio"),
        gds_ok.alias("gds_qualified"), tds_ok.alias("tds_qualified"), (gds_ok & tds_ok).alias("fully_qualified"),
        F.when(monthly == 0, "division by zero").alias("error"))


def loan_to_value(loan: str | Column, value: str | Column) -> Column:
    ok = col(value) > 0
    share = F.when(ok, F.try_divide(col(loan), col(value)))
    ltv = share * 100
    rate = first_match([(ltv > above, F.lit(percent)) for above, percent in PREMIUM_STEPS], F.lit(0.0))
    rate = F.when(ok, rate)
    return F.struct(
        F.round(ltv, 2).alias("ltv_ratio"), F.when(ok, col(value) - col(loan)).alias("down_payment"),
        F.round((1 - share) * 100, 2).alias("down_payment_percent"), (ltv > 80).alias("needs_insurance"),
        rate.alias("premium_rate"), (col(loan) * (rate / 100)).alias("premium"),
        F.when(~ok, "Property value must be > 0").alias("error"))


def payment_steps(principal: str | Column, annual_rate: str | Column, years: str | Column | int,
                  frequency: Column) -> list[dict[str, Column]]:
    """Columns of a loan compounded half-yearly, step by step; each step uses those before it.
    The last gives ``payment``. Unknown frequencies count as monthly."""
    amount, percent = col(principal), col(annual_rate)
    term = F.lit(years) if isinstance(years, int) else col(years)
    known = F.when(frequency.isin(list(PAYMENT_FREQUENCIES)), frequency).otherwise("monthly")
    error = first_match([
        (amount <= 0, F.lit("Principal must be > 0")),
        ((percent < 0) | (percent > 30), F.lit("Interest rate must be between 0-30%")),
    ])
    name, per_year, rate, count, growth, each, monthly, paid, wrong = map(F.col, _STEPS)
    pick = lambda part: first_match([(name == f, F.lit(v[part])) for f, v in PAYMENT_FREQUENCIES.items()])
    due = F.when(rate == 0, amount / count).otherwise(F.try_divide(amount * (rate * growth), growth - 1))
    interest = paid - amount

    def at(period: str, divisor: int) -> Column:
        return F.round(F.when(name == period, each).otherwise(monthly * 12 / divisor), 2)

    report = F.struct(
        name.alias("frequency"), F.round(each, 2).alias("payment"),
        F.round(monthly, 2).alias("monthly_payment"), at("biweekly", 26).alias("biweekly_payment"),
        at("weekly", 52).alias("weekly_payment"), count.alias("total_payments"),
        F.round(paid, 2).alias("total_paid"), F.round(interest, 2).alias("total_interest"),
        F.round(F.try_divide(interest, amount) * 100, 2).alias("interest_percent"), wrong.alias("error"))
    steps = [
        {"_name": known, "_wrong": error},
        {"_per_year": pick(0), "_rate": (F.pow(1 + percent / 100 / 2, F.lit(1 / 6)) - 1) / pick(1)},
        {"_count": term * per_year},
        {"_growth": F.pow(1 + rate, count)},
        {"_each": F.when(wrong.isNull(), due)},
        {"_monthly": F.when(name == "monthly", each).otherwise(each * per_year / 12), "_paid": each * count},
        {"payment": report},
    ]
    return steps


_STEPS = ["_name", "_per_year", "_rate", "_count", "_growth", "_each", "_monthly", "_paid", "_wrong"]


def with_payment(df: DataFrame, principal: str | Column, annual_rate: str | Column, years: str | Column | int = 25,
                 frequency: str | Column = "monthly") -> DataFrame:
    """``df`` with a struct ``payment``: frequency, payment, monthly_payment, biweekly_payment,
    weekly_payment, total_payments, total_paid, total_interest, interest_percent, error. ``frequency``
    is a constant or a column. Steps are projections, which stay in generated code."""
    asked = F.lit(frequency) if isinstance(frequency, str) else frequency
    for step in payment_steps(principal, annual_rate, years, asked):
        df = df.withColumns(step)
    return df.drop(*_STEPS)
