"""Jobs over income slips and loan books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.functions import finance as rules
from leafmill.functions.common import count_true, first_match


def yearly_income(slips: DataFrame) -> DataFrame:
    """One row per applicant and year, so later windows hold a few rows per applicant."""
    return slips.groupBy("applicant", "year").agg(F.sum("amount").alias("amount"))


def _trend_label(percent: Column) -> Column:
    return first_match([(percent > 0, F.lit("increasing")), (percent < 0, F.lit("decreasing"))], F.lit("stable"))


def income_trend(slips: DataFrame) -> DataFrame:
    """Change on the year before, per applicant and year."""
    years = Window.partitionBy("applicant").orderBy("year")
    staged = yearly_income(slips).withColumn("previous", F.lag("amount").over(years))
    change = F.try_divide(F.col("amount") - F.col("previous"), F.col("previous")) * 100
    label = first_match([(F.col("previous").isNull(), F.lit("single_year")), (change.isNull(), F.lit(None))],
                        _trend_label(change))
    return staged.withColumn("trend_percent", F.round(change, 2)).withColumn("trend", label)


def income_history(slips: DataFrame) -> DataFrame:
    """Mean, total, range and latest trend per applicant; a previous amount of
    zero is a division-by-zero error."""
    years = Window.partitionBy("applicant").orderBy("year")
    staged = yearly_income(slips).withColumn("previous", F.lag("amount").over(years))
    grouped = staged.groupBy("applicant").agg(
        F.round(F.avg("amount"), 2).alias("average_income"), F.round(F.sum("amount"), 2).alias("total_income"),
        F.round(F.min("amount"), 2).alias("min_income"), F.round(F.max("amount"), 2).alias("max_income"),
        F.count(F.lit(1)).alias("years"), F.max(F.struct("year", "amount", "previous")).alias("last"))
    change = F.try_divide(F.col("last.amount") - F.col("last.previous"), F.col("last.previous")) * 100
    single, broken = F.col("years") == 1, (F.col("years") > 1) & (F.col("last.previous") == 0)
    return grouped.select(
        "applicant", "average_income", "total_income", "min_income", "max_income", "years",
        F.round(F.when(single, 0.0).otherwise(change), 2).alias("trend_percent"),
        first_match([(single, F.lit("single_year")), (broken, F.lit(None))], _trend_label(change)).alias("trend"),
        F.when(broken, "division by zero").alias("error"))


def loan_book(loans: DataFrame, pay: DataFrame) -> DataFrame:
    """Income, payment, ratios and loan-to-value of every loan."""
    incomes = pay.select("applicant", rules.annual_income("amount", "period").alias("income"))
    joined = loans.join(incomes, "applicant", "left")
    staged = rules.with_payment(joined, "principal", "annual_rate", "years", F.col("freq")).withColumnRenamed("payment", "pay")
    staged = staged.withColumn("ltv", rules.loan_to_value("principal", "property_value"))
    staged = staged.withColumn("ratios", rules.debt_ratios(
        "income.annual_income", "pay.monthly_payment", "tax", "heating", "condo", "debts"))
    error = F.coalesce("income.error", "pay.error", "ltv.error", "ratios.error")
    return staged.select(
        "id", "applicant", "segment", "principal", "income.annual_income", "pay.monthly_payment",
        "ratios.gds_ratio", "ratios.tds_ratio", "ratios.fully_qualified", "ltv.ltv_ratio", "ltv.premium",
        error.alias("error"))


def loan_segments(book: DataFrame) -> DataFrame:
    sound = F.col("error").isNull()
    return book.groupBy("segment").agg(
        F.count(F.lit(1)).alias("loans"), count_true(sound).alias("sound_loans"),
        count_true(sound & F.col("fully_qualified")).alias("qualified_loans"),
        F.round(F.avg(F.when(sound, F.col("ltv_ratio"))), 4).alias("avg_ltv"),
        F.round(F.avg(F.when(sound, F.col("gds_ratio"))), 4).alias("avg_gds"))
