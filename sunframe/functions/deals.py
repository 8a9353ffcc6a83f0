"""Money, score and risk formulas of the marketplace, as column expressions.

Arguments are columns, so a term that depends on one party only (the system value) can be
computed on that party's table before any join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PRICE_PER_KW = 100_000.0
YEARLY_DEPRECIATION = 0.05
MAX_DEPRECIATION = 0.5
EFFICIENCY_BASE = 75.0
EFFICIENCY_STEP = 0.001
KWH_PER_KW_DAY = 5
SALE_PRICE = 5
GRID_SAVING = 10
CREDIT_POINTS = {"excellent": 20.0, "good": 15.0, "fair": 10.0, "poor": 0.0}
UNKNOWN_CREDIT_POINTS = 5.0
EMI_MONTHS = 12
MARKUP = 0.15
INVESTOR_ROI_CAP = 25.0
BUYER_ROI_CAP = 20.0


def present(x: Column) -> Column:
    """True for a value that is neither missing nor zero."""
    return F.coalesce(x, F.lit(0.0)) != 0


def _bounded(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def system_value(capacity: Column, age: Column, efficiency: Column) -> Column:
    depreciation = F.least(F.coalesce(age, F.lit(0.0)) * YEARLY_DEPRECIATION, F.lit(MAX_DEPRECIATION))
    premium = F.when(present(efficiency), (efficiency - EFFICIENCY_BASE) * EFFICIENCY_STEP).otherwise(0.0)
    return F.when(present(capacity), capacity * PRICE_PER_KW * (1 - depreciation) * (1 + premium)
                  ).otherwise(0.0)


def credit_points(rating: Column) -> Column:
    points = F.lit(UNKNOWN_CREDIT_POINTS)
    for name, worth in CREDIT_POINTS.items():
        points = F.when(rating == name, F.lit(worth)).otherwise(points)
    return points


def distance_points(distance: Column, reach_km: float) -> Column:
    return F.greatest(F.lit(0.0), 20 - distance / reach_km * 20)


def capacity_points(capacity: Column, demand: Column) -> Column:
    ratio = capacity / demand
    fits = F.when(ratio.between(0.8, 1.3), 30.0).when(ratio.between(0.6, 1.5), 20.0).otherwise(10.0)
    return F.when(present(capacity) & present(demand), fits).otherwise(15.0)


def buyer_finance_points(value: Column, budget: Column, balance: Column) -> Column:
    return (F.when(present(budget) & (value <= budget), 30.0)
            .when(balance >= value * 0.5, 20.0).otherwise(5.0))


def buyer_seller_score(distance: Column, capacity: Column, demand: Column, value: Column,
                       budget: Column, balance: Column, rating: Column) -> Column:
    return _bounded(distance_points(distance, 25.0) + capacity_points(capacity, demand)
                    + buyer_finance_points(value, budget, balance) + credit_points(rating))


def investor_seller_score(distance: Column, efficiency: Column, age: Column, value: Column,
                          balance: Column, max_investment: Column, rating: Column) -> Column:
    condition = F.when(
        present(efficiency) & present(age),
        F.least(F.lit(30.0), F.greatest(F.lit(5.0), efficiency * 0.3 - 20 - age * 2))).otherwise(15.0)
    money = (F.when((balance >= value) & (max_investment >= value), 30.0)
             .when(balance >= value * 0.7, 20.0).otherwise(5.0))
    return _bounded(distance_points(distance, 50.0) + condition + money + credit_points(rating))


def deal_terms(value: Column, balance: Column) -> Column:
    """What a buyer would pay for a system, as one struct."""
    return F.struct(
        value.alias("seller_asking_price"),
        balance.alias("buyer_budget_available"),
        (balance >= value).alias("can_afford_full"),
        F.greatest(F.lit(0.0), value - balance).alias("financing_needed"),
        F.lit(EMI_MONTHS).cast("long").alias("suggested_emi_months"),
        (value / EMI_MONTHS).alias("monthly_emi"),
        (value * MARKUP).alias("profit_potential"),
    )


def annual_revenue(capacity: Column) -> Column:
    return F.coalesce(capacity, F.lit(0.0)) * (KWH_PER_KW_DAY * 365 * SALE_PRICE)


def investment_terms(capacity: Column, value: Column, balance: Column) -> Column:
    """What an investor would put in and get back, as one struct."""
    revenue = annual_revenue(capacity)
    return F.struct(
        value.alias("investment_required"),
        balance.alias("investor_available_capital"),
        (balance >= value).alias("can_invest"),
        revenue.alias("estimated_annual_revenue"),
        F.when(revenue > 0, value / (revenue + 1)).otherwise(0.0).alias("estimated_payback_years"),
        F.when(value > 0, revenue / value * 100).otherwise(0.0).alias("roi_annual_percentage"),
    )


def investor_roi(capacity: Column, value: Column) -> Column:
    return F.when(present(capacity) & (value > 0), F.least(
        annual_revenue(capacity) / value * 100, F.lit(INVESTOR_ROI_CAP))).otherwise(0.0)


def buyer_roi(capacity: Column, value: Column) -> Column:
    saving = capacity * (KWH_PER_KW_DAY * GRID_SAVING * 365)
    return F.when(present(capacity) & (value > 0),
                  F.least(saving / value * 100, F.lit(BUYER_ROI_CAP))).otherwise(0.0)


def party_risk(rating: Column, score: Column) -> Column:
    return (F.when((rating == "excellent") & (score >= 80), "low")
            .when(rating.isin("excellent", "good") & (score >= 60), "medium").otherwise("high"))
