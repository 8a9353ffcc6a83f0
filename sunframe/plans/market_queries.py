"""Queries over matching, investing and energy offers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import deals
from ..operators import enrich, investing, matching
from .registry import BY_DEVICE, big, query, r


def _km(a: str, b: str) -> str:
    return (f"2 * 6371 * asin(sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude))"
            f" * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)))")


def _credit(c: str) -> str:
    return f"CASE {c} WHEN 'excellent' THEN 20.0 WHEN 'good' THEN 15.0 WHEN 'fair' THEN 10.0 WHEN 'poor' THEN 0.0 ELSE 5.0 END"


def _risk(rating: str, score: str) -> str:
    return (f"CASE WHEN {rating} = 'excellent' AND {score} >= 80 THEN 'low' "
            f"WHEN {rating} IN ('excellent', 'good') AND {score} >= 60 THEN 'medium' ELSE 'high' END")


_VALUED = """valued AS (SELECT *, CASE WHEN coalesce(capacity_kw, 0) = 0 THEN 0.0 ELSE capacity_kw * 100000.0::DOUBLE
    * (1 - least(coalesce(system_age_years, 0) * 0.05::DOUBLE, 0.5))
    * (1 + CASE WHEN coalesce(system_efficiency, 0) = 0 THEN 0 ELSE (system_efficiency - 75) * 0.001::DOUBLE END) END AS v
    FROM sellers)"""

_DISTANCE = {reach: f"greatest(0.0, 20 - km / {reach}.0::DOUBLE * 20)" for reach in (25, 50)}
_CAPACITY = """CASE WHEN coalesce(capacity_kw, 0) = 0 OR coalesce(demand_kw, 0) = 0 THEN 15.0
    WHEN capacity_kw / demand_kw BETWEEN 0.8::DOUBLE AND 1.3::DOUBLE THEN 30.0
    WHEN capacity_kw / demand_kw BETWEEN 0.6::DOUBLE AND 1.5::DOUBLE THEN 20.0 ELSE 10.0 END"""
_FINANCE = """CASE WHEN coalesce(budget_rupees, 0) <> 0 AND v <= budget_rupees THEN 30.0
    WHEN available_balance >= v * 0.5 THEN 20.0 ELSE 5.0 END"""
_SCORE = f"greatest(0.0, least(100.0, {_DISTANCE[25]} + {_CAPACITY} + {_FINANCE} + {_credit('b_rating')}))"

_PAIRS = f"""pairs AS (SELECT *, {_SCORE} AS score FROM (
    SELECT s.seller_id, s.capacity_kw, s.v, s.credit_rating AS s_rating, s.financial_score AS s_score,
           b.buyer_id, b.demand_kw, b.budget_rupees, b.available_balance, b.credit_rating AS b_rating,
           b.financial_score AS b_score, b.willing_to_travel_km AS reach, {_km('s', 'b')} AS km
    FROM valued s, buyers b) WHERE km <= reach)"""

_TERMS = f"""{r('v', 'seller_asking_price')}, {r('available_balance', 'buyer_budget_available')},
    available_balance >= v AS can_afford_full, {r('greatest(0.0, v - available_balance)', 'financing_needed')},
    {big('12', 'suggested_emi_months')}, {r('v / 12', 'monthly_emi')}, {r('v', 'recommended_price_rupees')}"""


def _flat(df):
    """Terms as columns, so that rows compare by value."""
    terms = [F.col(f"financial_feasibility.{f.name}") for f in df.schema["financial_feasibility"].dataType
             if f.name not in df.columns]
    return df.select(*[c for c in df.columns if c != "financial_feasibility"], *terms)


def _shown(expression: str, decimals: int | None = None) -> str:
    """A number inside a text of the SQL twin."""
    if decimals is not None:
        expression = f"CAST(round({expression}, {decimals}) AS DECIMAL(20, {decimals}))"
    return f"coalesce(CAST({expression} AS VARCHAR), 'unknown')"


@query("radius_join", f"SELECT seller_id, buyer_id, {r('km', 'distance_km')} FROM pairs", "sellers buyers",
       f"{_VALUED}, {_PAIRS}")
def _radius_join(spark, sf):
    pairs = matching.pairs_within(
        matching._sided(view(spark, sf, "sellers"), "seller"), matching._sided(view(spark, sf, "buyers"), "buyer"),
        "seller", "buyer", F.col("buyer_willing_to_travel_km"))
    return pairs.select("seller_id", "buyer_id", "distance_km")


@query("match_seller_to_buyers", f"""
    SELECT concat(seller_id, '_to_', buyer_id) AS match_id, seller_id, buyer_id, {r('score', 'match_score')},
        {r('km', 'distance_km')}, {_risk('b_rating', 'b_score')} AS transaction_risk, {_TERMS},
        {r('v * 0.15::DOUBLE', 'profit_potential')},
        'Buyer needs ' || {_shown('demand_kw')} || 'kW, seller has ' || {_shown('capacity_kw')} || 'kW at ' || {_shown('km', 1)}
        || 'km. Financial score: ' || {_shown('b_score', 0)} || '/100' AS compatibility_reason
    FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY score DESC, buyer_id) AS k FROM pairs)
    WHERE k <= 5""", "sellers buyers", f"{_VALUED}, {_PAIRS}")
def _seller_to_buyers(spark, sf):
    return _flat(matching.match_seller_to_buyers(view(spark, sf, "sellers"), view(spark, sf, "buyers"), 5))


@query("match_buyer_to_sellers", f"""
    SELECT concat(buyer_id, '_to_', seller_id) AS match_id, buyer_id, seller_id, {r('score', 'match_score')},
        {r('km', 'distance_km')}, {_risk('s_rating', 's_score')} AS transaction_risk, {_TERMS},
        'Seller has ' || {_shown('capacity_kw')} || 'kW (buyer needs ' || {_shown('demand_kw')} || 'kW). Financial match: '
        || {_shown('b_score', 0)} || '/100. Seller rating: ' || s_rating AS compatibility_reason
    FROM (SELECT *, row_number() OVER (PARTITION BY buyer_id ORDER BY score DESC, seller_id) AS k FROM pairs
          WHERE capacity_kw BETWEEN demand_kw * 0.8::DOUBLE AND demand_kw * 1.3::DOUBLE) WHERE k <= 10""",
       "sellers buyers", f"{_VALUED}, {_PAIRS}")
def _buyer_to_sellers(spark, sf):
    made = _flat(matching.match_buyer_to_sellers(view(spark, sf, "buyers"), view(spark, sf, "sellers"), 10))
    return made.drop("profit_potential")


_ROI = """CASE WHEN coalesce(capacity_kw, 0) = 0 OR v <= 0 THEN 0.0
    ELSE least(capacity_kw * 9125 / v * 100, 25.0) END"""
_INVESTOR_SCORE = f"""greatest(0.0, least(100.0, {_DISTANCE[50]}
    + CASE WHEN coalesce(system_efficiency, 0) <> 0 AND coalesce(system_age_years, 0) <> 0
           THEN least(30.0, greatest(5.0, system_efficiency * 0.3::DOUBLE - 20 - system_age_years * 2)) ELSE 15.0 END
    + CASE WHEN balance >= v AND max_investment >= v THEN 30.0 WHEN balance >= v * 0.7::DOUBLE THEN 20.0 ELSE 5.0 END
    + {_credit('credit_rating')}))"""


@query("match_investor_to_sellers", f"""
    SELECT concat(investor_id, '_to_', seller_id) AS match_id, investor_id, seller_id,
        {r(_INVESTOR_SCORE, 'match_score')}, {r('km', 'distance_km')},
        {_risk('credit_rating', 'financial_score')} AS transaction_risk, {r('v', 'recommended_price_rupees')},
        {r('roi', 'profit_potential')}, {r('v', 'investment_required')}, {r('balance', 'investor_available_capital')},
        balance >= v AS can_invest, {r('coalesce(capacity_kw, 0) * 9125', 'estimated_annual_revenue')},
        {r('CASE WHEN coalesce(capacity_kw, 0) > 0 THEN v / (capacity_kw * 9125 + 1) ELSE 0 END', 'estimated_payback_years')},
        {r('CASE WHEN v > 0 THEN coalesce(capacity_kw, 0) * 9125 / v * 100 ELSE 0 END', 'roi_annual_percentage')},
        'Seller has ' || {_shown('capacity_kw')} || 'kW system, ' || {_shown('system_efficiency', 0)} || '% efficient, '
        || {_shown('system_age_years', 1)} || ' years old. ROI potential: ' || {_shown('roi', 1)} || '%' AS compatibility_reason
    FROM (SELECT *, row_number() OVER (PARTITION BY investor_id ORDER BY roi DESC, seller_id) AS k FROM (
        SELECT *, {_ROI} AS roi FROM (
            SELECT s.*, i.investor_id, i.available_balance AS balance, i.max_investment, i.willing_to_travel_km AS reach,
                   {_km('i', 's')} AS km FROM valued s, investors i) WHERE km <= reach)) WHERE k <= 10""",
       "sellers investors", _VALUED)
def _investor_to_sellers(spark, sf):
    return _flat(matching.match_investor_to_sellers(view(spark, sf, "investors"), view(spark, sf, "sellers"), 10))


_PLACES = "places AS (SELECT DISTINCT latitude, longitude FROM device_registry)"


def _nearby_sql(party: str, ident: str, radius: int, columns: str, source: str | None = None) -> str:
    return f"""SELECT {r('la', 'place_latitude')}, {r('lo', 'place_longitude')}, {ident}, {columns},
        {r('d', 'distance_km')}, credit_rating FROM (
        SELECT *, row_number() OVER (PARTITION BY la, lo ORDER BY d, {ident}) AS k FROM (
            SELECT x.*, p.latitude AS la, p.longitude AS lo, round({_km('p', 'x')}, 2) AS d
            FROM places p, {source or party} x) WHERE d <= {radius}) WHERE k <= 5"""


def _places(spark, sf):
    return view(spark, sf, "device_registry").select("latitude", "longitude").distinct()


@query("nearby_sellers", _nearby_sql("sellers", "seller_id", 25, f"""{r('capacity_kw', 'capacity_kw')},
    {r('system_efficiency', 'efficiency')}, {r('system_age_years', 'system_age_years')}, {r('v', 'estimated_price')},
    {r('CASE WHEN coalesce(capacity_kw, 0) = 0 OR v <= 0 THEN 0 ELSE least(capacity_kw * 18250 / v * 100, 20.0) END', 'roi_potential')}""",
    "valued"), "sellers device_registry", f"{_VALUED}, {_PLACES}")
def _nearby_sellers(spark, sf):
    return matching.nearby_sellers(_places(spark, sf), view(spark, sf, "sellers"))


@query("nearby_buyers", _nearby_sql("buyers", "buyer_id", 25, f"""{r('demand_kw', 'demand_kw')},
    {r('budget_rupees', 'budget_rupees')}, {r('financial_score', 'financial_score')}"""), "buyers device_registry", _PLACES)
def _nearby_buyers(spark, sf):
    return matching.nearby_buyers(_places(spark, sf), view(spark, sf, "buyers"))


@query("nearby_investors", _nearby_sql("investors", "investor_id", 50, f"""{r('available_balance', 'available_capital')},
    {r('max_investment', 'max_investment')}, {r('roi_expectation', 'roi_expectation')},
    {r('financial_score', 'financial_score')}"""), "investors device_registry", _PLACES)
def _nearby_investors(spark, sf):
    return matching.nearby_investors(_places(spark, sf), view(spark, sf, "investors"))


# -- formulas on their own -------------------------------------------------------------------

def _valued(spark, sf):
    df = view(spark, sf, "sellers")
    return df.withColumn("v", deals.system_value(
        F.col("capacity_kw"), F.col("system_age_years"), F.col("system_efficiency")))


@query("system_value", f"SELECT seller_id, {r('v', 'system_value')} FROM valued", "sellers", _VALUED)
def _system_value(spark, sf):
    return _valued(spark, sf).select("seller_id", F.col("v").alias("system_value"))


@query("roi_estimates", f"""SELECT seller_id, {r(_ROI, 'investor_roi')},
    {r('CASE WHEN coalesce(capacity_kw, 0) = 0 OR v <= 0 THEN 0 ELSE least(capacity_kw * 18250 / v * 100, 20.0) END', 'buyer_roi')}
    FROM valued""", "sellers", _VALUED)
def _roi(spark, sf):
    return _valued(spark, sf).select(
        "seller_id", deals.investor_roi(F.col("capacity_kw"), F.col("v")).alias("investor_roi"),
        deals.buyer_roi(F.col("capacity_kw"), F.col("v")).alias("buyer_roi"))


@query("party_risk", f"""SELECT 'buyer' AS party, buyer_id AS id, {_risk('credit_rating', 'financial_score')} AS risk FROM buyers
    UNION ALL SELECT 'seller', seller_id, {_risk('credit_rating', 'financial_score')} FROM sellers""", "buyers sellers")
def _party_risk(spark, sf):
    def part(name):
        df = view(spark, sf, f"{name}s")
        return df.select(F.lit(name).alias("party"), F.col(f"{name}_id").alias("id"), deals.party_risk(
            F.col("credit_rating"), F.col("financial_score")).alias("risk"))

    return part("buyer").unionAll(part("seller"))


# Each buyer against the seller with the matching number; a plain equality join.
_DEAL = """deal AS (SELECT b.*, s.capacity_kw, s.v, s.system_age_years, s.system_efficiency, s.seller_id,
    CAST(buyer_id % 60 AS DOUBLE) AS km, b.credit_rating AS b_rating
    FROM buyers b JOIN valued s ON s.seller_id = b.buyer_id % (SELECT count(*) FROM sellers))"""


def _deal(spark, sf):
    sellers = _valued(spark, sf).select("seller_id", "capacity_kw", "v", "system_age_years", "system_efficiency")
    buyers = view(spark, sf, "buyers")
    n = sellers.count()
    return buyers.join(sellers, F.col("buyer_id") % n == F.col("seller_id")).withColumn(
        "km", (F.col("buyer_id") % 60).cast("double"))


@query("buyer_seller_score", f"SELECT buyer_id, {r(_SCORE, 'score')} FROM deal", "buyers sellers", f"{_VALUED}, {_DEAL}")
def _buyer_seller_score(spark, sf):
    score = deals.buyer_seller_score(F.col("km"), F.col("capacity_kw"), F.col("demand_kw"), F.col("v"),
                                     F.col("budget_rupees"), F.col("available_balance"), F.col("credit_rating"))
    return _deal(spark, sf).select("buyer_id", score.alias("score"))


_INVEST_DEAL = """deal AS (SELECT *, available_balance AS balance, budget_rupees AS max_investment FROM (
    SELECT b.buyer_id, b.available_balance, b.budget_rupees, b.credit_rating, s.v, s.system_age_years, s.system_efficiency,
    CAST(buyer_id % 60 AS DOUBLE) AS km FROM buyers b JOIN valued s ON s.seller_id = b.buyer_id % (SELECT count(*) FROM sellers)))"""


@query("investor_seller_score", f"SELECT buyer_id, {r(_INVESTOR_SCORE, 'score')} FROM deal", "buyers sellers",
       f"{_VALUED}, {_INVEST_DEAL}")
def _investor_seller_score(spark, sf):
    score = deals.investor_seller_score(
        F.col("km"), F.col("system_efficiency"), F.col("system_age_years"), F.col("v"), F.col("available_balance"),
        F.col("budget_rupees"), F.col("credit_rating"))
    return _deal(spark, sf).select("buyer_id", score.alias("score"))


@query("deal_terms", f"SELECT buyer_id, {_TERMS}, {r('v * 0.15::DOUBLE', 'profit_potential')} FROM deal",
       "buyers sellers", f"{_VALUED}, {_DEAL}")
def _deal_terms(spark, sf):
    terms = deals.deal_terms(F.col("v"), F.col("available_balance"))
    return _deal(spark, sf).select("buyer_id", terms.alias("t"), F.col("v").alias("recommended_price_rupees")).select(
        "buyer_id", "t.*", "recommended_price_rupees")


@query("investment_terms", f"""SELECT buyer_id, {r('v', 'investment_required')},
    {r('available_balance', 'investor_available_capital')}, available_balance >= v AS can_invest,
    {r('coalesce(capacity_kw, 0) * 9125', 'estimated_annual_revenue')},
    {r('CASE WHEN coalesce(capacity_kw, 0) > 0 THEN v / (capacity_kw * 9125 + 1) ELSE 0 END', 'estimated_payback_years')},
    {r('CASE WHEN v > 0 THEN coalesce(capacity_kw, 0) * 9125 / v * 100 ELSE 0 END', 'roi_annual_percentage')} FROM deal""",
       "buyers sellers", f"{_VALUED}, {_DEAL}")
def _investment_terms(spark, sf):
    terms = deals.investment_terms(F.col("capacity_kw"), F.col("v"), F.col("available_balance"))
    return _deal(spark, sf).select("buyer_id", terms.alias("t")).select("buyer_id", "t.*")


@query("top_k_per_key", f"""SELECT device_id, reading_id, {r('power_kw', 'power_kw')} FROM (
    SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY power_kw DESC, reading_id) AS k FROM readings)
    WHERE k <= 3""", "readings")
def _top_k(spark, sf):
    from ..operators.series import top_k_per_key

    return top_k_per_key(view(spark, sf, "readings").select("device_id", "reading_id", "power_kw"), ["device_id"],
                         [F.desc("power_kw"), F.asc("reading_id")], 3)


# -- host spaces -----------------------------------------------------------------------------

@query("affordable_hosts", f"""SELECT buyer_id, {big('count(h.id)', 'affordable_hosts')},
    {r('coalesce(sum(h.available_capacity_kw), 0)', 'affordable_kw')}
    FROM space_buyers b LEFT JOIN host_spaces h ON h.available_capacity_kw * 550000.0::DOUBLE <= b.budget * 1.2::DOUBLE
    GROUP BY buyer_id""", "space_buyers host_spaces")
def _affordable(spark, sf):
    return investing.affordable_hosts(view(spark, sf, "space_buyers"), view(spark, sf, "host_spaces"))


_NEAR = f"""near AS (SELECT *, least(available_capacity_kw * 4500 / (daily_energy_demand_kwh * 30), 1.0) * 0.3::DOUBLE
        + greatest(0.0, 1 - km / 50) * 0.4::DOUBLE + CASE WHEN max_price_per_kwh >= 8 THEN 0.3 ELSE 0.0 END AS iscore
    FROM (SELECT h.*, i.id AS industry_id, i.company_name, i.daily_energy_demand_kwh, i.max_price_per_kwh, {_km('h', 'i')} AS km
          FROM host_spaces h, industries i) WHERE km <= 50)"""
_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iscore DESC, industry_id) AS k
    FROM near) WHERE k = 1)"""
_HOSTS = f"""{_NEAR}, {_BEST}, scored AS (SELECT *,
    (max_price_per_kwh * 150 * 0.75::DOUBLE - monthly_rent_per_kw) AS profit,
    available_capacity_kw * 4500 / (daily_energy_demand_kwh * 30) AS ratio,
    (CASE WHEN has_structural_certificate THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END + host_rating / 5
     + CASE WHEN is_near_industry THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END) / 3 AS risk_base FROM best),
    rated AS (SELECT *, profit * 12 / 550000 * 100 AS roi, available_capacity_kw * 550000.0::DOUBLE AS cost,
    CASE WHEN profit > 0 THEN floor(550000 / profit) ELSE 999 END AS payback,
    CASE WHEN profit * 12 / 550000 * 100 >= 20 THEN 1.0::DOUBLE WHEN profit * 12 / 550000 * 100 >= 15 THEN 0.8::DOUBLE
         WHEN profit * 12 / 550000 * 100 >= 12 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS roi_score,
    CASE WHEN ratio BETWEEN 0.8::DOUBLE AND 1.2::DOUBLE THEN 1.0::DOUBLE WHEN ratio BETWEEN 0.5::DOUBLE AND 1.5::DOUBLE THEN 0.8::DOUBLE
         WHEN ratio BETWEEN 0.3::DOUBLE AND 2.0::DOUBLE THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS demand_score,
    CASE WHEN km <= 5 THEN 1.0::DOUBLE WHEN km <= 15 THEN 0.8::DOUBLE WHEN km <= 30 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS location_score
    FROM scored)"""
_OPPORTUNITY = """opportunity AS (SELECT *, floor((place * 0.25::DOUBLE + roi_score * 0.30::DOUBLE + risk * 0.20::DOUBLE
        + demand_score * 0.15::DOUBLE + location_score * 0.10::DOUBLE) * 100) AS points FROM (
    SELECT b.buyer_id, b.budget, h.*,
        CASE WHEN b.city = h.city THEN 1.0::DOUBLE WHEN b.state = h.state THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS place,
        risk_base * CASE risk_tolerance WHEN 'low' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS risk
    FROM space_buyers b JOIN rated h ON h.cost <= b.budget * 1.2::DOUBLE))"""


@query("nearby_industries", f"""SELECT id AS host_id, {big('count(*)', 'industries')}, {r('min(km)', 'nearest_km')},
    {r('avg(km)', 'mean_km')} FROM near GROUP BY id""", "host_spaces industries", _NEAR)
def _nearby_industries(spark, sf):
    near = investing.nearby_industries(view(spark, sf, "host_spaces"), view(spark, sf, "industries"), summary=True)
    return near.select(F.col("h_id").alias("host_id"), F.col("pairs").alias("industries"), "nearest_km", "mean_km")


@query("industry_score", f"SELECT id AS host_id, industry_id, {r('km', 'distance_km')}, {r('iscore', 'score')} FROM best",
       "host_spaces industries", f"{_NEAR}, {_BEST}")
def _industry_score(spark, sf):
    best = investing.best_industry(view(spark, sf, "host_spaces"), view(spark, sf, "industries"))
    return best.select(F.col("h_id").alias("host_id"), F.col("i_id").alias("industry_id"), "distance_km",
                       F.col("industry_score").alias("score"))


@query("opportunity_scores", f"""SELECT id AS host_id, {r('roi_score', 'roi_score')}, {r('risk_base', 'risk_base')},
    {r('demand_score', 'demand_score')}, {r('location_score', 'location_score')} FROM rated""",
       "host_spaces industries", _HOSTS)
def _opportunity_scores(spark, sf):
    rated = investing.host_scores(investing.best_industry(view(spark, sf, "host_spaces"), view(spark, sf, "industries")))
    return rated.select(F.col("h_id").alias("host_id"), "roi_score", "risk_base", "demand_score", "location_score")


_KW = "least(available_capacity_kw, budget / 550000)"
_MONEY = f"""buyer_id, id AS host_id, concat(city, ', ', state) AS location, industry_id, company_name AS industry_name,
    host_name, {r('host_rating', 'host_rating')}, {r('latitude', 'latitude')}, {r('longitude', 'longitude')},
    array_to_string(property_images, ';') AS property_images,
    {r('max_price_per_kwh', 'industry_price_per_kwh')}, {r('km', 'distance_km')}, {r(_KW, 'capacity_kw')},
    {r(f'{_KW} * 500000', 'panel_price')}, {r(f'{_KW} * 50000', 'installation_cost')},
    {r(f'{_KW} * 550000', 'total_investment')}, {r(f'{_KW} * 150', 'monthly_production_kwh')},
    {r(f'{_KW} * 150 * max_price_per_kwh', 'monthly_revenue')}, {r(f'{_KW} * profit', 'monthly_profit')},
    {r('roi', 'roi_percentage')}, {big('payback', 'payback_months')}, {big('floor((1 - risk) * 100)', 'risk_score')},
    {big('points', 'match_score')}, points >= 80 AS is_recommended"""


@query("find_opportunities", f"""SELECT {_MONEY}, {big('place_no', 'opportunity_rank')} FROM (
    SELECT *, row_number() OVER (PARTITION BY buyer_id ORDER BY points DESC, id) AS place_no FROM opportunity)
    WHERE place_no <= 5""",
       "host_spaces industries space_buyers", f"{_HOSTS}, {_OPPORTUNITY}")
def _find_opportunities(spark, sf):
    return _images(investing.find_opportunities(
        view(spark, sf, "space_buyers"), view(spark, sf, "host_spaces"), view(spark, sf, "industries"), 5))


def _images(df):
    return df.withColumn("property_images", F.array_join("property_images", ";"))


@query("score_opportunity", f"SELECT {_MONEY} FROM opportunity WHERE id = buyer_id % (SELECT count(*) FROM host_spaces)",
       "host_spaces industries space_buyers", f"{_HOSTS}, {_OPPORTUNITY}")
def _score_opportunity(spark, sf):
    buyers = view(spark, sf, "space_buyers")
    hosts = view(spark, sf, "host_spaces")
    pairs = buyers.select("buyer_id", (F.col("buyer_id") % hosts.count()).alias("host_id"))
    return _images(investing.score_opportunity(pairs, buyers, hosts, view(spark, sf, "industries")))


@query("opportunity_finance", f"""SELECT host_id, {r('profit', 'profit_per_kw')}, {r('roi', 'roi_percentage')},
    {big('payback', 'payback_months')} FROM rated""", "host_spaces industries", _HOSTS)
def _opportunity_finance(spark, sf):
    rated = investing.host_scores(investing.best_industry(view(spark, sf, "host_spaces"), view(spark, sf, "industries")))
    return rated.select(F.col("h_host_id").alias("host_id"), "profit_per_kw", F.col("roi").alias("roi_percentage"),
                        F.col("payback").cast("long").alias("payback_months"))


_OFFERS = """offers AS (SELECT *, row_number() OVER (PARTITION BY buyer_id ORDER BY score DESC, host_id) AS k,
    count(*) OVER (PARTITION BY buyer_id) AS n FROM (
    SELECT *, greatest(0.0, 100 - price_per_kwh / max_price * 50) * 0.30::DOUBLE + rating * 20 * 0.25::DOUBLE
        + CASE WHEN required_kwh > 0 THEN least(100.0, available_kwh / required_kwh * 100) ELSE 100.0 END * 0.10::DOUBLE
        + CASE WHEN renewable_cert AND renewable_pref THEN 10.0 ELSE 0.0 END
        + greatest(0.0, 100 - km / 50 * 100) * 0.25::DOUBLE AS score
    FROM (SELECT b.buyer_id, b.max_price, b.required_kwh, b.renewable_pref, h.*,
        sqrt((h.latitude - b.latitude) * (h.latitude - b.latitude) + (h.longitude - b.longitude) * (h.longitude - b.longitude)) * 111 AS km
        FROM energy_buyers b JOIN energy_hosts h ON h.price_per_kwh <= b.max_price))),
    matched AS (SELECT b.buyer_id, o.host_id, coalesce(o.score, 0) AS score, o.price_per_kwh, o.km,
        o.available_kwh >= o.required_kwh AS can_fulfill, coalesce(o.n, 0) AS n
        FROM energy_buyers b LEFT JOIN offers o ON o.buyer_id = b.buyer_id AND o.k = 1)"""


@query("price_match", f"""SELECT buyer_id, host_id IS NOT NULL AS matched, host_id AS best_host_id, {r('score', 'best_score')},
    {r('price_per_kwh', 'best_price')}, {r('km', 'best_distance')}, can_fulfill, {big('n', 'alternatives')} FROM matched""",
       "energy_buyers energy_hosts", _OFFERS)
def _price_match(spark, sf):
    return investing.price_match(view(spark, sf, "energy_buyers"), view(spark, sf, "energy_hosts"))


@query("match_metrics", f"""SELECT {big('count(*)', 'n_buyers')}, {r('count(host_id) / count(*) * 100', 'match_rate')},
    {r('count(*) FILTER (WHERE can_fulfill) / count(*) * 100', 'fulfillment_rate')},
    {r('avg(score) FILTER (WHERE host_id IS NOT NULL)', 'avg_match_score')}, {r('avg(n)', 'avg_alternatives')},
    {r('avg(price_per_kwh)', 'price_satisfaction')}, {r('avg(km) FILTER (WHERE km <> 0)', 'avg_distance_km')} FROM matched""",
       "energy_buyers energy_hosts", _OFFERS)
def _match_metrics(spark, sf):
    return investing.match_metrics(investing.price_match(view(spark, sf, "energy_buyers"), view(spark, sf, "energy_hosts")))


_HIGH_SUN = "CASE WHEN zenith_angle < 60 THEN ghi END"


@query("weather_enrich", f"""
    SELECT reading_id, {r('w.irradiance', 'irradiance')}, {r('w.zenith', 'zenith')} FROM readings r
    LEFT JOIN (SELECT date_trunc('hour', event_ts) AS hour_ts, device_id,
               avg(CASE WHEN zenith_angle < 60 THEN ghi END) AS irradiance, avg(zenith_angle) AS zenith
               FROM irradiance GROUP BY 1, 2) w
      ON w.hour_ts = date_trunc('hour', r.event_ts) AND w.device_id = r.device_id""", "readings irradiance")
def _weather_enrich(spark, sf):
    """Reports without a high sun have no irradiance."""
    reports = view(spark, sf, "irradiance").groupBy(
        F.date_trunc("hour", "event_ts").alias("hour_ts"), "device_id").agg(
        F.avg(F.expr(_HIGH_SUN)).alias("irradiance"), F.avg("zenith_angle").alias("zenith"))
    df = view(spark, sf, "readings").select("reading_id", "device_id", "event_ts")
    return enrich.weather_enrich(df, reports, ["device_id"], "event_ts", "hour_ts", ["irradiance", "zenith"]).select(
        "reading_id", "irradiance", "zenith")


@query("weather_as_of", f"""
    SELECT r.reading_id, {r('w.ghi', 'ghi')} FROM readings r ASOF LEFT JOIN (
        SELECT device_id, event_ts, ghi FROM irradiance WHERE zenith_angle < 60) w
      ON w.device_id = r.device_id AND r.event_ts >= w.event_ts""", "readings irradiance")
def _weather_as_of(spark, sf):
    """Reports without a high sun have blank cells; the latest known value counts."""
    reports = view(spark, sf, "irradiance").select(
        "device_id", F.col("event_ts").alias("hour_ts"), F.expr(_HIGH_SUN).alias("ghi"))
    df = view(spark, sf, "readings").select("reading_id", "device_id", "event_ts")
    return enrich.weather_as_of(df, reports, BY_DEVICE, "hour_ts", ["ghi"]).select("reading_id", "ghi")
