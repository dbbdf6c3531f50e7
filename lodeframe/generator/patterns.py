"""The eight planted patterns and the queries that show them: each returns one row of metrics and `detected`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.generator.tables import MONTH
from lodeframe.generator.world import World

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Pattern:
    key: str
    title: str
    expectation: str
    parameters: dict[str, Any]
    detect: Callable[[Frames], DataFrame]


def _ratio(part: Column, whole: Column, where: Column, scale: float = 1.0) -> Column:
    """scale * sum(part) / sum(whole) over the rows of `where`."""
    return F.sum(F.when(where, part)) * scale / F.nullif(F.sum(F.when(where, whole)).cast("double"), F.lit(0.0))


def _mean(value: Column, where: Column) -> Column:
    return F.avg(F.when(where, value))


def _judged(metrics: DataFrame, rule: str) -> DataFrame:
    return metrics.select("*", F.expr(rule).alias("detected"))


def patterns(w: World) -> list[Pattern]:
    p, end, start = w.s["patterns"], F.lit, w.start
    last = w.end
    one = F.lit(1)

    def p1(t: Frames) -> DataFrame:
        first, after = w.defect_window
        part, plant = w.parts[p["p1"]["part"]], w.plants[p["p1"]["plant"]]
        claims = t["fact_warranty_claim"].filter(F.col("part_id") == part).groupBy("vin").agg(F.count("*").alias("n"))
        fitted = t["fact_vehicle_component"].filter(F.col("part_id") == part).join(t["fact_production"], "vin").join(t["fact_part_supply"].select("supply_batch_id", "supplier_id"), "supply_batch_id").join(claims, "vin", "left")
        hit = (F.col("plant_id") == plant) & (F.col("supplier_id") == w.suppliers[w.part(part)[3]]) & (F.col("build_date") >= end(first)) & (F.col("build_date") < end(after))
        n = F.coalesce("n", F.lit(0))
        m = fitted.agg(_ratio(n, one, hit, 1000).alias("affected_claims_per_1000"), _ratio(n, one, ~hit, 1000).alias("other_claims_per_1000"))
        recalled = t["fact_recall_vehicle"].join(t["dim_recall_campaign"].filter(F.col("campaign_name") == p["p1"]["name"]), "recall_id").agg(F.count("*").alias("recalled_vehicles"))
        return _judged(m.crossJoin(F.broadcast(recalled)), "affected_claims_per_1000 >= 3 * other_claims_per_1000 and recalled_vehicles > 0")

    growth = {r: a["bev"][1] - a["bev"][0] for r, a in w.s["regions"].items()}
    fastest, slowest = max(growth, key=growth.get), min(growth, key=growth.get)

    def p2(t: Frames) -> DataFrame:
        sold = t["fact_sales"].filter(~F.col("is_cancelled") & (F.col("sale_date") <= end(last))).join(t["dim_dealer"].select("dealer_id", "region"), "dealer_id").join(t["fact_production"].select("vin", "model_id"), "vin").join(t["dim_vehicle_model"].select("model_id", "powertrain"), "model_id")
        bev = (F.col("powertrain") == "BEV").cast("int")
        r = sold.groupBy("region").agg(_mean(bev, F.col("sale_date") < end(start + timedelta(days=365))).alias("before"), _mean(bev, F.col("sale_date") > end(last - timedelta(days=365))).alias("after"))
        change = F.col("after") - F.col("before")
        m = r.agg(F.max(F.when(F.col("region") == fastest, change)).alias("fastest_region_growth"), F.max(F.when(F.col("region") == slowest, change)).alias("slowest_region_growth"), F.bool_and(change > 0).alias("all_regions_grow"))
        return _judged(m, "all_regions_grow and fastest_region_growth > 2 * slowest_region_growth")

    def p3(t: Frames) -> DataFrame:
        daily = t["fact_sales"].filter(~F.col("is_cancelled")).groupBy("sale_date").agg(F.count("*").alias("n"))
        days = t["dim_date"].filter(F.col("calendar_date").between(end(start + timedelta(days=180)), end(last))).select("calendar_date", "month").join(daily, F.col("sale_date") == F.col("calendar_date"), "left")
        n = F.coalesce("n", F.lit(0))
        window = F.datediff(F.last_day(F.add_months(F.trunc("calendar_date", "quarter"), 2)), "calendar_date") < p["p3"]["window"]
        m = days.agg((_mean(n, window) / _mean(n, ~window)).alias("quarter_end_uplift"), (_mean(n, F.col("month") == 3) / _mean(n, F.col("month") == 8)).alias("march_vs_august"))
        return _judged(m, "quarter_end_uplift >= 1.2 and march_vs_august >= 1.2")

    slow_ids = [d["dealer_id"] for d in w.dealers if d["slow"]]

    def p4(t: Frames) -> DataFrame:
        lag = t["fact_sales"].filter(~F.col("is_cancelled") & (F.col("sale_date") <= end(last))).groupBy("dealer_id").agg(F.avg(F.datediff("sale_date", "dealer_arrival_date")).alias("days"), F.count("*").alias("n")).filter("n >= 10")
        slow = F.col("dealer_id").isin(slow_ids)
        bar = lag.filter(~slow).agg(F.percentile("days", 0.95).alias("bar"))
        m = lag.crossJoin(F.broadcast(bar)).agg(_mean(F.col("days"), slow).alias("slow_dealers_avg_days"), F.median(F.when(~slow, F.col("days"))).alias("other_dealers_median_days"), F.count_if(slow & (F.col("days") > F.col("bar"))).alias("slow_dealers_above_p95"))
        return _judged(m, "slow_dealers_avg_days >= 1.8 * other_dealers_median_days")

    change = w.at(p["p5"]["change"])

    def p5(t: Frames) -> DataFrame:
        v = t["fact_production"].filter(F.col("build_date") <= end(last)).join(t["dim_vehicle_model"].filter(F.col("model_name") == p["p5"]["model"]).select("model_id"), "model_id")
        here, after, ok = F.col("plant_id") == w.plants[p["p5"]["plant"]], F.col("build_date") >= end(change), F.col("passed_first_inspection").cast("int")
        m = v.agg(_mean(ok, here & ~after).alias("pass_rate_before"), _mean(ok, here & after).alias("pass_rate_after"), _mean(ok, ~here & after).alias("other_plants_after"))
        return _judged(m, "pass_rate_after <= pass_rate_before - 0.08 and other_plants_after >= pass_rate_before - 0.03")

    def p6(t: Frames) -> DataFrame:
        sold = t["fact_sales"].filter(~F.col("is_cancelled") & (F.col("sale_date") < end(last - timedelta(days=90)))).join(t["dim_customer"].select("customer_id", "customer_type"), "customer_id")
        visits = t["fact_service_visit"].filter(F.col("visit_date") <= end(last)).groupBy("vin").agg(F.count("*").alias("n"))
        rate, years, n = F.col("discount_amount").cast("double") / F.col("list_price").cast("double"), F.datediff(end(last), "sale_date") / 365.0, F.coalesce("n", F.lit(0))
        kind = lambda k: F.col("customer_type") == k
        m = sold.join(visits, "vin", "left").agg(
            _mean(rate, F.col("sale_type") == "Fleet").alias("fleet_discount_rate"), _mean(rate, F.col("sale_type") == "Retail").alias("retail_discount_rate"),
            _ratio(n, years, kind("Fleet")).alias("fleet_visits_per_vehicle_year"), _ratio(n, years, kind("Individual")).alias("individual_visits_per_vehicle_year"),
        )
        return _judged(m, "fleet_discount_rate >= 2 * retail_discount_rate and fleet_visits_per_vehicle_year >= 1.3 * individual_visits_per_vehicle_year")

    def p7(t: Frames) -> DataFrame:
        parts = t["dim_part"].filter("component_category = 'Battery'").select("part_id")
        electric = t["fact_production"].join(t["dim_vehicle_model"].filter("powertrain = 'BEV'").select("model_id"), "model_id").select("vin")
        packs = t["fact_vehicle_component"].join(parts, "part_id").join(electric, "vin").join(t["fact_part_supply"].select("supply_batch_id", "supplier_id"), "supply_batch_id").join(t["fact_sales"].filter(~F.col("is_cancelled")).select("vin", "sale_date"), "vin")
        past = (F.col("odometer_km") >= p["p7"]["km"]) | (F.datediff("claim_date", "sale_date") >= round(p["p7"]["months"] * MONTH))
        worn = t["fact_warranty_claim"].filter(F.col("claim_date") <= end(last)).join(parts, "part_id").join(packs.select("vin", "sale_date"), "vin").groupBy("vin").agg(F.count_if(past).alias("worn"))
        theirs, n = F.col("supplier_id") == w.suppliers[p["p7"]["supplier"]], F.coalesce("worn", F.lit(0))
        m = packs.join(worn, "vin", "left").agg(_ratio(n, one, theirs, 1000).alias("supplier_worn_claims_per_1000"), _ratio(n, one, ~theirs, 1000).alias("other_worn_claims_per_1000"))
        return _judged(m, "supplier_worn_claims_per_1000 >= 3 * greatest(other_worn_claims_per_1000, 1)")

    def p8(t: Frames) -> DataFrame:
        sold = t["fact_sales"].filter(~F.col("is_cancelled") & (F.col("sale_date") < end(last))).join(t["dim_dealer"].select("dealer_id", "region"), "dealer_id").join(t["fact_production"].select("vin", "model_id"), "vin").join(t["dim_vehicle_model"].select("model_id", "model_name"), "model_id")
        repairs = t["fact_service_visit"].filter((F.col("visit_type") == "Repair") & ~F.col("is_warranty") & (F.col("component_category") == p["p8"]["category"]) & (F.col("visit_date") <= end(last))).groupBy("vin").agg(F.count("*").alias("n"))
        model, region = F.col("model_name") == p["p8"]["model"], F.col("region") == p["p8"]["region"]
        n, years = F.coalesce("n", F.lit(0)), F.datediff(end(last), "sale_date") / 365.0
        m = sold.join(repairs, "vin", "left").agg(_ratio(n, years, model & region).alias("target_rate_per_vehicle_year"), _ratio(n, years, model & ~region).alias("same_model_elsewhere_rate"), _ratio(n, years, region & ~model).alias("same_region_other_models_rate"))
        return _judged(m, "target_rate_per_vehicle_year >= 1.8 * same_model_elsewhere_rate and target_rate_per_vehicle_year >= 1.8 * same_region_other_models_rate")

    window = [str(w.defect_window[0]), str(w.defect_window[1] - timedelta(days=1))]
    return [
        Pattern("p1_brake_batch", "Bad brake batches at one plant, followed by a recall", "claims per 1,000 affected vehicles are 3 times the others' or more, and vehicles are recalled", p["p1"] | {"build_window": window}, p1),
        Pattern("p2_bev_share", "The electric share grows at different rates by region", "it grows everywhere, and in the fastest region more than twice as much as in the slowest", {r: a["bev"] for r, a in w.s["regions"].items()}, p2),
        Pattern("p3_seasonality", "Seasonal sales and a push at the quarters' ends", "quarter ends are 1.2 times other days or more, and March 1.2 times August", p["p3"], p3),
        Pattern("p4_slow_dealers", "A few dealers take much longer to sell", "their average is 1.8 times the others' median or more", p["p4"] | {"dealer_ids": slow_ids}, p4),
        Pattern("p5_line_change", "A line change lowers the pass rate of one model at one plant", "it falls by 8 points or more while other plants stay within 3", p["p5"] | {"change_date": str(change)}, p5),
        Pattern("p6_fleet", "Fleets get larger discounts and come to the workshop more often", "twice the discount rate and 1.3 times the visits or more", {"discounts": w.s["sales"]["discounts"], "annual_km": w.s["service"]["annual_km"]}, p6),
        Pattern("p7_battery_wear", "One supplier's packs wear out past a mileage or an age", "3 times the others' claims past it or more", p["p7"], p7),
        Pattern("p8_regional_repairs", "One model needs more repairs in one region", "1.8 times both controls or more", p["p8"], p8),
    ]


def measure(pattern: Pattern, frames: Frames) -> dict[str, Any]:
    """The pattern's metrics, numbers rounded to four digits."""
    row = pattern.detect(frames).first()
    return {k: round(float(v), 4) if isinstance(v, float | Decimal) else v for k, v in row.asDict().items()}
