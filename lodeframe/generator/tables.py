"""The star schema's tables as DataFrames, over all days to the horizon; columns that begin with _ date each row's arrival.

Everything about a vehicle follows from its key by hashed draws, so a table is one pass of column expressions with
joins to small tables, and is the same however it is partitioned. Ids come from the vehicle's key, not from a counter.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import calendar
from lodeframe.generator.random import Draws, looked_up, pick
from lodeframe.generator.world import SLOTS, WHEELS, World

MONTH = 30.44  # days


def money(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(12,2)")


def later(d: Column, days: Column | int) -> Column:
    return F.date_add(d, days if isinstance(days, Column) else F.lit(days))


class Tables:
    """staging: a folder in which what several tables need (vehicles, sales, failures) is written once and reread."""

    def __init__(self, spark: SparkSession, world: World, staging: str | None = None):
        self.spark, self.w, self.s, self.staging = spark, world, world.s, staging

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        if self.staging is None:
            return df
        path = f"{self.staging}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def day(self, d: date) -> Column:
        return F.lit(d)

    # -- dimensions ------------------------------------------------------------------------------------------------

    @cached_property
    def dim_date(self) -> DataFrame:
        return calendar.date_dimension(self.spark, self.w.start - timedelta(days=self.s["supply"]["lead_days"]), self.w.horizon)

    @cached_property
    def dim_vehicle_model(self) -> DataFrame:
        rows = [(t.model_id, t.brand, t.model, t.trim, t.body, t.segment, t.powertrain, t.litres, t.kwh, t.range_km, t.fuel, t.first, t.last, float(t.price)) for t in self.w.trims]
        return self._frame(rows, "model_id int, brand string, model_name string, trim string, body_type string, segment string, powertrain string, engine_displacement_l double, battery_kwh double, range_km int, fuel_consumption_l_per_100km double, first_model_year int, last_model_year int, base_msrp double")

    @cached_property
    def dim_plant(self) -> DataFrame:
        return self._frame([(k, *p[:6]) for k, p in enumerate(self.s["plants"], 1)], "plant_id int, plant_name string, country string, city string, region string, daily_capacity int, opened_year int")

    @cached_property
    def dim_supplier(self) -> DataFrame:
        return self._frame([(k, *p) for k, p in enumerate(self.s["suppliers"], 1)], "supplier_id int, supplier_name string, country string, supplier_tier string, quality_rating double")

    @cached_property
    def dim_part(self) -> DataFrame:
        return self._frame([(k, p[0], p[1], float(p[2]), self.w.suppliers[p[3]]) for k, p in enumerate(self.s["parts"], 1)], "part_id int, part_name string, component_category string, unit_cost double, primary_supplier_id int")

    @cached_property
    def dim_recall_campaign(self) -> DataFrame:
        rows = [(c["recall_id"], c["name"], self.w.part(c["part"])[1], c["part"], c["announced"], c["remedy"], c["announced"]) for c in self.w.campaigns]
        return self._frame(rows, "recall_id int, campaign_name string, component_category string, part_id int, announced_date date, remedy_description string, _available date")

    @cached_property
    def _dealers(self) -> DataFrame:
        rows = [(d["dealer_id"], d["dealer_name"], d["country"], d["city"], d["region"], d["dealer_tier"], d["opened"], d["closed"], d["slow"]) for d in self.w.dealers]
        return self._frame(rows, "dealer_id int, dealer_name string, country string, city string, region string, dealer_tier string, opened_date date, closed_date date, slow boolean")

    @cached_property
    def dim_dealer(self) -> DataFrame:
        return self._dealers.drop("slow").withColumn("is_active", F.col("closed_date").isNull()).withColumn("_available", F.col("opened_date"))

    # -- supply ----------------------------------------------------------------------------------------------------

    @cached_property
    def fact_part_supply(self) -> DataFrame:
        """Weekly deliveries of each part to each plant; in the window of bad batches one supplier delivers them all."""
        s, p1, (bad, good) = self.s["supply"], self.s["patterns"]["p1"], self.w.defect_window
        rows = [(part, plant, self.w.suppliers[about[3]], self.w.suppliers[about[4]], about[5], float(about[2]), about[0] == p1["part"] and plant == self.w.plants[p1["plant"]]) for part, plant in self.w.supplied for about in [self.w.part(part)]]
        pairs = self._frame(rows, "part_id int, plant_id int, first_supplier int, second_supplier int, share double, cost double, planted boolean")
        d = Draws(self.w.seed, "part_id", "plant_id", "week")
        begin = self.w.start - timedelta(days=s["lead_days"])
        weeks = (self.w.horizon - begin).days // 7
        b = pairs.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks)))).withColumn("delivery_date", later(self.day(begin), (F.col("week") * 7).cast("int")))
        # the bad batches are those that are the latest ones on days of the window
        b = b.withColumn("defective", F.col("planted") & (later(F.col("delivery_date"), 7) > self.day(bad)) & (F.col("delivery_date") < self.day(good)))
        defects = F.when(F.col("defective"), F.lit(p1["defect_rate"]) * d.between("bad", 0.8, 1.2)).otherwise(F.least(d.erlang("defects", 4, s["defect_mean"]), F.lit(0.02)))
        return b.select(
            (F.col("part_id").cast("long") * 1_000_000 + F.col("plant_id") * 10_000 + F.col("week")).alias("supply_batch_id"), "part_id", F.when(F.col("defective") | (d.uniform("second") >= F.col("share")), F.col("first_supplier")).otherwise(F.col("second_supplier")).alias("supplier_id"),
            "plant_id", "delivery_date", d.whole("quantity", 80, 400).alias("quantity"), money(F.col("cost") * d.between("cost", 0.95, 1.08)).alias("unit_cost"), F.when(d.uniform("null") < s["defect_null"], None).otherwise(F.round(defects, 4)).alias("inspected_defect_rate"),
            "defective", F.col("delivery_date").alias("_arrival"),
        )

    # -- vehicles --------------------------------------------------------------------------------------------------

    @cached_property
    def _vehicles(self) -> DataFrame:
        """Every vehicle built to the horizon, with all that later tables need."""
        w, s = self.w, self.s
        p = s["production"]
        span = (w.horizon - w.start).days + 1
        days = self.spark.range(span).select(F.col("id").cast("int").alias("day_no")).withColumn("build_date", later(self.day(w.start), F.col("day_no"))).filter(F.weekday("build_date") < 5)
        weight = F.element_at(F.array(*[F.lit(float(x)) for x in p["monthly"]]), F.month("build_date"))
        weights = [p["monthly"][d.month - 1] for k in range(w.days) if (d := w.start + timedelta(days=k)).weekday() < 5]
        mean = weight * (w.size["vehicles"] / sum(weights))
        a_day = Draws(w.seed, "day_no")
        count = F.greatest(F.lit(0), F.least(F.lit(WHEELS - 1), F.round(mean + F.sqrt(mean) * a_day.normal("count")).cast("int")))
        days = days.withColumn("n", count).filter("n > 0")
        v = days.select("day_no", "build_date", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select((F.col("day_no") * WHEELS + F.col("k")).cast("long").alias("vid"), "day_no", "build_date")
        d = Draws(w.seed, "vid")
        v = v.withColumn("region", d.choice("region", {r: a["weight"] for r, a in s["regions"].items()}))
        # electric share by region along a logistic curve, from its start to its end value
        t = F.least(F.lit(1.0), F.col("day_no") / F.lit(float(w.days)))
        low, high = (looked_up({r: float(a["bev"][k]) for r, a in s["regions"].items()}, F.col("region")) for k in (0, 1))
        curve = 1 / (1 + F.exp(-8 * (t - 0.5)))
        share = low + (high - low) * curve
        v = v.withColumn("powertrain", F.when(d.uniform("bev") < share, "BEV").otherwise(d.choice("mix", p["mix"]))).withColumn("model_year", calendar.model_year(F.col("build_date")))
        options = []
        for year in range(w.start.year, w.horizon.year + 2):
            for kind in ("ICE", "Hybrid", "PHEV", "BEV"):
                fit = [x for x in w.trims if x.powertrain == kind and x.first <= year and (x.last is None or year <= x.last)]
                total, reached = sum(x.weight for x in fit), 0.0
                cumulative = []
                for x in fit:
                    reached += x.weight / total
                    cumulative.append(reached)
                options.append((kind, year, [x.model_id for x in fit], cumulative))
        options = self._frame(options, "powertrain string, model_year int, ids array<int>, cumulative array<double>")
        trims = self._frame([(x.model_id, x.model, x.maker, float(x.price), [k for k, q in enumerate(s["plants"], 1) if x.model in q[6]], w.parts_of(x)) for x in w.trims], "model_id int, model_name string, maker string, price double, plants array<int>, parts array<int>")
        v = v.join(F.broadcast(options), ["powertrain", "model_year"]).withColumn("model_id", pick(F.col("ids"), F.col("cumulative"), d.uniform("trim"))).drop("ids", "cumulative")
        v = v.join(F.broadcast(trims), "model_id")
        v = v.withColumn("plant_id", F.element_at("plants", (F.floor(d.uniform("plant") * F.size("plants")) + 1).cast("int")))
        letters = F.lit("ABCDEFGHJKLMNPRSTUVWXYZ")
        vin = F.concat("maker", F.lpad(F.col("model_id").cast("string"), 3, "0"), F.substr(letters, F.col("plant_id"), F.lit(1)), F.lpad((F.col("model_year") % 100).cast("string"), 2, "0"), F.lpad(F.col("vid").cast("string"), 8, "0"))
        p5 = s["patterns"]["p5"]
        changed = (F.col("plant_id") == w.plants[p5["plant"]]) & (F.col("model_name") == p5["model"]) & (F.col("build_date") >= self.day(w.at(p5["change"])))
        passed = d.uniform("pass") < F.when(changed, p5["pass_rate"]).otherwise(p["pass_rate"])
        rework = F.greatest(F.lit(0.1), F.round(d.erlang("rework", 2, 1.0) * F.when(changed, p5["rework_mean"]).otherwise(p["rework_mean"]), 1))
        v = v.withColumn("vin", vin).withColumn("passed", passed).withColumn("rework", F.when(F.col("passed"), 0.0).otherwise(rework))
        v = v.withColumn("colour", F.when(d.uniform("colour_null") < p["colour_null"], None).otherwise(d.choice("colour", s["colours"]))).withColumn("cost", money(F.col("price") * d.between("cost", *p["cost_share"])))
        return self._staged(self._sold(v, d), "vehicles")

    def _dealer_at(self, stream: str, d: Draws, region: Column, when: str, until: str, *more: Column) -> Column:
        """A dealer of the region that is open from `when` to `until`: the first open one of twelve draws, else the region's oldest."""
        slots = looked_up_array({r: self.w.dealer_slots(r) for r in self.s["regions"]}, region)
        opened = {x["dealer_id"]: x["opened"] for x in self.w.dealers if x["opened"] >= self.w.start}
        closed = {x["dealer_id"]: x["closed"] for x in self.w.dealers if x["closed"]}
        tries = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.element_at(slots, (F.floor(d.uniform(stream, k, *more) * SLOTS) + 1).cast("int")))

        def is_open(x: Column) -> Column:
            fine = F.lit(True)
            if opened:
                fine = fine & F.coalesce(looked_up(opened, x) <= F.col(when), F.lit(True))
            if closed:
                fine = fine & F.coalesce(looked_up(closed, x) > F.col(until), F.lit(True))
            return fine

        return F.coalesce(F.get(F.filter(tries, is_open), 0), looked_up({r: self.w.anchor(r) for r in self.s["regions"]}, region))

    def _sold(self, v: DataFrame, d: Draws) -> DataFrame:
        """Adds the sale, its cancellation and the resale."""
        w, s, p3 = self.w, self.s["sales"], self.s["patterns"]["p3"]
        low, high = self.s["production"]["transit"]
        v = v.withColumn("arrival", later(F.col("build_date"), d.whole("transit", low, high))).withColumn("until", later(F.col("arrival"), 150))
        v = v.withColumn("dealer_id", self._dealer_at("dealer", d, F.col("region"), "arrival", "until"))
        v = v.join(F.broadcast(self._dealers.select("dealer_id", "closed_date", "slow", F.col("region").alias("dealer_region"))), "dealer_id")
        mean = F.when(F.col("slow"), float(self.s["patterns"]["p4"]["days"])).otherwise(float(s["days_to_sell"]))
        first = later(F.col("arrival"), F.round(d.erlang("wait", 2, mean)).cast("int"))
        demand = F.array(*[F.lit(float(x) / max(p3["monthly"])) for x in p3["monthly"]])
        # a customer of a weak month waits some days and thinks again, up to six times
        wait = F.aggregate(F.sequence(F.lit(1), F.lit(6)), first, lambda at, k: F.when(d.uniform("thin", k) > F.element_at(demand, F.month(at)), later(at, F.round(d.erlang("again", 1, 8.0, k)).cast("int"))).otherwise(at))
        v = v.withColumn("sale", wait).withColumn("q_end", calendar.quarter_end(F.col("sale")))
        pulled = (F.datediff("q_end", "sale") <= p3["lookahead"]) & (d.uniform("pull") < p3["pull"])
        v = v.withColumn("sale", F.when(pulled, F.greatest(F.col("sale"), F.date_sub("q_end", d.whole("into", 0, p3["window"] - 1)))).otherwise(F.col("sale")))
        v = v.withColumn("sale", F.greatest(F.col("arrival"), F.coalesce(F.least("sale", F.date_sub("closed_date", 1)), "sale")))
        v = v.withColumn("sale_type", d.choice("type", s["types"])).withColumn("cancelled", d.uniform("cancel") < s["cancelled"])
        again = later(F.col("sale"), d.whole("again_days", *s["resale_days"]))
        v = v.withColumn("resale", F.when(F.col("cancelled") & (d.uniform("resold") < s["resold"]) & (again < F.coalesce("closed_date", self.day(w.horizon + timedelta(days=999)))), again))
        # what the vehicle's life with its owner is counted from: the sale that stands
        v = v.withColumn("owned_from", F.when(F.col("cancelled"), F.col("resale")).otherwise(F.col("sale"))).withColumn("use", F.when(F.col("cancelled"), "Retail").otherwise(F.col("sale_type")))
        sigma = self.s["service"]["sigma"]
        yearly = looked_up({k: float(x) for k, x in self.s["service"]["annual_km"].items()}, F.col("use"))
        return v.withColumn("km_per_day", yearly * F.exp(sigma * d.normal("km") - sigma * sigma / 2) / 365).drop("q_end", "until", "slow")

    @cached_property
    def fact_production(self) -> DataFrame:
        return self._vehicles.select("vin", "model_id", "plant_id", "build_date", "model_year", F.col("colour").alias("exterior_colour"), F.col("cost").alias("production_cost"), F.col("passed").alias("passed_first_inspection"), F.col("rework").alias("rework_hours"), F.col("build_date").alias("_arrival"))

    @cached_property
    def _fitted(self) -> DataFrame:
        """vid, slot, part_id and the batch that was the latest one at the plant on the day of building."""
        begin = self.w.start - timedelta(days=self.s["supply"]["lead_days"])
        v = self._vehicles.select("vid", "vin", "plant_id", "build_date", "region", "dealer_id", "model_name", "owned_from", "km_per_day", F.posexplode("parts").alias("slot", "part_id"))
        week = F.floor(F.datediff("build_date", self.day(begin)) / 7)
        return v.withColumn("supply_batch_id", F.col("part_id").cast("long") * 1_000_000 + F.col("plant_id") * 10_000 + week)

    @cached_property
    def fact_vehicle_component(self) -> DataFrame:
        return self._fitted.select("vin", "part_id", "supply_batch_id", F.col("build_date").alias("_arrival"))

    # -- sales and customers ---------------------------------------------------------------------------------------

    @cached_property
    def _sales(self) -> DataFrame:
        """Both sales of a vehicle as rows, with their customers."""
        w, s, p3 = self.w, self.s["sales"], self.s["patterns"]["p3"]
        keep = ["vid", "vin", "dealer_id", "dealer_region", "arrival", "price", "build_date"]
        one = self._vehicles.select(*keep, F.col("sale").alias("sale_date"), "sale_type", F.col("cancelled").alias("is_cancelled"), F.lit(0).alias("nth"))
        two = self._vehicles.filter("resale is not null").select(*keep, F.col("resale").alias("sale_date"), F.lit("Retail").alias("sale_type"), F.lit(False).alias("is_cancelled"), F.lit(1).alias("nth"))
        x, d = one.unionByName(two), Draws(w.seed, "vid", "nth")
        years = F.datediff("sale_date", self.day(w.start)) / 365.0
        x = x.withColumn("list_price", money(F.col("price") * (1 + d.uniform("options") * s["options"]) * F.pow(F.lit(1 + s["price_rise"]), years)))
        in_window = F.datediff(calendar.quarter_end(F.col("sale_date")), "sale_date") < p3["window"]
        low, high = (looked_up({k: float(r[i]) for k, r in s["discounts"].items()}, F.col("sale_type")) for i in (0, 1))
        rate = low + (high - low) * d.uniform("discount") + F.when(in_window, p3["discount"]).otherwise(0.0)
        x = x.withColumn("discount_amount", money(F.col("list_price").cast("double") * rate)).withColumn("net_price", F.col("list_price") - F.col("discount_amount"))
        fleet = F.col("sale_type") == "Fleet"
        pool = w.size["fleet_customers"]
        # a fleet buys in its own region: customers are dealt to regions in turn
        regions = list(self.s["regions"])
        mine = F.array_position(F.array(*[F.lit(r) for r in regions]), F.col("dealer_region")).cast("int") - 1
        fleet_id = F.floor(F.pow(d.uniform("fleet"), F.lit(1.5)) * (pool // len(regions))).cast("int") * len(regions) + mine + 1
        return self._staged(x.withColumn("customer_id", F.when(fleet, fleet_id).otherwise((F.lit(10_000_000) + F.col("vid") * 2 + F.col("nth")).cast("int"))), "sales")

    @cached_property
    def fact_sales(self) -> DataFrame:
        return self._sales.select((F.col("vid") * 2 + F.col("nth")).alias("sale_id"), "vin", "dealer_id", "customer_id", "sale_date", F.col("arrival").alias("dealer_arrival_date"), "sale_type", "list_price", "discount_amount", "net_price", "is_cancelled", F.col("sale_date").alias("_arrival"))

    @cached_property
    def dim_customer(self) -> DataFrame:
        c = self.s["customers"]
        x = self._sales.withColumn("fleet", F.col("sale_type") == "Fleet").groupBy("customer_id", "fleet", "dealer_region").agg(F.min("sale_date").alias("first_purchase_date"))
        d = Draws(self.w.seed, "customer_id")
        about = [(r, list(a["countries"]), _cumulative([v[0] for v in a["countries"].values()])) for r, a in self.s["regions"].items()]
        cities = {k: v[1:] for a in self.s["regions"].values() for k, v in a["countries"].items()}
        x = x.join(F.broadcast(self._frame(about, "dealer_region string, names array<string>, cumulative array<double>")), "dealer_region")
        x = x.withColumn("country", pick(F.col("names"), F.col("cumulative"), d.uniform("country")))
        town = looked_up_array(cities, F.col("country"))
        age = F.when(F.col("fleet") | (d.uniform("age_null") < c["age_null"]), None).otherwise(d.choice("age", c["ages"]))
        return x.select("customer_id", F.when(F.col("fleet"), "Fleet").otherwise("Individual").alias("customer_type"), age.alias("age_band"), "country", F.element_at(town, (F.floor(d.uniform("city") * F.size(town)) + 1).cast("int")).alias("city"), F.col("dealer_region").alias("region"), "first_purchase_date", F.col("first_purchase_date").alias("_available"))

    # -- after the sale --------------------------------------------------------------------------------------------

    @cached_property
    def fact_recall_vehicle(self) -> DataFrame:
        s, (brakes, other) = self.s["recalls"], self.w.campaigns
        horizon = self.day(self.w.horizon)
        bad = self.fact_part_supply.filter("defective").select("supply_batch_id")
        one = self._fitted.join(F.broadcast(bad), "supply_batch_id", "left_semi").select("vid", "vin", "owned_from", "build_date", F.lit(1).alias("recall_id"), self.day(brakes["announced"]).alias("announced"))
        low, high = other["window"]
        two = self._fitted.filter((F.col("model_name") == other["model"]) & (F.col("part_id") == other["part"]) & (F.col("build_date") >= self.day(low)) & (F.col("build_date") < self.day(high)))
        two = two.select("vid", "vin", "owned_from", "build_date", F.lit(2).alias("recall_id"), self.day(other["announced"]).alias("announced"))
        x, d = one.unionByName(two), Draws(self.w.seed, "vid", "recall_id")
        start = F.greatest("announced", "owned_from")
        remedy = later(start, (F.round(d.erlang("remedy", 2, float(s["remedy_days"]))) + 1).cast("int"))
        done = F.when((F.col("owned_from") <= horizon) & (d.uniform("respond") >= s["no_response"]), remedy)
        return x.select("recall_id", "vin", "vid", done.alias("remedy_completed_date"), F.greatest("announced", "build_date").alias("_arrival"))

    @cached_property
    def _failures(self) -> DataFrame:
        """vid, slot, part, day and failure mode of every warranty failure: the usual ones and the planted ones."""
        war, p1, p7, w = self.s["warranty"], self.s["patterns"]["p1"], self.s["patterns"]["p7"], self.w
        parts = self._frame([(k, p[1], float(p[2]), float(war["rates"][p[1]]), float(war["battery_years"] if p[1] == "Battery" else war["years"]), float(war["hours"][p[1]])) for k, p in enumerate(self.s["parts"], 1)], "part_id int, category string, unit_cost double, rate double, cover double, hours double")
        horizon = self.day(w.horizon)
        x = self._fitted.filter((F.col("owned_from") <= horizon)).join(F.broadcast(parts), "part_id")
        d = Draws(w.seed, "vid", "slot")
        days = F.least(F.col("cover") * 365, F.lit(float(war["km"])) / F.col("km_per_day"), F.datediff(horizon, "owned_from").cast("double"))
        x = x.withColumn("exposed", F.greatest(F.lit(0.0), days / 365))
        usual = x.withColumn("n", F.least(F.lit(2), d.poisson("failures", F.col("rate") * F.pow("exposed", F.lit(war["shape"])), 3))).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
        e = Draws(w.seed, "vid", "slot", "k")
        modes = looked_up_array(self.s["failure_modes"], F.col("category"))
        usual = usual.withColumn("claim_date", later(F.col("owned_from"), F.floor(F.pow(e.uniform("when"), F.lit(1 / war["shape"])) * F.col("exposed") * 365).cast("int"))).withColumn("mode", F.element_at(modes, (F.floor(e.uniform("mode") * F.size(modes)) + 1).cast("int")))
        keep = ["vid", "slot", "k", "vin", "part_id", "category", "unit_cost", "hours", "dealer_id", "region", "owned_from", "km_per_day", "claim_date", "mode"]
        # P1: bad brake batches fail more often, until the months are over or the vehicle is remedied
        remedy = self.fact_recall_vehicle.filter("recall_id = 1").select("vid", "remedy_completed_date")
        bad = self.fact_part_supply.filter("defective").select("supply_batch_id")
        p1_end = F.least(later(F.col("owned_from"), round(p1["months"] * MONTH)), horizon)
        brakes = x.join(F.broadcast(bad), "supply_batch_id", "left_semi").join(remedy, "vid", "left").withColumn("span", F.greatest(F.lit(0), F.datediff(F.least(p1_end, F.coalesce("remedy_completed_date", horizon)), "owned_from")))
        brakes = brakes.withColumn("n", d.poisson("p1", F.col("span") * (p1["extra_per_year"] / 365.0), 4)).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(11), F.col("n") + 10)))
        brakes = brakes.withColumn("claim_date", later(F.col("owned_from"), F.floor(e.uniform("when") * F.col("span")).cast("int"))).withColumn("mode", F.lit(p1["mode"]))
        # P7: one supplier's packs in electric vehicles wear out once the mileage or the age is reached
        worn = self.fact_part_supply.filter(F.col("supplier_id") == w.suppliers[p7["supplier"]]).select("supply_batch_id")
        electric = self._vehicles.filter("powertrain = 'BEV'").select("vid")
        starts = F.least(F.lit(float(p7["km"])) / F.col("km_per_day"), F.lit(p7["months"] * MONTH))
        packs = x.filter("category = 'Battery'").join(worn, "supply_batch_id", "left_semi").join(electric, "vid", "left_semi").withColumn("after", F.ceil(starts)).withColumn("span", F.greatest(F.lit(0), F.datediff(horizon, "owned_from") - F.col("after")))
        packs = packs.withColumn("n", d.poisson("p7", F.col("span") * (p7["extra_per_year"] / 365.0), 5)).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(21), F.col("n") + 20)))
        packs = packs.withColumn("claim_date", later(F.col("owned_from"), (F.col("after") + F.floor(e.uniform("when") * F.col("span"))).cast("int"))).withColumn("mode", F.lit(p7["mode"]))
        found = usual.select(*keep).unionByName(brakes.select(*keep)).unionByName(packs.select(*keep))
        return self._staged(self._with_service_dealer(found, e, "claim_date"), "failures")

    def _with_service_dealer(self, x: DataFrame, d: Draws, when: str) -> DataFrame:
        """The selling dealer where it is open and its customer is loyal, else another one of the region."""
        x = x.withColumn("other", self._dealer_at("service", d, F.col("region"), when, when))
        closed = {y["dealer_id"]: y["closed"] for y in self.w.dealers if y["closed"]}
        still = F.coalesce(looked_up(closed, F.col("dealer_id")) > F.col(when), F.lit(True)) if closed else F.lit(True)
        stays = (d.uniform("loyal") < self.s["service"]["loyal"]) & still
        return x.withColumn("dealer_id", F.when(stays, F.col("dealer_id")).otherwise(F.col("other"))).drop("other")

    def _claim_costs(self, d: Draws) -> tuple[Column, Column, Column]:
        hours = F.greatest(F.lit(0.3), F.round(F.col("hours") * d.erlang("hours", 4, 1.0), 1))
        return hours, money(hours * float(self.s["service"]["labour_rate"])), money(F.col("unit_cost") * d.between("parts", 0.9, 1.15))

    @cached_property
    def fact_warranty_claim(self) -> DataFrame:
        war, d = self.s["warranty"], Draws(self.w.seed, "vid", "slot", "k")
        _, labour, parts = self._claim_costs(d)
        u, total, lag = d.uniform("lag"), 0.0, None
        for share, low, high in war["lags"][:-1]:
            total += share
            lag = F.when(u < total, d.whole("lag_days", low, high)) if lag is None else lag.when(u < total, d.whole("lag_days", low, high))
        lag = lag.otherwise(d.whole("lag_days", *war["lags"][-1][1:]))
        x = self._failures.withColumn("received_date", later(F.col("claim_date"), lag)).withColumn("labour_cost", labour).withColumn("parts_cost", parts)
        return x.select(
            ((F.col("vid") * 8 + F.col("slot")) * 32 + F.col("k")).cast("long").alias("claim_id"), "vin", "dealer_id", "part_id", "claim_date", "received_date", F.when(d.uniform("mode_null") < war["mode_null"], None).otherwise(F.col("mode")).alias("failure_mode"),
            F.round(F.col("km_per_day") * F.datediff("claim_date", "owned_from")).cast("int").alias("odometer_km"), "labour_cost", "parts_cost", (F.col("labour_cost") + F.col("parts_cost")).alias("total_cost"), F.when(d.uniform("reject") < war["rejected"], "Rejected").otherwise("Approved").alias("claim_status"),
            F.col("received_date").alias("_arrival"), later(F.col("received_date"), (F.round(d.erlang("decide", 2, float(war["decision_days"]))) + 1).cast("int")).alias("_decided"),
        )

    @cached_property
    def fact_service_visit(self) -> DataFrame:
        s, w, horizon = self.s["service"], self.w, self.day(self.w.horizon)
        rate, p8 = float(s["labour_rate"]), self.s["patterns"]["p8"]
        owned = self._vehicles.filter(F.col("owned_from") <= horizon).select("vid", "vin", "region", "dealer_region", "dealer_id", "model_name", "owned_from", "km_per_day")
        none, cat = F.lit(None).cast("string"), Draws(w.seed, "vid", "category")
        keep = ["vid", "kind", "k", "vin", "dealer_id", "region", "owned_from", "km_per_day", "visit_date", "visit_type", "category", "hours", "cost", "is_warranty"]
        # scheduled: whichever of time and distance comes first, with some days' scatter
        interval = 365 * F.least(F.lit(s["interval_months"] / 12), F.lit(float(s["interval_km"])) / (F.col("km_per_day") * 365))
        due = owned.withColumn("interval", interval).withColumn("n", F.floor(F.datediff(horizon, "owned_from") / F.col("interval")).cast("int")).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("kind", F.lit(0))
        d = Draws(w.seed, "vid", "kind", "k")
        day = F.least(horizon, F.greatest(later(F.col("owned_from"), 1), later(F.col("owned_from"), F.round(F.col("k") * F.col("interval") + 7 * d.normal("scatter")).cast("int"))))
        due = due.withColumn("visit_date", day).withColumn("hours", F.round(1 + d.erlang("labour", 2, 0.8), 1))
        due = self._with_service_dealer(due, d, "visit_date").select("*", F.lit("Scheduled").alias("visit_type"), none.alias("category"), money(F.col("hours") * rate + d.between("extra", 60, 260)).alias("cost"), F.lit(False).alias("is_warranty")).select(*keep)
        # repairs that the owner pays: P8 is one model in one region
        kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("category"), F.lit(float(r)).alias("rate")) for k, (c, r) in enumerate(s["repairs"].items(), 1)]))
        repairs = owned.select("*", kinds.alias("r")).select("*", "r.*").drop("r")
        factor = F.when((F.col("model_name") == p8["model"]) & (F.col("dealer_region") == p8["region"]) & (F.col("category") == p8["category"]), p8["factor"]).otherwise(1.0)
        repairs = repairs.withColumn("n", cat.poisson("repairs", F.col("rate") * factor * F.datediff(horizon, "owned_from") / 365, 5)).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
        repairs = repairs.withColumn("visit_date", later(F.col("owned_from"), F.floor(d.uniform("when") * (F.datediff(horizon, "owned_from") + 1)).cast("int"))).withColumn("hours", F.round(0.8 + d.erlang("labour", 2, 1.2), 1))
        repairs = self._with_service_dealer(repairs, d, "visit_date").select("*", F.lit("Repair").alias("visit_type"), money(F.col("hours") * rate + d.between("extra", 80, 600)).alias("cost"), F.lit(False).alias("is_warranty")).select(*keep)
        # warranty repairs are the claims' visits
        claim = Draws(w.seed, "vid", "slot", "k")
        hours, labour, parts = self._claim_costs(claim)
        claims = self._failures.withColumn("h", hours).withColumn("cost", labour + parts).select("vid", (F.lit(10) + F.col("slot")).alias("kind"), "k", "vin", "dealer_id", "region", "owned_from", "km_per_day", F.col("claim_date").alias("visit_date"), F.lit("Repair").alias("visit_type"), "category", F.col("h").alias("hours"), "cost", F.lit(True).alias("is_warranty"))
        # recall visits are the remedies
        parts_of = {c["recall_id"]: w.part(c["part"])[1] for c in w.campaigns}
        done = self.fact_recall_vehicle.filter("remedy_completed_date is not null").select("vid", "recall_id", "remedy_completed_date").join(owned, "vid").withColumn("kind", F.lit(20) + F.col("recall_id")).withColumn("k", F.lit(1)).withColumn("visit_date", F.col("remedy_completed_date"))
        done = done.withColumn("hours", F.round(0.5 + d.erlang("labour", 2, 1.0), 1))
        done = self._with_service_dealer(done, d, "visit_date").select("*", F.lit("Recall").alias("visit_type"), looked_up(parts_of, F.col("recall_id")).alias("category"), money(F.col("hours") * rate).alias("cost"), F.lit(True).alias("is_warranty")).select(*keep)
        x = due.unionByName(repairs).unionByName(claims).unionByName(done)
        odometer = F.when(d.uniform("odometer") < s["odometer_null"], None).otherwise(F.round(F.col("km_per_day") * F.datediff("visit_date", "owned_from")).cast("int"))
        return x.select(((F.col("vid") * 32 + F.col("kind")) * 4096 + F.col("k")).cast("long").alias("visit_id"), "vin", "dealer_id", "visit_date", "visit_type", F.col("category").alias("component_category"), odometer.alias("odometer_km"), F.col("hours").alias("labour_hours"), F.col("cost").alias("total_cost"), "is_warranty", F.col("visit_date").alias("_arrival"))

    # -- slices ----------------------------------------------------------------------------------------------------

    NAMES = ("dim_date", "dim_vehicle_model", "dim_plant", "dim_dealer", "dim_customer", "dim_supplier", "dim_part", "dim_recall_campaign", "fact_production", "fact_part_supply", "fact_vehicle_component", "fact_sales", "fact_service_visit", "fact_warranty_claim", "fact_recall_vehicle")

    def snapshot(self, name: str, on: date, only_day: bool = False) -> DataFrame:
        """The table as it was known on a day; of facts, with only_day, just the rows that arrived on it."""
        df, at = getattr(self, name), F.lit(on)
        if name == "dim_dealer":
            df = df.filter(F.col("_available") <= at).withColumn("closed_date", F.when(F.col("closed_date") <= at, F.col("closed_date"))).withColumn("is_active", F.col("closed_date").isNull())
        elif "_available" in df.columns:
            df = df.filter(F.col("_available") <= at)
        elif "_arrival" in df.columns:
            df = df.filter(F.col("_arrival") == at if only_day else F.col("_arrival") <= at)
        if name == "fact_warranty_claim":
            df = df.withColumn("claim_status", F.when(F.col("_decided") <= at, F.col("claim_status")).otherwise("Pending"))
        if name == "fact_recall_vehicle":
            df = df.withColumn("remedy_completed_date", F.when(F.col("remedy_completed_date") <= at, F.col("remedy_completed_date")))
        return df


def looked_up_array(table: dict[str, list], key: Column) -> Column:
    """table[key], an array, for a small dictionary of lists."""
    flat = []
    for k, values in table.items():
        flat += [F.lit(k), F.lit(list(values))]
    return F.element_at(F.create_map(*flat), key)


def _cumulative(weights: list[float]) -> list[float]:
    total, reached, out = sum(weights), 0.0, []
    for x in weights:
        reached += x / total
        out.append(reached)
    return out

