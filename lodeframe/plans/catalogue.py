"""Queries over the driver's tables, one for each kind of operator, with their equivalents in standard SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.contract import from_dict
from lodeframe.functions import calendar
from lodeframe.generator.tables import Tables
from lodeframe.generator.world import World
from lodeframe.operators.asof import asof_join
from lodeframe.operators.profile import column_stats
from lodeframe.operators.validate import report_frame
from lodeframe.sources.files import pinned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (t), where t(name) reads a table, under its name, with its SQL."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(partial(table, spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return put


def rate(pred, value=1):
    return F.avg(F.when(pred, value))


day = lambda c: F.col(c).cast("date")
round4 = lambda c: F.round(c, 4)
REVENUE = "l_extendedprice * (1 - l_discount)"


# -- scans, projections, filters -------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, cast(l_quantity as integer) as qty, round(l_extendedprice * (1 - l_discount), 4) as net, cast(l_shipdate as date) as ship_date, l_returnflag = 'R' as returned from lineitem")
def scan_project_cast(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("qty"), round4(F.expr(REVENUE)).alias("net"), day("l_shipdate").alias("ship_date"), (F.col("l_returnflag") == "R").alias("returned"))


@query("""select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus in ('F', 'O') and o_orderpriority not in ('1-URGENT', '5-LOW')
and o_totalprice between 1000 and 200000 and o_orderdate is not null and not (o_custkey is null)""")
def filter_3vl(t):
    o = t("orders").filter(F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & F.col("o_totalprice").between(1000, 200000) & F.col("o_orderdate").isNotNull() & ~F.col("o_custkey").isNull())
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""select lag_bucket, count(*) as n from (select case when d <= 3 then '0-3 days' when d <= 30 then '4-30 days' else '31+ days' end as lag_bucket
from (select date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as d from lineitem join orders on l_orderkey = o_orderkey)) group by all""")
def case_buckets(t):
    lag = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.datediff(day("l_shipdate"), day("o_orderdate")).alias("d"))
    bucket = F.when(F.col("d") <= 3, "0-3 days").when(F.col("d") <= 30, "4-30 days").otherwise("31+ days")
    return lag.groupBy(bucket.alias("lag_bucket")).agg(F.count("*").alias("n"))


@query("""select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '?') as status, greatest(o_totalprice, 50000.0) as floor_price, lpad(cast(month(o_orderdate) as varchar), 2, '0') as month2,
cast(date_trunc('quarter', o_orderdate) as date) as quarter_start, cast(cast(o_orderdate as date) + interval 1 month as date) as next_month, cast(cast(o_orderdate as date) - interval 90 day as date) as before90 from orders""")
def scalar_functions(t):
    d = day("o_orderdate")
    return t("orders").select(
        "o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("?")).alias("status"), F.greatest("o_totalprice", F.lit(50000.0)).alias("floor_price"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0").alias("month2"),
        F.trunc(d, "quarter").alias("quarter_start"), F.add_months(d, 1).alias("next_month"), F.date_sub(d, 90).alias("before90"),
    )


# -- joins ---------------------------------------------------------------------------------------------------------------


@query("""select r_name as region, c_mktsegment as segment, cast(year(o_orderdate) + case when month(o_orderdate) >= 4 then 1 else 0 end as integer) as fiscal_year, count(*) as units, round(sum(o_totalprice), 2) as value
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""")
def star_join_units(t):
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    sold = t("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return sold.groupBy(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), calendar.fiscal_year(F.col("o_orderdate")).alias("fiscal_year")).agg(F.count("*").alias("units"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("""with days as (select unnest(generate_series((select min(cast(o_orderdate as date)) from orders), (select max(cast(o_orderdate as date)) from orders), interval 1 day)) as d),
daily as (select cast(o_orderdate as date) as d, count(*) as n from orders group by 1)
select cast(days.d as date) as day, coalesce(n, 0) as n from days left join daily on cast(days.d as date) = daily.d""")
def left_join_zero_fill(t):
    daily = t("orders").groupBy(day("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    ends = t("orders").agg(F.min(day("o_orderdate")).alias("a"), F.max(day("o_orderdate")).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("day")).join(daily, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("select o_orderkey, o_custkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)")
def anti_join_orphans(t):
    return t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def semi_join_members(t):
    urgent = t("orders").filter("o_orderpriority = '1-URGENT'")
    return t("customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("""select a.l_orderkey, a.l_linenumber, count(*) as matches from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber group by all""")
def composite_key_join(t):
    b = t("lineitem").select("l_orderkey", "l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber").join(b, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("matches"))


@query("""select o_orderkey, count(l_orderkey) as big_lines from orders left join lineitem on l_orderkey = o_orderkey and l_quantity >= 45 group by o_orderkey""")
def join_filter_in_condition(t):
    return t("orders").join(t("lineitem"), (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_quantity") >= 45), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("big_lines"))


@query("""with p as (select event_id, user_id, ts, value from events where event_type = 'purchase'),
v as (select user_id, ts, max(event_id) as view_id from events where event_type = 'view' group by user_id, ts)
select p.event_id, p.user_id, p.value, v.view_id from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""")
def asof_last_view_before_purchase(t):
    buys = t("events").filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    views = t("events").filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return asof_join(buys, views, ["user_id"], "ts", "ts", ["view_id"], tie="view_id", bucket=lambda ts: ts.cast("date")).select("event_id", "user_id", "value", "view_id")


# -- aggregates -----------------------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def group_all_having(t):
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("""select l_linestatus, sum(case when l_returnflag = 'R' then 1 else 0 end) * 1000.0 / count(*) as returned_per_1000, round(avg(l_discount) filter (where l_quantity > 25), 4) as big_discount,
count(*) filter (where l_returnflag = 'N') as kept, round(avg(cast(l_returnflag = 'A' as integer)), 6) as share_a, round(sum(l_quantity) filter (where l_returnflag = 'R') / sum(l_quantity) filter (where l_returnflag <> 'R'), 6) as ratio
from lineitem group by l_linestatus""")
def conditional_aggregates(t):
    flag = F.col("l_returnflag")
    q = lambda p: F.sum(F.when(p, F.col("l_quantity")))
    return t("lineitem").groupBy("l_linestatus").agg(
        (F.count_if(flag == "R") * 1000.0 / F.count("*")).alias("returned_per_1000"), round4(rate(F.col("l_quantity") > 25, F.col("l_discount"))).alias("big_discount"), F.count_if(flag == "N").alias("kept"),
        F.round(F.avg((flag == "A").cast("int")), 6).alias("share_a"), F.round(q(flag == "R") / q(flag != "R"), 6).alias("ratio"),
    )


@query("""select count(*) as n_rows, count(distinct o_custkey) as customers, count(distinct o_orderpriority) as priorities, count(distinct cast(o_orderdate as date)) as days, count(*) - count(o_orderstatus) as null_status, min(o_totalprice) as low, max(o_totalprice) as high,
bool_and(o_totalprice > 0) as all_positive from orders""")
def distinct_counts(t):
    return t("orders").agg(
        F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"), F.countDistinct(day("o_orderdate")).alias("days"), (F.count("*") - F.count("o_orderstatus")).alias("null_status"),
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.bool_and(F.col("o_totalprice") > 0).alias("all_positive"),
    )


@query("select c_mktsegment, round(median(c_acctbal), 4) as median_balance, round(quantile_cont(c_acctbal, 0.95), 4) as p95_balance from customer group by c_mktsegment")
def median_p95(t):
    return t("customer").groupBy("c_mktsegment").agg(round4(F.median("c_acctbal")).alias("median_balance"), round4(F.percentile("c_acctbal", 0.95)).alias("p95_balance"))


@query("with s as (select l_suppkey, avg(l_quantity) as q, count(*) as n from lineitem group by 1 having count(*) >= 10) select round(avg(q), 6) as avg_of_avg, round(median(q), 6) as median_of_avg, count(*) as suppliers from s")
def two_level_agg(t):
    s = t("lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.count("*").alias("n")).filter("n >= 10")
    return s.agg(F.round(F.avg("q"), 6).alias("avg_of_avg"), F.round(F.median("q"), 6).alias("median_of_avg"), F.count("*").alias("suppliers"))


@query("""with s as (select l_suppkey, avg(l_extendedprice) as p from lineitem group by 1)
select l_suppkey, round(p, 4) as avg_price from s where p > (select quantile_cont(p, 0.95) from s)""")
def scalar_subquery_filter(t):
    s = t("lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("p"))
    bar = F.broadcast(s.agg(F.percentile("p", 0.95).alias("bar")))  # one row
    return s.join(bar, F.col("p") > F.col("bar")).select("l_suppkey", round4("p").alias("avg_price"))


@query("select p_type, count(*) as n from part group by p_type order by n desc, p_type limit 6")
def topn_categories(t):
    return t("part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(6)


@query("select r_name, n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def rollup_revenue(t):
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


# -- sets, chains, windows, order --------------------------------------------------------------------------------------


@query("""select 'all' as kind, count(*) as n from (select c_nationkey from customer union all select s_nationkey from supplier)
union all select 'both', count(*) from (select c_nationkey from customer intersect select s_nationkey from supplier)
union all select 'neither', count(*) from (select n_nationkey from nation except (select c_nationkey from customer union select s_nationkey from supplier))""")
def union_all_sets(t):
    c, s, n = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")), t("nation").select(F.col("n_nationkey").alias("k"))
    kinds = {"all": c.unionAll(s), "both": c.intersect(s), "neither": n.subtract(c.union(s))}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""with a as (select o_custkey, count(*) as orders, sum(o_totalprice) as spent from orders group by o_custkey), b as (select *, spent / orders as mean from a),
m as (select c_mktsegment, avg(mean) as segment_mean, max(orders) as most from b join customer on o_custkey = c_custkey group by c_mktsegment)
select c_mktsegment, round(segment_mean, 4) as segment_mean, most, segment_mean > 100000 as detected from m""")
def cte_chain(t):
    a = t("orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    b = a.select("*", (F.col("spent") / F.col("orders")).alias("mean"))
    m = b.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.avg("mean").alias("segment_mean"), F.max("orders").alias("most"))
    return m.select("c_mktsegment", round4("segment_mean").alias("segment_mean"), "most", (F.col("segment_mean") > 100000).alias("detected"))


@query("""select d as calendar_date, cast(year(d) as smallint) as year, cast(quarter(d) as smallint) as quarter, cast(month(d) as smallint) as month, monthname(d) as month_name, strftime(d, '%Y-%m') as year_month,
cast(weekofyear(d) as smallint) as week_of_year, cast(isodow(d) as smallint) as day_of_week, dayname(d) as day_name, isodow(d) >= 6 as is_weekend,
cast(year(d) + case when month(d) >= 4 then 1 else 0 end as smallint) as fiscal_year, cast((month(d) + 8) % 12 // 3 + 1 as smallint) as fiscal_quarter,
'FY' || cast(year(d) + case when month(d) >= 4 then 1 else 0 end as varchar) as fiscal_year_label,
cast(last_day(cast(date_trunc('quarter', d) + interval 2 month as date)) as date) as quarter_end, cast(year(d) + case when month(d) >= 7 then 1 else 0 end as integer) as model_year
from (select distinct cast(o_orderdate as date) as d from orders)""")
def date_dim_fiscal(t):
    d = F.col("d")
    days = t("orders").select(day("o_orderdate").alias("d")).distinct()
    return days.select(*[c.alias(n) for n, c in calendar.attributes(d).items()], calendar.quarter_end(d).alias("quarter_end"), calendar.model_year(d).alias("model_year"))


@query("""select o_orderkey, o_custkey, row_number() over w as nth, round(sum(o_totalprice) over w, 2) as running, rank() over (partition by o_custkey order by o_totalprice desc) as price_rank,
lag(o_orderkey) over w as previous from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row)""")
def window_rank_running(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    by_price = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return t("orders").select("o_orderkey", "o_custkey", F.row_number().over(w).cast("long").alias("nth"), F.round(F.sum("o_totalprice").over(running), 2).alias("running"), F.rank().over(by_price).cast("long").alias("price_rank"), F.lag("o_orderkey").over(w).alias("previous"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 1001")
def truncate_limit(t):
    return t("orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(1001).select("o_orderkey", "o_totalprice")


@query("select cast(date_trunc('day', ts) as date) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_daily_windows(t):
    windowed = t("events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), round4(F.sum("value")).alias("total"))
    return windowed.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")


# -- the eight pattern shapes -------------------------------------------------------------------------------------------

PATTERNS = {
    # returned lines per 1,000 of one brand and nation within a window, against all others
    "p1_cohort_window": """
with fitted as (select l_returnflag = 'R' as returned, p_brand = 'Brand#11' and s_nationkey < 5 and cast(l_shipdate as date) >= date '1996-01-01' and cast(l_shipdate as date) < date '1998-01-01' as in_window
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey),
m as (select sum(cast(returned as int)) filter (where in_window) * 1000.0 / nullif(count(*) filter (where in_window), 0) as affected_per_1000,
  sum(cast(returned as int)) filter (where not in_window) * 1000.0 / count(*) filter (where not in_window) as other_per_1000, (select count(*) from orders where o_orderstatus = 'F') as finished_orders from fitted)
select round(cast(affected_per_1000 as double), 4) as affected_per_1000, round(cast(other_per_1000 as double), 4) as other_per_1000, finished_orders, affected_per_1000 >= 3 * other_per_1000 and finished_orders > 0 as detected from m""",
    # share of urgent orders by region, first against last year
    "p2_share_growth": """
with span as (select min(cast(o_orderdate as date)) as a, max(cast(o_orderdate as date)) as b from orders),
s as (select r_name as region, cast(o_orderpriority = '1-URGENT' as int) as hit, cast(o_orderdate as date) < a + interval 365 day as first_year, cast(o_orderdate as date) > b - interval 365 day as last_year
  from orders cross join span join customer on o_custkey = c_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey),
r as (select region, avg(hit) filter (where first_year) as before, avg(hit) filter (where last_year) as after from s group by region),
m as (select max(after - before) as fastest_growth, min(after - before) as slowest_growth, bool_and(after > before) as all_grow from r)
select round(fastest_growth, 6) as fastest_growth, round(slowest_growth, 6) as slowest_growth, all_grow, all_grow and fastest_growth > 2 * slowest_growth as detected from m""",
    # daily order counts in quarter-end windows against the rest, and March against August
    "p3_seasonality": """
with daily as (select cast(o_orderdate as date) as d, count(*) as n from orders group by 1),
c as (select d, n, cast(month(d) as int) as m, {quarter_end_window} as in_window from daily),
m as (select avg(n) filter (where in_window) / avg(n) filter (where not in_window) as uplift, avg(n) filter (where m = 3) / avg(n) filter (where m = 8) as march_vs_august from c)
select round(uplift, 6) as uplift, round(march_vs_august, 6) as march_vs_august, uplift >= 1.2 and march_vs_august >= 1.2 as detected from m""",
    # days to ship of a few suppliers against the median and p95 of the others
    "p4_slow_groups": """
with d as (select l_suppkey, avg(cast({days} as double)) as lag_days from lineitem join orders on o_orderkey = l_orderkey group by l_suppkey having count(*) >= 10),
p as (select {p95} as bar from d where l_suppkey not in (1, 2, 3)),
m as (select avg(lag_days) filter (where l_suppkey in (1, 2, 3)) as slow_avg, median(lag_days) filter (where l_suppkey not in (1, 2, 3)) as other_median,
  count(*) filter (where l_suppkey in (1, 2, 3) and lag_days > bar) as slow_above_p95 from d cross join p)
select round(slow_avg, 6) as slow_avg, round(other_median, 6) as other_median, slow_above_p95, slow_avg >= 1.8 * other_median as detected from m""",
    # rate of kept lines before and after a date for one brand, other brands as control
    "p5_change_point": """
with v as (select p_brand = 'Brand#11' as target, cast(l_shipdate as date) >= date '1998-06-01' as after_change, cast(l_returnflag = 'N' as int) as kept from lineitem join part on p_partkey = l_partkey),
m as (select avg(kept) filter (where target and not after_change) as rate_before, avg(kept) filter (where target and after_change) as rate_after, avg(kept) filter (where not target and after_change) as others_after from v)
select round(rate_before, 6) as rate_before, round(rate_after, 6) as rate_after, round(others_after, 6) as others_after, rate_after <= rate_before - 0.08 and others_after >= rate_before - 0.03 as detected from m""",
    # discounts and orders for each customer-year, by cohort
    "p6_cohort_compare": """
with span as (select max(cast(o_orderdate as date)) as b from orders), first as (select o_custkey, min(cast(o_orderdate as date)) as since, count(*) as n from orders group by o_custkey),
x as (select c_mktsegment as segment, coalesce(n, 0) as n, cast({since_days} as double) / 365.0 as years from customer join first on o_custkey = c_custkey cross join span where since < b),
g as (select c_mktsegment as segment, l_discount from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey),
m as (select sum(n) filter (where segment = 'MACHINERY') / nullif(sum(years) filter (where segment = 'MACHINERY'), 0) as target_rate, sum(n) filter (where segment = 'BUILDING') / nullif(sum(years) filter (where segment = 'BUILDING'), 0) as control_rate from x),
k as (select avg(l_discount) filter (where segment = 'MACHINERY') as target_discount, avg(l_discount) filter (where segment = 'BUILDING') as control_discount from g)
select round(target_rate, 6) as target_rate, round(control_rate, 6) as control_rate, round(target_discount, 6) as target_discount, round(control_discount, 6) as control_discount, target_discount >= 2 * control_discount and target_rate >= 1.3 * control_rate as detected from m cross join k""",
    # large or late returned lines, by suppliers' nation
    "p7_threshold_wear": """
with b as (select s_nationkey = 7 as target, l_orderkey, count(*) filter (where l_returnflag = 'R' and (l_quantity >= 40 or {days} >= 60)) as worn from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey group by all),
m as (select sum(coalesce(worn, 0)) filter (where target) * 1000.0 / nullif(count(*) filter (where target), 0) as target_worn, sum(coalesce(worn, 0)) filter (where not target) * 1000.0 / count(*) filter (where not target) as other_worn from b)
select round(cast(target_worn as double), 4) as target_worn, round(cast(other_worn as double), 4) as other_worn, target_worn >= 3 * greatest(other_worn, 1) as detected from m""",
    # orders for each customer-year of a segment and region, against two controls
    "p8_interaction": """
with span as (select max(cast(o_orderdate as date)) as b from orders), o as (select o_custkey, count(*) as n, min(cast(o_orderdate as date)) as since from orders group by o_custkey),
x as (select c_mktsegment = 'AUTOMOBILE' and r_name = 'EUROPE' as target, c_mktsegment = 'AUTOMOBILE' as same_segment, r_name = 'EUROPE' as same_region, n, cast({since_days} as double) / 365.0 as years
  from customer join o on o_custkey = c_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey cross join span where since < b),
m as (select sum(n) filter (where target) / nullif(sum(years) filter (where target), 0) as target_rate, sum(n) filter (where same_segment and not target) / sum(years) filter (where same_segment and not target) as segment_elsewhere, sum(n) filter (where same_region and not target) / sum(years) filter (where same_region and not target) as region_others from x)
select round(target_rate, 6) as target_rate, round(segment_elsewhere, 6) as segment_elsewhere, round(region_others, 6) as region_others, target_rate >= 1.8 * segment_elsewhere and target_rate >= 1.8 * region_others as detected from m""",
}
DIALECT = {
    "spark": {"days": "datediff(cast(l_shipdate as date), cast(o_orderdate as date))", "since_days": "datediff(b, since)", "p95": "percentile(lag_days, 0.95)", "quarter_end_window": "d > date_sub(add_months(trunc(d, 'quarter'), 3), 11)"},
    "sql": {"days": "date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date))", "since_days": "date_diff('day', since, b)", "p95": "quantile_cont(lag_days, 0.95)", "quarter_end_window": "d > cast(date_trunc('quarter', d) + interval 3 month - interval 11 day as date)"},
}


def _with_views(text: str):
    """A query whose tables are this folder's: every name becomes a DataFrame parameter of spark.sql."""
    names = [n for n in TABLES if re.search(rf"\b(?:from|join) {n}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = text.format(**DIALECT["spark"])
        for n in names:
            body = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}} {n}", body)
        return spark.sql(body, **{n: table(spark, sf_dir, n) for n in names})

    return run


for _name, _text in PATTERNS.items():
    QUERIES[_name] = _with_views(_text)
    ORACLE_SQL[_name] = _text.format(**DIALECT["sql"])


# -- the library's own operators over the test tables --------------------------------------------------------------------

LINES = {
    "tables": {
        "orders": {"kind": "dimension", "primary_key": ["o_orderkey"], "columns": ["o_orderkey BIGINT", "o_custkey BIGINT 1.."]},
        "lineitem": {
            "kind": "fact", "primary_key": ["l_orderkey", "l_linenumber"], "date_column": "ship_date", "foreign_keys": [{"columns": ["l_orderkey"], "references": "orders.o_orderkey"}],
            "columns": ["l_orderkey BIGINT", "l_linenumber INTEGER 1..7", "l_quantity DOUBLE 2..49", "l_discount DOUBLE 0..0.05", "l_tax DOUBLE", "l_returnflag VARCHAR in A|R", "ship_date DATE"],
            "checks": [{"name": "discount_within_tax", "expr": "l_discount <= 10 * l_tax"}],
        },
    }
}


def _checked(t) -> dict[str, DataFrame]:
    lines = t("lineitem").withColumn("ship_date", day("l_shipdate"))
    return {"orders": t("orders").select("o_orderkey", "o_custkey"), "lineitem": lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "ship_date")}


_FAILS = {
    "lineitem": {
        **{f"not_null:{c}": f"{c} is null" for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")}, "not_null:ship_date": "l_shipdate is null", "min:l_linenumber": "l_linenumber < 1", "max:l_linenumber": "l_linenumber > 7",
        "min:l_quantity": "l_quantity < 2", "max:l_quantity": "l_quantity > 49", "min:l_discount": "l_discount < 0", "max:l_discount": "l_discount > 0.05", "allowed_values:l_returnflag": "l_returnflag not in ('A', 'R')", "check:discount_within_tax": "not (l_discount <= 10 * l_tax)",
    },
    "orders": {"not_null:o_orderkey": "o_orderkey is null", "not_null:o_custkey": "o_custkey is null", "min:o_custkey": "o_custkey < 1"},
}
_VALIDATION_SQL = " union all ".join(
    [f"select '{t}' as table_name, '{c}' as check, count(*) as failing_rows from {t} where {p}" for t, rules in _FAILS.items() for c, p in rules.items()]
    + [f"select '{t}', 'primary_key_unique', count(*) from (select 1 from {t} group by {k} having count(*) > 1)" for t, k in (("lineitem", "l_orderkey, l_linenumber"), ("orders", "o_orderkey"))]
    + ["select 'lineitem', 'foreign_key:l_orderkey', count(*) from (select distinct l_orderkey from lineitem where l_orderkey not in (select o_orderkey from orders))"]
)


@query(_VALIDATION_SQL)
def validate_lineitem_checks(t):
    frames = _checked(t)
    return report_frame(frames["orders"].sparkSession, from_dict(LINES), frames)


@query(" union all ".join(f"select '{c}' as column_name, '{k}' as type, count(*) as n_rows, count(*) - count({c}) as nulls, count(distinct {c}) as distinct_values, cast(min({c}) as varchar) as low, cast(max({c}) as varchar) as high, {f'round(avg({c}), 6)' if k == 'BIGINT' else 'cast(null as double)'} as mean from orders" for c, k in (("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "VARCHAR"), ("o_orderpriority", "VARCHAR"))))
def profile_orders(t):
    stats = column_stats(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    return stats.withColumn("mean", F.round("mean", 6)).withColumnRenamed("distinct", "distinct_values")


@query("""select 'orders' as table_name, count(*) as n_rows, min(cast(o_orderdate as date)) as min_date, max(cast(o_orderdate as date)) as max_date from orders
union all select 'lineitem', count(*), min(cast(l_shipdate as date)), max(cast(l_shipdate as date)) from lineitem union all select 'events', count(*), min(cast(ts as date)), max(cast(ts as date)) from events""")
def stats_per_table(t):
    parts = [t(n).agg(F.count("*").alias("n_rows"), F.min(day(c)).alias("min_date"), F.max(day(c)).alias("max_date")).select(F.lit(n).alias("table_name"), "n_rows", "min_date", "max_date") for n, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pinned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan by an explicit file list with a declared schema, in the contract's columns."""
    parts = from_dict({"tables": {"part": {"kind": "dimension", "primary_key": ["p_partkey"], "columns": ["p_partkey BIGINT", "p_brand VARCHAR", "p_retailprice DOUBLE"]}}}).table("part")
    return pinned(spark, [f"{sf_dir}/part.parquet"], parts).groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("top_price"))


def generated_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator's sales, by type: units, discount rate, cancelled; no table is read."""
    world = World("tiny")
    sales = Tables(spark, world).snapshot("fact_sales", world.end)
    return sales.groupBy("sale_type").agg(F.count("*").alias("units"), F.round(F.avg(F.col("discount_amount").cast("double") / F.col("list_price").cast("double")), 4).alias("discount_rate"), F.count_if("is_cancelled").alias("cancelled"))


QUERIES |= {"pinned_scan": pinned_scan, "generated_sales": generated_sales}
ORACLE_SQL["pinned_scan"] = "select p_brand, count(*) as n, max(p_retailprice) as top_price from part group by p_brand"
