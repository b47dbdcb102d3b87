"""Relational operators over the test tables: scans, projections, filters, joins, aggregates, reshape, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import names, scalars
from quadrat.operators import grouping, joins, rank, reshape
from quadrat.plans import views
from quadrat.plans.registry import query, rounded, rsql
from quadrat.sources.tables import literal_table, load

# ---------------------------------------------------------------- scans and projections


@query(
    "scan_typed",
    """select l_orderkey as order_key, l_linenumber as line_number, l_quantity as quantity_sold,
              l_shipdate::date as ship_date from lineitem""",
)
def scan_typed(spark, d):
    raw = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("Order.Key"),
        F.col("l_linenumber").alias("Line Number"),
        F.col("l_quantity").alias("quantitySold"),
        F.to_date("l_shipdate").alias("Ship-Date"),
    )
    return names.clean_names(raw)


@query(
    "project_select",
    "select l_orderkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount from lineitem",
)
def project_select(spark, d):
    return names.pick(
        load(spark, d, "lineitem"),
        "l_orderkey",
        "l_returnflag",
        ends_with="status",
        between=("l_quantity", "l_tax"),
        drop=["l_tax"],
    )


@query(
    "across_round",
    """select p_partkey, cast(round_even(p_size / 2.0::double, 0) as double) as half_size,
              cast(round_even(p_partkey / 8.0::double, 0) as double) as eighth_key, abs(sqrt(p_size) - 3) < 1 as near_nine
       from part""",
)
def across_round(spark, d):
    halves = load(spark, d, "part").select(
        "p_partkey",
        (F.col("p_size") / 2.0).alias("half_size"),
        (F.col("p_partkey") / 8.0).alias("eighth_key"),
        (F.abs(F.sqrt("p_size") - 3) < 1).alias("near_nine"),
    )
    return names.across(halves, ["half_size", "eighth_key"], lambda c: F.bround(c, 0))


@query(
    "row_id",
    """select row_number() over (order by o_orderdate, o_orderkey) as row_id, o_orderkey, o_custkey
       from orders""",
)
def row_id(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return rank.number_rows(orders, ["o_orderdate", "o_orderkey"], "row_id").select("row_id", "o_orderkey", "o_custkey")


# ---------------------------------------------------------------- filters


@query(
    "filter_basic",
    """select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem
       where (l_returnflag = 'R' and l_quantity < 10) or (l_discount >= 0.09 and l_linestatus = 'O')""",
)
def filter_basic(spark, d):
    wanted = ((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 10)) | (
        (F.col("l_discount") >= 0.09) & (F.col("l_linestatus") == "O")
    )
    return load(spark, d, "lineitem").where(wanted).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "drop_null",
    """select event_type, user_id, v from (select event_type, user_id, case when value > 50 then value end as v from events)
       where v is not null""",
)
def drop_null(spark, d):
    events = load(spark, d, "events").select(
        "event_type", "user_id", F.when(F.col("value") > 50, F.col("value")).alias("v")
    )
    return events.na.drop(subset=["v"])


@query(
    "drop_empty_features",
    """with cells as (
         select l_suppkey as sample, l_partkey as feature,
                cast(sum(case when l_returnflag = 'R' and l_quantity >= 45 then 1 else 0 end) as bigint) as reads
         from lineitem group by 1, 2)
       select sample, feature, reads from cells
       where feature in (select feature from cells group by feature having sum(reads) > 0)""",
)
def drop_empty_features(spark, d):
    from quadrat.operators.composition import drop_empty

    big_return = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)
    cells = (
        load(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature"))
        .agg(F.count_if(big_return).alias("reads"))
    )
    return drop_empty(cells, "feature", "reads")


@query(
    "kth_event",
    """select user_id, event_id, value from (
         select *, row_number() over (partition by user_id order by ts, event_id) as k
         from events where event_type = 'click') where k = 2""",
)
def kth_event(spark, d):
    clicks = load(spark, d, "events").where("event_type = 'click'")
    return grouping.kth_row(clicks, ["user_id"], [F.col("ts"), F.col("event_id")], 2).select(
        "user_id", "event_id", "value"
    )


# Ordered evidence rules for the text queries, exceptions before the general rule.
TEXT_RULES = [
    ("regex", "(?i)not? the", "no"),
    ("equals", "red ring", "no"),
    ("regex", "(?i)ation", "yes"),
    ("regex", "^Is ", "yes"),
    ("regex", "(?i)heon|erst", "yes"),
]


@query(
    "regex_flag",
    """select doc_id, case when regexp_matches(text, '(?i)not? the') then 'no' when text = 'red ring' then 'no'
              when regexp_matches(text, '(?i)ation') then 'yes' when regexp_matches(text, '^Is ') then 'yes'
              when regexp_matches(text, '(?i)heon|erst') then 'yes' else 'no' end as flag,
              regexp_matches(text, '(?i)ring(s|$)') as plural
       from documents""",
)
def regex_flag(spark, d):
    text = F.col("text")
    return load(spark, d, "documents").select(
        "doc_id", scalars.text_rules(text, TEXT_RULES, "no").alias("flag"), text.rlike("(?i)ring(s|$)").alias("plural")
    )


# ---------------------------------------------------------------- joins

_SIDES = """a as (select o_orderkey, o_custkey, nullif(o_orderpriority, '3-MEDIUM') as priority, o_orderstatus as status
                  from orders),
            b as (select nullif(o_orderpriority, '3-MEDIUM') as priority, o_orderstatus as status, count(*) as n
                  from orders where o_orderstatus <> 'P' group by 1, 2)"""


def _sides(spark, d):
    orders = load(spark, d, "orders")
    a = orders.select(
        "o_orderkey",
        "o_custkey",
        F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )
    b = a.where("status <> 'P'").groupBy("priority", "status").agg(F.count("*").alias("n"))
    return a, b


@query(
    "join_left_natural",
    f"""with {_SIDES} select a.o_orderkey, a.o_custkey, a.priority, a.status, b.n
        from a left join b on a.priority is not distinct from b.priority and a.status is not distinct from b.status""",
)
def join_left_natural(spark, d):
    a, b = _sides(spark, d)
    return joins.natural_join(a, b, "left").select("o_orderkey", "o_custkey", "priority", "status", "n")


@query(
    "join_left",
    """select c.c_custkey, c.c_name, t.n_orders from customer c left join
         (select o_custkey, count(*) as n_orders from orders where o_orderstatus = 'F' group by 1) t
         on c.c_custkey = t.o_custkey""",
)
def join_left(spark, d):
    per_customer = (
        load(spark, d, "orders")
        .where("o_orderstatus = 'F'")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n_orders"))
    )
    customer = load(spark, d, "customer").select("c_custkey", "c_name")
    return joins.keyed_join(customer, per_customer, ["c_custkey"], "left")


@query(
    "join_full",
    f"""with {views.VISITS}, {views.DIM},
        per as (select entity, count(*) as n_days from visits where eggs >= 3 group by 1),
        near as (select * from dim where species <> 'BUILDING')
        select coalesce(near.entity, per.entity) as entity, near.site, per.n_days
        from near full join per on near.entity = per.entity""",
)
def join_full(spark, d):
    per_entity = views.visits(spark, d).where("eggs >= 3").groupBy("entity").agg(F.count("*").alias("n_days"))
    near = views.dim(spark, d).where("species <> 'BUILDING'").select("entity", "site")
    return joins.natural_join(near, per_entity, "full")


@query(
    "join_right",
    f"""with {views.READS}, per as (select feature, max(reads) as top from reads group by 1 having max(reads) > 9)
        select reads.sample, reads.feature, reads.reads, per.top from per right join reads on per.feature = reads.feature""",
)
def join_right(spark, d):
    cells = views.reads(spark, d)
    tops = cells.groupBy("feature").agg(F.max("reads").alias("top")).where("top > 9")
    return joins.keyed_join(tops, cells, ["feature"], "right").select("sample", "feature", "reads", "top")


@query(
    "join_renamed_key",
    """select s.s_name as label, n.n_name as nation, s.s_acctbal from supplier s
       left join (select * from nation where n_regionkey <> 2) n on s.s_nationkey = n.n_nationkey""",
)
def join_renamed_key(spark, d):
    supplier, nation = load(spark, d, "supplier"), load(spark, d, "nation").where("n_regionkey <> 2")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left").select(
        F.col("s_name").alias("label"), F.col("n_name").alias("nation"), "s_acctbal"
    )


@query(
    "join_fold",
    """with a as (select l_suppkey as id, count(*) as n_return from lineitem where l_returnflag = 'R' group by 1),
            b as (select l_suppkey as id, count(*) as n_big from lineitem where l_quantity > 49 group by 1),
            c as (select s_suppkey as id, s_name as name from supplier where s_acctbal > 0)
       select coalesce(a.id, b.id, c.id) as id, n_return, n_big, name
       from a full join b on a.id = b.id full join c on coalesce(a.id, b.id) = c.id""",
)
def join_fold(spark, d):
    lines = load(spark, d, "lineitem").withColumnRenamed("l_suppkey", "id")
    returned = lines.where("l_returnflag = 'R'").groupBy("id").agg(F.count("*").alias("n_return"))
    big = lines.where("l_quantity > 49").groupBy("id").agg(F.count("*").alias("n_big"))
    named = (
        load(spark, d, "supplier")
        .where("s_acctbal > 0")
        .select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    )
    return joins.fold_join([returned, big, named], ["id"], "full")


@query(
    "join_semi",
    """select o_orderkey, o_custkey, o_totalprice from orders
       where o_custkey in (select user_id from events where event_type = 'purchase' and value > 200)""",
)
def join_semi(spark, d):
    buyers = load(spark, d, "events").where("event_type = 'purchase' and value > 200")
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.keep_members(orders, buyers, "o_custkey", "user_id").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "join_anti",
    """select o_orderkey, o_custkey from (select o_orderkey, nullif(o_custkey, 7) as o_custkey from orders) o
       where not exists (select 1 from events e where e.event_type = 'purchase' and e.value > 200 and e.user_id = o.o_custkey)""",
)
def join_anti(spark, d):
    buyers = load(spark, d, "events").where("event_type = 'purchase' and value > 200")
    orders = load(spark, d, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("o_custkey"))
    return joins.drop_members(orders, buyers, "o_custkey", "user_id").select("o_orderkey", "o_custkey")


@query(
    "group_max_broadcast",
    """select o_orderkey, o_custkey, o_totalprice, max(o_totalprice) over (partition by o_custkey) as top_price,
              o_totalprice = max(o_totalprice) over (partition by o_custkey) as is_top
       from orders""",
)
def group_max_broadcast(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = grouping.with_group(orders, ["o_custkey"], {"top_price": F.max("o_totalprice")})
    return out.withColumn("is_top", F.col("o_totalprice") == F.col("top_price"))


# ---------------------------------------------------------------- aggregates


@query(
    "distinct_count_by_group",
    """select l_returnflag, l_shipmonth, count(distinct l_suppkey) as n_suppliers, count(*) as n_lines from
         (select *, date_trunc('month', l_shipdate)::date as l_shipmonth from lineitem) group by 1, 2""",
)
def distinct_count_by_group(spark, d):
    lines = load(spark, d, "lineitem").select(
        "l_returnflag", F.to_date(F.date_trunc("month", "l_shipdate")).alias("l_shipmonth"), "l_suppkey"
    )
    keys = ["l_returnflag", "l_shipmonth"]
    folded = lines.groupBy(*keys, "l_suppkey").agg(F.count("*").alias("n"))
    return folded.groupBy(*keys).agg(F.count("l_suppkey").alias("n_suppliers"), F.sum("n").alias("n_lines"))


@query(
    "global_total",
    f"""select count(*) as n, {rsql('sum(l_quantity)', 2)} as quantity, {rsql('sum(l_extendedprice)', 0)} as price,
               case when count(nullif(l_discount, 0.05)) = count(*) then {rsql('sum(l_discount)', 2)} end as strict_discount
        from lineitem""",
)
def global_total(spark, d):
    return load(spark, d, "lineitem").agg(
        F.count("*").alias("n"),
        rounded(F.sum("l_quantity"), 2).alias("quantity"),
        rounded(F.sum("l_extendedprice"), 0).alias("price"),
        rounded(scalars.strict_sum(F.nullif("l_discount", F.lit(0.05))), 2).alias("strict_discount"),
    )


_PROFILE = ["l_quantity", "l_discount", "l_tax"]


@query(
    "profile_summary",
    "select l_returnflag, l_linestatus, "
    + ", ".join(
        f"min({v}) as min_{v}, max({v}) as max_{v}, {rsql(f'avg({v})')} as mean_{v}, {rsql(f'stddev_samp({v})')} as sd_{v}"
        for v in _PROFILE
    )
    + " from lineitem group by 1, 2",
)
def profile_summary(spark, d):
    out = grouping.profile(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], _PROFILE)
    return names.across(out, [c for c in out.columns if c.startswith(("mean_", "sd_"))], rounded)


@query(
    "replicate_summary",
    f"""select l_suppkey, {rsql('avg(l_quantity)')} as mean_q, {rsql('median(l_quantity)')} as median_q,
               {rsql('stddev_samp(l_quantity)')} as sd_q, min(l_quantity) as min_q, max(l_quantity) as max_q
        from lineitem group by 1""",
)
def replicate_summary(spark, d):
    from quadrat.operators.quantiles import exact_quantiles

    lines = load(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    moments = lines.groupBy("l_suppkey").agg(
        rounded(F.avg("l_quantity")).alias("mean_q"),
        rounded(F.stddev_samp("l_quantity")).alias("sd_q"),
        F.min("l_quantity").alias("min_q"),
        F.max("l_quantity").alias("max_q"),
    )
    medians = exact_quantiles(lines, ["l_suppkey"], "l_quantity", {"median_q": 0.5})
    return moments.join(medians.withColumn("median_q", rounded("median_q")), "l_suppkey")


_STATUS = {
    "returned": "l_returnflag = 'R'",
    "accepted": "l_returnflag = 'A'",
    "open_big": "l_linestatus = 'O' and l_quantity > 49",
    "free": "l_discount = 0 and l_tax = 0",
    "impossible": "l_quantity > 50",
}


@query(
    "status_count_table",
    "select r_name as site, c_mktsegment as segment, "
    + ", ".join(f"nullif(count(distinct case when {c} then o_custkey end), 0) as {n}" for n, c in _STATUS.items())
    + """ from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
          join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""",
)
def status_count_table(spark, d):
    lines = load(spark, d, "lineitem")
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    dim = views.dim(spark, d).withColumnRenamed("species", "segment")
    flags = {n: F.expr(c) for n, c in _STATUS.items()}
    # lines fold to one row per order before they meet the orders
    per_order = lines.groupBy("l_orderkey").agg(*[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in flags.items()])
    joined = per_order.join(orders, per_order.l_orderkey == orders.o_orderkey).join(dim, F.col("o_custkey") == dim.entity)
    return grouping.status_counts(joined, ["site", "segment"], "o_custkey", {n: F.col(n) == 1 for n in _STATUS})


@query(
    "hist_bins",
    """select cast(least(floor(l_extendedprice / 10000), 10) as integer) as bin, count(*) as n
       from lineitem group by 1""",
)
def hist_bins(spark, d):
    width = F.least(F.floor(F.col("l_extendedprice") / 10000), F.lit(10)).cast("int")
    return load(spark, d, "lineitem").groupBy(width.alias("bin")).agg(F.count("*").alias("n"))


@query(
    "quartiles_by_group",
    f"""select l_returnflag, l_linestatus, min(l_extendedprice) as lowest,
               {rsql('quantile_cont(l_extendedprice, 0.25)', 4)} as q1, {rsql('quantile_cont(l_extendedprice, 0.5)', 4)} as q2,
               {rsql('quantile_cont(l_extendedprice, 0.75)', 4)} as q3, max(l_extendedprice) as highest
        from lineitem group by 1, 2""",
)
def quartiles_by_group(spark, d):
    from quadrat.operators.quantiles import exact_quantiles

    keys = ["l_returnflag", "l_linestatus"]
    lines = load(spark, d, "lineitem").select(*keys, "l_extendedprice")
    ends = lines.groupBy(*keys).agg(F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest"))
    quartiles = exact_quantiles(lines, keys, "l_extendedprice", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return ends.join(names.across(quartiles, ["q1", "q2", "q3"], lambda c: rounded(c, 4)), keys)


@query(
    "median_by_date",
    f"""select cast(ts as date) as date, event_type, {rsql('median(value)')} as median_value
        from events group by 1, 2""",
)
def median_by_date(spark, d):
    from quadrat.operators.quantiles import exact_quantiles

    events = load(spark, d, "events").select(F.to_date("ts").alias("date"), "event_type", "value")
    out = exact_quantiles(events, ["date", "event_type"], "value", {"median_value": 0.5})
    return out.withColumn("median_value", rounded("median_value"))


# ---------------------------------------------------------------- sets and reshape


@query("distinct_rows", "select distinct l_suppkey, l_returnflag, l_linestatus from lineitem")
def distinct_rows(spark, d):
    return load(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query(
    "union_distinct",
    """select l_suppkey, l_partkey from lineitem where l_returnflag = 'R' union
       select l_suppkey, l_partkey from lineitem where l_quantity > 40 union
       select l_suppkey, l_partkey from lineitem where l_tax = 0""",
)
def union_distinct(spark, d):
    pairs = load(spark, d, "lineitem")
    parts = [pairs.where(c).select("l_suppkey", "l_partkey") for c in ("l_returnflag = 'R'", "l_quantity > 40", "l_tax = 0")]
    return reshape.union_distinct(parts)


@query(
    "union_tagged",
    """select 'customer' as kind, c_nationkey as nationkey, c_acctbal as balance, c_mktsegment as segment from customer
       union all select 'supplier', s_nationkey, s_acctbal, null from supplier""",
)
def union_tagged(spark, d):
    customer = load(spark, d, "customer").select(
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    supplier = load(spark, d, "supplier").select(
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("balance")
    )
    return reshape.stack_tagged({"customer": customer, "supplier": supplier}, "kind")


@query(
    "set_region_counts",
    """with seen as (
         select distinct 'part' as level, l_partkey as taxon, l_returnflag || l_linestatus as grp from lineitem
         union all
         select distinct 'supplier', l_suppkey, l_returnflag || l_linestatus from lineitem)
       select level, region, count(*) as n from (
         select level, taxon, string_agg(distinct grp, ',' order by grp) as region from seen group by 1, 2) group by 1, 2""",
)
def set_region_counts(spark, d):
    lines = (
        load(spark, d, "lineitem")
        .select(
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supplier"),
            F.concat("l_returnflag", "l_linestatus").alias("grp"),
        )
    )
    long = reshape.to_long(lines, ["grp"], ["part", "supplier"], "level", "taxon")
    return grouping.set_regions(long, ["level"], "taxon", "grp")


@query(
    "reshape_long",
    """select l_orderkey, l_linenumber, measure, amount from
         (unpivot (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem)
          on l_quantity, l_discount, l_tax into name measure value amount)""",
)
def reshape_long(spark, d):
    lines = load(spark, d, "lineitem")
    return reshape.to_long(lines, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount")


@query(
    "reshape_wide",
    """select user_id, """
    + ", ".join(
        f"max(case when event_type = '{e}' then n end) as n_{e}" for e in ("click", "error", "purchase", "signup", "view")
    )
    + " from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1",
)
def reshape_wide(spark, d):
    counts = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return reshape.to_wide(
        counts, ["user_id"], "event_type", "n", ["click", "error", "purchase", "signup", "view"], prefix="n_"
    )


@query(
    "unite_cols",
    """select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'NA') || '-' || o_orderpriority as with_marker,
              concat_ws('; ', nullif(o_orderstatus, 'P'), nullif(o_orderpriority, '5-LOW')) as without_null
       from orders""",
)
def unite_cols(spark, d):
    status, priority = F.nullif("o_orderstatus", F.lit("P")), F.nullif("o_orderpriority", F.lit("5-LOW"))
    return load(spark, d, "orders").select(
        "o_orderkey",
        scalars.unite([status, F.col("o_orderpriority")], "-").alias("with_marker"),
        scalars.unite([status, priority], "; ", skip_null=True).alias("without_null"),
    )


# ---------------------------------------------------------------- scalars


@query(
    "packed_date_time",
    """select o_orderkey, packed, make_date(2022, cast(substr(packed, 1, 1) as integer), cast(substr(packed, 2) as integer)) as date,
              hour_part, minute_part, hour_part || ':' || minute_part as time
       from (select o_orderkey, cast((month(o_orderdate) % 9 + 1) * 100 + day(o_orderdate) % 28 + 1 as varchar) as packed,
                    lpad(cast(o_orderkey % 24 as varchar), 2, '0') as hour_part, lpad(cast(o_orderkey % 60 as varchar), 2, '0') as minute_part
             from orders)""",
)
def packed_date_time(spark, d):
    key = F.col("o_orderkey")
    orders = load(spark, d, "orders").select(
        "o_orderkey",
        ((F.month("o_orderdate") % 9 + 1) * 100 + F.day("o_orderdate") % 28 + 1).cast("string").alias("packed"),
        F.format_string("1899-12-31 %02d:%02d:00", key % 24, key % 60).alias("stamp"),
    )
    time = scalars.clock_time(F.col("stamp"))
    return orders.select(
        "o_orderkey",
        "packed",
        scalars.packed_date(F.col("packed"), 2022).alias("date"),
        F.split(time, ":")[0].alias("hour_part"),
        F.split(time, ":")[1].alias("minute_part"),
        time.alias("time"),
    )


@query(
    "recode_map",
    """select p_partkey, case when p_type in ('ECONOMY', 'PROMO') then 'cheap' when p_type = 'LARGE' then 'big'
                              when p_type = 'SMALL' then null else p_type end as kind, days, source
       from part left join (values ('STANDARD', 12, 'table a'), ('PROMO', 13, 'table b')) as t(p_type2, days, source)
       on p_type = p_type2""",
)
def recode_map(spark, d):
    lookup = literal_table(
        spark, [("STANDARD", 12, "table a"), ("PROMO", 13, "table b")], "p_type string, days int, source string"
    )
    mapping = {"ECONOMY": "cheap", "PROMO": "cheap", "LARGE": "big", "SMALL": None}
    # the lookup is typed in above, so its size is fixed
    return (
        load(spark, d, "part")
        .join(F.broadcast(lookup), "p_type", "left")
        .select("p_partkey", scalars.recode(F.col("p_type"), mapping).alias("kind"), "days", "source")
    )


@query(
    "rule_classify",
    """select p_partkey, case when regexp_matches(p_name, '(?i)^red ') then 'warm' when p_name = 'hot ring' then 'exempt'
                              when regexp_matches(p_name, '(?i)hot') then 'warm' when regexp_matches(p_name, 'cold|blue') then 'cool'
                              else 'plain' end as class from part""",
)
def rule_classify(spark, d):
    rules = [
        ("regex", "(?i)^red ", "warm"),
        ("equals", "hot ring", "exempt"),
        ("regex", "(?i)hot", "warm"),
        ("regex", "cold|blue", "cool"),
    ]
    return load(spark, d, "part").select("p_partkey", scalars.text_rules(F.col("p_name"), rules, "plain").alias("class"))


@query(
    "null_tokens",
    """select event_id, case when lower(trim(raw)) in ('na', 'n/a', 'u', '?', 'unknown') then null else raw end as clean from (
         select event_id, case event_type when 'error' then ' N/A' when 'signup' then '?' when 'view' then 'Unknown'
                          else event_type end as raw from events)""",
)
def null_tokens(spark, d):
    raw = scalars.recode(F.col("event_type"), {"error": " N/A", "signup": "?", "view": "Unknown"})
    return load(spark, d, "events").select("event_id", scalars.null_tokens(raw).alias("clean"))


@query(
    "string_edits",
    """select c_custkey, regexp_replace(c_name, '0', 'o') as first_zero, replace(c_name, '0', '') as no_zero,
              case when regexp_matches(c_name, '7$') then null else c_name end as no_seven,
              coalesce(nullif(c_mktsegment, 'BUILDING'), 'Unknown') as segment,
              upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as title,
              regexp_replace(c_name, '^Customer#0*', '') as tail
       from customer""",
)
def string_edits(spark, d):
    name = F.col("c_name")
    return load(spark, d, "customer").select(
        "c_custkey",
        scalars.replace_first(name, "0", "o").alias("first_zero"),
        F.replace(name, F.lit("0"), F.lit("")).alias("no_zero"),
        scalars.null_if_match(name, "7$").alias("no_seven"),
        F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("Unknown")).alias("segment"),
        F.initcap("c_mktsegment").alias("title"),
        F.regexp_replace(name, "^Customer#0*", "").alias("tail"),
    )


@query(
    "label_parse",
    """with labels as (
         select s_suppkey, case s_suppkey % 6 when 0 then 'a' || s_suppkey || '_mul1806' when 1 then 'e' || s_suppkey || '_mul1806'
                  when 2 then 'dogsample1_mul1806' when 3 then 'water2_cou1805' when 4 then 'x00' || s_suppkey || '_mul1806'
                  else 'j' || s_suppkey || '_mul1806' end as label from supplier)
       select s_suppkey, label,
              case when regexp_matches(label, '^(dogsample|water|x00)') then null else regexp_replace(label, '_mul.*', '') end as entity,
              case when regexp_matches(label, '^[aej]') then null when label like 'x00%' then 'cloacal'
                   else regexp_replace(label, '._(mul|cou).*', '') end as control_type
       from labels""",
)
def label_parse(spark, d):
    from quadrat.operators.composition import decode_labels

    key = F.col("s_suppkey")
    kind = key % 6
    label = (
        F.when(kind == 0, F.concat(F.lit("a"), key, F.lit("_mul1806")))
        .when(kind == 1, F.concat(F.lit("e"), key, F.lit("_mul1806")))
        .when(kind == 2, F.lit("dogsample1_mul1806"))
        .when(kind == 3, F.lit("water2_cou1805"))
        .when(kind == 4, F.concat(F.lit("x00"), key, F.lit("_mul1806")))
        .otherwise(F.concat(F.lit("j"), key, F.lit("_mul1806")))
    )
    return decode_labels(load(spark, d, "supplier").select("s_suppkey", label.alias("label")), "label")


@query(
    "date_functions",
    """select o_orderkey, cast(dayofyear(o_orderdate) as integer) as doy, cast(o_orderdate as date) - 1 as day_before,
              cast(o_orderdate as date) + 1 as day_after,
              make_date(2022, 1, 1) + cast(dayofyear(o_orderdate) - 1 as integer) as same_day_2022,
              make_date(cast(year(o_orderdate) as integer), 1, 1) as new_year
       from orders""",
)
def date_functions(spark, d):
    date = F.to_date("o_orderdate")
    doy = F.dayofyear(date)
    return load(spark, d, "orders").select(
        "o_orderkey",
        doy.alias("doy"),
        F.date_sub(date, 1).alias("day_before"),
        F.date_add(date, 1).alias("day_after"),
        scalars.date_of_day(doy, 2022).alias("same_day_2022"),
        scalars.date_of_day(F.lit(1), F.year(date)).alias("new_year"),
    )
