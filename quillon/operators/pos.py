"""Point-of-sale aggregations over nested orders, payments, shifts and refunds. Amounts are whole minor units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.cleaning import tender
from quillon.functions.conventions import local_hour, round_up_half, safe_ratio


def exploded(orders: DataFrame, state: str = "COMPLETED") -> DataFrame:
    """One row per line of the orders in a state."""
    return orders.where(F.col("state") == state).select("order_id", "location_id", "created_at", F.explode("line_items").alias("x")).select("order_id", "location_id", "created_at", "x.*")


def net_cents(gross: Column, discount_pct: Column) -> Column:
    """Gross less a percentage, rounded half up to a whole cent."""
    return gross - F.floor((gross * discount_pct + 50) / 100).cast("long")


def sales_summary(orders: DataFrame) -> DataFrame:
    """(location_id, n_orders, gross, discount, net, average) of completed orders. Lines are summed within their order first."""
    lines = lambda f: F.aggregate(F.transform("line_items", f), F.lit(0).cast("long"), lambda a, x: a + x)
    gross, net = lines(lambda x: x["gross_cents"]), lines(lambda x: net_cents(x["gross_cents"], x["discount_pct"]))
    sums = orders.where("state = 'COMPLETED'").select("location_id", gross.alias("g"), net.alias("n")).groupBy("location_id")
    return sums.agg(F.count("*").alias("n_orders"), F.sum("g").alias("gross"), (F.sum("g") - F.sum("n")).alias("discount"), F.sum("n").alias("net"), F.round(F.sum("n") / F.count("*"), 4).alias("average"))


def top_items(lines: DataFrame, k: int = 50) -> DataFrame:
    """(variation_id, quantity, gross, n_orders)."""
    return lines.groupBy("variation_id").agg(F.sum("quantity").alias("quantity"), F.sum("gross_cents").alias("gross"), F.countDistinct("order_id").alias("n_orders")).orderBy(F.desc("gross"), "variation_id").limit(k)


def category_sales(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """(category, quantity, gross, share): lines of unknown items are Uncategorised. Sales are summed by item before the catalog is joined."""
    by_item = lines.groupBy("variation_id").agg(F.sum("quantity").alias("quantity"), F.sum("gross_cents").alias("gross"))
    named = by_item.join(catalog.select("variation_id", "category"), "variation_id", "left")
    sums = named.groupBy(F.coalesce("category", F.lit("Uncategorised")).alias("category")).agg(F.sum("quantity").alias("quantity"), F.sum("gross").alias("gross"))
    total = sums.agg(F.sum("gross").alias("t"))
    return sums.crossJoin(F.broadcast(total)).select("category", "quantity", "gross", F.round(safe_ratio(F.col("gross"), F.col("t")), 6).alias("share"))  # one row


def modifier_popularity(lines: DataFrame) -> DataFrame:
    """(modifier, n, quantity) of lines with a positive quantity."""
    return lines.where("quantity > 0").groupBy("modifier").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


def discount_usage(lines: DataFrame) -> DataFrame:
    """(discount_pct, n, n_orders, amount) of discounted lines."""
    amount = F.col("gross_cents") - net_cents(F.col("gross_cents"), F.col("discount_pct"))
    return lines.where("discount_pct > 0").groupBy("discount_pct").agg(F.count("*").alias("n"), F.countDistinct("order_id").alias("n_orders"), F.sum(amount).alias("amount"))


def payment_breakdown(payments: DataFrame) -> DataFrame:
    """(tender, n, amount, tips, average) of settled payments, and a row for all (tender null)."""
    settled = payments.where(F.col("status").isin("COMPLETED", "APPROVED")).withColumn("tender", tender(F.col("source_type")))
    return settled.rollup("tender").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("amount"), F.sum("tip_cents").alias("tips"), F.round(F.avg("amount_cents"), 4).alias("average"))


def refund_summary(refunds: DataFrame, sales: DataFrame) -> DataFrame:
    """(n, amount, gross, rate): refunded of the gross in the same window; rate is null without sales."""
    r = refunds.agg(F.count("*").alias("n"), F.coalesce(F.sum("gross_cents"), F.lit(0)).alias("amount"))
    s = sales.agg(F.coalesce(F.sum("gross_cents"), F.lit(0)).alias("gross"))
    return r.crossJoin(F.broadcast(s)).withColumn("rate", F.round(safe_ratio(F.col("amount"), F.col("gross")), 6))  # one row each


def hourly(orders: DataFrame, zone: str) -> DataFrame:
    """(hour, n, total) for all 24 hours of the venue's clock."""
    counts = orders.groupBy(local_hour(F.col("created_at").cast("timestamp"), zone).alias("hour")).agg(F.count("*").alias("n"), F.sum("total_cents").alias("total"))
    return orders.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(counts, "hour", "left").na.fill(0)


def with_rate(rows: DataFrame, wages: DataFrame) -> DataFrame:
    """Adds rate: the member's for the job, else the member's own (a wage without a job); null where neither is known."""
    own = wages.where("job is not null").select("member_id", "job", F.col("rate_cents").alias("r1"))
    general = wages.where("job is null").select("member_id", F.col("rate_cents").alias("r2"))
    return rows.join(own, ["member_id", "job"], "left").join(general, "member_id", "left").withColumn("rate", F.coalesce("r1", "r2")).drop("r1", "r2")


def labour_summary(shifts: DataFrame, wages: DataFrame, now: str) -> DataFrame:
    """(location_id, n_shifts, n_open, hours, cost, n_uncosted): open shifts end now; each shift's cost is cut to a whole cent."""
    minutes = F.coalesce("minutes", F.greatest(F.lit(0), F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("start_at").cast("timestamp"))) / 60_000_000)).cast("long"))
    rows = with_rate(shifts.withColumn("m", minutes), wages)
    cost = F.expr("rate * m div 60")
    return rows.groupBy("location_id").agg(F.count("*").alias("n_shifts"), F.count_if(F.col("minutes").isNull()).alias("n_open"), F.round(F.sum("m") / 60, 4).alias("hours"), F.coalesce(F.sum(cost), F.lit(0)).alias("cost"), F.count_if(F.col("rate").isNull()).alias("n_uncosted"))


def scheduled_labour(scheduled: DataFrame, wages: DataFrame, start: str, end: str, *, drafts: bool = False) -> DataFrame:
    """(location_id, n_shifts, hours, cost, coverage, n_uncosted) of the rota: shifts that start in [start, end).

    Shifts that were never published count only with `drafts`; those that don't end after they start never. Hours are taken
    to a millionth, a shift's cost is cut to a whole cent; coverage is the percentage of shifts with a known rate, and cost
    is null where none has one.
    """
    seen = scheduled if drafts else scheduled.where("published is not null")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    rows = published_shift(seen).where((F.col("start_at") >= at(start)) & (F.col("start_at") < at(end)) & (F.col("end_at") > F.col("start_at")))
    seconds = F.timestamp_diff("SECOND", F.col("start_at"), F.col("end_at"))
    rows = with_rate(rows.withColumn("_us", F.round(seconds * 2500 / 9).cast("long")).withColumn("_s", seconds), wages)
    known = F.count("rate")
    return rows.groupBy("location_id").agg(
        F.count("*").alias("n_shifts"), F.round(F.sum("_s") / 3600, 2).alias("hours"), F.sum(F.expr("rate * _us div 1000000")).alias("cost"),
        round_up_half(100 * known / F.count("*"), 2).alias("coverage"), F.count_if(F.col("rate").isNull()).alias("n_uncosted"),
    )


def item_unit_costs(receipts: DataFrame) -> DataFrame:
    """(variation_id, unit_cost): what received units cost on the mean, cut to a whole cent; items whose receipts cost nothing are left out."""
    sums = receipts.where("quantity > 0").groupBy("variation_id").agg(F.sum(F.col("quantity") * F.col("unit_cents")).alias("_c"), F.sum("quantity").alias("_q"))
    return sums.where("_c > 0").select("variation_id", F.expr("_c div _q").alias("unit_cost"))


def cogs_summary(lines: DataFrame, costs: DataFrame, *, reliable: float = 50.0) -> DataFrame:
    """(gross, cogs, coverage, margin, n_uncosted, ask_percent, no_data), one row.

    Coverage is the percentage of sold items whose cost is known; the margin, in percent of the whole gross, is given only from
    `reliable` on, below which the caller should ask for a percentage. no_data says why there is nothing: no sales, or no costs.
    """
    by_item = lines.groupBy("variation_id").agg(F.sum("quantity").alias("q"), F.sum("gross_cents").alias("g")).join(costs, "variation_id", "left")
    known = F.col("unit_cost").isNotNull()
    s = by_item.agg(F.count("*").alias("_n"), F.coalesce(F.sum("g"), F.lit(0)).alias("gross"), F.sum(F.col("q") * F.col("unit_cost")).alias("cogs"), F.count_if(~known).alias("n_uncosted"))
    s = s.withColumn("coverage", F.when(F.col("_n") > 0, round_up_half(100 * (F.col("_n") - F.col("n_uncosted")) / F.col("_n"), 2)).otherwise(0.0))
    margin = F.when((F.col("coverage") >= reliable) & (F.col("gross") > 0), round_up_half(100 * (F.col("gross") - F.col("cogs")) / F.col("gross"), 2))
    reason = F.when(F.col("gross") == 0, "no-completed-orders").when(F.col("coverage") == 0, "no-known-costs")
    return s.select("gross", "cogs", "coverage", margin.alias("margin"), "n_uncosted", (F.col("coverage") < reliable).alias("ask_percent"), reason.alias("no_data"))


def cogs_from_percent(gross: Column, percent: Column) -> tuple[Column, Column]:
    """(cost of goods, margin in percent) of a gross and a cost percentage, both to 2 places; null for a negative gross or a percentage outside 0 to 100."""
    valid = (gross >= 0) & percent.between(0, 100)
    return F.when(valid, round_up_half(gross * percent / 100, 2)), F.when(valid, round_up_half(100 - percent, 2))


def top_uncosted(lines: DataFrame, costs: DataFrame, k: int = 10) -> DataFrame:
    sold = lines.groupBy("variation_id").agg(F.sum("gross_cents").alias("gross"))
    return sold.join(costs, "variation_id", "left_anti").orderBy(F.desc("gross"), "variation_id").limit(k)


def compare_periods(orders: DataFrame, split: str) -> DataFrame:
    """(metric, before, after, delta, percent) of orders before and from a time; percent is null where nothing was before."""
    late = F.col("created_at") >= F.lit(split).cast("timestamp_ntz")
    sums = orders.agg(*(F.coalesce(e, F.lit(0)).alias(n) for n, e in (("o0", F.count_if(~late)), ("o1", F.count_if(late)), ("t0", F.sum(F.when(~late, F.col("total_cents")))), ("t1", F.sum(F.when(late, F.col("total_cents")))))))
    pair = lambda name, a, b: F.struct(F.lit(name).alias("metric"), F.col(a).alias("before"), F.col(b).alias("after"))
    rows = sums.select(F.explode(F.array(pair("orders", "o0", "o1"), pair("total", "t0", "t1"))).alias("x")).select("x.*")
    return rows.withColumn("delta", F.col("after") - F.col("before")).withColumn("percent", F.round(safe_ratio(100 * (F.col("after") - F.col("before")), F.col("before")), 4))


def open_balances(invoices: DataFrame, now: str) -> DataFrame:
    """(n_open, amount, first_due, n_overdue) of unpaid invoices or disputes."""
    at = F.lit(now).cast("timestamp_ntz")
    is_open = F.col("status") != "COMPLETED"
    return invoices.agg(F.count_if(is_open).alias("n_open"), F.coalesce(F.sum(F.when(is_open, F.col("amount_cents"))), F.lit(0)).alias("amount"), F.min(F.when(is_open, F.col("created_at"))).alias("first_due"), F.count_if(is_open & (F.col("created_at") < at)).alias("n_overdue"))


def drawer_variance(drawers: DataFrame) -> DataFrame:
    """(location_id, n, expected, counted, variance, n_off) of closed cash drawers."""
    d = F.col("counted_cents") - F.col("expected_cents")
    return drawers.groupBy("location_id").agg(F.count("*").alias("n"), F.sum("expected_cents").alias("expected"), F.sum("counted_cents").alias("counted"), F.sum(d).alias("variance"), F.count_if(d != 0).alias("n_off"))


def gift_card_liability(cards: DataFrame) -> DataFrame:
    """(n_active, liability) of active gift cards; null without a balance."""
    return cards.where("state = 'ACTIVE'").agg(F.count("*").alias("n_active"), F.sum("balance_cents").alias("liability"))


def customer_summary(customers: DataFrame, now: str, days: int = 30) -> DataFrame:
    """(n, with_email, with_phone, n_new): an empty address or number counts as none; new ones were created less than `days` before now."""
    given = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return customers.agg(F.count("*").alias("n"), given("email").alias("with_email"), given("phone").alias("with_phone"), F.count_if(F.col("created_at") > since).alias("n_new"))


def loyalty_summary(programs: DataFrame, accounts: DataFrame) -> DataFrame:
    """(program_id, status, points_name, n_accounts, points), one row: the first programme (least position) and what its members hold; NO_PROGRAM and zeros without one."""
    first = programs.agg(F.min_by(F.struct("program_id", "status", "points_name"), "position").alias("p"))
    sums = accounts.agg(F.count("*").alias("a"), F.coalesce(F.sum("balance"), F.lit(0)).alias("b"))
    some = F.col("p.program_id").isNotNull()
    both = first.crossJoin(F.broadcast(sums))  # one row each
    return both.select(
        "p.program_id", F.when(some, F.col("p.status")).otherwise("NO_PROGRAM").alias("status"), F.when(some, F.coalesce("p.points_name", F.lit("points"))).alias("points_name"),
        F.when(some, F.col("a")).otherwise(0).alias("n_accounts"), F.when(some, F.col("b")).otherwise(0).alias("points"),
    )


def booking_summary(bookings: DataFrame, now: str, ahead_hours: int = 168) -> DataFrame:
    """(location_id, n_upcoming, n_accepted, n_pending, n_cancelled, next_at) of bookings from now to at most 90 days ahead."""
    hours = min(max(ahead_hours, 1), 24 * 90)
    at = F.lit(now).cast("timestamp_ntz")
    soon = bookings.where(F.col("start_at").between(at, at + F.make_dt_interval(hours=F.lit(hours))))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    status = F.col("status")
    return soon.groupBy("location_id").agg(F.count("*").alias("n_upcoming"), n(status == "ACCEPTED").alias("n_accepted"), n(status == "PENDING").alias("n_pending"), n(status.startswith("CANCELLED")).alias("n_cancelled"), F.min("start_at").alias("next_at"))


def list_with_cap(rows: DataFrame, order: list[Column], cap: int) -> tuple[DataFrame, bool]:
    """At most cap rows, and whether there were more."""
    got = rows.orderBy(*order).limit(cap + 1)
    return got.limit(cap), got.count() > cap


def published_shift(scheduled: DataFrame) -> DataFrame:
    """The published version of each scheduled shift, else its draft; deleted ones go."""
    return scheduled.withColumn("v", F.coalesce("published", "draft")).where("v is not null and not coalesce(v.is_deleted, false)").select("shift_id", "v.*")
