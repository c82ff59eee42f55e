"""Queries of the dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import cleaning
from quillon.operators import dashboards as d
from quillon.sources.views import MESSAGES, SEARCH_EVENTS, STOCK, TASKS, messages, search_events, stock, table, tasks

NOW = "1997-01-01 00:00:00"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 5).alias("venue_id"))


MEMBERS = "members AS (SELECT c_custkey AS user_id, c_name AS name, c_custkey % 5 AS venue_id FROM customer)"


def _tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a log of called tools, a citation and a cost, all derived from the keys."""
    m = messages(spark, sf_dir)
    k = F.col("conv_id") + F.col("turn")
    return m.withColumn("tools", F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.concat(F.lit("tool"), ((F.col("conv_id") + i) % 7).cast("string")))).withColumn("cost_e6", k % 100 * 25)


TOOLS = f"{MESSAGES}, tooled AS (SELECT *, list_transform(range(0, (conv_id + turn) % 3 + 1), lambda i: 'tool' || CAST((conv_id + i) % 7 AS VARCHAR)) AS tools, (conv_id + turn) % 100 * 25 AS cost_e6 FROM messages)"

QUERIES = {
    "search_outcomes": lambda s, p: d.outcomes_by_day(search_events(s, p), "2023-12-28", "2024-02-05"),
    "escalations": lambda s, p: d.escalations_by_day(search_events(s, p), F.col("event_type") == "error", F.col("value") > 50),
    "costs": lambda s, p: d.costs_by_day(search_events(s, p)),
    "feedback": lambda s, p: d.feedback_by_day(search_events(s, p), up="click", down="error", again="view"),
    "pricing_funnel": lambda s, p: d.funnel(search_events(s, p).withColumn("cents", F.floor(F.col("value") * 100 + 0.5).cast("long")), "event_type", ["purchase", "signup"], ["error"], "cents"),
    "weekly_active": lambda s, p: d.weekly_active(search_events(s, p), "America/Los_Angeles", "2023-12-25", 8),
    "hours_recovered": lambda s, p: d.hours_recovered(search_events(s, p), "2024-01-05 00:00:00", "2024-01-20 00:00:00"),
    "top_unanswered": lambda s, p: d.top_queries(search_events(s, p), "no-data", 10),
    "top_answered": lambda s, p: d.top_queries(search_events(s, p), "hit", 10, trim=False),
    "undismissed_gaps": lambda s, p: d.unanswered(search_events(s, p), search_events(s, p).where("outcome = 'error' and value > 80").select("query")),
    "active_staff": lambda s, p: d.active_staff(search_events(s, p), _members(s, p), 10),
    "competency": lambda s, p: d.competency(search_events(s, p)),
    "onboarding_cohort": lambda s, p: d.onboarding(_members(s, p), search_events(s, p)),
    "independent_day": lambda s, p: d.first_independent_day(search_events(s, p), least=3, below=0.5),
    "messages_by_month": lambda s, p: d.by_month(messages(s, p)),
    "tool_frequency": lambda s, p: d.tool_frequency(_tools(s, p), "tools", 30),
    "grounding": lambda s, p: d.grounding(_tools(s, p).where("role = 'assistant'"), F.col("text").rlike("[.]$"), F.array_contains("tools", "tool3"), "cost_e6"),
    "adoption": lambda s, p: d.adoption(_members(s, p), messages(s, p)),
    "latest_message": lambda s, p: d.latest_per_group(messages(s, p).select("user_id", "conv_id", "turn", "created_at"), ["user_id"], ["created_at", "conv_id"]),
    "next_reply": lambda s, p: d.next_reply(messages(s, p)),
    "failure_rates": lambda s, p: d.failure_rates(messages(s, p).where("role = 'assistant'"), cleaning.contains_any(F.col("text"), ["ou", "keit"])),
    "gap_scorecard": lambda s, p: d.cluster_scorecard(messages(s, p).where("role = 'user'"), "venue_id", cleaning.contains_any(F.col("text"), ["keit"]), "text"),
    "due_counters": lambda s, p: d.due_counters(tasks(s, p), NOW),
    "task_status": lambda s, p: d.status_counts(tasks(s, p), "status", "severity"),
    "task_list": lambda s, p: d.task_list(tasks(s, p)),
    "message_page": lambda s, p: d.page(messages(s, p).select("created_at", "conv_id", "turn", "role"), ("2024-01-05 00:00:00", 96, 0), ["created_at", "conv_id", "turn"], 20),
    "task_page": lambda s, p: d.offset_page(tasks(s, p), [F.col("task_id")], 40, 20),
    "below_par": lambda s, p: d.below_par(stock(s, p)),
    "stock_status": lambda s, p: stock(s, p).select("stock_id", "venue_id", cleaning.stock_status(F.col("current"), F.col("par")).alias("status"), F.round(F.col("current") / F.nullif(F.col("weekly_use"), F.lit(0)), 4).alias("weeks_left")),
    "supplier_stock": lambda s, p: d.suppliers_with_stock(stock(s, p)),
    "usage_mix": lambda s, p: d.usage_mix(messages(s, p)),
    "gap_askers": lambda s, p: d.named_askers(search_events(s, p).where("outcome = 'no-data'").groupBy("query").agg(F.slice(F.array_sort(F.collect_set("user_id")), 1, 5).alias("asked_by")), "asked_by", _members(s, p)),
    "name_search": lambda s, p: stock(s, p).where(F.col("name").ilike("%a%")).orderBy("name", "stock_id").limit(5).select("stock_id", "name"),
}


def _day(body: str, where: str = "") -> str:
    return f"WITH {SEARCH_EVENTS} SELECT CAST(created_at AS DATE) AS day, {body} FROM search_events {where} GROUP BY CAST(created_at AS DATE)"


_CENTS = "CAST(floor(value * 100 + 0.5) AS BIGINT)"
ORACLES = {
    "search_outcomes": f"""WITH {SEARCH_EVENTS}, days AS (SELECT CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day)
      SELECT day, count(*) FILTER (WHERE outcome = 'hit') AS hit, count(*) FILTER (WHERE outcome = 'no-data') AS no_data, count(*) FILTER (WHERE outcome = 'error') AS error, count(event_id) AS total FROM days LEFT JOIN search_events ON CAST(created_at AS DATE) = day GROUP BY day""",
    "escalations": _day("count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_escalated, count(*) FILTER (WHERE event_type = 'error' AND value > 50) AS n_resolved, round(count(*) FILTER (WHERE event_type = 'error' AND value > 50) / nullif(count(*) FILTER (WHERE event_type = 'error'), 0), 6) AS resolution_rate"),
    "costs": _day(f"CAST(coalesce(sum({_CENTS}), 0) AS BIGINT) AS cents, count(value) AS n_costed, round(sum({_CENTS}) / count(*), 6) AS cents_per_event"),
    "feedback": _day("count(*) FILTER (WHERE event_type = 'click') AS up, count(*) FILTER (WHERE event_type = 'error') AS down, count(*) FILTER (WHERE event_type = 'view') AS regenerate, round(count(*) FILTER (WHERE event_type = 'click') / nullif(count(*) FILTER (WHERE event_type IN ('click', 'error')), 0), 6) AS positive_rate"),
    "pricing_funnel": f"""WITH {SEARCH_EVENTS} SELECT count(*) AS n, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS n_adopted, count(*) FILTER (WHERE event_type = 'error') AS n_dismissed, CAST(sum({_CENTS}) FILTER (WHERE event_type IN ('purchase', 'signup')) AS BIGINT) AS uplift,
      round(count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) / nullif(count(*) FILTER (WHERE event_type IN ('purchase', 'signup', 'error')), 0), 6) AS adoption_rate FROM search_events""",
    "weekly_active": f"""WITH {SEARCH_EVENTS}, local AS (SELECT CAST(date_trunc('week', timezone('America/Los_Angeles', timezone('UTC', created_at))) AS DATE) AS week, user_id FROM search_events),
      weeks AS (SELECT DATE '2023-12-25' + CAST(7 * k AS INTEGER) AS week FROM range(8) AS r(k)) SELECT week, count(DISTINCT user_id) AS n_users, count(user_id) AS n_events FROM weeks LEFT JOIN local USING (week) GROUP BY week""",
    "hours_recovered": f"""WITH {SEARCH_EVENTS} SELECT count(*) AS hits, round(count(*) * 4.2::DOUBLE / 60, 4) AS hours, CAST(floor(count(*) * 4.2::DOUBLE / 60 * 2500 + 0.5) AS BIGINT) AS pence FROM search_events
      WHERE outcome = 'hit' AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20'""",
    "top_unanswered": f"WITH {SEARCH_EVENTS} SELECT lower(trim(query)) AS query, count(*) AS n, max(created_at) AS last_asked FROM search_events WHERE outcome = 'no-data' GROUP BY 1 ORDER BY n DESC, last_asked DESC, query LIMIT 10",
    "top_answered": f"WITH {SEARCH_EVENTS} SELECT lower(query) AS query, count(*) AS n, max(created_at) AS last_asked FROM search_events WHERE outcome = 'hit' GROUP BY 1 ORDER BY n DESC, last_asked DESC, query LIMIT 10",
    "undismissed_gaps": f"WITH {SEARCH_EVENTS} SELECT lower(query) AS query, count(*) AS n, max(created_at) AS last_asked FROM search_events WHERE outcome = 'no-data' AND lower(query) NOT IN (SELECT lower(query) FROM search_events WHERE outcome = 'error' AND value > 80) GROUP BY 1",
    "active_staff": f"WITH {SEARCH_EVENTS}, {MEMBERS} SELECT user_id, name, count(*) AS n, max(created_at) AS last_seen FROM search_events JOIN members USING (user_id) GROUP BY user_id, name ORDER BY n DESC, last_seen DESC, user_id LIMIT 10",
    "competency": f"WITH {SEARCH_EVENTS} SELECT user_id, count(*) AS total, count(*) - count(DISTINCT query) AS repeats, round((count(*) - count(DISTINCT query)) / count(*), 6) AS repeat_rate FROM search_events GROUP BY user_id",
    "onboarding_cohort": f"WITH {SEARCH_EVENTS}, {MEMBERS} SELECT user_id, count(event_id) AS total, count(event_id) - count(DISTINCT query) AS repeats, round((count(event_id) - count(DISTINCT query)) / nullif(count(event_id), 0), 6) AS repeat_rate FROM members LEFT JOIN search_events USING (user_id) GROUP BY user_id",
    "independent_day": f"""WITH {SEARCH_EVENTS}, j AS (SELECT user_id, min(created_at) AS joined FROM search_events GROUP BY user_id), a AS (SELECT user_id, query, CAST(floor((epoch_us(created_at) - epoch_us(joined)) / 86400000000) AS BIGINT) AS d FROM search_events JOIN j USING (user_id)),
      r AS (SELECT user_id, day, count(*) AS n, count(DISTINCT query) AS u FROM a JOIN range(1, 15) AS b(day) ON d < day AND d >= day - 7 WHERE d < 14 GROUP BY user_id, day HAVING count(*) >= 3 AND (count(*) - count(DISTINCT query)) / count(*) < 0.5)
      SELECT user_id, min(day) AS first_day FROM j LEFT JOIN r USING (user_id) GROUP BY user_id""",
    "messages_by_month": f"WITH {MESSAGES} SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM messages GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
    "tool_frequency": f"WITH {TOOLS}, t AS (SELECT unnest(tools) AS tool FROM tooled) SELECT tool, count(*) AS n FROM t GROUP BY tool ORDER BY n DESC, tool LIMIT 30",
    "grounding": f"""WITH {TOOLS} SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[.]$')) AS n_cited, count(*) FILTER (WHERE list_contains(tools, 'tool3')) AS n_tool, count(*) FILTER (WHERE list_contains(tools, 'tool3') AND NOT regexp_matches(text, '[.]$')) AS n_tool_uncited,
      CAST(sum(cost_e6) AS BIGINT) AS cost, round(avg(cost_e6), 6) AS mean_cost FROM tooled WHERE role = 'assistant'""",
    "adoption": f"WITH {MESSAGES}, {MEMBERS} SELECT m.venue_id, count(DISTINCT m.user_id) AS n_members, count(DISTINCT x.user_id) AS n_active, count(DISTINCT conv_id) AS n_conversations, count(turn) AS n_messages FROM members m LEFT JOIN messages x ON x.user_id = m.user_id GROUP BY m.venue_id",
    "latest_message": f"WITH {MESSAGES} SELECT DISTINCT ON (user_id) user_id, conv_id, turn, created_at FROM messages ORDER BY user_id, created_at DESC, conv_id DESC",
    "next_reply": f"""WITH {MESSAGES} SELECT u.conv_id, u.turn, u.text, a.turn AS reply_turn, a.text AS reply FROM messages u LEFT JOIN messages a ON a.conv_id = u.conv_id AND a.role = 'assistant'
      AND a.turn = (SELECT min(b.turn) FROM messages b WHERE b.conv_id = u.conv_id AND b.role = 'assistant' AND b.turn > u.turn) WHERE u.role = 'user'""",
    "failure_rates": f"""WITH {MESSAGES}, f AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE contains(lower(text), 'ou') OR contains(lower(text), 'keit')) AS n_failed FROM messages WHERE role = 'assistant' GROUP BY 1)
      SELECT *, round(n_failed / n, 6) AS rate, round(avg(n_failed / n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rate_7 FROM f""",
    "gap_scorecard": f"""WITH {MESSAGES}, u AS (SELECT *, contains(lower(text), 'keit') AS f FROM messages WHERE role = 'user'), e AS (SELECT venue_id, list(DISTINCT text) AS x FROM u WHERE f GROUP BY venue_id)
      SELECT u.venue_id, count(*) AS n, count(*) FILTER (WHERE f) AS n_failed, round(count(*) FILTER (WHERE f) / count(*), 6) AS density, round(count(*) FILTER (WHERE f) / count(*) * count(*) FILTER (WHERE f), 6) AS score, round(count(*) FILTER (WHERE f) / count(*), 6) >= 0.5 AS is_gap, any_value(list_sort(x)[1:3]) AS examples
      FROM u LEFT JOIN e USING (venue_id) GROUP BY u.venue_id""",
    "due_counters": f"""WITH {TASKS} SELECT count(*) FILTER (WHERE status = 'open') AS n_open, count(*) FILTER (WHERE status = 'open' AND due_at < TIMESTAMP '{NOW}') AS n_overdue, count(*) FILTER (WHERE status = 'open' AND due_at >= TIMESTAMP '{NOW}' AND due_at < TIMESTAMP '{NOW}' + INTERVAL 30 DAY) AS n_due_30,
      count(*) FILTER (WHERE status = 'open' AND due_at IS NULL) AS n_undated FROM tasks""",
    "task_status": f"WITH {TASKS} SELECT status, severity, count(*) AS n FROM tasks GROUP BY status, severity",
    "task_list": f"WITH {TASKS} SELECT * FROM tasks ORDER BY status <> 'open', due_at NULLS LAST, created_at DESC, task_id LIMIT 50",
    "message_page": f"WITH {MESSAGES} SELECT created_at, conv_id, turn, role FROM messages WHERE (created_at, conv_id, turn) < (TIMESTAMP '2024-01-05', 96, 0) ORDER BY created_at DESC, conv_id DESC, turn DESC LIMIT 21",
    "task_page": f"WITH {TASKS} SELECT *, (SELECT count(*) FROM tasks) AS total FROM tasks ORDER BY task_id LIMIT 20 OFFSET 40",
    "below_par": f"WITH {STOCK} SELECT *, round(1 - current / par, 6) AS depletion FROM stock WHERE current < par AND par > 0 ORDER BY depletion DESC, name, stock_id LIMIT 50",
    "stock_status": f"WITH {STOCK} SELECT stock_id, venue_id, CASE WHEN current <= 0 THEN 'OUT_OF_STOCK' WHEN current < par THEN 'BELOW_PAR' WHEN current >= 1.5 * par THEN 'OVERSTOCKED' ELSE 'OK' END AS status, round(current / nullif(weekly_use, 0), 4) AS weeks_left FROM stock",
    "supplier_stock": f"WITH {STOCK} SELECT venue_id, supplier_id, count(*) AS n FROM stock GROUP BY venue_id, supplier_id",
    "usage_mix": f"WITH {MESSAGES} SELECT venue_id, channel, count(DISTINCT conv_id) AS n_conversations, count(*) AS n_messages FROM messages GROUP BY venue_id, channel",
    "gap_askers": f"""WITH {SEARCH_EVENTS}, {MEMBERS}, g AS (SELECT query, list_sort(list(DISTINCT user_id))[1:5] AS a FROM search_events WHERE outcome = 'no-data' GROUP BY query), x AS (SELECT query, unnest(a) AS user_id FROM g)
      SELECT query, coalesce(list(name ORDER BY user_id) FILTER (WHERE name IS NOT NULL), []) AS asker_names FROM x LEFT JOIN members USING (user_id) GROUP BY query""",
    "name_search": f"WITH {STOCK} SELECT stock_id, name FROM stock WHERE name ILIKE '%a%' ORDER BY name, stock_id LIMIT 5",
}
