"""Conversations and documents as users see them: unread counts, inbox, people, escalations, libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unread(messages: DataFrame, reads: DataFrame) -> DataFrame:
    """(conv_id, n): assistant messages after the last read time; all where a conversation was never read."""
    r = reads.groupBy("conv_id").agg(F.max("read_at").alias("_at"))
    return messages.where("role = 'assistant'").join(r, "conv_id", "left").where(F.col("_at").isNull() | (F.col("created_at") > F.col("_at"))).groupBy("conv_id").agg(F.count("*").alias("n"))


def visible(conversations: DataFrame, hidden: list[DataFrame]) -> DataFrame:
    """Conversations that are on none of the lists."""
    for h in hidden:
        conversations = conversations.join(h.select("conv_id").distinct(), "conv_id", "left_anti")
    return conversations


def inbox(docs: DataFrame, most: int = 200) -> DataFrame:
    """Failed documents, and ready ones without a type or with a proposal; the newest first. A proposal of JSON null is none."""
    proposed = F.col("proposal").isNotNull() & (F.trim("proposal") != "null")
    return docs.where((F.col("status") == "failed") | ((F.col("status") == "ready") & (F.col("kind").isNull() | proposed))).orderBy(F.desc("created_at"), F.desc("doc_id")).limit(most)


def person(people: DataFrame, text: str) -> DataFrame:
    """(user_id, name, snippet) of people one of whose role words is in the text, or whose name holds it."""
    words = [w for w in text.lower().split() if w]
    roles = F.exists(F.split(F.lower("role"), r"[^a-z0-9]+"), lambda t: t.isin(words))
    at = F.instr(F.lower("name"), text.lower())
    return people.where(roles | (at > 0)).select("user_id", "name", F.substr(F.col("name"), F.greatest(at - 10, F.lit(1)), F.lit(40)).alias("snippet"))


def escalation(calls: Column, own: Column) -> Column:
    """The target of the first successful escalating call that isn't the user; calls: array of (tool, ok, target)."""
    hits = F.filter(calls, lambda c: (c["tool"] == "escalate") & c["ok"] & (c["target"] != own))
    return F.get(F.transform(hits, lambda c: c["target"]), F.lit(0))


def recent_escalations(found: DataFrame, staff: DataFrame, members: DataFrame, most: int = 20) -> DataFrame:
    """The newest escalations with who escalated and, if still a member, to whom."""
    s = staff.select(F.col("user_id").alias("from_id"), F.col("name").alias("from_name"))
    m = members.select(F.col("user_id").alias("to_id"), F.col("name").alias("to_name"))
    return found.join(s, "from_id", "left").join(m, "to_id", "left").orderBy(F.desc("created_at"), F.desc("from_id")).limit(most)


def thread(notes: DataFrame, replies: DataFrame, most: int = 100) -> DataFrame:
    """Notes and replies in one order of time."""
    return notes.withColumn("source", F.lit("note")).unionByName(replies.withColumn("source", F.lit("reply"))).orderBy("created_at", "source").limit(most)


def library(docs: DataFrame, *, text: str | None = None, source: str | None = None, lang: str | None = None) -> DataFrame:
    """Documents by text, source and language; "none" asks for those without one."""
    out = docs
    if text:
        out = out.where(F.lower("text").contains(text.lower()) | F.lower("source").contains(text.lower()))
    for column, value in (("source", source), ("lang", lang)):
        if value:
            out = out.where(F.col(column).isNull() if value == "none" else F.col(column) == value)
    return out


def metadata_filter(rows: DataFrame, column: str, path: str, *, holds: str | None = None, contains: str | None = None) -> DataFrame:
    """Rows whose JSON has, under a path, an array that holds a string or a string that contains one."""
    out = rows
    if holds is not None:
        out = out.where(F.array_contains(F.from_json(F.get_json_object(column, path), "array<string>"), holds))
    if contains is not None:
        out = out.where(F.get_json_object(column, path).contains(contains))
    return out


def first_of_kind(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first by an order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
