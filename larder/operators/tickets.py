"""Store-support ticket metrics and notification bodies.

All metrics are keyed aggregates; per-week changes use a window over the
aggregated weekly rows (one per category and week), never over tickets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Notification wording of the escalation and checkpoint functions.
DEFAULT_USER = "agent_supervisor"
ESCALATION_TITLE = "Ticket Escalation"
ESCALATION_LABELS = ("User: ", "User Message: ", "Agent Summary: ")
CHECKPOINT_TITLE_PREFIX = "Checkpoint - "

SLA_HOURS = 24  # not defined by the source material: our parameter


def resolution_hours(created: str = "created_time", closed: str = "close_time") -> Column:
    return F.timestamp_diff("SECOND", F.col(created), F.col(closed)) / F.lit(3.6e3)


def csat_wait_corr(t: DataFrame) -> DataFrame:
    """Pearson correlation of CSAT and hold time."""
    both = t.filter(F.col("csat_score").isNotNull() & F.col("hold_time_seconds").isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"),
                    F.corr(F.col("csat_score"), F.col("hold_time_seconds").cast("double")).alias("corr"))


def ticket_categories(t: DataFrame) -> DataFrame:
    """Tickets per category and share of all."""
    per = t.groupBy("issue_category").agg(F.count(F.lit(1)).alias("n_tickets"))
    return per.withColumn("share", F.col("n_tickets") / F.sum("n_tickets").over(Window.partitionBy()))


def ticket_sla(t: DataFrame, sla_hours: float = SLA_HOURS) -> DataFrame:
    """Per category: tickets, open tickets, mean hours to resolve, SLA share.

    The SLA share is over closed tickets: resolved within ``sla_hours``.
    """
    h = resolution_hours()
    closed = F.col("close_time").isNotNull()
    return t.groupBy("issue_category").agg(
        F.count(F.lit(1)).alias("n_tickets"),
        F.count_if(F.col("status") == "open").alias("n_open"),
        F.avg(F.when(closed, h)).alias("avg_resolution_hours"),
        F.try_divide(F.count_if(closed & (h <= F.lit(float(sla_hours)))).cast("double"),
                     F.count_if(closed).cast("double")).alias("sla_share"))


def ticket_wow(t: DataFrame) -> DataFrame:
    """Weekly tickets per category with week-over-week change.

    Weeks start on Monday.  The change compares with the calendar week before;
    where the category has no tickets in it, there is nothing to compare with.
    """
    wk = F.date_trunc("week", F.col("created_time")).cast("date")
    weekly = t.groupBy("issue_category", wk.alias("week_start")).agg(
        F.count(F.lit(1)).alias("n_tickets"),
        F.avg(resolution_hours()).alias("avg_resolution_hours"))
    w = Window.partitionBy("issue_category").orderBy("week_start")
    adjacent = F.lag("week_start").over(w) == F.date_sub("week_start", 7)
    prev = F.when(adjacent, F.lag("n_tickets").over(w))
    return weekly.select("issue_category", "week_start", "n_tickets", "avg_resolution_hours",
                         prev.alias("prev_n_tickets"),
                         F.try_divide((F.col("n_tickets") - prev).cast("double"), prev.cast("double"))
                         .alias("wow_change"))


def similar_cases(t: DataFrame, keys=("issue_category", "status")) -> DataFrame:
    """Similar cases: every ticket cited, beside the size of its group.

    One row per ticket, so a group of any size is never collected; the counts
    are a few rows that the runtime joins without moving the tickets.
    """
    keys = list(keys)
    counts = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cases"))
    return t.select(*keys, "ticket_id").join(counts, keys, "inner").select(*keys, "n_cases", "ticket_id")


def escalation_body(summary: Column, message: Column, user: Column) -> Column:
    """Three-line escalation body; empty or missing user -> default."""
    u = F.coalesce(F.nullif(user, F.lit("")), F.lit(DEFAULT_USER))
    a, b, c = ESCALATION_LABELS
    return F.concat(F.lit(a), u, F.lit("\n" + b), F.coalesce(message, F.lit("")),
                    F.lit("\n" + c), F.coalesce(summary, F.lit("")))


def checkpoint_title(name: Column) -> Column:
    return F.concat(F.lit(CHECKPOINT_TITLE_PREFIX), name)


def checkpoint_body(user: Column, message: Column) -> Column:
    """'User: u', plus the message on a second line when it is not blank."""
    head = F.concat(F.lit(ESCALATION_LABELS[0]), user)
    return F.when(F.coalesce(F.trim(message), F.lit("")) != "",
                  F.concat(head, F.lit("\n"), message)).otherwise(head)


def checkpoint_log(rows: DataFrame) -> DataFrame:
    """Run-log rows of reached checkpoints (U2): title and body of the note, and the result line."""
    return rows.select("checkpoint_id", checkpoint_title(F.col("name")).alias("title"),
                       checkpoint_body(F.col("user_id"), F.col("message")).alias("body"),
                       F.concat(F.lit("Checkpoint: "), F.col("name")).alias("result"))


def escalation_outbox(t: DataFrame) -> DataFrame:
    """Outbox rows for escalated tickets: delivery is a separate job.

    Nothing is sent from here; a sender reads the outbox table.
    """
    esc = t.filter(F.col("escalated"))
    user = F.when(F.col("unit_id") % 10 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("unit-"), F.col("unit_id")))
    msg = F.concat(F.lit("Ticket "), F.col("ticket_id"), F.lit(" needs attention"))
    summary = F.concat(F.col("issue_category"), F.lit(" issue, hold "), F.col("hold_time_seconds"),
                       F.lit("s, status "), F.col("status"))
    return esc.select("ticket_id", F.lit(ESCALATION_TITLE).alias("title"),
                      escalation_body(summary, msg, user).alias("body"))
