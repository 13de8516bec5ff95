"""Support-ticket queries."""

from __future__ import annotations

from larder.operators import tickets as tk
from larder.plans.oracle_fixtures import with_ctes
from larder.plans.registry import register
from larder.sources import fixtures as fx

_HOURS = "(epoch(close_time) - epoch(created_time)) / 3.6e3"


@register("csat_wait_corr", with_ctes("tickets") + """
SELECT count(*) AS n, round(corr(csat_score, cast(hold_time_seconds AS DOUBLE)), 4) AS corr
FROM tickets WHERE csat_score IS NOT NULL AND hold_time_seconds IS NOT NULL""")
def q_csat_wait_corr(spark, sf):
    """CSAT vs wait correlation."""
    return tk.csat_wait_corr(fx.tickets(spark, sf))


@register("ticket_categories", with_ctes("tickets") + """
SELECT issue_category, count(*) AS n_tickets, round(count(*) / sum(count(*)) OVER (), 4) AS share
FROM tickets GROUP BY issue_category""")
def q_ticket_categories(spark, sf):
    """Category distribution."""
    return tk.ticket_categories(fx.tickets(spark, sf))


@register("ticket_sla", with_ctes("tickets") + f"""
SELECT issue_category, count(*) AS n_tickets, count(*) FILTER (WHERE status = 'open') AS n_open,
       round(avg(CASE WHEN close_time IS NOT NULL THEN {_HOURS} END), 4) AS avg_resolution_hours,
       round(cast(count(*) FILTER (WHERE close_time IS NOT NULL AND {_HOURS} <= {float(tk.SLA_HOURS)})
                  AS DOUBLE) / NULLIF(count(*) FILTER (WHERE close_time IS NOT NULL), 0), 4) AS sla_share
FROM tickets GROUP BY issue_category""")
def q_ticket_sla(spark, sf):
    """Open tickets, time to resolve, SLA share."""
    return tk.ticket_sla(fx.tickets(spark, sf))


@register("ticket_wow", with_ctes("tickets") + f"""
, weekly AS (SELECT issue_category, cast(date_trunc('week', created_time) AS DATE) AS week_start,
                    count(*) AS n_tickets, avg({_HOURS}) AS avg_resolution_hours
             FROM tickets GROUP BY 1, 2)
SELECT issue_category, week_start, w.n_tickets, round(avg_resolution_hours, 4) AS avg_resolution_hours,
       p.n_tickets AS prev_n_tickets,
       round(cast(w.n_tickets - p.n_tickets AS DOUBLE) / NULLIF(p.n_tickets, 0), 4) AS wow_change
FROM weekly w LEFT JOIN (SELECT issue_category AS c, week_start AS s, n_tickets FROM weekly) p
  ON p.c = w.issue_category AND p.s = w.week_start - 7""")
def q_ticket_wow(spark, sf):
    """Week-over-week ticket change per category."""
    return tk.ticket_wow(fx.tickets(spark, sf))


@register("similar_cases", with_ctes("tickets") + """
SELECT issue_category, status, count(*) OVER (PARTITION BY issue_category, status) AS n_cases, ticket_id
FROM tickets""")
def q_similar_cases(spark, sf):
    """Grouped similar cases, all of their ticket ids cited."""
    return tk.similar_cases(fx.tickets(spark, sf))


@register("checkpoint_log", """
SELECT event_id AS checkpoint_id, concat('Checkpoint - Part ', event_id % 9) AS title,
       concat('User: user-', user_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE chr(10) || props END) AS body,
       concat('Checkpoint: Part ', event_id % 9) AS result
FROM events WHERE event_type = 'signup'""")
def q_checkpoint_log(spark, sf):
    """Run-log rows of reached checkpoints (no network call)."""
    return tk.checkpoint_log(fx.checkpoints(spark, sf))


@register("escalation_messages", with_ctes("tickets") + """
SELECT ticket_id, 'Ticket Escalation' AS title,
       concat('User: ', coalesce(nullif(CASE WHEN unit_id % 10 = 0 THEN NULL ELSE concat('unit-', unit_id) END, ''),
                                 'agent_supervisor'),
              chr(10) || 'User Message: ', concat('Ticket ', ticket_id, ' needs attention'),
              chr(10) || 'Agent Summary: ',
              concat(issue_category, ' issue, hold ', hold_time_seconds, 's, status ', status)) AS body
FROM tickets WHERE escalated""")
def q_escalation_messages(spark, sf):
    """H4 + U1: escalation outbox rows (no network call)."""
    return tk.escalation_outbox(fx.tickets(spark, sf))
