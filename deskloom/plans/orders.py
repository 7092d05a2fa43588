"""The order in which reports are shown. Reports are frames that others build on, so the order is put on last, where rows are handed out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scope import BLIND

NAMES = {"group_name", "user_name", "operator", "account", "category"}  # compared without case and accents

# fixed values: columns of each report's order, a minus for descending ones; what follows them settles ties
ORDERS = {
    "timeseries": "bucket",
    "sla": "bucket",
    "resolution": "bucket",
    "reopens": "bucket",
    "categories": "-requests category",
    "category_timeseries": "bucket -requests category",
    "backlog_tickets": "-opened_at client",
    "tickets_opened": "-opened_at client",
    "tickets_closed": "-opened_at client",
    "tickets_of_client": "-opened_at client",
    "off_hours_messages": "client at",
    "clients": "-tickets -messages client",
    "operators": "-closed -messages operator",
    "groups": "group_name",
    "companies": "group_name",
    "users": "user_name",
    "chat_tickets": "opened_at",
    "help_accounts": "account",
    "help_users": "group_name user_name",
    "help_sla": "group_name",
    "help_resolution": "group_name",
    "help_reopens": "group_name",
    "help_timeseries": "group_name bucket",
    "help_categories": "group_name -requests category",
}
CUTS = ("week", "month", "scoped", "judged")  # a report by another unit, in a scope, or over judged tickets


def order_of(query: str) -> str | None:
    """The order of a query by its name ``q_<report>``, with or without a cut; None if it has none."""
    name = query.removeprefix("q_") if query.startswith("q_") else ""
    for cut in CUTS:
        name = name.removesuffix(f"_{cut}")
    return ORDERS.get(name)


def in_order(rows: DataFrame, order: str | None) -> DataFrame:
    """Rows by the columns named; nulls are least, as in the rows' own order. Names that differ by case or accents alone are settled by their letters."""
    keys: list[Column] = []
    for key in order.split() if order else ():
        c = key.removeprefix("-")
        if c not in rows.columns:
            raise ValueError(f"no column {c} to order by")
        keys += [F.desc(c)] if key != c else [F.collate(c, BLIND), F.col(c)] if c in NAMES else [F.col(c)]
    return rows.orderBy(*keys) if keys else rows
