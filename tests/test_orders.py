import os
import unicodedata

import pytest

from deskloom.plans import catalog, more
from deskloom.plans.orders import NAMES, ORDERS, in_order, order_of

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries() | more.queries()


def folded(name):
    return "".join(c for c in unicodedata.normalize("NFD", name.lower()) if not unicodedata.combining(c))


def sorted_by_hand(rows, order):
    """Stable sorts from the last key to the first; nulls are least."""
    for key in reversed(order.split()):
        c = key.removeprefix("-")
        value = (lambda r: (r[c] is not None, r[c] and folded(r[c]))) if c in NAMES else (lambda r: (r[c] is not None, r[c]))
        rows = sorted(rows, key=value, reverse=key != c)
    return rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if order_of(n)])
def test_reports_come_in_order(spark, name):
    rows, order = QUERIES[name](spark, SF).collect(), order_of(name)
    columns = [k.removeprefix("-") for k in order.split()]
    shown = lambda found: [tuple(r[c] for c in columns) for r in found]
    assert shown(rows) == shown(sorted_by_hand(rows, order))


def test_every_order_has_a_report():
    assert {f"q_{name}" for name in ORDERS} <= set(QUERIES)
    assert order_of("q_sla_month") == "bucket" and order_of("q_clients_judged") == ORDERS["clients"]
    assert order_of("q_summary") is None and order_of("ticket") is None and order_of("sla") is None


def test_names_without_case_and_accents_nulls_least(spark):
    rows = spark.createDataFrame([("b", 1), ("Á", 2), (None, 3), ("a", 4), ("B", 5)], "group_name string, requests int")
    got = [r.group_name for r in in_order(rows, "group_name").collect()]
    assert got[0] is None and [folded(x) for x in got[1:]] == ["a", "a", "b", "b"]
    assert [r.requests for r in in_order(rows, "-requests").collect()] == [5, 4, 3, 2, 1]
    assert in_order(rows, None) is rows and in_order(rows.limit(0), "group_name").count() == 0
    with pytest.raises(ValueError):
        in_order(rows, "nothing")
