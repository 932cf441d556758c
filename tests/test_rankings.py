"""Order of rankings: swapped, partial, tied and unlisted items."""

import pytest
from pyspark.sql import functions as F

from tracegauge.operators import rankings

SOURCE = "Cases by product:\n- Data Import: 40\n- Alerts: 30\n- Billing: 30\n- Login (SSO): 10\n"


def verdict(spark, *turns, **options):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    r = rankings.ranking_orders(df, **options).orderBy(F.desc("turn")).first()
    return r.n_items, r.n_ranked, r.n_backwards, r.order_kept


@pytest.mark.parametrize(
    "said, want",
    [
        ("1. Data import - 40\n2. Alerts\n3. Billing\n4. Login", (4, 4, 0, True)),
        ("1. Alerts\n2. Data Import", (2, 2, 1, False)),
        ("* **Data Import**: 40\n* Login: 10", (2, 2, 0, True)),  # partial
        ("1) Data Import\n2) Billing\n3) Alerts\n4) Login", (4, 4, 0, True)),  # tied in the source
        ("1. Data Import\n2. Login\n3. Billing\n4. Alerts", (4, 4, 1, False)),
        ("- Billing: 30\n- Unknown thing\n- Data Import: 40", (3, 2, 1, False)),  # unlisted in between
        ("- Data Import\n- Data Import\n- Alerts", (3, 3, 0, True)),  # said twice
        ("- Alerts", (1, 1, 0, None)),
        ("- Something\n- else", (2, 0, 0, None)),
        ("No list at all: Login, then Data Import.", (0, 0, 0, None)),
        ("", (0, 0, 0, None)),
        (None, (0, 0, 0, None)),
    ],
)
def test_orders(spark, said, want):
    assert verdict(spark, ("tool", SOURCE), ("assistant", said)) == want


def test_only_earlier_turns_of_others_are_a_source(spark):
    swapped = "- Alerts\n- Data Import"
    assert verdict(spark, ("assistant", SOURCE), ("assistant", swapped))[3] is None
    assert verdict(spark, ("user", "hello"), ("assistant", swapped), ("tool", SOURCE))[3] is None
    assert verdict(spark, ("user", swapped), ("tool", SOURCE), ("assistant", swapped), evidence_roles=("tool",))[3] is False
    assert verdict(spark, ("user", swapped), ("tool", SOURCE), ("assistant", swapped))[3] is True  # the first list counts


def test_order_over_two_lists(spark):
    """An item of a later list ranks behind all of an earlier one."""
    assert verdict(spark, ("tool", "- One\n- Two"), ("tool", "- Three\n- One"), ("assistant", "- One\n- Two\n- Three")) == (3, 3, 0, True)
    assert verdict(spark, ("tool", "- One\n- Two"), ("tool", "- Three\n- One"), ("assistant", "- Three\n- One")) == (2, 2, 1, False)


def test_items(spark):
    df = spark.createDataFrame([("- **Résumé tool** (v2): 1,200\n 2. Login – 3.5 %\n•  Plain 7\nnot an item\n-\n- : 4",)], "t string")
    got = df.select(rankings.list_items(F.col("t")).alias("i")).first().i
    assert [(x.label, x.number) for x in got] == [("résumé tool", "1200"), ("login", "3.5"), ("plain", "7"), (None, "4")]
