import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.operators.delivery import Conflict, DeliveryLedger, admit_deliveries, instant
from tidewell.session import shared_folder

SCHEMA = "delivery_id long, post_id string, crawled_at string, admitted string"


@pytest.fixture
def ledger(spark):
    return DeliveryLedger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")


def admitted(df):
    return {r.delivery_id: r.admitted for r in df.collect()}


def test_first_instant_wins_whatever_its_offset(spark, ledger):
    rows = [(1, "a", "2026-01-05T10:00:00+07:00", "x"), (2, "a", "2026-01-05T02:59:59Z", "x"), (3, "a", None, "x"), (4, "b", "N/A", "x"), (5, "b", "", "x"), (6, " b", "unknown", "x")]
    got = admitted(admit_deliveries(spark.createDataFrame(rows, SCHEMA), ledger))
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_null_and_blank_keys_are_kept_without_identity(spark, ledger):
    rows = [(1, None, None, None), (2, "", None, None), (3, " \t ", None, None), (4, "k", None, None)]
    assert admitted(admit_deliveries(spark.createDataFrame(rows, SCHEMA), ledger)) == {1: None, 2: None, 3: None, 4: True}


def test_later_batches_admit_only_unseen_keys(spark, ledger):
    first = [(i, f"p{i % 50}", None, None) for i in range(100)]
    assert sum(v for v in admitted(admit_deliveries(spark.createDataFrame(first, SCHEMA), ledger)).values()) == 50
    second = [(200 + i, f"p{i}", None, None) for i in range(30, 70)]
    got = admitted(admit_deliveries(spark.createDataFrame(second, SCHEMA), ledger))
    assert {k - 200 for k, v in got.items() if v} == set(range(50, 70))
    assert ledger.dictionary().count() == 70
    assert ledger.seen().select(F.sum(F.expr("bitmap_count(bits)"))).first()[0] == 70
    assert sorted(r.code for r in ledger.dictionary().collect()) == list(range(70))
    third = [(300 + i, f"p{i}", None, None) for i in (3, 69, 70, 71, 70)]
    got = admitted(admit_deliveries(spark.createDataFrame(third, SCHEMA), ledger))
    assert sum(got.values()) == 2 and not got[303] and not got[369]


def test_a_batch_that_comes_again_gives_the_same(spark, ledger):
    rows = spark.createDataFrame([(i, f"p{i % 5}", None, None) for i in range(10)], SCHEMA)
    once = admitted(admit_deliveries(rows, ledger, "b1"))
    version = ledger.state()["version"]
    assert admitted(admit_deliveries(rows, ledger, "b1")) == once and sum(once.values()) == 5
    assert ledger.state()["version"] == version
    assert sum(admitted(admit_deliveries(rows, ledger, "b2")).values()) == 0


def test_identifiers_of_a_lost_job_are_still_admitted(spark, ledger):
    """Its dictionary was published, its bits were not: the bitmaps decide."""
    ledger._encoded(spark.createDataFrame([("a", 1), ("b", 1)], "key string, first int"))
    rows = [(1, "a", None, None), (2, "b", None, None), (3, "c", None, None), (4, "a", None, None)]
    assert admitted(admit_deliveries(spark.createDataFrame(rows, SCHEMA), ledger)) == {1: True, 2: True, 3: True, 4: False}
    assert ledger.dictionary().count() == 3


def test_of_two_writers_none_is_lost(spark, ledger):
    stale = ledger.state()
    other = DeliveryLedger(spark, ledger.folder)
    rows = [(1, "a", None, None), (2, "b", None, None)]
    assert admitted(admit_deliveries(spark.createDataFrame(rows, SCHEMA), other)) == {1: True, 2: True}
    with pytest.raises(Conflict):
        ledger._publish(stale | {"next": 99})
    current, calls = ledger.state, []
    ledger.state = lambda: stale if not calls.append(1) and len(calls) == 1 else current()  # the first read came before the other's commit
    got = admitted(admit_deliveries(spark.createDataFrame([(3, "b", None, None), (4, "c", None, None)], SCHEMA), ledger))
    assert got == {3: False, 4: True} and len(calls) > 2
    assert sorted(r.code for r in ledger.dictionary().collect()) == [0, 1, 2]


def test_equal_rows_keep_one(spark, ledger):
    rows = spark.createDataFrame([(1, "a", None, None)] * 3, SCHEMA)
    got = ledger.admit(rows, "post_id", instant("crawled_at"), F.col("delivery_id"), tie_is_unique=False)
    assert sorted(r.admitted for r in got.collect()) == [False, False, True]


def test_empty_batch_changes_nothing(spark, ledger):
    assert admitted(admit_deliveries(spark.createDataFrame([], SCHEMA), ledger)) == {}
    assert ledger.seen().isEmpty()
