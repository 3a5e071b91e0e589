"""Status kept by batches equals the recomputed one."""

import datetime as dt
import random

import pytest

from millrate.operators import state
from millrate.operators.status import parcel_events
from millrate.schemas import JOURNAL
from millrate.session import scratch_path
from millrate.sources.bucketed import table_name
from test_status_events import _rows


def _frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in JOURNAL.names) for r in rows], JOURNAL)


def _dated(seed):
    rnd = random.Random(seed)
    return [dict(r, date_received=dt.date(2025, rnd.randrange(1, 7), rnd.randrange(1, 28))) for r in _rows(seed)]


def _by_parcel(events):
    return {r["parcel_id"]: tuple(r) for r in events.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_batches_and_reopened_months(spark, seed):
    rnd, path = random.Random(seed), scratch_path(spark, "state")
    rows, journal, n = _dated(seed), {}, 0
    for start in range(0, len(rows), 100):
        batch, months = rows[start:start + 100], []
        if start and rnd.random() < 0.8:  # a reopened month: its amounts change, some rows go
            months = [dt.date(2025, rnd.randrange(1, 7), 1)]
            again = [r for r in journal.values() if r["date_received"].replace(day=1) in months]
            for r in again:
                journal.pop(r["transaction_id"])
            batch = batch + [dict(r, amount_paid=None if r["amount_paid"] is None else r["amount_paid"] + 1)
                             for r in again if rnd.random() < 0.8]
        journal.update({r["transaction_id"]: r for r in batch})
        n += 1
        assert state.apply_batch(spark, path, _frame(spark, batch), n, months)
        if rnd.random() < 0.3:
            n += 1
            assert state.compact(spark, path, n)
        want = _by_parcel(parcel_events(_frame(spark, list(journal.values()))))
        assert _by_parcel(state.state_events(spark, path)) == want
    assert state.compact(spark, path, n + 1)
    state.remove_replaced(spark, path)
    assert _by_parcel(state.state_events(spark, path)) == want


def test_a_batch_reads_and_writes_its_own_rows_only(spark):
    path, rows = scratch_path(spark, "state"), _dated(5)
    state.apply_batch(spark, path, _frame(spark, rows[:390]), 1)
    state.apply_batch(spark, path, _frame(spark, rows[390:]), 2)
    live = state.live_groups(spark, path)
    assert 0 < live.filter("batch = 2").count() <= len(rows) - 390


def test_unpublished_batches_do_not_count_and_retries_do_once(spark, monkeypatch):
    path, rows = scratch_path(spark, "state"), _dated(4)
    state.apply_batch(spark, path, _frame(spark, rows[:100]), 1)
    before = _by_parcel(state.state_events(spark, path))
    with monkeypatch.context() as m:
        m.setattr(state, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.apply_batch(spark, path, _frame(spark, rows[100:]), 2)
    assert _by_parcel(state.state_events(spark, path)) == before
    assert state.apply_batch(spark, path, _frame(spark, rows[100:]), 2)
    assert not state.apply_batch(spark, path, _frame(spark, rows[100:]), 2)
    assert _by_parcel(state.state_events(spark, path)) == _by_parcel(parcel_events(_frame(spark, rows)))
    with pytest.raises(ValueError):
        state.apply_batch(spark, path, _frame(spark, rows[:1]), 0)


def test_replaced_months_are_pruned_by_folder(spark):
    path, rows = scratch_path(spark, "state"), _dated(6)
    state.apply_batch(spark, path, _frame(spark, rows), 1)
    state.apply_batch(spark, path, _frame(spark, []), 2, [dt.date(2025, 3, 15)])
    live = state.live_groups(spark, path)
    assert "PartitionFilters: [" in live._jdf.queryExecution().executedPlan().toString()
    assert live.filter("receipt_month = DATE '2025-03-01'").isEmpty() and not live.isEmpty()


def test_no_batches(spark):
    assert state.state_events(spark, scratch_path(spark, "state")).isEmpty()


def test_a_state_in_buckets_gives_the_same(spark):
    """Rows that are dealt otherwise, no rows, reopened months, a compaction, another catalog."""
    plain, dealt, rows = scratch_path(spark, "state"), scratch_path(spark, "state"), _dated(7)
    again = [dict(r, amount_paid=None) for r in rows if r["date_received"].month == 2]
    for path, buckets in ((plain, None), (dealt, 5)):
        for n, batch, months in ((1, rows[::2], []), (2, rows[1::2], []), (3, [], []),
                                 (4, again, [dt.date(2025, 2, 1)]), (5, [], [dt.date(2025, 3, 1)])):
            assert state.apply_batch(spark, path, _frame(spark, batch), n, months, buckets=buckets)
    want = _by_parcel(state.state_events(spark, plain))
    assert _by_parcel(state.state_events(spark, dealt)) == want
    assert state.compact(spark, dealt, 6)
    state.remove_replaced(spark, dealt)
    assert _by_parcel(state.state_events(spark, dealt)) == want
    spark.sql(f"DROP TABLE {table_name(dealt)}")
    assert _by_parcel(state.state_events(spark, dealt)) == want


def test_an_unpublished_try_in_buckets_is_written_over(spark, monkeypatch):
    path, rows = scratch_path(spark, "state"), _dated(8)
    with monkeypatch.context() as m:
        m.setattr(state, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.apply_batch(spark, path, _frame(spark, rows), 1, buckets=3)
    assert state.apply_batch(spark, path, _frame(spark, rows[:50]), 1, buckets=3)
    assert _by_parcel(state.state_events(spark, path)) == _by_parcel(parcel_events(_frame(spark, rows[:50])))


def test_the_ledgers_state_is_read_without_a_shuffle(ledger):
    import __spark_entry__ as e
    status = e.q_status_from_batches(ledger)
    assert "Exchange hashpartitioning" not in status._jdf.queryExecution().executedPlan().toString()
    files = [f.rsplit("/", 1)[1] for f in state.live_groups(ledger.spark, e._status_state(ledger)).inputFiles()]
    assert files and len({f.split("_")[-1].split(".")[0] for f in files}) <= ledger.buckets
