from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

from conftest import d, ts

from depotcast.contracts import RESTRICTION, UNIT_HISTORY
from depotcast.operators.restrictions import active_restrictions


def run(spark, history, restrictions, statuses=(1,)):
    got = active_restrictions(
        spark.createDataFrame(history, UNIT_HISTORY),
        spark.createDataFrame(restrictions, RESTRICTION),
        statuses,
    )
    return {(r.month_end, r.branch, r.description): r.restrictions for r in got.collect()}


def brute_force(history, restrictions, statuses=(1,)):
    counts = Counter()
    for moment, branch, unit, status in history:
        if moment.day != 1 or status not in statuses:
            continue
        day = moment.date()
        active = [
            text for u, start, end, text in restrictions
            if u == unit and start.date() <= day and (end is None or day < end.date())
        ]
        for text in active or [None]:
            counts[day - timedelta(days=1), branch, text] += 1
    return dict(counts)


def test_interval_bounds(spark):
    opening = ts("2024-03-01 08:00")
    history = [(opening, "b", unit, 1) for unit in range(1, 8)] + [(opening, "b", 8, 2)]
    restrictions = [
        (1, ts("2024-01-10"), None, "open"),
        (2, ts("2024-01-10"), ts("2024-02-20"), "closed before"),
        (3, ts("2024-01-10"), ts("2024-03-01 23:00"), "ends that day"),
        (4, ts("2024-03-01 23:00"), None, "starts that day"),
        (5, ts("2024-03-02"), None, "starts after"),
        (6, ts("2024-02-01"), ts("2024-03-02"), "ends the day after"),
        (8, ts("2024-01-10"), None, "other status"),
    ]
    month = d("2024-02-29")
    expected = {
        (month, "b", "open"): 1, (month, "b", "starts that day"): 1,
        (month, "b", "ends the day after"): 1, (month, "b", None): 4,
    }
    assert run(spark, history, restrictions) == expected == brute_force(history, restrictions)


def test_agrees_with_pairing_everything(spark):
    rng = random.Random(7)

    def moment():
        return datetime(2023, 1, 1) + timedelta(hours=rng.randrange(24 * 500))

    history = []
    for unit in range(12):
        for month in range(16):
            opening = datetime(2023 + month // 12, month % 12 + 1, 1, rng.randrange(24))
            branch = rng.choice(["a", "b", None])
            history += [(opening, branch, unit, rng.choice([1, 2]))] * rng.choice([1, 1, 2])
            history.append((opening + timedelta(days=5), branch, unit, 1))
    restrictions = [
        # unit 0 holds most restrictions; some end before they start
        (0 if rng.random() < 0.5 else rng.randrange(14), moment(),
         None if rng.random() < 0.3 else moment(), rng.choice(["x", "y", None]))
        for _ in range(400)
    ]
    # a restriction without a description and no restriction at all share the NULL label
    assert run(spark, history, restrictions, (1, 2)) == brute_force(history, restrictions, (1, 2))


def test_months_in_force_are_not_broadcast(spark):
    one = spark.range(1)  # of known, small size
    history = one.selectExpr("timestamp_ntz'2024-03-01 08:00' AS snapshot_ts", "'b' AS branch", "id AS unit_id", "1 AS status_id")
    restrictions = one.selectExpr(
        "id AS unit_id", "timestamp_ntz'2000-01-10' AS valid_from", "CAST(NULL AS timestamp_ntz) AS valid_to", "'open' AS description"
    )
    got = active_restrictions(history, restrictions, (1,))
    # a few restrictions without an end are very many months: their size tells nothing
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert [tuple(r) for r in got.collect()] == [(d("2024-02-29"), "b", "open", 1)]
