"""Places of all tasks in each order."""

import numpy as np
import pytest

from granary.operators import tasks
from granary.plans.load import QUERIES

KEYS = {
    "manual": lambda t: (t[1], t[2], -t[3], t[0]), "due": lambda t: (t[4] or "9999", t[0]),
    "priority": lambda t: (tasks.PRIORITIES.index(t[5]), t[0]), "created": lambda t: (-t[3], t[0]),
}


@pytest.mark.parametrize("mode", sorted(KEYS))
def test_every_task_has_its_place(spark, mode):
    r = np.random.default_rng(0)
    rows = [(i, bool(r.integers(2)), int(r.integers(5)), int(r.integers(9)), None if i % 5 == 0 else f"2024-01-{r.integers(10, 30)}", tasks.PRIORITIES[r.integers(3)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, completed boolean, position int, created_at int, due_date string, priority string").repartition(7)
    got = {x["id"]: x["place"] for x in tasks.places(df, mode).collect()}
    assert got == {t[0]: n for n, t in enumerate(sorted(rows, key=KEYS[mode]), 1)}
    assert tasks.places(df.where("false"), mode).count() == 0


def test_queries_return_all_tasks(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/orders.parquet").count()
    assert n > 100 and QUERIES["task_order"](spark, d).count() == n and QUERIES["task_sort_modes"](spark, d).count() == 4 * n
