import itertools
import random

from pyspark.sql import functions as F

from starloom.operators import cdc
from tests.conftest import rows

SCHEMA = "tenant string, id string, v long, op string, seq long, arrival long"
LOG = [
    ("A", "1", 10, "UPSERT", 1, 1), ("A", "1", 20, "UPSERT", 2, 2), ("A", "1", 10, "UPSERT", 1, 9),
    ("A", "2", 30, "UPSERT", 1, 3), ("A", "2", 30, "DELETE", 2, 4), ("A", "2", 35, "UPSERT", 1, 8),
    ("B", "1", 40, "UPSERT", 5, 5),
]
KEYS, ORDER = ["tenant", "id"], ["seq", "arrival"]
WANT = [("A", "1", 20), ("B", "1", 40)]


def state(df):
    return rows(cdc.current_state(df, KEYS, ORDER, F.col("op") == "DELETE").select("tenant", "id", "v"))


def test_tombstone_beats_late_older_row(spark):
    assert state(spark.createDataFrame(LOG, SCHEMA)) == WANT


def test_any_arrival_order_and_batching_gives_the_same_state(spark):
    rng = random.Random(7)
    for _ in range(3):
        shuffled = LOG[:]
        rng.shuffle(shuffled)
        cut = rng.randrange(1, len(LOG))
        first, second = (spark.createDataFrame(part, SCHEMA) for part in (shuffled[:cut], shuffled[cut:]))
        applied = cdc.apply_batch(cdc.latest_version(first, KEYS, ORDER), second, KEYS, ORDER)
        assert rows(applied.where("op <> 'DELETE'").select("tenant", "id", "v")) == WANT


def test_replay_changes_nothing(spark):
    assert state(spark.createDataFrame(LOG * 3, SCHEMA)) == WANT


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame(LOG, SCHEMA)
    plan = cdc.latest_version(df, KEYS, ORDER)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning", 1)
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below


def test_large_integers_stay_exact(spark):
    big = 2**62 + 1
    df = spark.createDataFrame([("A", "1", big, "UPSERT", 1, 1)], SCHEMA)
    assert cdc.latest_version(df, KEYS, ORDER).first().v == big


def test_conflicts_and_replays(spark):
    log = spark.createDataFrame([("A", "1", 1, 1, 1), ("A", "1", 1, 1, 2), ("A", "2", 5, 1, 3), ("A", "2", 6, 1, 4)], "t string, id string, v long, seq long, arrival long")
    assert rows(cdc.version_conflicts(log, ["t", "id"], "seq", ["v"])) == [("A", "2", 1, 2)]
    assert rows(cdc.replay_count(log, ["t", "id", "seq", "v"])) == [(4, 1)]


def test_history_intervals(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', DATE '2024-01-05', 'x'), ('a', DATE '2024-03-01', 'y'), ('a', DATE '2024-03-09', 'z'), ('b', DATE '2024-02-02', 'q') t(k, at, s)")
    got = {(r.k, r.s): r.valid_to and r.valid_to.isoformat() for r in cdc.history_from_versions(df, ["k"], "at").collect()}
    assert got == {("a", "x"): "2024-03-01", ("a", "y"): "2024-03-09", ("a", "z"): None, ("b", "q"): None}


def test_counterfactual_leaves_other_rows(spark):
    base = spark.createDataFrame([(1, 10), (2, 20)], "id long, v long")
    out = cdc.apply_counterfactual(base, ["id"], replace=spark.createDataFrame([(2, 99)], "id long, v long"), append=spark.createDataFrame([(3, 1)], "id long, v long"))
    assert rows(out) == [(1, 10), (2, 99), (3, 1)]
