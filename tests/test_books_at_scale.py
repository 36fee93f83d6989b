"""Work of the queries of queues, checkpoints and gappy channels that must not pile up in few tasks or repeat."""

from tapeloom.operators import queues
from tapeloom.plans import depth, wires


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_queues_take_one_walk(spark, small):
    plan = optimized(depth.order_queue_position(spark, small))
    assert plan.count("MapInArrow") == 1 and "Generate explode(sequence" not in plan and "Aggregate" not in plan


def test_a_queue_stays_small():
    queue = queues.LevelQueue()
    for age in range(50_000):
        queue.enter(age, 3)
        if age >= 5:
            assert queue.ahead(age) == (5, 15)
            queue.reduce(age - 5, 3, True)
    assert len(queue.orders) < 200 and list(queue.left) == list(range(49_995, 50_000))


def test_checkpoints_read_a_stored_tape(spark, small):
    assert "get_json_object" not in optimized(depth.reconcile_checkpoints(spark, small))


def test_frames_are_numbered_by_ranges(spark, small):
    windows = [line for line in optimized(wires._gappy_frames(spark, small)).splitlines() if "row_number" in line or "Window " in line]
    assert windows and not any("row_number" in line for line in windows)
