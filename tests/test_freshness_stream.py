import random
from datetime import datetime, timedelta

from quotemill.streaming import freshness
from quotemill.streaming.runs import drain_to_parquet, stream_parquet

SCHEMA = "table_name string, timestamp timestamp_ntz"
START = datetime(2024, 1, 1)


def gaps_of(rows, minutes, delay_minutes=15):
    """(table, last time) of the silences that end before the watermark."""
    times = [t for n, t in rows if n is not None and t is not None]
    watermark = max(times) - timedelta(minutes=delay_minutes)
    limit, out = timedelta(minutes=minutes), set()
    for name in {n for n, t in rows if n is not None and t is not None}:
        mine = sorted(t for n, t in rows if n == name and t is not None)
        for a, b in zip(mine, [*mine[1:], datetime.max]):
            if b - a > limit and a + limit < watermark:
                out.add((name, a, a + limit))
    return out


def test_stepping_stones_keep_all_gaps():
    rng = random.Random(1)
    for _ in range(300):
        times = [rng.randrange(200) for _ in range(rng.randrange(30))]
        kept = freshness.stepping_stones(times, 10)
        late = [rng.randrange(200) for _ in range(rng.randrange(4))]
        gaps = lambda ts: [(a, b) for a, b in zip(sorted(set(ts)), sorted(set(ts))[1:]) if b - a > 10]
        assert gaps(kept + late) == gaps(times + late)
        assert len(kept) <= 2 * (max(times, default=0) - min(times, default=0)) / 10 + 3


def test_settle():
    assert freshness.settle(None, [5, 40], 30, 10) == ([5], None, [40])
    assert freshness.settle(5, [12, 40], 15, 10) == ([], 12, [40])
    assert freshness.settle(5, [40], 15, 10) == ([], 5, [40])
    assert freshness.settle(5, [40], 16, 10) == ([5], None, [40])
    assert freshness.settle(5, [20, 50], 25, 10) == ([5], 20, [50])
    assert freshness.settle(None, [], 25, 10) == ([], None, [])


def test_alerts_over_batches_and_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for name in ("prices", "news", "weather"):
        at = START
        for _ in range(60):
            at += timedelta(minutes=rng.choice([1, 3, 9, 16, 40]), microseconds=rng.randrange(10**6))
            rows.append((name, at))
    rows += [("gone", START + timedelta(minutes=3)), (None, START), ("gone", None)] + rows[:5]
    rows.sort(key=lambda r: (r[1] is None, r[1]))
    # Neighbouring rows change places, as far as the watermark allows.
    for i in range(0, len(rows) - 4, 3):
        if rows[i + 1][1] and rows[i + 1][1] - rows[i][1] < timedelta(minutes=10):
            rows[i], rows[i + 1] = rows[i + 1], rows[i]
    source, root = tmp_path / "in", f"{tmp_path}/out"

    def run():
        stream = stream_parquet(spark, str(source), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        with freshness.rocks_state(spark):
            return {tuple(r) for r in spark.read.parquet(drain_to_parquet(freshness.freshness_stream(stream), "f", root)).collect()}

    sent = set()
    parts = [rows[i : i + 45] for i in range(0, len(rows), 45)]
    for number, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        sent = run()  # each time a new query goes on from the checkpoint
        assert sent == gaps_of([r for p in parts[: number + 1] for r in p], 15)
    assert ("gone", START + timedelta(minutes=3), START + timedelta(minutes=18)) in sent and len(sent) > 10
