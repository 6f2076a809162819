from datetime import datetime, timedelta

from quotemill.streaming import jobs
from quotemill.streaming.runs import drain_to_parquet, stream_parquet

SCHEMA = "symbol string, timestamp timestamp_ntz, price double"


def test_gaps_over_batches_and_after_a_restart(spark, tmp_path):
    """Each poller's polls come in files; a poll counts as missed only once both have passed its time."""
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    polls = [("BTC" if m % 2 else "ETH", at(m), 1.0) for m in range(120)]
    sides = {
        "first": [p for i, p in enumerate(polls) if i % 7] + [(None, at(3), 1.0), ("BTC", None, 1.0)],
        "second": [p for i, p in enumerate(polls) if i % 11] + [polls[5]] * 3,
    }
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        streams = [stream_parquet(spark, f"{tmp_path}/{name}", schema, 1) for name in sides]
        return [tuple(r) for r in spark.read.parquet(drain_to_parquet(jobs.poller_gaps_stream(*streams), "g", f"{tmp_path}/out")).collect()]

    def expected(first, second):
        a, b = ({p[:2] for p in rows if None not in p} for rows in (first, second))
        passed = min(max(t for _, t in a), max(t for _, t in b)) - timedelta(minutes=15)
        missed = [(s, t, name) for name, own in (("first", a - b), ("second", b - a)) for s, t in own]
        return sorted(x for x in missed if x[1] < passed)

    seen = {name: [] for name in sides}
    for part in range(3):
        for name, rows in sides.items():
            mine = [r for r in rows if (r[1] or at(0)) < at(40 * part + 40) and (r[1] or at(0)) >= at(40 * part)]
            # The second poller is behind in the first round: nothing is missing there yet.
            mine = mine[: len(mine) // 2] if part == 0 and name == "second" else mine
            if part == 1 and name == "second":
                mine = sorted((r for r in rows if r[1] < at(80) and r not in seen[name]), key=lambda r: r[1])
            seen[name] += mine
            spark.createDataFrame(mine, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        found = run()
        assert sorted(found) == expected(seen["first"], seen["second"])
    assert len(found) > 15 and {x[2] for x in found} == {"first", "second"}
