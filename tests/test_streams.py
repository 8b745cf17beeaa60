"""The state machine on event time, and tables that a repeated batch does not change."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from tallyweave.operators.workflow import ENDS, HAPPY_PATH, judged
from tallyweave.sources.paths import work_path
from tallyweave.streaming import latest, machine

SCHEMA = "workflow_id long, ts timestamp, event_id long, state string"
START = datetime(2027, 1, 1, tzinfo=UTC)


def plain(events):
    """One step after the other."""
    out, runs = [], {}
    for w, _, _, name in sorted(e for e in events if None not in e[:3]):
        place, seq, prior = runs.get(w, (-1, 0, None))
        legal, place, after = machine.step(place, prior, name or "")
        out.append((w, seq, name or "", prior, legal))
        runs[w] = (place, seq + 1, after)
    return sorted(out)


@pytest.fixture(scope="module")
def events():
    rng = random.Random(5)
    out = []
    for w in range(12):
        names = list(HAPPY_PATH) if w % 3 else [*HAPPY_PATH[: rng.randrange(3, 9)], rng.choice(ENDS), HAPPY_PATH[4]]
        for _ in range(rng.randrange(6)):
            names.insert(rng.randrange(len(names)), rng.choice([*HAPPY_PATH, *ENDS[:1], "NO SUCH STATE"]))
        at = START
        for n, name in enumerate(names):
            at += timedelta(milliseconds=rng.choice([0, 0.25, 40, 900_000]))
            out.append((w, at, 1000 * w + n, name))
    return [*out, (3, START, 9_999, None), (None, START, 1, "CREATED"), (4, None, 2, "CREATED")]


def test_batch_machine_steps_like_one_event_after_the_other(spark, events):
    assert sorted(map(tuple, judged(spark.createDataFrame(events, SCHEMA)).collect())) == plain(events)
    assert judged(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_arrival_does_not_matter(spark, events, seed):
    rng = random.Random(seed)
    mixed = rng.sample(events, len(events))
    folder = work_path(spark, "events")
    for n in range(4):
        spark.createDataFrame(mixed[n::4], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    found = machine.run_to_end(stream, timedelta(days=2), max(e[1] for e in events if e[1]))
    assert sorted(map(tuple, found.collect())) == plain(events)


def test_a_batch_played_twice_changes_nothing(spark):
    table = latest.LatestTable(spark, work_path(spark, "latest"), "k", ["at", "n"], "k long, at long, n long, v string", buckets=4)
    rows = lambda *r: spark.createDataFrame(r, "k long, at long, n long, v string")
    seen = lambda: sorted(map(tuple, table.latest().collect()))
    assert seen() == [] and table.log().count() == 0
    table.write(rows((1, 5, 0, "a"), (2, 5, 0, "b"), (3, 1, 0, None), (1, 4, 0, "old")), 0)
    table.write(rows((1, 6, 0, "c"), (2, 3, 9, "older"), (7, 1, 0, "x"), (7, 1, 0, "x")), 1)
    expected = [(1, 6, 0, "c"), (2, 5, 0, "b"), (3, 1, 0, None), (7, 1, 0, "x")]
    assert seen() == expected
    for _ in range(2):
        table.write(rows((1, 6, 0, "c"), (2, 3, 9, "older"), (7, 1, 0, "x"), (7, 1, 0, "x")), 1)
        assert seen() == expected and table.log().count() == 8
    table.tidy()
    assert seen() == expected
    table.write(rows((1, 6, 0, "c"), (2, 3, 9, "older"), (7, 1, 0, "x"), (7, 1, 0, "x")), 1)
    assert seen() == expected
    table.write(rows(), 2)
    table.write(rows((3, 2, 0, "new")), 3)
    table.tidy()
    assert seen() == [(1, 6, 0, "c"), (2, 5, 0, "b"), (3, 2, 0, "new"), (7, 1, 0, "x")]


def test_a_batch_that_was_not_whole_is_not_read(spark):
    table = latest.LatestTable(spark, work_path(spark, "latest"), "k", ["at"], "k long, at long", buckets=2)
    table.write(spark.createDataFrame([(1, 1)], "k long, at long"), 0)
    table.write(spark.createDataFrame([(1, 2)], "k long, at long"), 1)
    system, mark = latest._files(spark, f"{table.folder}/latest/batch=1/_SUCCESS")
    system.delete(mark, False)
    assert [tuple(r) for r in table.latest().collect()] == [(1, 1)]
    table.write(spark.createDataFrame([(1, 2)], "k long, at long"), 1)
    assert [tuple(r) for r in table.latest().collect()] == [(1, 2)]


def test_a_stream_restarted_from_its_checkpoint_goes_on(spark):
    folder, checkpoint, source = (work_path(spark, n) for n in ("latest", "check", "source"))
    table = latest.LatestTable(spark, folder, "k", ["at"], "k long, at long")
    for n in range(3):
        spark.createDataFrame([(k, n) for k in range(n, n + 5)], "k long, at long").write.mode("append").parquet(source)
        latest.run(spark.readStream.schema("k long, at long").parquet(source), table, checkpoint)
    assert sorted(map(tuple, table.latest().collect())) == [(0, 0), (1, 1), *((k, 2) for k in range(2, 7))]
    assert table.log().count() == 15
