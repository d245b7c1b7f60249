import collections
import os
import random

import pytest
from meshframe.operators import numbering
from meshframe.sources import series
from meshframe.streaming import steps

STEP = "series string, iteration long, write_seq long, note string"
SPAN = "series string, lo long, hi long"


def run(spark, tmp_path, batches, horizon=None):
    """The steps and the reopened ones of a stream that gets a file a batch, and the state after each."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    states = []
    for rows in batches:
        spark.createDataFrame(rows, STEP).coalesce(1).write.mode("append").parquet(source)
        steps.closed_capture(steps.read_steps(spark, source, STEP, 1), out, check, horizon=horizon).awaitTermination()
        states.append(sorted(map(tuple, steps.closed_iterations(spark, out, SPAN).collect())))
    read = lambda name: [tuple(r) for r in spark.read.schema(STEP).parquet(f"{out}/{name}").select("series", "iteration", "write_seq", "note").collect()]
    return read("steps"), read("reopened"), states


def test_closed_steps_are_not_opened_again(spark, tmp_path):
    rng, seq, batches = random.Random(2), 0, []
    for k in range(3):
        rows = []
        for _ in range(60):
            seq += 1
            rows.append((rng.choice("ab"), rng.randint(k * 8, k * 8 + 12), seq, f"n{seq}"))
        rows += [rows[0], (None, 3, seq + 1, "x"), ("a", None, seq + 1, "y"), ("hot", k, 10_000 + k, "z"), ("hot", k, 10_000 + k, "z")]
        seq += 5
        batches.append(rows)
    good, again, states = run(spark, tmp_path, batches)
    seen, want, rest = set(), [], collections.Counter()
    for rows in batches:
        own = collections.defaultdict(list)
        for r in rows:
            if r[0] is not None and r[1] is not None:
                own[r[:2]].append(r)
        for k, group in own.items():
            rest.update(group)
            if k not in seen:
                seen.add(k)
                first = min(group, key=lambda r: r[2])
                want.append(first)
                rest[first] -= 1
    assert sorted(good) == sorted(want) and collections.Counter(again) == +rest
    intervals = []
    for s, i in sorted(seen):
        if intervals and intervals[-1][0] == s and intervals[-1][2] == i - 1:
            intervals[-1] = (s, intervals[-1][1], i)
        else:
            intervals.append((s, i, i))
    assert states[-1] == intervals and ("hot", 0, 2) in intervals
    versions = collections.Counter(d.split("part=")[1].split("/")[0] for d, _, _ in os.walk(tmp_path / "out" / "closed") if "batch=" in d)
    assert max(versions.values()) <= 2


def test_a_horizon_bounds_the_intervals(spark, tmp_path):
    batches = [[("a", 2 * i, i, "") for i in range(40)], [("a", 3, 100, "late"), ("a", 71, 101, ""), ("a", 90, 102, "")]]
    good, again, states = run(spark, tmp_path, batches, horizon=10)
    assert [len(s) for s in states] == [7, 2] and states[1][1] == ("a", 90, 90) and states[1][0][2] == 79
    assert ("a", 3, 100, "late") in again and ("a", 71, 101, "") in good and len(good) == 42


def test_sums_of_fractions_stay(spark):
    df = spark.createDataFrame([("a", i, i / 4) for i in range(8)], "k string, o long, v double")
    assert [r["s"] for r in numbering.exclusive_sum(df, ["k"], ["o"], "v", "s").orderBy("o").collect()] == [sum(j / 4 for j in range(i)) for i in range(8)]


def test_a_pipe_of_attributes_names_the_version(spark, tmp_path):
    with pytest.raises(ValueError):
        series.pipe({"attributes": spark.createDataFrame([], "iteration long, path string, node_type string, name string, dtype string, value string")}, str(tmp_path))


def test_the_running_maximum_rewrites_only_the_series_of_a_batch(spark, tmp_path):
    """Series that a batch doesn't have keep their files; steps without a series are one series, over batches too."""
    rng, source, out, check = random.Random(4), *(str(tmp_path / x) for x in ("in", "out", "check"))
    rows, names = [], [None, *(f"s{i}" for i in range(12))]
    for k in range(5):
        own = names if k < 2 else names[k : k + 2]
        batch = [(rng.choice(own), k * 100 + i, rng.choice([None, *range(k * 5, k * 5 + 30)])) for i in range(60)]
        rows += batch
        spark.createDataFrame(batch, "series string, write_seq long, iteration long").write.parquet(f"{source}/{k}")
        before = {d: os.stat(d).st_mtime_ns for d, _, files in os.walk(f"{out}/state") if files and "part=" in d}
        steps.running_max_capture(steps.read_steps(spark, f"{source}/*", "series string, write_seq long, iteration long", 99), out, check).awaitTermination()
        after = {d: os.stat(d).st_mtime_ns for d, _, files in os.walk(f"{out}/state") if files and "part=" in d}
        assert all(after[d] == t for d, t in before.items() if d in after) and len([d for d in after if f"batch={k}/" in d]) <= len(own)
        versions = collections.Counter(d.split("part=")[1] for d in after)
        assert max(versions.values()) <= 2 and len(versions) >= len(versions.keys() & {d.split("part=")[1] for d in before})
    most, want = {}, []
    for s, seq, i in rows:
        if i is not None and (s not in most or i > most[s]):
            most[s] = i
            want.append((s, seq, i))
    got = [tuple(r) for r in spark.read.parquet(f"{out}/steps").select("series", "write_seq", "iteration").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
