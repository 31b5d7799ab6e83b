"""Windows and candidates of many episodes: what leaves Python is bounded, sums are exact, choices are those of a plain loop."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.functions import ranks
from tempora.operators import moments, scoring
from tempora.plans import queries_moments
from tempora.plans.config import Scoring

CFG = Scoring.resolve({"cell_s": 1.0, "max_candidates": 5})


def batch(cells, seed=3):
    """Timeline rows with hooks, as the scorer gets them; an episode for each number of cells."""
    rng = np.random.default_rng(seed)
    ends = pa.array(np.concatenate([[0], np.cumsum(cells)]).astype(np.int32))
    cols = {"episode_id": pa.array(range(len(cells)), pa.int64())}
    cols |= {s: pa.ListArray.from_arrays(ends, rng.random(sum(cells)) * (rng.random(sum(cells)) < 0.3)) for s in ranks.SIGNALS}
    hooks = [[{"start": float(t), "end": t + 1.5, "score": float(s), "type": "promise", "text": f"{t}"} for t, s in zip(range(0, n, 7), rng.random(n))] for n in cells]
    cols |= {"duration_s": pa.array([float(n) for n in cells]), "motion_ref": pa.array([0.4] * len(cells)), "hooks": pa.array(hooks)}
    return pa.RecordBatch.from_pydict(cols)


def scored(b, kind, more=()):
    return list(scoring._scorer([c for c, _ in scoring.FLAT] + list(more), 10.0, 30.0, CFG, kind)([b]))


def timelines(spark, arrays, duration):
    kind = ", ".join(f"{s} array<double>" for s in ranks.SIGNALS)
    return spark.createDataFrame([(1, *arrays, duration, 0.4, int(duration))], f"episode_id long, {kind}, duration_s double, motion_ref double, cells int")


def test_rows_leave_in_stretches():
    """One long episode and many short ones: no batch holds all windows of either."""
    for cells, windows in (([60_000], 3 * 60_000 - 57), ([300] * 300, 300 * (291 + 281 + 271))):
        out = scored(batch(cells), "every")
        assert sum(b.num_rows for b in out) == windows and max(b.num_rows for b in out) < 2 * scoring.STRETCH


def test_only_chosen_windows_leave():
    b = batch([80, 20, 200, 400])
    every, best = pa.Table.from_batches(scored(b, "every")).to_pylist(), pa.Table.from_batches(scored(b, "best", ["rank"])).to_pylist()
    for e in range(4):
        taken = []
        for w in sorted((w for w in every if w["episode_id"] == e), key=lambda w: (-w["score"], w["start_s"], w["duration_s"])):
            shared = [max(0, min(w["end_s"], t["end_s"]) - max(w["start_s"], t["start_s"])) / min(w["duration_s"], t["duration_s"]) for t in taken]
            if len(taken) < CFG.max_candidates and all(s <= CFG.nms_overlap for s in shared):
                taken.append(w)
        assert [w | {"rank": i + 1} for i, w in enumerate(taken)] == [w for w in best if w["episode_id"] == e]


def test_candidates_collect_no_windows(spark):
    b = batch([120])
    t = timelines(spark, [b.column(s)[0].as_py() for s in ranks.SIGNALS], 120.0)
    plan = scoring.build_candidates(t, None, 10.0, 30.0, CFG)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Generate" not in plan
    assert scoring.build_candidates(t, None, 10.0, 30.0, CFG).count() <= CFG.max_candidates


def test_heads_are_a_row_for_each_start(spark):
    b = batch([120])
    t = timelines(spark, [b.column(s)[0].as_py() for s in ranks.SIGNALS], 120.0)
    hooks = spark.createDataFrame([(1, h["start"], h["end"], h["score"], h["type"], h["text"]) for h in b.column("hooks")[0].as_py()], "episode_id long, start_s double, end_s double, score double, type string, text string")
    heads = scoring.window_heads(t, hooks, 10.0, 30.0, CFG)
    assert "Aggregate" not in heads.drop("hook_text")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    got = {r["start_s"]: tuple(r[c] for c in scoring.HEAD) for r in heads.collect()}
    want = {r["start_s"]: tuple(r["stats"]["head"][c] for c in scoring.HEAD) for r in scoring.score_windows(t, hooks, 10.0, 30.0, CFG).collect()}
    assert got == want and len(got) == 111


def test_eight_decimals_without_decimal_numbers(spark):
    rng = np.random.default_rng(8)
    x = [0.0, 1.0, 0.5, 1 / 3, 0.123456785, 1e-9, 123.00000001, float("nan"), *(rng.random(500) * rng.choice([1e-6, 1.0, 60.0], 500)).tolist()]
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    fast = df.select(queries_moments.r8("x").alias("a"), F.round(F.col("x") + 1e-12, 8).alias("b"))
    assert "round(" not in fast.select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert all(repr(r["a"]) == repr(r["b"]) for r in fast.collect())


def test_only_what_is_needed_leaves_python(spark):
    b = batch([120])
    t = timelines(spark, [b.column(s)[0].as_py() for s in ranks.SIGNALS], 120.0)
    some, every = (scoring.score_windows(t, None, 10.0, 30.0, CFG, *only) for only in ((("s_longest_silence_s", "transcript"),), ()))
    assert some.schema["stats"].dataType.fieldNames() == ["longest_silence_s"] and "warnings" not in some.columns
    pick = lambda x: sorted(x.select("start_s", "end_s", "score", "stats.longest_silence_s", "signals.transcript").collect())
    assert pick(some) == pick(every)


def test_shares_are_exact_behind_long_running_totals(spark):
    """Half an hour of speech in eight hours is 0.0625, shown as 0.063, whatever came before it."""
    rng = np.random.default_rng(6)
    a, b = rng.random(2) / 4
    speech = np.concatenate([rng.random(400), [0, 0, a, b, 0.5 - a - b, 0, 0, 0], rng.random(12)])
    assert np.cumsum(speech)[407] - np.cumsum(speech)[399] < 0.5  # running totals of doubles lose it
    t = timelines(spark, [speech.tolist(), *[[0.0] * 420] * 7], 420.0)
    m = spark.createDataFrame([(1, [(400.0, 408.0)])], "episode_id long, segs array<struct<start:double,end:double>>")
    r = moments.evaluate(m, t, None, CFG).first()
    assert (r["speech_density"], r["segs"][0]["start"]) == (0.063, 400.0)


def test_odd_moments_and_hooks(spark):
    """Moments without segments or times, hooks without a score, and a moment of no known episode."""
    b = batch([50])
    t = timelines(spark, [b.column(s)[0].as_py() for s in ranks.SIGNALS], 50.0)
    hooks = spark.createDataFrame([(1, 0.0, 5.0, None, "a", None), (1, 1.0, 4.0, 0.5, None, "x" * 200), (1, 2.0, 3.0, -1.0, "b", "y")], "episode_id long, start_s double, end_s double, score double, type string, text string")
    m = spark.createDataFrame([(1, []), (1, [(float("nan"), 9.0)]), (1, [(1.0, 4.0), (60.0, 90.0)]), (2, [(0.0, 1.0)]), (None, [(0.0, 1.0)])], "episode_id long, segs array<struct<start:double,end:double>>")
    got = moments.evaluate(m, t, hooks, CFG).collect()
    assert len(got) == 3 and max(r["signals"]["hook"] for r in got) >= 0.25
    head = scoring.window_heads(t, hooks, 10.0, 30.0, CFG).where("start_s = 2").first()
    assert (head["hook_text_score"], head["hook_type"], head["hook_text"]) == (0.5, "", "x" * 160)


def test_rounding_as_spark_does_it(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([(2 * np.arange(2000) + 1) / 2000, rng.random(2000) * 100, [-0.0005, -0.0001, 0.0, 1e17, np.nan, np.inf]])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 3)).collect()]
    assert ranks.half_up(x, 3).tolist() == pytest.approx(want, abs=0, nan_ok=True)
