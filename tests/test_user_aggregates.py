"""User states: batches, trees of merges, limits and a stream."""

import json
import random
from datetime import datetime

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from gridspark.operators import user_aggregates as U
from gridspark.streaming import partials as SP


def _evaluators():
    # Made in a function, so that they travel to the workers whole: they cannot import this file.
    class LongestWords:
        """The three longest values and how many different first letters there are: no sum in sight."""

        columns = ("word",)
        result = "longest array<string>, letters int"

        def add(self, state, rows):
            words = [w for w in rows["word"] if w is not None]
            return self.merge(state or {"top": [], "letters": []}, {"top": words, "letters": [w[:1] for w in words]})

        def merge(self, a, b):
            top = sorted(set(a["top"]) | set(b["top"]), key=lambda w: (-len(w), w))[:3]
            return {"top": top, "letters": sorted(set(a["letters"]) | set(b["letters"]))}

        def pack(self, state):
            return json.dumps(state).encode()

        def unpack(self, packed):
            return json.loads(packed)

        def finish(self, state):
            return state["top"], len(state["letters"])

    class Everything(LongestWords):
        """A state that grows with its rows."""

        def merge(self, a, b):
            return {"top": a["top"] + b["top"], "letters": []}
    return LongestWords, Everything


LongestWords, Everything = _evaluators()
SCHEMA = "word string, g string, day timestamp, state string, _row int"


def rows(n, seed=1):
    dice = random.Random(seed)
    return [("".join(dice.choice("abcdef") for _ in range(dice.randint(1, 9))) if dice.random() > 0.05 else None,
             dice.choice(["hot"] * 8 + ["a", "b", None]), datetime(2020, 1, dice.randint(1, 3)), "clash", 7) for _ in range(n)]


def expected(given, key):
    e, out = LongestWords(), {}
    import pandas as pd
    for r in given:
        out.setdefault(key(r), []).append(r[0])
    return {k: e.finish(e.add(None, pd.DataFrame({"word": v}, dtype=object))) for k, v in out.items()}


@pytest.mark.parametrize("fan_in", [2, 3, 64])
def test_any_tree_gives_the_same(spark, fan_in):
    given = rows(4000)
    df = spark.createDataFrame(given, SCHEMA).repartition(23)
    a = U.StateAggregate(["g", "day"], LongestWords(), fan_in=fan_in)
    got = {(r.g, r.day): (r.longest, r.letters) for r in a.evaluate(df).collect()}
    assert got == expected(given, lambda r: (r[1], r[2]))
    parts = a.partial(df)
    assert parts.count() > len(got)
    # Tiles together, and fewer keys than the partials have.
    halves = a.partial(df.where("g = 'hot'")), a.partial(df.where("g IS NULL OR g <> 'hot'"))
    coarse = a.finish(a.merge(*halves, by=["day"]))
    assert {r.day: (r.longest, r.letters) for r in coarse.collect()} == expected(given, lambda r: r[2])


def test_many_groups_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(U, "OPEN_BYTES", 50 << 20)
    df = spark.range(0, 3000, 1, 2).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), (F.col("id") % 700).alias("k"))
    a = U.StateAggregate(["k"], LongestWords())
    got = a.evaluate(df).collect()
    assert len(got) == 700 and all(r.letters == 1 for r in got)


def test_no_keys_and_no_rows(spark):
    a = U.StateAggregate([], LongestWords())
    df = spark.createDataFrame(rows(100), SCHEMA)
    r, = a.evaluate(df).collect()
    assert (r.longest, r.letters) == expected(rows(100), lambda r: ())[()]
    assert U.StateAggregate(["g"], LongestWords()).evaluate(df.limit(0)).count() == 0


def test_a_growing_state_is_refused(spark):
    df = spark.createDataFrame(rows(2000), SCHEMA).repartition(8)
    with pytest.raises(PythonException, match="StateTooLarge"):
        U.StateAggregate(["g"], Everything(), state_bytes=2000).evaluate(df).collect()


def test_rank_correlation(spark):
    pairs = [(float(i % 13), float((i * i) % 11)) for i in range(300)] + [(None, 1.0), (float("nan"), 2.0), (1.0, None)]
    df = spark.createDataFrame([(1, *p) for p in pairs] + [(2, 3.0, 1.0), (2, 3.0, 9.0)], "k int, a double, b double").repartition(5)
    got = {r.k: (r.n, r.rank_cc) for r in U.StateAggregate(["k"], U.RankCorrelation("a", "b", 0.0, 16.0, 16)).evaluate(df).collect()}
    import pandas as pd
    whole = pd.DataFrame([p for p in pairs[:300]])
    assert got[1] == (300, pytest.approx(whole[0].rank().corr(whole[1].rank()))) and got[2] == (2, None)


def test_streamed_states(spark, tmp_path):
    given, source, out = rows(600, 4), str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame(given[i * 200:(i + 1) * 200], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    a = U.StateAggregate(["g"], LongestWords(), fan_in=2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    SP.stream_merge(stream, a, out, str(tmp_path / "log")).awaitTermination()
    got = {r.g: (r.longest, r.letters) for r in a.finish(SP.merged_partials(spark, out, a)).collect()}
    assert got == expected(given, lambda r: r[1]) and len(list((tmp_path / "out").glob("batch=*"))) == 3
