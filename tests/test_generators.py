"""Generators of the user's own over ordered groups and blocks."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark import fixtures as fx
from gridspark.operators import generators as G
from gridspark.operators import samples as S

TYPES = {"tmp": "double", "soilm_10": "double"}


def spells():
    """Made in a function, so that it travels to the workers whole: runs of rows without rain, each given when it ends."""
    class Spells:
        def __init__(self):
            self.begin, self.last, self.key = None, None, None

        def push(self, row):
            if row["apcp"] == 0 and self.begin is not None and row["step"] == self.last + 1:
                self.last = row["step"]
                return
            yield from self.finish()
            self.key = (row["y"], row["x"])
            self.begin = self.last = row["step"] if row["apcp"] == 0 else None

        def finish(self):
            if self.begin is not None:
                yield (*self.key, self.begin, self.last - self.begin + 1)
            self.begin = None
    return lambda: Spells()


def test_runs_that_explode_cannot_give(spark, sf):
    rows = fx.gapped(spark, sf).select("y", "x", "step", "apcp").distinct()
    got = sorted(map(tuple, G.generate(rows, spells(), "y int, x int, begin int, n int", ["y", "x"], ["step"]).collect()))
    want, by = [], {}
    for r in rows.collect():
        by.setdefault((r.y, r.x), []).append((r.step, r.apcp))
    for key, series in by.items():
        run = []
        for step, rain in [*sorted(series), (10**9, 1.0)]:
            if run and (rain != 0 or step != run[-1] + 1):
                want.append((*key, run[0], len(run)))
                run = []
            if rain == 0:
                run.append(step)
    assert got == sorted(want) and len(got) > 100


@pytest.mark.parametrize("block", [40, 64, 4096])
@pytest.mark.parametrize("gaps", [False, True])
def test_samples_equal_the_operator(spark, sf, block, gaps):
    """Whatever the block length, also where steps are missing or repeated."""
    rows = (fx.gapped if gaps else fx.dynamic)(spark, sf).where("y < 2")
    spec = S.SampleSpec(4, 8, ["tmp"], ["tmp"], ["soilm_10"], separation=5, max_offset=7, seed=3)
    got = G.generated_samples(rows, spec, TYPES, block=block).collect()
    cut = S.to_arrays(S.cut_samples(rows, S.sample_starts(rows, spec), spec), spec, ["y", "x", "sample"])
    by = {}
    for r in got:
        by.setdefault((r.y, r.x, r.sample), []).append(r)
    want = {(r.y, r.x, r.sample): [w.tmp for w in r.window] + [h.tmp for h in r.horizon] for r in cut.collect()}
    assert {k: [r.tmp for r in sorted(v, key=lambda r: r.pos)] for k, v in by.items()} == want
    assert want and all([r.pos for r in sorted(v, key=lambda r: r.pos)] == list(range(12)) for v in by.values())


def test_groups_and_order(spark):
    """Rows arrive in order within each group, null keys too; every group has a generator of its own."""
    def factory():
        class Seen:
            def __init__(self):
                self.rows = []

            def push(self, row):
                self.rows.append(row["v"])
                return ()

            def finish(self):
                yield (len(self.rows), self.rows == sorted(self.rows), self.rows[0] if self.rows else None)
        return Seen()
    dice = random.Random(1)
    given = [(dice.choice(["a", "b", None]), dice.randrange(10**6)) for _ in range(500)]
    df = spark.createDataFrame(given, "k string, v int").repartition(6)
    got = sorted(map(tuple, G.generate(df, factory, "n int, ordered boolean, low int", ["k"], ["v"]).collect()))
    want = sorted((sum(k == g for k, _ in given), True, min(v for k, v in given if k == g)) for g in ("a", "b", None))
    assert got == want
    assert G.generate(df.limit(0), factory, "n int, ordered boolean, low int", ["k"], ["v"]).where(F.col("n") > 0).count() == 0


def test_a_row_costs_the_same_whatever_the_length_of_a_sample():
    """A row that ends no sample looks at itself, not at all rows of the sample before it."""
    asked = []

    class Counted(dict):
        def __getitem__(self, name):
            asked.append(name)
            return super().__getitem__(name)
    spec = S.SampleSpec(200, 200, ["v"], ["v"], ["v"], separation=10_000)
    generator = G.sample_generator(spec, ["v"])()
    given = [Counted(y=0, x=0, step=i, v=i, _first_offset=0, _starts=1, _core=True) for i in range(3000)]
    out = [r for row in given for r in generator.push(row)] + list(generator.finish())
    assert out == [(0, 0, 0, i, i) for i in range(400)]
    assert len(asked) < 10 * len(given)
