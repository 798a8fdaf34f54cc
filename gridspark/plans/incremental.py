"""Aggregates over many input files, kept up to date by reading only the files that changed.

Partials are stored with the file they were made from, and a manifest says which files count, with their size and time, and in which
run of `refresh` each was read. A refresh lists the files, reads those that are new or differ from the manifest, stores their
partials as one run, and publishes a new manifest. A changed file's old partials are not subtracted: the manifest no longer
names their run for that file. Files that are gone lose their line. Until the manifest is published, readers see the state before;
a refresh that was killed leaves a run that no manifest names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.user_aggregates import StateAggregate
from ..operators.verification import Moments, Tally
from ..sources import published
from ..sources.archive import listed_path, plain_path

#: Makes an evaluator's partials by the given extra keys, as `horizon_moments` does.
Evaluator = Callable[[Sequence[str]], Moments | Tally | StateAggregate]
MANIFEST = "input string, size long, modified timestamp, run string"


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: the files read, the files dropped, how many were left as they are."""

    read: list[str]
    dropped: list[str]
    kept: int


def list_inputs(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """(input, size, modified) of the files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(listed_path(F.col("path")).alias("input"),
                        F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


@dataclass(frozen=True)
class Incremental:
    """An evaluator over the files below `inputs`, kept below `path`.

    `rows` turns the files' rows into the evaluator's; it must keep a column `input`, the file, and work on each file's rows
    alone. Size and time tell a changed file: a file rewritten within the clock's grain and of equal size counts as unchanged.
    """

    spark: SparkSession
    inputs: str
    path: str
    evaluator: Evaluator
    keys: Sequence[str]
    rows: Callable[[DataFrame], DataFrame] = lambda df: df
    glob: str = "*.parquet"
    options: Mapping[str, str] = field(default_factory=dict)

    def manifest(self) -> DataFrame:
        """The published manifest; empty before the first refresh."""
        try:
            return published.read_published(self.spark, f"{self.path}/manifest")[0]
        except published.NotPublished:
            return self.spark.createDataFrame([], MANIFEST)

    def scan(self, files: Sequence[str]) -> DataFrame:
        """The evaluator's rows of some files. Partition columns above the files are read too."""
        df = self.spark.read.options(basePath=self.inputs, **self.options).parquet(*files)
        return self.rows(df.select("*", plain_path(F.col("_metadata.file_path")).alias("input")))

    def refresh(self) -> Refreshed:
        """Read what changed, store its partials, publish the manifest. Without a change nothing is written."""
        old = self.manifest().select("input", "size", "modified", "run")
        now = list_inputs(self.spark, self.inputs, self.glob)
        # Lists of file names; Spark's own scan holds as much of every file.
        told = now.join(old.toDF("input", "_size", "_modified", "run"), "input", "full").withColumn(
            "same", F.coalesce((F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified")), F.lit(False))).collect()
        changed = sorted(r.input for r in told if r.size is not None and not r.same)
        dropped = sorted(r.input for r in told if r.size is None)
        kept = [r for r in told if r.size is not None and r.same]
        if not changed and not dropped:
            return Refreshed([], [], len(kept))
        run = uuid.uuid4().hex
        if changed:
            self._partials(changed).write.parquet(f"{self.path}/runs/{run}")
        lines = [(r.input, r.size, r.modified, r.run if r.same else run) for r in told if r.size is not None]
        published.write_published(self.spark.createDataFrame(lines, MANIFEST), f"{self.path}/manifest", {"run": run})
        return Refreshed(changed, dropped, len(kept))

    def _partials(self, files: Sequence[str]) -> DataFrame:
        return self.evaluator(["input"]).partial(self.scan(files))

    def partials(self) -> DataFrame:
        """All partials that count, by file."""
        manifest = self.manifest()
        runs = [r[0] for r in manifest.select("run").distinct().collect()]
        if not runs:
            raise published.NotPublished(self.path)
        # A run whose files had no rows has no partials; its folder may hold no file with a schema.
        parts = [self.spark.read.parquet(f"{self.path}/runs/{r}").withColumn("run", F.lit(r)) for r in runs]
        stored = parts[0]
        for p in parts[1:]:
            stored = stored.unionByName(p)
        return stored.join(manifest.select("input", "run"), ["input", "run"], "left_semi").drop("run")

    def totals(self) -> DataFrame:
        """The evaluator's result over all files that count."""
        work = self.evaluator([])
        return work.finish(work.merge(self.partials(), by=list(self.keys)))

    def compact(self) -> int:
        """Put the partials of all runs into one and drop the others' folders; returns how many runs there were."""
        runs = [r[0] for r in self.manifest().select("run").distinct().collect()]
        if len(runs) < 2:
            return len(runs)
        run = uuid.uuid4().hex
        self.partials().write.parquet(f"{self.path}/runs/{run}")
        published.write_published(self.manifest().withColumn("run", F.lit(run)), f"{self.path}/manifest", {"run": run}, keep=1)
        for r in runs:
            place, fs = published.folder(self.spark, f"{self.path}/runs/{r}")
            fs.delete(place, True)
        return len(runs)
