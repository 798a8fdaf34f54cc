"""Results of the plans as stored tables, each with the parameters that made it (`sources.published`)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.published import folder, read_published, versions, write_published


@dataclass(frozen=True)
class Store:
    """Where a run of a plan keeps its results: a table for each (source, model, feat, evaluator, error type)."""

    path: str
    source: str
    model: str
    err_type: str = "bias"
    params: Mapping = field(default_factory=dict)

    def _place(self, feat: str, evaluator: str, source: str | None = None) -> str:
        return f"{self.path}/source={source or self.source}/model={self.model}/feat={feat}/eval_type={evaluator}/err_type={self.err_type}"

    def keep(self, results: Mapping[str, DataFrame], feat: str, source: str | None = None) -> dict[str, DataFrame]:
        """Store and publish each result; returns them as read back."""
        told = {"source": source or self.source, "model": self.model, "feat": feat, "err_type": self.err_type, **self.params}
        out = {}
        for name, df in results.items():
            write_published(df, self._place(feat, name, source), {**told, "eval_type": name})
            out[name] = read_published(df.sparkSession, self._place(feat, name, source))[0]
        return out

    def load(self, spark: SparkSession, feat: str, evaluator: str, source: str | None = None) -> tuple[DataFrame, dict]:
        """A stored result and the parameters that made it."""
        return read_published(spark, self._place(feat, evaluator, source))


def stored_results(spark: SparkSession, path: str, source: str | None = None, models: Sequence[str] | None = None,
                   feats: Sequence[str] | None = None, eval_type: str | None = None, err_type: str | None = None) -> list[dict]:
    """The published results below `path` by their fields: source, model, feat, eval_type, err_type and path. Folders are listed, no data read."""
    wanted = [("source", source and [source]), ("model", models), ("feat", feats), ("eval_type", eval_type and [eval_type]),
              ("err_type", err_type and [err_type])]
    found = [({}, path)]
    for field_name, values in wanted:
        deeper = []
        for told, at in found:
            place, fs = folder(spark, at)
            for f in fs.listStatus(place) if fs.exists(place) else []:
                name, _, value = f.getPath().getName().partition("=")
                if name == field_name and (not values or value in values):
                    deeper.append(({**told, name: value}, f"{at}/{name}={value}"))
        found = deeper
    return [{**told, "path": at} for told, at in sorted(found, key=lambda x: x[1]) if versions(spark, at)]
