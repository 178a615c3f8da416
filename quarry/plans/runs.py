"""Counters of a run, taken in the stages' own pass: what each stage got, gave and lost, without reading anything twice."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "stage string, counts map<string,long>, seconds double, error string"


@dataclass
class RunLog:
    """Stages of one run. watch() hangs counters on a table; write() runs the job that they ride on and files what they saw; table() is the run's record."""

    spark: SparkSession
    entries: list[tuple] = field(default_factory=list)
    _open: dict[str, Observation] = field(default_factory=dict)

    def watch(self, stage: str, df: DataFrame, **counts: Column) -> DataFrame:
        """df with a count of its rows (`rows`), and of the rows for which each further condition holds. The counters fill when a job reads df; a stage's name may be used once."""
        if stage in self._open or any(e[0] == stage for e in self.entries):
            raise ValueError(f"stage {stage!r} is watched already")
        self._open[stage] = Observation(stage)
        return df.observe(self._open[stage], F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()])

    def write(self, stage: str, df: DataFrame, save: Callable[[DataFrame], None]) -> bool:
        """Runs save(df) and files all watched stages that took part. A failure is filed with its message and gives False, so that later stages can go on."""
        began = time.monotonic()
        try:
            save(self.watch(stage, df))
        except Exception as e:
            self._open.clear()
            self.entries.append((stage, {}, time.monotonic() - began, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
            return False
        spent = time.monotonic() - began
        for name, seen in self._open.items():
            self.entries.append((name, {k: int(v) for k, v in seen.get.items()}, spent if name == stage else None, None))
        self._open.clear()
        return True

    def table(self) -> DataFrame:
        """stage, counts, seconds (of the stage that was written) and error, in order."""
        return self.spark.createDataFrame(self.entries, SCHEMA)


def funnel(papers: DataFrame, keywords: DataFrame, labels: DataFrame, save: Callable[[DataFrame], None], log: RunLog) -> bool:
    """The curation funnel of engine.collect as one job: each stage is watched, papers that it drops go on with the stage's name, and one write takes all: papers and
    their `stage` (kept, or what dropped them)."""
    from quarry.operators import curation as C

    found = log.watch("recalled", C.recall(papers))
    labelled = log.watch("ruled", found.withColumn("label", C.rule_label(C.paper_text())), clear=F.col("label") == "clear", edge=F.col("label") == "edge")
    edge = labelled.filter("label = 'edge'").drop("label")
    rejected, passed = C.keyword_matches(edge, keywords, C.paper_text())
    suitable, unsuitable = C.label_split(passed, labels)
    columns = papers.columns
    parts = [(labelled.filter("label = 'clear'"), "kept"), (suitable, "kept"), (rejected, "keyword_filtered"), (unsuitable, "unsuitable")]
    out = None
    for df, name in parts:
        part = df.select(*columns, F.lit(name).alias("stage"))
        out = part if out is None else out.unionByName(part)
    return log.write("saved", out, save)
