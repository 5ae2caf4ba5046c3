"""What a preparation did: counters that Spark gathers on the way, and seconds by stage."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

STAGES = ("request.validate", "chat.render", "media.plan", "chat.tokenize", "batch.plan", "media.prepare")


@dataclass
class Report:
    """Spans (stage, parent, seconds, outcome) and counters. At most ``most`` spans are kept; the rest are counted."""

    most: int = 1000
    spans: list[dict] = field(default_factory=list)
    dropped: int = 0
    _open: list[int] = field(default_factory=list)
    _watched: dict[str, Observation] = field(default_factory=dict)

    @contextmanager
    def span(self, stage: str) -> Iterator[None]:
        """Times what is done inside; its parent is the innermost span that is open."""
        began, at = time.perf_counter(), len(self.spans)
        kept = at < self.most
        if kept:
            self.spans.append({"stage": stage, "parent": self._open[-1] if self._open else None, "seconds": None, "outcome": "open"})
            self._open.append(at)
        else:
            self.dropped += 1
        outcome = "failed"
        try:
            yield
            outcome = "ok"
        finally:
            if kept:
                self._open.pop()
                self.spans[at] |= {"seconds": time.perf_counter() - began, "outcome": outcome}

    def watch(self, rows: DataFrame, name: str, *sums: str) -> DataFrame:
        """Counts the rows, and sums some columns, whenever an action first runs over them."""
        self._watched[name] = seen = Observation(name)
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.sum(x).alias(x) for x in sums))

    def to_json(self) -> str:
        """Call it after an action over everything that is watched."""
        counters = {k: v.get for k, v in self._watched.items()}
        return json.dumps({"spans": self.spans, "dropped": self.dropped, "counters": counters}, default=str)


def observed(prepared) -> Report:
    """Runs every step of a preparation, one after another, and reports it."""
    report = Report()
    with report.span("request.validate"):
        prepared.planned_requests.count()
    with report.span("media.plan"):
        prepared.occurrences.count()
    with report.span("batch.plan"), report.span("chat.render"):
        report.watch(prepared.text, "text").write.format("noop").mode("overwrite").save()
    with report.span("media.prepare"):
        report.watch(prepared.patches().withColumn("bytes", F.octet_length("patches")), "patches", "bytes").write.format("noop").mode("overwrite").save()
    return report
