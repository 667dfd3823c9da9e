"""LCDD on a stream of finished cases: one pass, with bounded state for each log.

Only this detector is online by nature.  The state of a log is the relations of
its reference window, the relations of cases seen since the last cut that may
still matter (at most a complete and a detection window), and the place.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "log_id string, change_point double"


class Online:
    """The state machine: feed the cases' relation sets in order, get cuts."""

    def __init__(self, complete: int, detection: int):
        self.complete, self.detection = complete, detection
        self.held: list[frozenset] = []  # from the segment's start on, as far as needed
        self.start = 0
        self.reference: set | None = None
        self.checked = False

    def feed(self, relations: frozenset) -> list[int]:
        out = []
        self.held.append(relations)
        while (cut := self._step()) is not None:
            out.append(cut)
        return out

    def _step(self) -> int | None:
        c, d = self.complete, self.detection
        n = len(self.held)
        if n <= c:
            return None
        if self.reference is None:
            self.reference = set().union(*self.held[:c])
        first = next((k for k in range(c, min(n, c + d)) if not self.held[k] <= self.reference), None)
        if first is None and not self.checked and n > c + d:
            self.checked = True
            if len(self.reference - set().union(*self.held[c : c + d])) > 1:
                first = c
        if first is None and self.checked:
            late = next((k for k in range(c + d, n) if not self.held[k] <= self.reference), None)
            if late is None:
                # quiet cases behind the detection window are not needed again
                self.start += n - (c + d)
                self.held = self.held[: c + d]
                return None
            first = late
        if first is None:
            return None
        cut = self.start + first
        self.held, self.start = self.held[first:], cut
        self.reference, self.checked = None, False
        return cut


def detect(cases: DataFrame, complete: int, detection: int) -> DataFrame:
    """(log_id, change_point) of a stream of (log_id, case_idx, relations: array<string>).

    Cases of a log must come in order of case_idx over the batches; within a batch they are sorted.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else Online(complete, detection)
        rows = pd.concat(list(frames)).sort_values("case_idx")
        cuts = [x for r in rows["relations"] for x in machine.feed(frozenset(() if r is None else r))]
        state.update((pickle.dumps(machine),))
        yield pd.DataFrame({"log_id": key[0], "change_point": [float(x) for x in cuts]})

    return cases.groupBy("log_id").applyInPandasWithState(step, OUT, "machine binary", "append", GroupStateTimeout.NoTimeout)
