from __future__ import annotations


def make_log(spark, traces: list[str], log_id: str = "log"):
    """Events of a log given as strings, a character for each event."""
    rows = [(log_id, str(i), i, j, a) for i, t in enumerate(traces) for j, a in enumerate(t)]
    return spark.createDataFrame(rows, "log_id string, case_id string, case_idx long, evt_idx long, activity string")
