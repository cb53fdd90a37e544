"""Small fixed frames."""

import datetime as dt

from runmetrics import schema

START = dt.datetime(2024, 1, 1, 12, 0, 0)


def task(run, task_id, status, ordinal=0, task_type="command", seconds=1.0, retry=0, error=None, output=None, metadata=None,
         workflow="wf", start=START):
    end = None if seconds is None else start + dt.timedelta(seconds=seconds)
    ms = None if seconds is None else int(seconds * 1000)
    return (run, workflow, ordinal, task_id, task_type, status, start, end, ms, output, error, retry, metadata or {})


def tasks(spark, rows):
    return spark.createDataFrame(rows, schema.TASK_RUN)


def runs(spark, *ids, workflow="wf", seconds=10):
    rows = [(workflow, i, None, START, START + dt.timedelta(seconds=seconds), seconds * 1000, {}) for i in ids]
    return spark.createDataFrame(
        rows, "workflow_name string, run_id string, status string, start_time timestamp, end_time timestamp, duration_ms long, metadata map<string,string>"
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
