"""Training progress over all epochs of a run, against a plain loop."""

import pandas as pd

from lakeproof.plans import catalog

DATA = "/root/testdata/sf0.01"


def test_all_epochs(spark):
    events = pd.read_parquet(f"{DATA}/events.parquet").sort_values("event_id")
    want = {}
    for run, values in events.groupby("event_type")["value"]:
        best = rose = None
        for epoch, value in enumerate(values, 1):
            if best is None or value > best:
                best, rose = value, epoch
            want[run, epoch] = (best, epoch - rose)
    rows = catalog.QUERIES["training_progress_all"](spark, DATA).collect()
    assert max(r.epoch for r in rows) > 200
    assert {(r.run, r.epoch): (r.best, r.waited) for r in rows} == want and len(rows) == len(want)
