"""Greedy order plans against a plain loop, with lookaheads too short to suffice at first."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelspark.operators import ledger


def test_order_plan_is_greedy_beyond_the_lookahead(spark):
    rng = np.random.default_rng(5)
    need = np.round(rng.uniform(1, 40, 500), 2)
    df = spark.createDataFrame(pd.DataFrame({"a": "x", "o": [f"{i:04d}" for i in range(500)], "need": need})).withColumns(
        {"cash": F.lit(300.0), "limit": F.lit(10_000)})
    got = ledger.greedy_accept(df, ["a"], ["o"], lookahead=4).filter("accepted").toPandas()["o"].tolist()
    left, want = 300.0, []
    for k, x in enumerate(need):
        if x <= left:
            left -= x
            want.append(f"{k:04d}")
    assert sorted(got) == want
