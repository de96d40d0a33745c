"""Prefix combinations of small states over ordered blocks, without a task or a driver that gets all of them."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: States that one task combines; more of them are combined level by level.
FAN = 1024

STATE = "i long, state binary"


def carries(table: DataFrame, combine: Callable, backward: bool = False) -> DataFrame:
    """(i, carry): for each (i, state) the combination of all states before it, or after it; a pickled None where there are none.

    combine(left, right) is associative, on unpickled states in the order of i.
    """
    fan, levels = FAN, [cut(table.select("i", "state"), "level")]
    top = levels[0].agg(F.max("i")).first()[0]
    while top is not None and top >= fan:
        top //= fan
        levels.append(cut(levels[-1].groupBy(F.expr(f"i div {fan}").alias("g")).applyInPandas(lambda f: _combined(f, combine, fan), STATE), "level"))

    def down(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i", ascending=not backward)
        held, out = pickle.loads(frame["carry"].iloc[0]) if "carry" in frame else None, []
        for state in frame["state"]:
            out.append(pickle.dumps(held))
            own = pickle.loads(state)
            held = own if held is None else combine(own, held) if backward else combine(held, own)
        return pd.DataFrame({"i": frame["i"], "state": out})

    carry = levels.pop().groupBy(F.lit(0).alias("g")).applyInPandas(down, STATE)
    while levels:
        level = levels.pop().withColumn("g", F.expr(f"i div {fan}")).join(carry.select(F.col("i").alias("g"), F.col("state").alias("carry")).hint("merge"), "g")
        carry = level.groupBy("g").applyInPandas(down, STATE)
    return cut(carry.select("i", F.col("state").alias("carry")), "carries")


def _combined(frame: pd.DataFrame, combine: Callable, fan: int) -> pd.DataFrame:
    frame, held = frame.sort_values("i"), None
    for state in frame["state"]:
        own = pickle.loads(state)
        held = own if held is None else combine(held, own)
    return pd.DataFrame({"i": [frame["i"].iloc[0] // fan], "state": [pickle.dumps(held)]})
