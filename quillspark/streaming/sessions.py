"""Session state over a stream of turns: last messages and the escalation window of each session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config as C
from ..operators.safety import any_of

OUT = "conv_id long, turn long, history_size int, escalated boolean"
STATE = "roles array<string>, weak array<int>"


@C.configured
def session_states(turns: DataFrame, weak=C.WEAK_SIGNALS, rounds: int = C.setting("escalation_rounds"), messages: int = C.setting("history_rounds", 2)) -> DataFrame:
    """Per turn: size of the kept history after it, and whether the user's turns before escalate it.

    The weak-signal test runs in the plan; the state holds the last `messages` roles and the last
    `rounds` user signals. A session's turns of one micro-batch are taken together, in turn order, however
    many Arrow batches bring them.
    """
    marked = turns.select("conv_id", "turn", "role", F.coalesce(F.col("text").rlike(any_of(weak)), F.lit(False)).cast("int").alias("weak"))

    def step(key, batches, state: GroupState):
        roles, signals = (list(x) for x in state.get) if state.exists else ([], [])
        new = pd.concat(list(batches)).sort_values("turn", kind="stable")
        user = (new["role"] == "user").to_numpy()
        weak = np.concatenate([np.array(signals, np.int64), new["weak"].to_numpy()[user]])
        before = len(signals) + np.cumsum(user) - user  # user signals known before each turn
        run = np.concatenate([[0], np.cumsum(weak)])
        up = user & (before >= rounds) & (run[before] - run[np.maximum(before - rounds, 0)] == rounds)
        size = np.minimum(len(roles) + 1 + np.arange(len(new)), messages)
        state.update(([*roles, *new["role"]][-messages:], weak[len(weak) - min(rounds, len(weak)) :].tolist()))
        yield pd.DataFrame({"conv_id": key[0], "turn": new["turn"].to_numpy(), "history_size": size.astype(np.int32), "escalated": up})

    return marked.groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(source: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Run a streaming frame over what is there now and stop."""
    q = source.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
