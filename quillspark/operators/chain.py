"""Answers of a chain of services: each row goes from hop to hop until one answers.

A hop gets all rows of an Arrow batch that are still open, in one call, and gives an answer or an error for
each. A hop that is switched off is passed over with its reason. An unreachable one (no connection, no
authorisation) is not tried again. Where only the JSON mode failed the row is asked once more without it,
before it goes on to the next hop. A row that no hop answers keeps every hop's error, in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame

CLOUD, LOCAL = "云端", "本地"


class Unreachable(Exception):
    """The service cannot be reached or refuses the caller: another try would wait for nothing."""


@dataclass(frozen=True)
class Hop:
    """call(prompts, json_mode) gives a list with a string or an exception for each prompt."""

    name: str
    call: Callable[[list[str], bool], list]
    source: str = CLOUD
    json_mode: bool = False
    off: str | None = None  # why it is switched off


def _asked(hop: Hop, prompts: list[str], json_mode: bool) -> list:
    """One call; an exception of the whole call is every row's."""
    if not prompts:
        return []
    try:
        out = list(hop.call(prompts, json_mode))
    except Exception as error:
        return [error] * len(prompts)
    if len(out) != len(prompts):
        return [ValueError(f"{len(out)} answers to {len(prompts)} prompts")] * len(prompts)
    return out


def answers(prompts: list[str | None], hops: list[Hop]) -> list[tuple[str | None, str | None, str | None, str | None]]:
    """answer, hop, source, errors of each prompt; null prompts have none of them."""
    done: list = [(None, None, None, None)] * len(prompts)
    errors: list[list[str]] = [[] for _ in prompts]
    left = [i for i, p in enumerate(prompts) if p is not None]
    for hop in hops:
        if hop.off is not None:
            for i in left:
                errors[i].append(f"{hop.name}: {hop.off}")
            continue
        got = dict(zip(left, _asked(hop, [prompts[i] for i in left], hop.json_mode), strict=True))
        if hop.json_mode:
            plain = [i for i in left if isinstance(got[i], Exception) and not isinstance(got[i], Unreachable)]
            got |= dict(zip(plain, _asked(hop, [prompts[i] for i in plain], False), strict=True))
        for i in left:
            if isinstance(got[i], Exception):
                errors[i].append(f"{hop.name}: {got[i]}")
            else:
                done[i] = (got[i], hop.name, hop.source, "；".join(errors[i]) or None)
        left = [i for i in left if isinstance(got[i], Exception)]
    for i in left:
        done[i] = (None, None, None, "；".join(errors[i]))
    return done


def answered(rows: DataFrame, prompt: Column, hops: list[Hop]) -> DataFrame:
    """rows with answer, hop, source and errors; a row without an answer was given up by every hop."""
    added = ["answer", "hop", "source", "errors"]
    rest = [c for c in rows.columns if c.lower() not in added]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for batch in batches:
            got = answers(batch.column(batch.num_columns - 1).to_pylist(), hops)
            cols = zip(*got, strict=True) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.string()) for c in cols)], names=[*rest, *added])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), *(f"{c} string" for c in added)])
    return rows.select(*rest, prompt.cast("string").alias("_prompt")).mapInArrow(run, schema)
