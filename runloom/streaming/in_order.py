"""Keyed state over events that may come late: each key's events are numbered, and one waits for those before it.

State is kept as JSON text, so that one helper serves every operator; what is kept is the operator's own state and the events that
still wait. Batches may be any cut of the stream: the rows are those of the batch twins.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from runloom.shipping import by_value

by_value(sys.modules[__name__])

#: step(state, event) -> (state, rows); an event is a dict of a row's columns.
Step = Callable[[dict, dict], tuple[dict, list[dict]]]


def ready(state: dict, events: list[dict], number: str, first: int) -> tuple[dict, list[dict]]:
    """The events that may be worked off, in order, with those that waited; the others stay in ``state``. An event seen before counts once."""
    waiting = {int(k): v for k, v in state.get("waiting", {}).items()}
    nxt = state.get("next", first)
    for e in events:
        if int(e[number]) >= nxt:
            waiting.setdefault(int(e[number]), e)
    out = []
    while nxt in waiting:
        out.append(waiting.pop(nxt))
        nxt += 1
    return state | {"next": nxt, "waiting": {str(k): v for k, v in waiting.items()}}, out


def worker(key: str, number: str, step: Step, start: dict, columns: list[str], first: int, timeout_ms: int | None, late: Step | None) -> Callable:
    """What Spark calls with the rows of a key and its state."""

    def work(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"own": start}
        rows: list[dict] = []
        if state.hasTimedOut:
            if late is not None:
                _, rows = late(kept["own"], {})
            state.remove()
        else:
            got = [{k: (None if pd.isna(v) else v.item() if hasattr(v, "item") else v) for k, v in r.items()} for b in batches for r in b.to_dict("records")]
            kept, todo = ready(kept, got, number, first)
            own = kept["own"]
            for e in todo:
                own, some = step(own, e)
                rows += some
            state.update((json.dumps(kept | {"own": own}),))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([{key: group[0], **r} for r in rows], columns=columns)

    return work


def keyed(events: DataFrame, key: str, number: str, step: Step, start: dict, schema: str, columns: list[str], first: int = 1, timeout_ms: int | None = None, late: Step | None = None) -> DataFrame:
    """Rows of ``step`` over the events of each key, in order of ``number`` from ``first``, on a stream. Where ``timeout_ms`` is given and
    nothing comes for so long, ``late`` (state, {}) is asked once for rows, and the key's state goes."""
    work = worker(key, number, step, start, columns, first, timeout_ms, late)
    return events.groupBy(key).applyInPandasWithState(work, schema, "kept string", "append", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")
