"""Maps of keyed state, read once a batch and written back by their differences."""

from __future__ import annotations

from pyspark.sql.streaming.stateful_processor import MapState


def read_map(state: MapState) -> dict:
    """The map as a dict; keys and values of one field are plain."""
    plain = lambda x: x[0] if len(x) == 1 else tuple(x)
    return {plain(k): plain(v) for k, v in state.iterator()} if state.exists() else {}


def write_map(state: MapState, before: dict, after: dict) -> None:
    wrap = lambda x: x if isinstance(x, tuple) else (x,)
    for k in before.keys() - after.keys():
        state.removeKey(wrap(k))
    for k, v in after.items():
        if k not in before or before[k] != v:
            state.updateValue(wrap(k), wrap(v))
