"""State by key, one rule for tables and streams: a machine takes a key's rows in order, holds a small state and gives rows.

On a table the rows are partitioned by key and sorted, and each task reads them once with one state at hand, however many rows a key has. On
a stream the state lives in the state store. Both start from saved states if there are any, and both can give the states they end with.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Machine:
    """What a key's state is and does.

    columns: what it reads of a row, after key and order. fresh(): the state of a new key, of what JSON can hold. step(state, row) changes the
    state and returns what the row gives, tuples of `gives`; row is (order value, *columns), null as None. key and order: names of columns.
    """

    columns: tuple[str, ...]
    gives: str
    fresh: Callable[[], dict]
    step: Callable[[dict, tuple], list[tuple]]
    key: str = "symbol"
    order: str = "ts"


STATES = "payload string, rows long, at string"


def _plain(value: Any) -> Any:
    """A cell as plain Python: null as None, arrays as lists, structs as dictionaries."""
    if type(value) in (int, str, bool):
        return value
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if value != value else value
    if hasattr(value, "tolist"):
        return [_plain(x) for x in value.tolist()] if getattr(value, "ndim", 0) else _plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return [_plain(x) for x in value]
    if isinstance(value, dict):
        return {k: _plain(x) for k, x in value.items()}
    return value


def _mark(value: Any) -> str:
    """An order value as text that sorts like it: times in ISO form, integers with a sign and leading zeros."""
    if isinstance(value, (dt.datetime, pd.Timestamp)):
        return pd.Timestamp(value).isoformat(timespec="nanoseconds")
    return f"{int(value) + (1 << 63):020d}"


def pack(state: dict) -> str:
    return json.dumps(state, separators=(",", ":"))


class _Held:
    """A key's state with the number of rows taken and the last order value."""

    def __init__(self, machine: Machine, payload: str | None = None, rows: int = 0, at: str = ""):
        self.machine, self.rows, self.at = machine, rows or 0, at or ""
        self.state = json.loads(payload) if payload else machine.fresh()

    def take(self, row: tuple) -> list[tuple]:
        mark = _mark(row[0])
        if mark < self.at:
            return []  # late
        self.rows, self.at = self.rows + 1, mark
        return self.machine.step(self.state, row)

    def saved(self) -> tuple[str, int, str]:
        return pack(self.state), self.rows, self.at


def _fields(schema: str) -> list[str]:
    return [f.name for f in T.StructType.fromDDL(schema).fields]


def _sorted(rows: DataFrame, machine: Machine, states: DataFrame | None, ties: tuple[str, ...]) -> DataFrame:
    """Rows by key in order; a key's saved state comes before its rows."""
    names = list(dict.fromkeys([machine.key, machine.order, *machine.columns, *ties]))
    blank = {f.name: f.dataType for f in T.StructType.fromDDL(STATES).fields}
    both = rows.where(F.col(machine.order).isNotNull()).select(*names, F.lit(1).alias("_kind"), *[F.lit(None).cast(t).alias(f"_{c}") for c, t in blank.items()])
    if states is not None:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        held = states.select(F.col("key").cast(kinds[machine.key]).alias(machine.key), *[F.lit(None).cast(kinds[c]).alias(c) for c in names if c != machine.key], F.lit(0).alias("_kind"), *[F.col(c).alias(f"_{c}") for c in blank])
        both = held.unionByName(both)
    return both.repartition(machine.key).sortWithinPartitions(machine.key, "_kind", machine.order, *ties)


def _walk(machine: Machine, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Any, _Held, list[tuple] | None]]:
    """(key, state, given) for each row; given is None once a key's rows are over."""
    key, held, none = None, None, object()
    last: Any = none
    for batch in batches:
        cells = [batch[c].tolist() for c in (machine.key, machine.order, *machine.columns, "_kind", "_payload", "_rows", "_at")]
        for key, *row, kind, payload, count, at in zip(*cells, strict=True):
            key = _plain(key)
            if last is none or key != last:
                if held is not None:
                    yield last, held, None
                held, last = _Held(machine), key
            if kind == 0:
                held = _Held(machine, payload, int(_plain(count) or 0), at)
            else:
                yield key, held, held.take(tuple(_plain(x) for x in row))
    if held is not None:
        yield last, held, None


def run(rows: DataFrame, machine: Machine, states: DataFrame | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """(key, *gives): what each row gives, in order of `order` and then of `ties`, columns of the rows.

    states (key, payload, rows, at): where keys go on from; a table only. A stream's state is restored by its own checkpoint. On a stream, rows of one batch
    are put in order; a row older than the last one taken is late and gives nothing. Rows without an order value give nothing; a null key is a key.
    """
    kind = rows.schema[machine.key].dataType.simpleString()
    schema = f"`{machine.key}` {kind}, {machine.gives}"
    names = [machine.key, *_fields(machine.gives)]

    if rows.isStreaming:
        if states is not None:
            raise ValueError("a stream goes on from its checkpoint")

        def grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            held = _Held(machine, *state.get) if state.exists else _Held(machine)
            batch = pd.concat(list(batches)).sort_values([machine.order, *ties], kind="stable")
            out = []
            for row in zip(*(list(batch[c]) for c in (machine.order, *machine.columns)), strict=True):
                if _plain(row[0]) is not None:
                    out += [(key[0], *x) for x in held.take(tuple(_plain(x) for x in row))]
            state.update(held.saved())
            yield pd.DataFrame(out, columns=names)

        return rows.groupBy(machine.key).applyInPandasWithState(grow, schema, STATES, "append", GroupStateTimeout.NoTimeout)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for key, _, given in _walk(machine, batches):
            out += [(key, *x) for x in given or ()]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return _sorted(rows, machine, states, ties).mapInPandas(fold, schema)


def end_states(rows: DataFrame, machine: Machine, states: DataFrame | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """(key string, payload, rows, at): the state of each key after its rows of a table, to be saved or looked into; keys with a saved state and no rows keep it."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = [(None if key is None else str(key), *held.saved()) for key, held, given in _walk(machine, batches) if given is None]
        yield pd.DataFrame(out, columns=["key", "payload", "rows", "at"])

    return _sorted(rows, machine, states, ties).mapInPandas(fold, f"key string, {STATES}")
