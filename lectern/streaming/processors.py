"""State per key for streams.

All processors see rows as ``at`` (event time in microseconds, a long, so no time zone gets in the
way) and ``row`` (the whole record as JSON text). Rows of one key within one micro-batch count in
event-time order whatever order they arrive in.

A call of a processor and each of its reads and writes of state cost milliseconds, so the keys are dealt out to
buckets (``Bucketed``), and a call handles all keys of a bucket by columns.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000_000
#: A time that no clock reaches, and a day before all others.
NEVER, NO_DAY = 1 << 62, -(1 << 62)
#: The column with the rows of a bucket, and the types of columns in it and in state values.
CELL = "cell"
KINDS = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
#: Types whose JSON text is known here, so that such columns need not travel as text.
TEXTS = re.compile(r"string|bigint|int|boolean|timestamp_ntz|decimal\(\d+,\d+\)")
#: Bytes of rows that a task deals out together: the more, the more rows a cell has, and the fewer cells there are.
DEAL_BYTES = 16 << 20


def _instant(at: pd.Series) -> pd.Series:
    return pd.to_datetime(at, unit="us", utc=True)


def whole(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of a call; what ``dealt`` has put into cells is taken out of them."""
    frame = pd.concat(list(rows), ignore_index=True)
    if CELL not in frame:
        return frame
    tables = [pa.ipc.open_stream(bytes(cell)).read_all() for cell in frame[CELL]]
    return _columns(pa.concat_tables(tables))


def _columns(table: pa.Table) -> pd.DataFrame:
    """Columns as a processor sees them: text as objects, nulls of text as None, numbers with nulls as floats."""
    return pd.DataFrame({c: pd.Series(table[c].to_numpy(), dtype=object if pa.types.is_string(table.schema.field(c).type) else None)
                         for c in table.column_names})


def dealt(frame: pd.DataFrame, kinds: dict[str, str]) -> pd.DataFrame:
    """The rows of each bucket as one cell, an Arrow table: a row of its own costs a conversion on its way to a processor."""
    frame = frame.sort_values("bucket", kind="stable")
    buckets = frame["bucket"].to_numpy()
    table = pa.table({c: pa.array(frame[c], KINDS[t], from_pandas=True) for c, t in kinds.items()})
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else buckets
    cells = [_ipc(table.slice(a, b - a)) for a, b in zip(starts, np.append(starts, len(buckets))[1:], strict=True)]
    return pd.DataFrame({"bucket": buckets[starts], CELL: pd.Series(cells, dtype=object)})


def numbered(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """A number for each row's key, from 0; nulls are keys like any other."""
    out = np.zeros(len(frame), np.int64)
    for k in keys:
        codes, values = pd.factorize(frame[k], use_na_sentinel=False)
        out = pd.factorize(out * max(1, len(values)) + codes)[0]
    return out


def in_order(frame: pd.DataFrame, n: np.ndarray) -> np.ndarray:
    """Positions of the rows by number, time and text; rows without time come last. Texts are long and seldom decide, so
    only those of one number and time are compared."""
    at = frame["at"].to_numpy()
    if at.dtype.kind == "f":
        at = np.where(np.isnan(at), np.inf, at)
    return _in_order(n, at, lambda tied: frame["row"].to_numpy()[tied])


def _in_order(n: np.ndarray, at: np.ndarray, text: Callable[[np.ndarray], list]) -> np.ndarray:
    order = np.lexsort((at, n))
    by_n, by_at = n[order], at[order]
    same = (by_n[1:] == by_n[:-1]) & (by_at[1:] == by_at[:-1])
    tied = np.flatnonzero(np.append(False, same) | np.append(same, False)) if len(order) else order
    if len(tied):
        texts = pd.DataFrame({"n": by_n[tied], "at": by_at[tied], "row": text(order[tied])})
        order[tied] = order[tied][texts.sort_values(["n", "at", "row"]).index.to_numpy()]
    return order


def least(frame: pd.DataFrame, n: np.ndarray) -> pd.DataFrame:
    """The first row of each number by time and text."""
    order = in_order(frame, n)
    return frame.iloc[order[~pd.Series(n[order]).duplicated().to_numpy()]]


def greatest(frame: pd.DataFrame, n: np.ndarray) -> pd.DataFrame:
    """The last row of each number by time and text."""
    order = in_order(frame, n)
    return frame.iloc[order[~pd.Series(n[order]).duplicated(keep="last").to_numpy()]]


def earliest_per_day(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The first row of each key and day within one chunk."""
    by = frame[keys].assign(_day=frame["at"] // DAY)
    return least(frame, numbered(by, [*keys, "_day"])).reset_index(drop=True)


def first_rows(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """``earliest_per_day`` plus the chunk's last row, so that the watermark moves as with all rows."""
    last = frame.loc[[frame["at"].idxmax()]] if len(frame) else frame
    return pd.concat([earliest_per_day(frame, keys), last], ignore_index=True)


def marked(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The rows without event time, and a mark: a row without keys that has the latest row's."""
    if not len(frame):
        return frame.assign(event_ts=pd.Series([], dtype="datetime64[us, UTC]"))
    mark = frame.loc[[frame["at"].idxmax()]].assign(**{k: None for k in keys}, row="")
    both = pd.concat([frame.assign(event_ts=pd.NaT), mark.assign(event_ts=_instant(mark["at"]))], ignore_index=True)
    return both.assign(event_ts=pd.to_datetime(both["event_ts"], utc=True))


def marked_cells(cells: pd.DataFrame, at: pd.Series, kinds: dict[str, str]) -> pd.DataFrame:
    """The cells without event time, and a mark: an empty cell that has the latest row's."""
    mark = pd.DataFrame({"bucket": cells["bucket"].iloc[:1], CELL: [_ipc(pa.table({c: pa.array([], KINDS[t]) for c, t in kinds.items()}))] * min(1, len(cells))})
    times = pd.concat([pd.Series(pd.NaT, index=range(len(cells))), pd.Series([at.max()] * len(mark)).pipe(_instant)])
    both = pd.concat([cells, mark], ignore_index=True)
    return both.assign(event_ts=pd.to_datetime(pd.Series(times.to_numpy(), dtype=object), utc=True))


def latest_per_key(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The greatest version of each key within one chunk; of equal ones the later row."""
    ordered = frame.sort_values("at", kind="stable", ignore_index=True)
    return ordered.drop_duplicates(keys, keep="last", ignore_index=True)


class Payload:
    """A row's columns besides key and time on their way through keyed state: each in its own type, or, where the JSON text
    of a type is not known here, all of them as one JSON text. Rows of one time are in the order of their JSON texts."""

    def __init__(self, dtypes: list[tuple[str, str]], prefix: str) -> None:
        self.fields = [name for name, _ in dtypes]
        self.plain = bool(dtypes) and all(TEXTS.fullmatch(kind) for _, kind in dtypes)
        self.kinds = {f"{prefix}{i}": kind for i, (_, kind) in enumerate(dtypes)} if self.plain else {prefix: "string"}
        self.names = list(self.kinds)

    def texts(self, table: pa.Table) -> list:
        """The JSON texts that Spark writes for the rows; null columns are left out."""
        if not self.plain:
            return table[self.names[0]].to_pylist()
        columns = [_json_texts(field, table[name]) for field, name in zip(self.fields, self.names, strict=True)]
        return ["{" + ",".join(c for c in cells if c is not None) + "}" for cells in zip(*columns, strict=True)]


def _json_texts(field: str, column: pa.ChunkedArray) -> list:
    kind, name = column.type, json.dumps(field, ensure_ascii=False)
    if pa.types.is_boolean(kind):
        text = {True: "true", False: "false"}.get
    elif pa.types.is_string(kind):
        text = lambda v: json.dumps(v, ensure_ascii=False)
    elif pa.types.is_timestamp(kind):
        text = lambda v: f'"{v.isoformat(timespec="microseconds")}"'
    else:
        text = str
    return [None if v is None else f"{name}:{text(v)}" for v in column.to_pylist()]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches as tables of about ``DEAL_BYTES``."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= DEAL_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def cells_of(table: pa.Table, schema: pa.Schema, mark: bool = False) -> pa.RecordBatch:
    """``dealt`` for a table -> ``bucket, cell, mark``: with ``mark`` an empty cell more, which has the latest row's time. A cell
    is a record batch without its schema, which the reader has, as a stream of its own costs many times as much."""
    buckets = table["bucket"].to_numpy()
    order = np.argsort(buckets, kind="stable")
    buckets, rows = buckets[order], table.select(schema.names).take(order).cast(schema).combine_chunks().to_batches()
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else np.array([], np.int64)
    cells = [rows[0].slice(a, b - a).serialize().to_pybytes() for a, b in zip(starts, np.append(starts, len(buckets))[1:], strict=True)]
    buckets, marks = buckets[starts].tolist(), [None] * len(cells)
    if mark and cells:
        buckets, cells, marks = [*buckets, buckets[0]], [*cells, rows[0].slice(0, 0).serialize().to_pybytes()], [*marks, pc.max(table["at"]).as_py()]
    return pa.record_batch({"bucket": pa.array(buckets, pa.int32()), CELL: pa.array(cells, pa.binary()), "mark": pa.array(marks, pa.int64())})


def table_of(rows: Iterator[pd.DataFrame], schema: pa.Schema) -> pa.Table:
    """The rows of a call whose cells ``cells_of`` has made."""
    cells = [pa.ipc.read_record_batch(pa.py_buffer(cell), schema) for frame in rows for cell in frame[CELL]]
    return pa.Table.from_batches(cells, schema).combine_chunks()


def numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    """``numbered`` for a table: numbers are given in the order in which keys first come."""
    out = np.zeros(table.num_rows, np.int64)
    for i, k in enumerate(keys):
        column = table[k].combine_chunks()
        codes = (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).dictionary_encode(null_encoding="encode")
        here = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = pd.factorize(out * max(1, len(codes.dictionary)) + here)[0].astype(np.int64) if i else here
    return out


def times(table: pa.Table, none: int) -> np.ndarray:
    """The column ``at`` with ``none`` for nulls."""
    return pc.fill_null(table["at"], none).to_numpy()


def greatest_of(table: pa.Table, n: np.ndarray, payload: Payload) -> np.ndarray:
    """``greatest`` for a table: the positions of the rows, by number."""
    order = _in_order(n, times(table, NEVER), lambda tied: payload.texts(table.take(tied)))
    return order[np.append(n[order][1:] != n[order][:-1], True)] if len(order) else order


def typed(rows: pa.Table | pa.RecordBatch, types: dict[str, pa.DataType]) -> pa.Table | pa.RecordBatch:
    """The rows with those columns in those types."""
    return type(rows).from_arrays([rows.column(c).cast(types[c]) if c in types else rows.column(c) for c in rows.schema.names], rows.schema.names)


def window_cells(table: pa.Table, size: int, keys: list[str], sums: list[str]) -> pa.RecordBatch:
    """The sums per window of that size, part and key of a chunk (``at, part``, keys and measures), as one row per window and
    part: the part, the latest time, and a list per column."""
    at = table["at"].to_numpy()
    table = table.append_column("start", pa.array(at - at % size))
    table = table.group_by(["start", "part", *keys], use_threads=False).aggregate([("at", "max"), *[(c, "sum") for c in sums]])
    start, part = table["start"].to_numpy(), table["part"].to_numpy()
    order = np.lexsort((part, start))
    start, part, table = start[order], part[order], table.take(order).combine_chunks()
    begins = np.flatnonzero(np.append(True, (start[1:] != start[:-1]) | (part[1:] != part[:-1]))) if len(start) else start
    offsets = pa.array(np.append(begins, len(start)).astype(np.int32))
    columns = {c: pa.ListArray.from_arrays(offsets, table[name].chunk(0)) for c, name in [*[(k, k) for k in keys], *[(c, f"{c}_sum") for c in sums]]}
    latest = np.maximum.reduceat(table["at_max"].to_numpy(), begins) if len(begins) else start
    return pa.record_batch({"part": pa.array(part[begins], pa.int32()), "at": pa.array(latest, pa.int64()), **columns})


def window_sums(batch: pa.RecordBatch, keys: list[str], sums: list[str]) -> pa.Table:
    """The rows of closed windows (``stt, edt``, lists of the cells' lists) taken apart and summed per window and key."""
    cells = {c: batch.column(c).flatten() for c in (*keys, *sums)}  # the lists of all rows' cells
    whose = batch.column(keys[0] if keys else sums[0]).value_parent_indices().to_numpy()
    whose = whose[cells[keys[0] if keys else sums[0]].value_parent_indices().to_numpy()]
    rows = pa.table({"stt": batch.column("stt").take(pa.array(whose)), "edt": batch.column("edt").take(pa.array(whose)), **{c: v.flatten() for c, v in cells.items()}})
    found = rows.group_by(["stt", "edt", *keys], use_threads=False).aggregate([(c, "sum") for c in sums])
    return found.rename_columns([c.removesuffix("_sum") if c not in ("stt", "edt", *keys) else c for c in found.column_names])


def with_columns(table: pa.Table, **columns: np.ndarray) -> pa.Table:
    for name, values in columns.items():
        at = table.column_names.index(name) if name in table.column_names else None
        table = table.append_column(name, pa.array(values)) if at is None else table.set_column(at, name, pa.array(values))
    return table


def frame_of(table: pa.Table) -> pd.DataFrame:
    """What a processor gives back, without a Python object per cell."""
    return table.combine_chunks().to_pandas(types_mapper=pd.ArrowDtype)


def packed(columns: dict[str, str], frame: pd.DataFrame) -> tuple:
    """Entries as a state value: an Arrow table in one cell, since each cell of a value costs a conversion, and a null
    whose type names the columns for readers."""
    return _ipc(pa.table({c: pa.array(frame[c], KINDS[t], from_pandas=True) for c, t in columns.items()})), None


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def packed_type(columns: dict[str, str]) -> str:
    return f"entries binary, columns struct<{', '.join(f'{c}: {t}' for c, t in columns.items())}>"


def unpacked(columns: dict[str, str], value: tuple | None) -> pd.DataFrame:
    """The entries of a state value; nulls of text are None."""
    if value is None:
        return pd.DataFrame({c: pd.Series([], dtype={"bigint": "int64", "boolean": "bool"}.get(t, "object")) for c, t in columns.items()})
    table = pa.ipc.open_stream(bytes(value[0])).read_all()
    return pd.DataFrame({c: pd.Series(table[c].to_numpy(), dtype=object if t == "string" else None) for c, t in columns.items()})


class Bucketed(StatefulProcessor):
    """Keys that share a bucket, the grouping column, share a state value, a table with an entry per key
    (``state_rows`` shows them by key). A bucket has one timer, for the key that is due first."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def _value(self, handle: StatefulProcessorHandle, name: str, columns: str):
        """The state value of that name, whose entries have the keys and ``columns``."""
        self.kinds = {**dict.fromkeys(self.keys, "string"), **dict(c.split(" ", 1) for c in columns.split(", "))}
        self.columns = list(self.kinds)
        return handle.getValueState(name, packed_type(self.kinds))

    def _held(self, state) -> pd.DataFrame:
        return unpacked(self.kinds, state.get())

    def _held_table(self, state, like: pa.Table | None = None) -> pa.Table | None:
        """The entries as a table; where there are none, an empty one with the columns of ``like``."""
        value = state.get()
        if value is not None:
            return pa.ipc.open_stream(bytes(value[0])).read_all().combine_chunks()
        if like is None:
            return None
        return pa.table({c: pa.array([], like.schema.field(c).type if c in like.column_names else KINDS[t]) for c, t in self.kinds.items()})

    def _keep_table(self, state, table: pa.Table) -> None:
        if table.num_rows:
            state.update((_ipc(table.select(self.columns).combine_chunks()), None))
        elif state.exists():
            state.clear()

    def _keep(self, state, frame: pd.DataFrame) -> None:
        if len(frame):
            state.update(packed(self.kinds, frame))
        elif state.exists():
            state.clear()

    def _wake(self, handle: StatefulProcessorHandle, before: pd.Series, after: pd.Series) -> None:
        """Move the bucket's timer from the least time of ``before`` to that of ``after``."""
        old, new = (int(due.min()) if len(due) else NEVER for due in (before, after))
        if old != new:
            if old != NEVER:
                handle.deleteTimer(old)
            if new != NEVER:
                handle.registerTimer(new)

    def close(self) -> None:
        pass


def _forget_at(day):
    """When the clock is a full day past a day."""
    return (day + 2) * DAY // 1000


class DailyFirst(Bucketed):
    """The first row of each key on each day later than the last one seen; older days are dropped.

    ``last_day`` in the output is the key's last day before (null: never seen). With ``forget`` the
    state of a key goes away once the watermark is a full day past it. Without ``event_time`` the output
    has none, and rows without key are marks that only move the clock.
    """

    plain = "at bigint, row string, last_day bigint"
    output = plain + ", event_ts timestamp"

    def __init__(self, keys: list[str], forget: bool = True, event_time: bool = True) -> None:
        super().__init__(keys)
        self.forget, self.event_time = forget, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = self._value(handle, "last_day", "day bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = whole(rows)
        if not self.event_time:
            frame = frame[frame[self.keys[0]].notna()]
        if frame.empty:
            return
        held, first = self._held(self.last), earliest_per_day(frame[[*self.keys, "at", "row"]], self.keys)
        first["day"] = first["at"] // DAY
        both = pd.concat([held, first[self.columns]], ignore_index=True)
        n = numbered(both, self.keys)
        last = np.full(n.max() + 1, NO_DAY)
        last[n[: len(held)]] = held["day"]
        first["n"] = n[len(held) :]
        first = first[first["day"] > last[first["n"]]].sort_values(["n", "day"], ignore_index=True)
        if first.empty:
            return
        before = np.where(first["n"].duplicated(), first["day"].shift(fill_value=NO_DAY), last[first["n"]])
        np.maximum.at(last, first["n"].to_numpy(), first["day"].to_numpy())
        now = both.assign(day=last[n])[~pd.Series(n).duplicated()]
        self._keep(self.last, now)
        if self.forget:
            self._wake(self.handle, _forget_at(held["day"]), _forget_at(now["day"]))
        out = first[["at", "row"]].assign(last_day=pd.Series(before, dtype="Int64").mask(before == NO_DAY))
        yield out if not self.event_time else out.assign(event_ts=_instant(out["at"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held(self.last)
        kept = held[_forget_at(held["day"]) > timerValues.getCurrentWatermarkInMs()]
        self._keep(self.last, kept)
        self._wake(self.handle, _forget_at(held["day"]), _forget_at(kept["day"]))
        return iter([])


class FlagRepair(Bucketed):
    """The new-visitor flag, corrected by the key's first day."""

    output = "at bigint, is_new string, row string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = self._value(handle, "first_day", "day bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Only a key's very first micro-batch must be seen whole to find its earliest row.
        frame, held = whole(rows), self._held(self.first)
        frame = frame.iloc[in_order(frame, numbered(frame, self.keys))].reset_index(drop=True)
        here = frame[self.keys].assign(day=frame["at"] // DAY - (frame["is_new"] != "1"))
        both = pd.concat([held, here], ignore_index=True)
        n = numbered(both, self.keys)
        known = both[~pd.Series(n).duplicated()]  # numbers are given in this order
        if len(known) > len(held):
            self._keep(self.first, known)
        first = known["day"].to_numpy()[n[len(held) :]]
        wrong = (frame["is_new"] == "1") & (frame["at"] // DAY != first)
        yield frame[["at", "is_new", "row"]].assign(is_new=frame["is_new"].mask(wrong, "0"))


class BounceDetector(Bucketed):
    """Entry rows not followed, within the bound, by a row that is no entry."""

    output = "at bigint, row string"

    def __init__(self, keys: list[str], within_seconds: int) -> None:
        super().__init__(keys)
        self.bound = within_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = self._value(handle, "open_entry", "at bigint, row string")

    def _due(self, at):
        return -(-(at + self.bound) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = self._held(self.open)
        frame = whole(rows)[[*self.columns, "entry"]]
        frame = frame.iloc[in_order(frame, numbered(frame, self.keys))]
        frame = pd.concat([waiting.assign(entry=True), frame], ignore_index=True)
        frame["n"] = numbered(frame, self.keys)
        frame = frame.sort_values(["n", "at"], kind="stable", ignore_index=True)
        entry, last = frame["entry"].astype(bool), ~frame["n"].duplicated(keep="last")
        following = (frame["at"].shift(-1, fill_value=0) - frame["at"] < self.bound) & ~last
        went_on = following & ~entry.shift(-1, fill_value=True)
        now = frame[entry & last]
        self._keep(self.open, now)
        self._wake(self.handle, self._due(waiting["at"]), self._due(now["at"]))
        bounced = frame[entry & ~went_on & ~last]
        if len(bounced):
            yield bounced[["at", "row"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self._held(self.open)
        over = self._due(waiting["at"]) <= timerValues.getCurrentWatermarkInMs()
        self._keep(self.open, waiting[~over])
        self._wake(self.handle, self._due(waiting["at"]), self._due(waiting["at"][~over]))
        yield waiting.loc[over, ["at", "row"]]


class FirstLogin(Bucketed):
    """The earliest row of a key and day, held back for a while so that an earlier row can still win.

    ``due`` in the state is when a row goes out, and once it is sent, when its day is forgotten.
    """

    output = "at bigint, row string"

    def __init__(self, keys: list[str], hold_seconds: int = 10) -> None:
        super().__init__(keys)
        self.hold = hold_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = self._value(handle, "days", "day bigint, at bigint, row string, due bigint, sent boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = whole(rows)
        frame = frame[frame[self.keys[0]].notna()]  # marks only move the clock
        if frame.empty:
            return iter([])
        held, by = self._held(self.days), [*self.keys, "day"]
        here = earliest_per_day(frame[[*self.keys, "at", "row"]], self.keys)
        here["day"], here["due"], here["sent"] = here["at"] // DAY, -(-(here["at"] + self.hold) // 1000), False
        both = pd.concat([held, here[self.columns]], ignore_index=True) if len(held) else here[self.columns]
        n = numbered(both, by)
        before = ~pd.Series(n).duplicated().to_numpy()  # a day that is held keeps its time and whether it is sent
        due, sent = both["due"].to_numpy()[before], both["sent"].to_numpy()[before]
        open_or_held = ~sent[n] | before  # a day that is sent keeps its row
        now = least(both.assign(due=due[n], sent=sent[n])[open_or_held], n[open_or_held])
        self._keep(self.days, now)
        self._wake(self.handle, held["due"], now["due"])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock, held = timerValues.getCurrentWatermarkInMs(), self._held(self.days)
        over = held["due"] <= clock
        out = held[over & ~held["sent"]]
        # a day that was sent is remembered until the clock is a full day past it, as the key's rows see it
        n = numbered(held, self.keys)
        seen = np.full(n.max() + 1 if len(n) else 0, NO_DAY)
        np.maximum.at(seen, n[over], held.loc[over, "due"].to_numpy())
        until, new = _forget_at(held["day"]), over & ~held["sent"]
        gone = (held["sent"] | (new & (held["due"] < seen[n]))) & (until <= seen[n])
        now = held.assign(row=held["row"].mask(new, ""), sent=held["sent"] | new, due=held["due"].mask(new, np.maximum(until, clock + 1)))[~gone]
        self._keep(self.days, now)
        self._wake(self.handle, held["due"], now["due"])
        if len(out):
            yield out[["at", "row"]]


class LatestVersion(StatefulProcessor):
    """Upsert compaction: waits a short time after the first version of a key, then emits the greatest.
    Of equal versions the later arrival stays."""

    output = "at bigint, row string"

    def __init__(self, hold_ms: int = 5_000, keep_ms: int = 60_000) -> None:
        self.hold_ms, self.keep_ms = hold_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "at bigint, row string, sent boolean", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get()
        best = (held[0], held[1]) if held else None
        for chunk in rows:
            top = chunk[["at", "row"]].sort_values("at", kind="stable").iloc[-1]
            here = (int(top["at"]), top["row"])
            best = here if best is None or here[0] >= best[0] else best
        self.best.update((*best, bool(held[2]) if held else False))
        if held is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.hold_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.best.get()
        if held is not None and not held[2]:
            self.best.update((held[0], held[1], True))
            yield pd.DataFrame({"at": [held[0]], "row": [held[1]]})

    def close(self) -> None:
        pass


class LatestByClock(Bucketed):
    """Upsert compaction by event time: the greatest version of a key, emitted once when the clock has passed the first
    micro-batch's earliest version by a while. What comes later counts for nothing, as the row is out already.

    Rows come and go as columns. Without ``keep_seconds`` a key is remembered for good; with it, that long after it was emitted.
    """

    def __init__(self, keys: list[str], payload: Payload, cell: pa.Schema, hold_seconds: int, keep_seconds: int | None = None) -> None:
        super().__init__(keys)
        self.payload, self.cell = payload, cell
        self.hold, self.keep = hold_seconds * 1_000_000, keep_seconds

    @property
    def output(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in {"at": "bigint", **self.payload.kinds}.items())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = self._value(handle, "best", f"{self.output}, sent boolean, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = table_of(rows, self.cell)  # marks, which only move the clock, are empty cells
        if not frame.num_rows:
            return iter([])
        row = [*self.keys, "at", *self.payload.names]
        held = self._held_table(self.best, frame.select(row))
        both = pa.concat_tables([held.select(row), frame.select(row)])
        n, size = numbers(both, self.keys), held.num_rows
        first = np.full(n.max() + 1, NEVER)
        np.minimum.at(first, n[size:], pc.fill_null(frame["first"], NEVER).to_numpy())
        # the state's keys come first and keep their numbers: a key that is held keeps its time, and its row if that is out
        due, sent = np.where(first == NEVER, NEVER, -(-(first + self.hold) // 1000)), np.zeros(len(first), bool)
        due[:size], sent[:size] = held["due"].to_numpy(), held["sent"].to_numpy()
        open_or_held = np.flatnonzero(~sent[n] | (np.arange(len(n)) < size))
        both, n = both.take(open_or_held), n[open_or_held]
        best = greatest_of(both, n, self.payload)
        self._keep_table(self.best, with_columns(both.take(best), sent=sent[n[best]], due=due[n[best]]))
        self._wake(self.handle, due[:size], due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held_table(self.best)
        if held is None:
            return
        clock, due, sent = timerValues.getCurrentWatermarkInMs(), held["due"].to_numpy(), held["sent"].to_numpy()
        over = due <= clock
        new, stay = over & ~sent, ~(over & sent)
        until = NEVER if self.keep is None else np.maximum(due + self.keep * 1000, clock + 1)
        now = with_columns(held, sent=sent | new, due=np.where(new, until, due))
        for c in self.payload.names:  # a row that is out is not needed any more
            now = now.set_column(now.column_names.index(c), c, pc.if_else(pa.array(new), pa.scalar(None, held[c].type), held[c]))
        now = now.filter(pa.array(stay))
        self._keep_table(self.best, now)
        self._wake(self.handle, due, now["due"].to_numpy())
        if new.any():
            yield frame_of(held.filter(pa.array(new)).select(["at", *self.payload.names]))


def greatest_and_first(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The greatest version of each key within one chunk, and the time of its earliest."""
    first = frame.groupby(keys, dropna=False)["at"].transform("min") if len(frame) else frame["at"]
    return greatest(frame.assign(first=first), numbered(frame, keys)).reset_index(drop=True)


def greatest_and_first_of(table: pa.Table, keys: list[str], payload: Payload) -> pa.Table:
    """``greatest_and_first`` for a table."""
    n = numbers(table, keys)
    first = np.full(n.max() + 1 if len(n) else 0, NEVER)
    np.minimum.at(first, n, times(table, NEVER))
    best = greatest_of(table, n, payload)
    first = first[n[best]]
    return table.take(best).append_column("first", pa.array(first, mask=first == NEVER))


# Executors get these classes with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
