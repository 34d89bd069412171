"""Live request and reply correlation (ST4)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from warden.operators.frames import KEY, Slot
from warden.streaming.ordering import in_order

#: Ids are dealt to so many shares by default; a share is what one call of the processor sees and one state value.
SHARES = 512
#: Frames that a task packs before it hands them on, and frames of a share and micro-batch that are put in order in memory;
#: more of them go through sorted runs on disk.
PACKED = 1_000_000
ORDERED = 500_000
#: Settled frames of a block.
BLOCK = 10_000
_OUT = (("session_id", "string"), ("id", "string"), ("seq", "bigint"), ("kind", "string"), ("_at", "bigint"), ("status", "string"),
        ("request_seq", "bigint"), ("latency_us", "bigint"), ("expires", "bigint"))
OUTPUT = ", ".join(f"{name} {kind}" for name, kind in _OUT)
_STATE = "timer bigint, session_id array<string>, id array<string>, seq array<bigint>, at array<bigint>, off array<bigint>"
_KINDS = {"string": pa.string(), "bigint": pa.int64()}
_FRAME = pa.schema([("session_id", pa.string()), ("id", pa.string()), ("_at", pa.int64()), ("seq", pa.int64()), ("kind", pa.string())])
_SETTLED = pa.schema([(name, _KINDS[kind]) for name, kind in _OUT])
_BLOCK = Row("block")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames (share, ts, ...) as an Arrow block per share, with the moment of its last frame; what a task holds is bounded."""
    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("share").combine_chunks()
        share, frames = table["share"].to_numpy(), table.select(_FRAME.names).to_batches()[0]
        starts = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
        # Groups come in no order of their own.
        last = table.group_by("share", use_threads=False).aggregate([("ts", "max")]).sort_by("share")
        blocks = [frames.slice(a, b - a).serialize().to_pybytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(share)])]
        return pa.RecordBatch.from_arrays([last["share"].combine_chunks(), last["ts_max"].combine_chunks(),
                                           pa.array(blocks, pa.binary())], ["share", "ts", "block"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= PACKED:
            yield pack(held)
            held, size = [], 0
    if held:
        yield pack(held)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks of settled frames."""
    for batch in batches:
        for block in batch.column(0).to_pylist():
            yield pa.ipc.read_record_batch(pa.py_buffer(block), _SETTLED)


_ORDER = ("_at", "seq", "kind")


def _place(frame: tuple) -> tuple:
    """Where a frame (_at, seq, kind, ...) stands; null comes first."""
    return tuple((part is not None, part) for part in frame[:3])


def _runs(rows: Iterator[Row]) -> Iterator[list[tuple]]:
    """Frames of blocks as lists in order, of ``ORDERED`` at least but for the last."""
    held, size, more = [], 0, True
    while more:
        if pack := next(rows, None):
            held.append(pa.ipc.read_record_batch(pa.py_buffer(pack["block"]), _FRAME))
            size += held[-1].num_rows
        else:
            more = False
        if held and (size >= ORDERED or not more):
            table = pa.Table.from_batches(held).select([*_ORDER, *KEY])
            table = table.take(pc.sort_indices(table, [(c, "ascending") for c in _ORDER], null_placement="at_start"))
            yield list(zip(*[c.to_pylist() for c in table.columns]))
            held, size = [], 0


class Pending(StatefulProcessor):
    """A share of the ids: holds their accepted requests, and one timer for the moment at which the first expires."""

    def __init__(self, limit: int):
        self._limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("open", _STATE)

    def _load(self) -> tuple[dict[tuple, Slot], int | None]:
        held = self._state.get()
        if held is None:
            return {}, None
        return {(session, id_): Slot(self._limit, (session, id_, seq, "request", at), off)
                for session, id_, seq, at, off in zip(*held[1:])}, held[0]

    def _keep(self, slots: dict[tuple, Slot], timer: int | None) -> None:
        """Store what is open now; the timer of the first to expire replaces the one that was set."""
        held = [s for s in slots.values() if s.accepted]
        due = min((_due(s) for s in held), default=None)
        if timer is not None and timer != due:
            self._handle.deleteTimer(timer)
        if due is not None and timer != due:
            self._handle.registerTimer(due)
        if held:
            self._state.update((due, *[[s.accepted[i] for s in held] for i in (0, 1, 2, 4)], [s.called_off for s in held]))
        elif timer is not None:
            self._state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        slots, timer = self._load()
        out = []
        for at, seq, kind, session, id_ in in_order(_runs(rows), _place, ORDERED):
            name = session, id_
            slot = slots.get(name)
            if slot is None:
                slot = slots[name] = Slot(self._limit)
            out += slot.take((session, id_, seq, kind, at))
            if not slot.accepted:
                del slots[name]
            if len(out) >= BLOCK:
                yield from _rows(out)
                out = []
        yield from _rows(out)
        self._keep(slots, timer)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        slots, _ = self._load()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        yield from _rows([row for s in slots.values() for row in s.expired(now * 1000)])
        held = {name: s for name, s in slots.items() if s.accepted}
        # The timer that fired goes by itself.
        self._keep(held, None)
        if slots and not held:
            self._state.clear()

    def close(self) -> None:
        pass


def _due(slot: Slot) -> int:
    return -(-slot.expiry() // 1000)


def _rows(found: list[tuple]) -> Iterator[Row]:
    """Settled frames as Arrow blocks of some thousands."""
    for a in range(0, len(found), BLOCK):
        columns = [pa.array(values, kind) for values, kind in zip(zip(*found[a:a + BLOCK]), _SETTLED.types)]
        yield _BLOCK(pa.RecordBatch.from_arrays(columns, schema=_SETTLED).serialize().to_pybytes())


def paired(frames: DataFrame, timeout_seconds: int = 30, delay: str = "10 seconds", shares: int = SHARES) -> DataFrame:
    """ST4: status of every request, reply and cancellation of a live log, by the rule of operators.frames.paired.

    ``frames`` has session_id, id, ts (a timestamp), seq and kind. The state is one open request per (session_id, id). Ids
    are dealt to ``shares``, which must stay the same for as long as a checkpoint is used: a call of the processor, its
    state and its timer then cost once per share and micro-batch, not once per id, and a busy session still spreads over
    its ids. Frames of a share and micro-batch are taken in order, however many there are; a frame that comes in a later
    batch meets the state it finds. A request without a reply is given once the watermark, ``delay`` behind the latest frame,
    has passed its end. Null ids form an id of their own.
    """
    if timeout_seconds < 1:
        raise ValueError("the timeout is a second at least")
    share = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in KEY]), F.lit(shares)).cast("int")
    rows = frames.select(
        share.alias("share"), "ts", F.col("session_id").cast("string").alias("session_id"),
        F.col("id").cast("string").alias("id"), F.col("seq").cast("bigint").alias("seq"), "kind",
        F.unix_micros("ts").alias("_at"))
    packs = rows.mapInArrow(_packed, "share int, ts timestamp, block binary").withWatermark("ts", delay)
    settled = packs.groupBy("share").transformWithState(
        Pending(timeout_seconds * 1_000_000), "block binary", "Append", "EventTime")
    return settled.mapInArrow(_opened, OUTPUT).withColumn("ts", F.timestamp_micros("_at"))
