"""Taint of live sessions (ST1, ST2, ST6, ST7).

The state of a session is its category set and its last 32 sources. Only events
that matter, those with a source or a sink, reach the stateful operator; all others
keep their stateless decision in a map-only branch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from warden.operators.taint import KEY, enforce, first_seen, order_key, prior
from warden.streaming.ordering import in_order
from warden.vocab import CATEGORIES, MAX_SOURCES

OUTPUT = (
    "agent string, session_id string, call_id string, kind string, ts timestamp, seq bigint, effect string, rule_id string, "
    "sink string, prior array<string>, n_sources int, capability string, category string, severity string, policy_layer string"
)
#: What an event may carry besides, for the audit.
CARRIED = ("capability", "category", "severity", "policy_layer")
_ROW = Row(*[part.split()[0] for part in OUTPUT.split(", ")])
_STATE = "categories array<string>, sources array<string>, created timestamp, updated timestamp"
#: Events of one session and micro-batch that are put in order in memory; more of them go through sorted runs on disk.
ORDERED = 50_000


def _place(event: Row) -> tuple:
    return event["ts"], event["seq"]


def _runs(rows: Iterator[Row]) -> Iterator[list[Row]]:
    while part := sorted(islice(rows, ORDERED), key=_place):
        yield part


class SessionTaint(StatefulProcessor):
    """Emits every event with what its session had touched before; taint has no expiry.

    The events of a session and micro-batch come in order, however many there are; ``ORDERED`` of them are in memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("taint", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self._state.get() if self._state.exists() else None
        known = set(old[0]) if old else set()
        sources = list(old[1]) if old else []
        created, updated = (old[2], old[3]) if old else (None, None)
        before, changed = [c for c in CATEGORIES if c in known], False
        for e in in_order(_runs(rows), _place, ORDERED):
            yield _ROW(key[0], key[1], e["call_id"], e["kind"], e["ts"], e["seq"], e["effect"], e["rule_id"], e["sink"],
                       before, len(sources), *[e[c] for c in CARRIED])
            if e["source_categories"]:
                known.update(e["source_categories"])
                before, changed = [c for c in CATEGORIES if c in known], True
                created, updated = created or e["ts"], e["ts"]
                if e["source"] not in sources:
                    sources = [*sources, e["source"]][-MAX_SOURCES:]
        if changed:
            self._state.update((before, sources, created, updated))

    def close(self) -> None:
        pass


def stream(events: DataFrame) -> DataFrame:
    """ST1, ST2: enforced decisions of a live log of calls and results.

    ``events`` has agent, session_id, call_id, kind (pre or post), ts, seq,
    source_categories, source, sink, effect and rule_id, and may have the columns of CARRIED. Late events are decided with
    the state they meet, so there is no watermark; a repeated event changes nothing,
    since the union of categories is idempotent.
    """
    relevant = events.where("session_id is not null and (size(source_categories) > 0 or sink is not null)")
    columns = ["agent", "session_id", "call_id", "kind", "ts", "seq", "source_categories", "source", "sink", "effect", "rule_id"]
    carried = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in CARRIED]
    stated = (
        relevant.select(*columns, *carried).groupBy(*KEY)
        .transformWithState(SessionTaint(), OUTPUT, "Append", "None"))
    return enforce(stated)


def fold_batch(batch: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST1 without Python: one micro-batch joined with the stored first moments of its sessions.

    ``known`` has the columns of operators.taint.first_seen. Returns the events with
    their prior categories and the new first moments of the sessions of this batch that
    have any; the caller merges those rows into the stored ones by (agent, session_id). What was known before the batch
    counts for all of its events, however late; within the batch the order decides.
    """
    marks = [f"first_{c}" for c in CATEGORIES]
    here = batch.select(*KEY).where("session_id is not null").distinct()
    fresh = first_seen(batch)
    earlier = known.join(here, list(KEY), "left_semi")
    merged = earlier.unionByName(fresh).groupBy(*KEY).agg(*[F.min(m).alias(m) for m in marks])
    joined = (
        batch.withColumn("_order", order_key())
        .join(fresh, list(KEY), "left")
        .join(earlier.select(*KEY, *[F.col(m).alias(f"old_{m}") for m in marks]), list(KEY), "left"))
    touched = F.filter(
        F.array(*[F.when(F.col(f"old_first_{c}").isNotNull() | (F.col(f"first_{c}") < F.col("_order")), F.lit(c))
                  for c in CATEGORIES]), lambda c: c.isNotNull())
    return joined.withColumn("prior", touched).drop("_order", *marks, *[f"old_{m}" for m in marks]), merged


def once(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST6: audit rows of calls that are delivered again within the delay are written once."""
    return records.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["call"])


__all__ = ["SessionTaint", "fold_batch", "once", "prior", "stream"]
