"""Request and reply frames: pairs, orphans, timeouts, cancellations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from warden.functions import sql as S
from warden.functions.detectors import detect
from warden.functions.fields import ScanConfig, field_category
from warden.functions.sql import Sql
from warden.functions.variants import opened, unopened
from warden.operators.running import running_sum
from warden.vocab import CLIENT_METHODS, MAX_IDENTIFIER_BYTES, MAX_PENDING, SERVER_NOTIFICATIONS

KEY = ("session_id", "id")
#: A time bucket of an id is this many timeouts long.
BUCKET_TIMEOUTS = 64
FRAME = ("session_id", "id", "seq", "kind", "_at")
OUTCOME = ("status", "request_seq", "latency_us", "expires")


def frame_fields(text: Sql) -> Sql:
    """struct(valid, kind, id, method) of one frame; an id is an integer or a short text."""
    def fields(v: Sql) -> Sql:
        part = lambda path, kind: S.try_variant_get(v, path, kind)
        has = lambda path: part(path, "variant").isNotNull()
        kind_of = lambda path: S.schema_of_variant(part(path, "variant"))
        id_text = (kind_of("$.id") == "STRING") & (S.octet_length(part("$.id", "string")).__gt__(0)) & (
            S.octet_length(part("$.id", "string")) <= MAX_IDENTIFIER_BYTES)
        id_ok = (kind_of("$.id") == "BIGINT") | id_text
        method = S.when(kind_of("$.method") == "STRING", part("$.method", "string"))
        method_ok = method.isNotNull() & (method != "") & (S.octet_length(method) <= 128) & ~has("$.result") & ~has(
            "$.error") & (~has("$.params") | kind_of("$.params").startswith("OBJECT"))
        error_ok = ~has("$.error") | ((kind_of("$.error.code") == "BIGINT") & (kind_of("$.error.message") == "STRING"))
        reply_ok = ((has("$.result") & ~has("$.error")) | (has("$.error") & ~has("$.result"))) & has("$.id") & error_ok
        valid = S.coalesce(
            (part("$.jsonrpc", "string") == "2.0") & (~has("$.id") | id_ok) & S.when(
                has("$.method"), method_ok).otherwise(reply_ok), S.lit(False))
        kind = S.when(method == "notifications/cancelled", "cancel").when(method.isNotNull() & has("$.id"), "request").when(
            method.isNotNull(), "notification").otherwise("reply")
        return S.struct(
            valid.alias("valid"), kind.alias("kind"),
            S.when(kind == "cancel", S.to_json(part("$.params.requestId", "variant")))
            .otherwise(S.to_json(part("$.id", "variant"))).alias("id"), method.alias("method"))

    return S.let(S.try_parse_json(text), fields)


def read_frames(spark, path: str) -> DataFrame:
    """Newline-delimited frames of ``session_id=...`` folders; invalid ones keep valid = false."""
    return spark.read.text(path).withColumn("f", S.col(frame_fields(S.ref("value")))).select("*", "f.*").drop("f")


def runs(frames: DataFrame, timeout_seconds: int = 30) -> DataFrame:
    """Frames with ``_at`` and ``_run``, the place of the frame that begins their run.

    A reply leaves nothing open under its id, and neither does a pause as long as the
    timeout, so after either a new run begins and runs do not depend on each other. A
    frame's run is found inside its time bucket; one small row per bucket carries the
    last beginning over to later buckets. An id used over and over is thus spread over
    its buckets, then over its runs.
    """
    limit = timeout_seconds * 1_000_000
    spots = ["_id", "_bucket"]
    # As a struct, null sessions and ids are equal to each other in a join.
    rows = (
        frames.select(F.struct(*KEY).alias("_id"), "seq", "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
        .withColumn("_bucket", F.floor(F.col("_at") / F.lit(limit * BUCKET_TIMEOUTS))))
    order = Window.partitionBy(*spots).orderBy("_at", "seq", "kind")
    place, prev = F.struct("_at", "seq"), F.struct("kind", "_at")
    marked = rows.withColumn("_prev", F.lag(prev).over(order)).withColumn(
        "_begins", F.when((F.col("_prev.kind") == "reply") | (F.col("_at") - F.col("_prev._at") >= limit), place))
    found = marked.withColumn("_run", F.last("_begins", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = marked.groupBy(*spots).agg(
        F.min(place).alias("_head"), F.max(F.struct("_at", "seq", "kind")).alias("_tail"), F.max("_begins").alias("_begun"))
    along = Window.partitionBy("_id").orderBy("_bucket")
    ends = ends.withColumn("_left", F.lag("_tail").over(along))
    fresh = (F.col("_left").isNull() | (F.col("_left.kind") == "reply")
             | (F.col("_head._at") - F.col("_left._at") >= limit))
    carried = (
        ends.withColumn("_head", F.when(fresh, F.col("_head")))
        .withColumn("_carry", F.coalesce("_head", F.last(F.coalesce("_begun", "_head"), ignorenulls=True).over(
            along.rowsBetween(Window.unboundedPreceding, -1))))
        .select(*spots, "_carry"))
    return found.join(carried, spots).select("_id", "seq", "kind", "_at", F.coalesce("_run", "_carry").alias("_run"))


class Slot:
    """What one id has open: an accepted request (session_id, id, seq, kind, at), and when it was cancelled.

    The rule of ``paired``, frame by frame; batch and stream share it.
    """

    def __init__(self, limit: int, accepted: tuple | None = None, called_off: int | None = None):
        self.limit, self.accepted, self.called_off = limit, accepted, called_off

    def expiry(self) -> int:
        return (self.accepted[4] if self.called_off is None else self.called_off) + self.limit

    def _end(self, gone: int | None) -> tuple:
        row = *self.accepted, "unanswered" if self.called_off is None else "cancelled", None, None, gone
        self.accepted = self.called_off = None
        return row

    def expired(self, at: int | None = None) -> list[tuple]:
        """The row of a request whose time is over at a moment, or in any case without one."""
        over = self.accepted is not None and (at is None or at >= self.expiry())
        return [self._end(self.expiry())] if over else []

    def take(self, mine: tuple) -> list[tuple]:
        """The rows that one frame settles."""
        out, (seq, kind, at) = self.expired(mine[4]), mine[2:]
        if kind == "request" and self.accepted:
            out.append((*mine, "duplicate", None, None, None))
        elif kind == "request":
            self.accepted = mine
        elif kind == "cancel" and self.accepted and self.called_off is None:
            self.called_off = at
            out.append((*mine, "cancelled", self.accepted[2], None, None))
        elif kind == "cancel":
            out.append((*mine, "unknown_cancel", None, None, None))
        elif kind == "reply" and self.accepted and self.called_off is None:
            out.append((*self.accepted, "answered", None, None, None))
            out.append((*mine, "answered", self.accepted[2], at - self.accepted[4], None))
            self.accepted = None
        elif kind == "reply" and self.accepted:
            out.append(self._end(None))
            out.append((*mine, "dropped", None, None, None))
        else:
            out.append((*mine, "orphan" if kind == "reply" else "other", None, None, None))
        return out


def _statuses(limit: int):
    """The rule of one id, frame by frame. It holds no more than one open request."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, slot = None, Slot(limit)
        for batch in batches:
            out = []
            for frame in zip(*[batch.column(c).to_pylist() for c in (*FRAME, "_run_at", "_run_seq")]):
                here = (frame[0], frame[1], *frame[5:])
                if here != run:
                    out += slot.expired()
                run = here
                out += slot.take(frame[:5])
            if out:
                yield _batch(out)
        if last := slot.expired():
            yield _batch(last)

    return judge


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    kinds = (text, text, number, text, number, text, number, number, number)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], names=[*FRAME, *OUTCOME])


def _by_automaton(frames: DataFrame, timeout_seconds: int) -> DataFrame:
    """``paired`` for any frames: one ordered pass over each run."""
    ready = runs(frames, timeout_seconds).select(
        F.col("_id.session_id").cast("string").alias("session_id"), F.col("_id.id").cast("string").alias("id"),
        F.col("seq").cast("bigint").alias("seq"), "kind", "_at",
        F.col("_run._at").alias("_run_at"), F.col("_run.seq").cast("bigint").alias("_run_seq"))
    run = [*KEY, "_run_at", "_run_seq"]
    return ready.repartition(*run).sortWithinPartitions(*run, "_at", "seq", "kind").mapInArrow(
        _statuses(timeout_seconds * 1_000_000),
        "session_id string, id string, seq bigint, kind string, _at bigint, "
        "status string, request_seq bigint, latency_us bigint, expires bigint")


def _placed(frames: DataFrame, limit: int) -> DataFrame:
    """Frames with their run inside a time bucket, what its first request met there, and whether that is all of it.

    Only a run that touches a bucket's edge may go on beyond it; one whose frames all come within the timeout of its first
    request has no second one accepted. Such runs are ``_plain`` once neither edge is near.
    """
    wide = limit * BUCKET_TIMEOUTS
    rows = (frames.select(*KEY, "seq", "kind", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
            .withColumn("_bucket", F.floor(F.col("_at") / F.lit(wide))))
    order = Window.partitionBy(*KEY, "_bucket").orderBy("_at", "seq", "kind")
    far = F.col("_at") - F.col("_bucket") * wide >= limit
    marked = (
        rows.withColumn("_n", F.row_number().over(order)).withColumn("_prev", F.lag(F.struct("kind", "_at")).over(order))
        .withColumn("_begins", F.coalesce(F.when(F.col("_prev").isNull(), far).otherwise(
            F.coalesce(F.col("_prev.kind") == "reply", F.lit(False)) | (F.col("_at") - F.col("_prev._at") >= limit)), F.lit(False)))
        # Run 0 began before the bucket, or may have.
        .withColumn("_run", F.sum(F.col("_begins").cast("long")).over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    run = Window.partitionBy(*KEY, "_bucket", "_run").orderBy("_n")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_ = lambda kind: F.col("kind") == kind
    spot = F.struct("_n", "_at", "seq")
    met = (
        marked.withColumn("_asked", F.count(F.when(is_("request"), 1)).over(
            run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_first", F.min(F.when(is_("request"), spot)).over(whole))
        .withColumn("_reply", F.max(is_("reply")).over(whole))
        .withColumn("_last", F.max("_at").over(whole))
        .withColumn("_off", F.min(F.when(is_("cancel") & (F.col("_asked") > 0), spot)).over(whole)))
    closed = F.coalesce("_reply", F.lit(False)) | (F.col("_last") + limit <= (F.col("_bucket") + 1) * wide)
    one = F.col("_first").isNull() | (F.col("_last") - F.col("_first._at") < limit)
    return met.withColumn("_plain", F.coalesce((F.col("_run") > 0) & closed & one, F.lit(False)))


def paired(frames: DataFrame, timeout_seconds: int = 30) -> DataFrame:
    """Status of every request, reply and cancellation.

    ``frames`` has session_id, id, ts, seq and kind. A request is accepted if its id is
    free: no accepted request waits under it, and none was cancelled less than the
    timeout ago. Others are duplicates and change nothing. A reply answers the accepted
    request; after a cancellation it is dropped. ``expires`` (microseconds) is set for
    accepted requests that no reply ended. Null ids form an id of their own; any other
    kind is passed on as "other". Runs with one accepted request, nearly all, are decided by
    columns; the rest need an automaton and an ordered pass over each run, in which a task
    holds one open request, never a run.
    """
    limit = timeout_seconds * 1_000_000
    found = _placed(frames, limit)
    kind, first, off = F.col("kind"), F.col("_first"), F.col("_off")
    accepted, answered = F.col("_n") == first["_n"], F.coalesce("_reply", F.lit(False))
    status = (
        F.when(kind == "request", F.when(~accepted, "duplicate").when(off.isNotNull(), "cancelled").when(
            answered, "answered").otherwise("unanswered"))
        .when(kind == "cancel", F.when(F.col("_n") == off["_n"], "cancelled").otherwise("unknown_cancel"))
        .when(kind == "reply", F.when(first.isNull(), "orphan").when(off.isNull(), "answered").otherwise("dropped"))
        .otherwise("other"))
    settles = (kind == "reply") & first.isNotNull() & off.isNull()
    plain = found.where("_plain").select(
        F.col("session_id").cast("string").alias("session_id"), F.col("id").cast("string").alias("id"),
        F.col("seq").cast("bigint").alias("seq"), "kind", "_at", status.alias("status"),
        F.when(settles | (kind == "cancel") & (F.col("_n") == off["_n"]), first["seq"]).cast("bigint").alias("request_seq"),
        F.when(settles, F.col("_at") - first["_at"]).alias("latency_us"),
        F.when((kind == "request") & accepted & ~answered, F.coalesce(off["_at"], F.col("_at")) + limit).alias("expires"))
    rest = _by_automaton(found.where("not _plain").select(*KEY, "ts", "seq", "kind"), timeout_seconds)
    return plain.unionByName(rest).withColumn("ts", F.timestamp_micros("_at"))


def pair(frames: DataFrame, timeout_seconds: int = 30) -> DataFrame:
    """Answered requests with their reply and latency."""
    return paired(frames, timeout_seconds).where("kind = 'reply' and status = 'answered'").select(
        *KEY, "request_seq", F.col("seq").alias("reply_seq"), "latency_us")


def orphans(frames: DataFrame, timeout_seconds: int = 30) -> DataFrame:
    """Replies without a pending request, and requests that reuse a live id."""
    return paired(frames, timeout_seconds).where("status in ('orphan', 'duplicate')")


def unanswered(frames: DataFrame, timeout_seconds: int = 30) -> DataFrame:
    """J10."""
    return paired(frames, timeout_seconds).where("kind = 'request' and status = 'unanswered'")


def cancelled(frames: DataFrame, timeout_seconds: int = 30) -> DataFrame:
    """Replies dropped after a cancellation and cancellations of unknown ids."""
    return paired(frames, timeout_seconds).where("status in ('dropped', 'unknown_cancel')")


def refused(frames: DataFrame) -> DataFrame:
    """Frames whose method the protocol does not allow in their direction."""
    client = (F.col("direction") == "client") & ~F.col("method").isin(*CLIENT_METHODS)
    server = (F.col("direction") == "server") & ~(
        ((F.col("method") == "ping") & F.col("id").isNotNull())
        | (F.col("method").isin(*SERVER_NOTIFICATIONS) & F.col("id").isNull()))
    return frames.where(F.col("method").isNotNull() & (client | server))


def live(frames: DataFrame, timeout_seconds: int = 30, bucket_seconds: int = 3600) -> DataFrame:
    """Requests pending per session after every frame, and whether the cap of 64 is broken.

    A request leaves with its reply, else with the timeout, counted from its cancellation if there was one.
    """
    known = paired(frames, timeout_seconds)
    change = F.when((F.col("kind") == "request") & (F.col("status") != "duplicate"), 1).when(
        (F.col("kind") == "reply") & F.col("status").isin("answered", "dropped"), -1).otherwise(0)
    step = lambda at, frame, by: F.struct(at.alias("_at"), frame.alias("_frame"), by.alias("_change"))
    steps = F.filter(F.array(
        step(F.col("_at"), F.lit(1), change), step(F.col("expires"), F.lit(0), F.lit(-1))), lambda s: s["_at"].isNotNull())
    rows = known.withColumn("_step", F.explode(steps)).select(
        *KEY, "ts", "seq", "kind", "status", "_step._at", "_step._frame", "_step._change")
    # What expires at a moment is gone before the frames of that moment count.
    summed = running_sum(rows, ["session_id"], ["_at", "_frame", "seq"], "_change",
                         F.floor(F.col("_at") / F.lit(bucket_seconds * 1_000_000)), "n_live")
    return summed.where("_frame = 1").withColumn("over_cap", F.col("n_live") > MAX_PENDING).drop("_change", "_at", "_frame")


def binary_payload(value: Sql) -> Sql:
    """Content a text scan cannot cover: blobs, and typed or non-text data; and what is nested too deep to tell."""
    def judged(found: Sql) -> Sql:
        paths = S.transform(found, lambda n: n["path"])
        text = lambda n: S.try_variant_get(n["value"], "$", "string")
        beside = lambda parent, key: S.exists(
            paths, lambda p: (p == S.concat(parent, S.lit("/" + key))) | p.startswith(S.concat(parent, S.lit(f"/{key}/")))
            | p.startswith(S.concat(parent, S.lit(f"/{key}["))))
        typed = S.exists(found, lambda n: (n["key"] == "type") & text(n).isin("image", "audio", "attachment", "blob")
                         & beside(S.regexp_replace(n["path"], r"/type\z", ""), "data"))
        mime = S.exists(found, lambda n: n["key"].isin("mimeType", "mime_type") & ~text(n).startswith("text/")
                        & (text(n) != "application/json") & beside(S.regexp_replace(n["path"], r"/[^/]*\z", ""), "data"))
        blob = S.exists(paths, lambda p: p.rlike(r"/blob(?:[/\[]|\z)"))
        return S.coalesce(typed, S.lit(False)) | S.coalesce(mime, S.lit(False)) | blob | unopened(found)

    return S.let(opened(value), judged)


def safe_metadata(value: Sql, config: ScanConfig = ScanConfig()) -> Sql:
    """A control message without sensitive text, keys or values.

    Names of schema properties may be sensitive words; their default, enum, examples
    and const values may not be given. What is nested too deep to look at is not safe.
    """
    def unsafe(n: Sql) -> Sql:
        keys = S.filter(S.split(S.regexp_replace(n["path"], r"\[[0-9]+\]", ""), "/"), lambda k: k != "")
        plain = S.regexp_replace(n["path"], r"(?s)/(?:inputSchema|outputSchema)(?:[/\[].*|\z)", "")
        outside = S.filter(S.split(S.regexp_replace(plain, r"\[[0-9]+\]", ""), "/"), lambda k: k != "")
        null_leaf = S.is_variant_null(n["value"])
        named = S.exists(S.transform(outside, lambda k, i: field_category(k, config).isNotNull() & (
            ~null_leaf | (i + 1 < S.size(outside)))), lambda x: x)
        in_schema = S.exists(S.transform(keys, lambda k, i: (
            (k == "properties") & field_category(S.get(keys, i + 1), config).isNotNull()
            & S.get(keys, i + 2).isin("default", "enum", "examples", "const") & ~null_leaf)),
            lambda x: S.coalesce(x, S.lit(False)))
        words = S.exists(S.concat(keys, S.array(S.coalesce(S.when(
            S.schema_of_variant(n["value"]) == "STRING", S.try_variant_get(n["value"], "$", "string")), S.lit("")))),
            lambda w: S.size(detect(w, config)) > 0)
        return named | (n["path"].rlike("/(?:inputSchema|outputSchema)/") & in_schema) | words

    return S.let(opened(value), lambda found: ~(S.exists(found, unsafe) | unopened(found)))
