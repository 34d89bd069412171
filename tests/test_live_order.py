"""Live taint and pairs put all rows of a key and micro-batch in order, however many there are."""

import random

import pyarrow as pa
from pyspark.sql import Row, functions as F

from warden.streaming import frames as live_frames, ordering, taint as live_taint
from warden.vocab import CATEGORIES

EVENT = Row("call_id", "kind", "ts", "seq", "source_categories", "source", "sink", "effect", "rule_id", *live_taint.CARRIED)


class Value:
    """A state value of one key."""

    def __init__(self):
        self.value = None

    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def session_events(n, draw):
    """Calls and results of a session; few of them hold something, and those come at random."""
    held = [[]] * 80 + [[c] for c in CATEGORIES[:4]]
    return [EVENT(str(i), "post" if i % 5 == 0 else "pre", i // 3, i, draw.choice(held), f"s{i % 50}", "outbound_http" if i % 2 else None,
                  "allow", "none", *["x"] * len(live_taint.CARRIED)) for i in range(n)]


def prior_of(events):
    known, want = set(), {}
    for e in events:
        want[e.call_id] = [c for c in CATEGORIES if c in known]
        known |= set(e.source_categories)
    return want


def taints(batches):
    processor, got = live_taint.SessionTaint(), []
    processor._state = Value()
    for batch in batches:
        got += processor.handleInputRows(("codex", "s"), iter(batch), None)
    return got, processor._state.value


def test_sorted_runs_become_one_order():
    draw = random.Random(1)
    rows = [(draw.randrange(400), i) for i in range(5000)]
    for room in (10, 100, 2500, 5000, 6000):  # 500 runs: several levels
        parts = (sorted(rows[a:a + room], key=lambda r: r[0]) for a in range(0, len(rows), room))
        assert list(ordering.in_order(parts, lambda r: r[0], room)) == sorted(rows, key=lambda r: r[0])
    assert list(ordering.in_order(iter(()), lambda r: r, 5)) == []


def test_st1_a_session_beyond_the_room_is_in_order(monkeypatch):
    """All events of a session in one micro-batch, the last ones first."""
    draw = random.Random(2)
    events = session_events(3000, draw)
    shown, state = taints([events[::-1]])
    monkeypatch.setattr(live_taint, "ORDERED", 100)
    got, small = taints([events[::-1]])
    want = prior_of(events)
    assert {r.call_id: r.prior for r in got} == want and [r.call_id for r in got] == [e.call_id for e in events]
    assert got == shown and small == state


def test_st2_results_taint_what_comes_after_them(monkeypatch):
    """Calls hold nothing themselves; a result, an event after its call, taints the rest of a large session only."""
    calls = [EVENT(str(i), "pre", i, 2 * i, [], None, "outbound_http", "allow", "none", *["x"] * 4) for i in range(900)]
    results = [EVENT(str(i), "post", i, 2 * i + 1, ["personal_data"], "personal.email", None, "allow", "recorded", *[None] * 4)
               for i in (400, 700)]
    monkeypatch.setattr(live_taint, "ORDERED", 100)
    got, _ = taints([[*results, *calls[::-1]]])
    assert {int(r.call_id) for r in got if r.kind == "pre" and r.prior} == set(range(401, 900))


def test_st7_late_calls_of_a_large_session_are_in_order(monkeypatch):
    """Even events come first, odd ones late; each half is more than is ordered in memory."""
    events = session_events(3000, random.Random(5))
    early, late = events[::2], events[1::2]
    monkeypatch.setattr(live_taint, "ORDERED", 100)
    got, _ = taints([early[::-1], late[::-1]])
    known = {c for e in early for c in e.source_categories}
    want = prior_of(early) | {k: [c for c in CATEGORIES if c in known or c in v] for k, v in prior_of(late).items()}
    assert {r.call_id: r.prior for r in got} == want


def test_st5_audited_rows_of_a_large_session(spark, tmp_path):
    """One micro-batch of 52,000 calls of a session, the last ones first; only the last thousand are tainted."""
    from warden.plans.stream_queries import audited_twice
    from warden.sources import audit_lake

    n, text = 52_000, ("capability", "category", "severity", "policy_layer")
    late = F.col("id") >= n - 1001
    events = spark.range(n - 1, -1, -1, 1).select(
        F.lit("codex").alias("agent"), F.lit("s").alias("session_id"), F.col("id").cast("string").alias("call_id"),
        F.lit("pre").alias("kind"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"),
        F.when(late, F.array(F.lit("credential"))).otherwise(F.expr("cast(array() as array<string>)")).alias("source_categories"),
        F.when(late, F.lit("drupal.secret.env")).alias("source"), F.lit("outbound_http").alias("sink"),
        F.lit("allow").alias("effect"), F.lit("none").alias("rule_id"), *[F.lit("x").alias(c) for c in text])
    feed, path = str(tmp_path / "feed"), str(tmp_path / "audit")
    events.write.parquet(feed)
    stream = live_taint.stream(spark.readStream.schema(events.schema).parquet(feed))
    (stream.writeStream.foreachBatch(audited_twice(path)).option("checkpointLocation", str(tmp_path / "state"))
     .trigger(availableNow=True).start().awaitTermination())
    rows = audit_lake.read_committed(spark, path, "calls").select(
        F.col("timestamp_unix_ms") / 1000, F.size("sensitivity_categories") > 0, "enforcement_decision").collect()
    assert len(rows) == n and {int(r[0]) for r in rows if r[1]} == set(range(n - 1000, n))
    assert all((r[2] == "deny") == r[1] for r in rows)


FRAMES = pa.schema([("share", pa.int32()), ("ts", pa.timestamp("us", "UTC")), ("session_id", pa.string()), ("id", pa.string()),
                    ("_at", pa.int64()), ("seq", pa.int64()), ("kind", pa.string())])


def packs(rows, size):
    """Blocks of frames (share, at, seq, kind, session, id) that came ``size`` a task."""
    for a in range(0, len(rows), size):
        batch = pa.RecordBatch.from_pylist([
            {"share": share, "ts": at, "session_id": session, "id": name, "_at": at, "seq": seq, "kind": kind}
            for share, at, seq, kind, session, name in rows[a:a + size]], FRAMES)
        for out in live_frames._packed(iter([batch])):
            yield from (live_frames.Row(**r) for r in out.to_pylist())


def test_st4_blocks_hold_the_frames_of_their_share():
    draw = random.Random(1)
    for n in [5, 50, 300, 1000, 3000] * 12:
        shares = [draw.randrange(512) for _ in range(n)]
        rows = [(share, draw.randrange(10 ** 15), share, "request", "s", str(i)) for i, share in enumerate(shares)]
        held = {}
        for pack in packs(rows, n):
            block = pa.ipc.read_record_batch(pa.py_buffer(pack["block"]), live_frames._FRAME)
            assert set(block["seq"].to_pylist()) == {pack["share"]}
            assert int(pack["ts"].timestamp() * 1e6 + 0.5) - max(block["_at"].to_pylist()) in (-1, 0, 1)
            held[pack["share"]] = block.num_rows
        assert sum(held.values()) == n and set(held) == set(shares)


def test_st4_frames_beyond_the_room_are_in_order(monkeypatch):
    """A share with many more frames than are ordered in memory, null ids and places among them, the last ones first."""
    draw, limit = random.Random(3), 30_000_000
    rows = [(0, draw.randint(0, 2000) * 1_000_000, draw.choice([n, n, n, None]), draw.choice(["request", "request", "reply", "cancel"]),
             draw.choice(["a", None]), draw.choice([None, *map(str, range(40))])) for n in range(6000)]
    rows.sort(key=lambda r: (r[1], r[2] is not None, r[2], r[3]), reverse=True)
    monkeypatch.setattr(live_frames, "ORDERED", 250)
    pending, out = live_frames.Pending(limit), []
    pending._state = pending._handle = held = Value()
    held.registerTimer = held.deleteTimer = lambda at: None
    for row in pending.handleInputRows((0,), packs(rows, 100), None):
        out += (tuple(r.values()) for r in pa.ipc.read_record_batch(pa.py_buffer(row.block), live_frames._SETTLED).to_pylist())
    want, open_ = [], 0
    for name in {r[4:] for r in rows}:
        slot = live_frames.Slot(limit)
        for _, at, seq, kind, *_ in (r for r in rows[::-1] if r[4:] == name):
            want += slot.take((*name, seq, kind, at))
        open_ += slot.accepted is not None
    assert sorted(map(str, out)) == sorted(map(str, want)) and len(held.value[1]) == open_ > 0
