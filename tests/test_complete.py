"""Findings and masks stay whole, however many hits a text has."""

import time
import uuid

from pyspark.sql import functions as F

from warden import mask, scan
from warden.functions import sql as S
from warden.functions.fields import ScanConfig
from warden.functions.spans import SPAN, before, merge, total
from warden.operators import frames, taint
from warden.streaming import taint as live_taint
from warden.vocab import CATEGORIES

N = 1000


def test_many_hits(spark):
    mails = " ".join(f"user{i}.x@mail{i}.example.com," for i in range(N))
    table = "name | password\n" + "\n".join(f"n{i} | s3cret-{i}-value" for i in range(N))
    ibans = " ".join("DE89370400440532013000," for _ in range(400))
    df = spark.createDataFrame([(1, mails), (2, table), (3, ibans), (4, "nothing here")], "doc_id long, body string")
    found = {r.doc_id: r.n for r in scan.findings(df, "body", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert found[1] == N and found[2] == N and found[3] == 400 and 4 not in found
    masked = {r.doc_id: r.body for r in mask.mask_columns(df).collect()}
    assert "@mail" not in masked[1] and "s3cret" not in masked[2] and "DE89" not in masked[3]
    assert masked[1].count("[REDACTED:") == N and masked[4] == "nothing here"


def test_long_text(spark):
    long = "calm words " * 120_000 + " write to someone@mail.example.com now"
    df = spark.createDataFrame([(1, long)], "doc_id long, body string")
    assert scan.findings(df, "body", "doc_id").count() == 1
    assert "@mail" not in mask.mask_columns(df).first().body


def _frames(spark, rows):
    return spark.createDataFrame(rows, "session_id string, id string, sec int, seq bigint, kind string").withColumn(
        "ts", F.timestamp_seconds("sec"))


def _brute_statuses(rows, limit):
    """The rule of an id in plain Python: what waits, what was called off, frame by frame."""
    got, open_, off = {}, {}, {}
    for session, id_, sec, seq, kind in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        key = (session, id_)
        if key in open_ and sec - open_[key][0] >= limit:
            del open_[key]
        if key in off and sec - off[key][0] >= limit:
            del off[key]
        if kind == "request":
            if key in open_ or key in off:
                got[seq] = "duplicate"
            else:
                got[seq], open_[key] = "unanswered", (sec, seq)
        elif kind == "cancel":
            if key in open_:
                request = open_.pop(key)[1]
                got[seq], got[request], off[key] = "cancelled", "cancelled", (sec, request)
            else:
                got[seq] = "unknown_cancel"
        elif key in off:
            got[seq] = "dropped"
            del off[key]
        elif key in open_:
            request = open_.pop(key)[1]
            got[seq] = got[request] = "answered"
        else:
            got[seq] = "orphan"
    return got


def test_frame_statuses_follow_the_rule(spark):
    import random
    rnd = random.Random(4)
    rows, sec = [], 0
    for seq in range(3000):
        sec += rnd.choice([0, 1, 1, 3, 9, 40])
        rows.append((rnd.choice(["a", "b", None]), rnd.choice(["1", "2", None]), sec, seq,
                     rnd.choice(["request", "request", "request", "reply", "cancel"])))
    rows += [("dense", "1", i * 5, 10_000 + i, "request") for i in range(2000)]  # no reply, no pause
    got = {r.seq: r.status for r in frames.paired(_frames(spark, rows), 30).collect()}
    assert got == _brute_statuses(rows, 30)


def test_plain_runs_by_columns_equal_the_automaton(spark):
    """All columns, over many time buckets and their edges; the automaton sees the few runs that need it."""
    import random
    rnd = random.Random(8)
    rows, sec = [], 0
    for seq in range(6000):
        sec += rnd.choice([0, 0, 1, 5, 29, 30, 31, 40, 1900])
        rows.append((rnd.choice(["a", "b", None]), rnd.choice(["1", "2", None]), sec, seq,
                     rnd.choice(["request", "request", "reply", "reply", "cancel", "other"])))
    log = _frames(spark, rows + rows[:50])
    show = lambda df: sorted(map(str, df.select(
        "session_id", "id", "seq", "kind", "_at", "status", "request_seq", "latency_us", "expires").collect()))
    assert show(frames.paired(log, 30)) == show(frames._by_automaton(log, 30))
    assert frames._placed(log, 30_000_000).where("not _plain").count() < 0.2 * len(rows)


def test_first_request_is_answered_and_requests_expire(spark):
    rows = [("s", "1", 0, 1, "request"), ("s", "1", 5, 2, "request"), ("s", "1", 10, 3, "reply")]
    pairs = frames.pair(_frames(spark, rows), 30).collect()
    assert [(r.request_seq, r.reply_seq, r.latency_us) for r in pairs] == [(1, 3, 10_000_000)]
    spaced = [("s", str(i), 60 * i, i, "request") for i in range(100)]
    assert {r.n_live for r in frames.live(_frames(spark, spaced), 30).collect()} == {1}
    assert frames.paired(_frames(spark, rows[:0]), 30).collect() == []


def test_deep_and_neighbouring_payloads(spark):
    deep = lambda n, leaf: '{"a":' * n + leaf + "}" * n
    texts = [deep(20, '{"blob":"x"}'), deep(40, '{"x":1}'), '[{"type":"image","url":"u"},{"type":"text","data":"d"}]',
             '{"type":"image","data":{}}', deep(20, '{"password":"x"}'), '{"a":[1,{"b":{}}]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.try_parse_json("t").alias("v"))
    got = df.select("i", S.col(frames.binary_payload(S.ref("v"))).alias("b"), S.col(frames.safe_metadata(S.ref("v"))).alias("s")).orderBy("i").collect()
    assert [r.b for r in got] == [True, True, False, True, False, False]
    assert [r.s for r in got] == [True, False, True, True, False, True]


def test_late_call_keeps_taint_known_at_arrival(spark):
    schema = "agent string, session_id string, call_id string, sec int, seq bigint, source_categories array<string>"
    rows = lambda part: spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("sec"))
    first = rows([("x", "s", "1", 50, 1, ["credential"])])
    _, known = live_taint.fold_batch(first, taint.first_seen(first.where("false")))
    late, changed = live_taint.fold_batch(rows([("x", "s", "2", 10, 2, [])]), known)
    assert late.select("prior").first().prior == ["credential"]
    assert changed.count() == 1
    assert live_taint.fold_batch(rows([("x", "other", "3", 10, 3, [])]), known)[1].count() == 0


def test_project_rules_are_taint_sources(spark):
    from warden.functions.decisions import BUILT_IN, PathRule, RuleSet
    own = PathRule("project", "project.path.deny_read", "deny", "high", "filesystem", "", "read", ("**/private/**",), project="p")
    calls = spark.createDataFrame([("1", "/w", "p", ["private/a"], []), ("2", "/w", "q", ["private/a"], [])],
                                  "call_id string, cwd string, project string, paths array<string>, sql_texts array<string>")
    got = taint.sources(calls, RuleSet((*BUILT_IN, own))).select("call_id", "source_id").collect()
    assert [tuple(r) for r in got] == [("1", "project.path.deny_read")]


def test_cards_beside_other_findings_are_redacted(spark):
    """A card's digits that run on into an address or a phone number: the run as a whole is no card."""
    rows = ["pay 4028005252517056 10.0.0.1 now", "phone +32470123456 4111 1111 1111 1111", "x@mail.test1 4111111111111111",
            "calm 4111111111111112 10.0.0.1"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, body string")
    got = [r.redacted for r in scan.verdicts(df, "body", "doc_id", ScanConfig(ip_personal=True)).orderBy("doc_id").collect()]
    assert got == ["pay [REDACTED:FINANCIAL_DATA] [REDACTED:PERSONAL_DATA] now", "phone [REDACTED:PERSONAL_DATA] [REDACTED:FINANCIAL_DATA]",
                   "[REDACTED:PERSONAL_DATA] [REDACTED:FINANCIAL_DATA]", "calm 4111111111111112 [REDACTED:PERSONAL_DATA]"]


def test_work_grows_with_findings(spark):
    """Offsets, merging and redaction of a text with very many findings, checked against plain Python."""
    n = 60_000
    text = " ".join(f"é{'x' * (i % 7)} u{i}@example.test" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, body string").repartition(1)
    start = time.time()
    row = scan.verdicts(df, "body", "doc_id").first()
    assert time.time() - start < 60
    assert row.n_findings == n and row.rule_id == "result.scan_limit"
    assert row.redacted == " ".join(f"é{'x' * (i % 7)} [REDACTED:PERSONAL_DATA]" for i in range(n))


def test_merge_and_running_values_match_python(spark):
    import random
    rnd, spans = random.Random(3), []
    for i in range(9000):
        start = rnd.randrange(30_000)
        c = rnd.randrange(8)
        spans.append((start, start + 1 + rnd.randrange(6), rnd.randrange(4), 8 - c, CATEGORIES[c], f"d{c}", "high"))
    want = []
    for s in sorted(spans):
        if want and s[0] <= want[-1][1]:
            last = want[-1]
            want[-1] = (last[0], max(last[1], s[1]), *(s[2:] if s[3] > last[3] else last[2:]))
        else:
            want.append(s)
    df = spark.createDataFrame([(spans,), ([],), (None,)], f"s array<{SPAN}>")
    got = df.select(S.col(merge(S.ref("s"))).alias("m"), S.col(before(S.transform(S.ref("s"), lambda x: x["start"]), 0, total)).alias("b")).collect()
    assert [tuple(x) for x in got[0].m] == want and got[1].m == [] and got[2].m is None
    assert got[0].b == [sum(x[0] for x in spans[:i]) for i in range(len(spans))] and got[1].b == []


def test_a_delivered_batch_is_computed_once(spark, tmp_path):
    from warden.plans.stream_queries import audited_twice
    from warden.sources import audit_lake

    drawn = F.udf(lambda: uuid.uuid4().hex).asNondeterministic()
    calls = spark.createDataFrame([(i, "codex", "s") for i in range(20)], "call_id long, agent string, session_id string")
    text = ("capability", "effect", "category", "severity", "policy_layer", "sink")
    batch = calls.withColumns({c: F.lit("x") for c in text} | {
        "kind": F.lit("pre"), "ts": F.lit("2024-01-01").cast("timestamp"), "rule_id": drawn()})
    audited_twice(str(tmp_path))(batch, 0)
    shown = [{r[0] for r in audit_lake.read_committed(spark, str(tmp_path), name).select("rule_id").collect()}
             for name in ("calls", "rules")]
    assert len(shown[0]) == 20 and shown[0] == shown[1]
