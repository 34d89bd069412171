"""Registered queries on request and reply frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from warden.functions import sql as S
from warden.operators import frames
from warden.plans.derived import derive, sql
from warden.plans.registry import query
from warden.vocab import CLIENT_METHODS, SERVER_NOTIFICATIONS

DAY = 86400
TIMEOUT = 60 * DAY
# A third and more of the orders share one session; ids are used again within the timeout.
FRAMES = """
with o as (select o_orderkey, o_orderdate, o_orderstatus,
    case when o_custkey % 3 = 1 then 'hub' else concat('c', cast(o_custkey as string)) end as session_id,
    case when o_custkey % 3 = 1 then cast(o_orderkey % 32 + 32 * cast(floor(o_orderkey / 512) as bigint) as string)
      else cast(o_orderkey % 3 as string) end as id
  from {orders})
select session_id, id, o_orderdate as ts, o_orderkey * 1000000 as seq, 'request' as kind from o
union all
select session_id, id, o_orderdate + interval 9 days, o_orderkey * 1000000 + 999999, 'cancel' from o where o_orderstatus = 'P'
union all
select session_id, id, l_shipdate, o_orderkey * 1000000 + l_partkey % 1000 * 900 + l_linenumber, 'reply'
  from {lineitem} join o on l_orderkey = o_orderkey
"""
# The rule one frame after the other: what is open under an id (its kind, moment and place), then the next frame.
STATUS = f"""
recursive f as (select *, row_number() over (partition by session_id, id order by ts, seq, kind) as n from ({sql(FRAMES)}) x),
w as (select session_id, id, ts, seq, kind, n, cast(null as bigint) as request_seq, cast(null as timestamp) as request_ts,
    case kind when 'request' then 'accepted' when 'reply' then 'orphan' else 'unknown_cancel' end as status,
    case when kind = 'request' then 'open' else 'free' end as held, cast(ts as timestamp) as held_ts, seq as held_seq, cast(ts as timestamp) as begun
  from f where n = 1
  union all
  select session_id, id, ts, seq, kind, n, case when status in ('answered', 'cancelled') then held_seq end,
    case when status in ('answered', 'cancelled') then begun end, status,
    case when status = 'accepted' then 'open' when status = 'cancelled' then 'off' when kind = 'reply' then 'free' else held end,
    case when status in ('accepted', 'cancelled') then ts else held_ts end,
    case when status = 'accepted' then seq else held_seq end, case when status = 'accepted' then ts else begun end
  from (select s.*, case
      when kind = 'request' then case when held = 'free' then 'accepted' else 'duplicate' end
      when kind = 'cancel' then case when held = 'open' then 'cancelled' else 'unknown_cancel' end
      else case held when 'open' then 'answered' when 'off' then 'dropped' else 'orphan' end end as status
    from (select f.*, w.held_ts, w.held_seq, w.begun,
        case when date_diff('second', w.held_ts, cast(f.ts as timestamp)) < {TIMEOUT} then w.held else 'free' end as held
      from w join f on f.session_id = w.session_id and f.id = w.id and f.n = w.n + 1) s) t),
e as (select session_id, id, request_seq, max(ts) filter (where status = 'cancelled') as off_ts,
    max(ts) filter (where status = 'answered') as reply_ts from w where request_seq is not null group by all),
s as (select w.session_id, w.id, w.ts, w.seq, w.kind, w.request_seq, w.request_ts, e.off_ts, e.reply_ts,
    case when w.status <> 'accepted' then w.status when e.off_ts is not null then 'cancelled'
      when e.reply_ts is not null then 'answered' else 'unanswered' end as status
  from w left join e on w.status = 'accepted' and e.session_id = w.session_id and e.id = w.id and e.request_seq = w.seq)"""


def rows(spark, folder):
    return derive(spark, folder, FRAMES)


@query("j8_request_reply", f"""
with {STATUS} select session_id, id, request_seq, seq as reply_seq, date_diff('microsecond', request_ts, cast(ts as timestamp)) as latency_us
from s where kind = 'reply' and status = 'answered'""")
def j8(spark, folder):
    return frames.pair(rows(spark, folder), TIMEOUT)


@query("j9_orphans_and_duplicates", f"with {STATUS} select session_id, id, seq, status from s where status in ('orphan', 'duplicate')")
def j9(spark, folder):
    return frames.orphans(rows(spark, folder), TIMEOUT).select("session_id", "id", "seq", "status")


@query("j10_unanswered", f"with {STATUS} select session_id, id, seq from s where status = 'unanswered'")
def j10(spark, folder):
    return frames.unanswered(rows(spark, folder), TIMEOUT).select("session_id", "id", "seq")


@query("j11_cancelled", f"with {STATUS} select session_id, id, seq, status from s where status in ('dropped', 'unknown_cancel')")
def j11(spark, folder):
    return frames.cancelled(rows(spark, folder), TIMEOUT).select("session_id", "id", "seq", "status")


@query("w7_live_requests", f"""
with {STATUS}, d as (select session_id, id, seq, ts from s where status = 'dropped'),
b as (select session_id, 1 as frame, ts as moment, seq, case when kind = 'request' and status <> 'duplicate' then 1
    when kind = 'reply' and status in ('answered', 'dropped') then -1 else 0 end as step from s
  union all select session_id, 0, ts + interval {TIMEOUT} seconds, null, -1 from s where kind = 'request' and status = 'unanswered'
  union all select c.session_id, 0, c.off_ts + interval {TIMEOUT} seconds, null, -1 from s c
    where c.kind = 'request' and c.status = 'cancelled' and not exists (select 1 from d where d.session_id = c.session_id
      and d.id = c.id and d.ts >= c.off_ts and d.ts < c.off_ts + interval {TIMEOUT} seconds)),
l as (select session_id, frame, seq, sum(step) over (partition by session_id order by moment, frame, seq rows unbounded preceding) as n_live from b)
select session_id, seq, cast(n_live as bigint) as n_live, cast(n_live > 64 as int) as over_cap from l where frame = 1""")
def w7(spark, folder):
    return frames.live(rows(spark, folder), TIMEOUT, DAY).select(
        "session_id", "seq", "n_live", F.col("over_cap").cast("int").alias("over_cap"))


METHODS = ["tools/call", "ping", "shutdown", "resources/read", "notifications/progress", "sampling/createMessage", "prompts/get",
           "notifications/initialized", "tools/execute"]
MESSAGES = (f"select event_id, split_part('{','.join(METHODS)}', ',', cast(event_id % {len(METHODS)} + 1 as int)) as method, "
            "case when user_id % 2 = 0 then 'client' else 'server' end as direction, "
            "case when event_type = 'view' then null else cast(event_id as string) end as id from {events}")


@query("j12_refused_methods", f"""
with m as ({sql(MESSAGES)}) select direction, method, count(*) as n from m
where (direction = 'client' and method not in ({', '.join(f"'{x}'" for x in CLIENT_METHODS)}))
   or (direction = 'server' and not (id is not null and method = 'ping') and not (id is null and method in ({', '.join(f"'{x}'" for x in SERVER_NOTIFICATIONS)})))
group by all""")
def j12(spark, folder):
    return frames.refused(derive(spark, folder, MESSAGES)).groupBy("direction", "method").agg(F.count("*").alias("n"))


# (frame with # for the event id, valid, kind, binary payload, safe metadata): golden rows.
RAW = [
    ('{"jsonrpc":"2.0","id":#,"method":"tools/call","params":{"name":"x"}}', 1, "request", 0, 1),
    ('{"jsonrpc":"2.0","id":"a#","result":{"content":[{"type":"text","text":"ok"}]}}', 1, "reply", 0, 1),
    ('{"jsonrpc":"2.0","id":#,"result":{"content":[{"type":"image","data":"AAAA"}]}}', 1, "reply", 1, 1),
    ('{"jsonrpc":"2.0","id":#,"result":{"x":{"blob":"AA"}}}', 1, "reply", 1, 1),
    ('{"jsonrpc":"2.0","id":#,"result":{"mimeType":"application/pdf","data":"AA"}}', 1, "reply", 1, 1),
    ('{"jsonrpc":"2.0","id":#,"result":{"mimeType":"text/plain","data":"AA"}}', 1, "reply", 0, 1),
    ('{"jsonrpc":"2.0","id":#,"error":{"code":-1,"message":"no"}}', 1, "reply", 0, 1),
    ('{"jsonrpc":"2.0","id":#,"error":{"message":"no"}}', 0, "reply", 0, 1),
    ('{"jsonrpc":"2.0","id":#,"result":{},"error":{"code":1,"message":"x"}}', 0, "reply", 0, 1),
    ('{"jsonrpc":"2.0","method":"notifications/cancelled","params":{"requestId":#}}', 1, "cancel", 0, 1),
    ('{"jsonrpc":"1.0","id":#,"method":"ping"}', 0, "request", 0, 1),
    ('{"jsonrpc":"2.0","id":1.5,"method":"ping"}', 0, "request", 0, 1),
    ('{"jsonrpc":"2.0","id":#,"method":"initialize","params":{"password":"p#"}}', 1, "request", 0, 0),
    ('{"jsonrpc":"2.0","id":#,"result":{"tools":[{"inputSchema":{"properties":{"password":{"type":"string"}}}}]}}', 1, "reply", 0, 1),
    ('{"jsonrpc":"2.0","id":#,"result":{"tools":[{"inputSchema":{"properties":{"password":{"default":"x#"}}}}]}}', 1, "reply", 0, 0),
    ('{"jsonrpc":"2.0","id":#,"method":"ping","params":{"note":"mail a@b.example"}}', 1, "request", 0, 0),
    ('not json #', 0, "-", 0, 1),
]


def _pick(column: int, index: str = "event_id") -> str:
    from warden.plans.derived import pick
    return pick([str(r[column]) for r in RAW], index)


_TEXT = _pick(0).replace("{", "{{").replace("}", "}}")
RAW_SQL = (f"select event_id, replace({_TEXT}, '#', cast(event_id as string)) "
           "as value from {events}")


@query("s12_read_frames", f"""
select event_id, cast({_pick(1)} as int) as valid, case when {_pick(1)} = '1' then {_pick(2)} else '-' end as kind from events""")
def s12(spark, folder):
    text = derive(spark, folder, RAW_SQL).withColumn("f", S.col(frames.frame_fields(S.ref("value"))))
    return text.select("event_id", F.coalesce(F.col("f.valid"), F.lit(False)).cast("int").alias("valid"),
                       F.when(F.col("f.valid"), F.col("f.kind")).otherwise("-").alias("kind"))


@query("p27_binary_payloads", f"select event_id, cast({_pick(3)} as int) as blocked from events where {_pick(0)} not like 'not%'")
def p27(spark, folder):
    bodies = derive(spark, folder, RAW_SQL).select("event_id", F.try_parse_json("value").alias("v")).where("v is not null")
    return bodies.select("event_id", S.col(frames.binary_payload(S.ref("v")).cast("int")).alias("blocked"))


@query("p28_safe_metadata", f"select event_id, cast({_pick(4)} as int) as safe from events where {_pick(0)} not like 'not%'")
def p28(spark, folder):
    bodies = derive(spark, folder, RAW_SQL).select("event_id", F.try_parse_json("value").alias("v")).where("v is not null")
    return bodies.select("event_id", S.col(frames.safe_metadata(S.ref("v")).cast("int")).alias("safe"))
