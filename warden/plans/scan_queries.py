"""Registered queries on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from warden.functions import detectors as D, sql as S
from warden.functions.fields import ScanConfig, field_category
from warden.functions.spans import merge, redact
from warden.operators import scan
from warden.plans.derived import LOG_KINDS, LOGS, derive, letters, logs, sql
from warden.plans.finding_sql import FINDINGS
from warden.plans.registry import load, query

R = S.ref
L = sql(LOGS)
CONFIG = ScanConfig(("npm_",), {"first_name": "personal_data"}, True)
T = R("text")


def documents(spark, folder):
    return load(spark, folder, "documents").select("doc_id", "text")


def spans_of(df, spans):
    """doc_id, start_char, end_char and matched text of one detector."""
    rows = df.select("doc_id", "text", F.explode_outer(S.col(spans)).alias("s")).where("s is not null")
    return rows.select("doc_id", F.col("s.detector").alias("detector_id"), F.col("s.start").alias("start_char"),
                       F.expr("substring(text, s.start + 1, s.`end` - s.start)").alias("value"))


def at(group: str) -> str:
    """DuckDB: where the captured value of a log line starts (each log line holds it once)."""
    return f"cast(strpos(text, {group}) - 1 as int)"


PEM = r"(?s)-----BEGIN RSA PRIVATE KEY-----\n.*?-----END RSA PRIVATE KEY-----"


@query("f1_pem_keys", f"""
with l as ({L}), m as (select doc_id, text, regexp_extract(text, '{PEM}') as value from l)
select doc_id, 'secret.pem_private_key' as detector_id, {at('value')} as start_char, value from m where value <> ''""")
def f1(spark, folder):
    return spans_of(logs(spark, folder), D.pem_keys(T))


FIELD_SQL = """case when regexp_matches({n}, '(^|_)(password|passwd|secret|api_key|private_key)$') or {n} in ('pass','token','access_token',
   'refresh_token','accountkey','access_key_id','secret_access_key') then 'credential'
  when regexp_matches({n}, '(^|_)(authorization|cookie|session|session_id|hash)$') then 'authentication'
  when regexp_matches({n}, '(^|_)(card_number|iban|bank_account|payment_method)$') then 'financial_data'
  when regexp_matches({n}, '(^|_)(billing_address|shipping_address|customer_profile|webform_submission|comment_author)$') then 'customer_data'
  when regexp_matches({n}, '(^|_)(email|mail|phone|telephone|address|postal_code|birth_date|date_of_birth)$') then 'personal_data'
  when {n} = 'first_name' then 'personal_data' end"""
ASSIGNED = f"""
l as ({L}), n as (select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from l),
k as (select *, lower(regexp_replace(trim(split_part(replace(line, '=', ':'), ':', 1)), '[^A-Za-z0-9]', '_', 'g')) as name,
   regexp_extract(line, '^[^=:]*[=:](.*)$', 1) as raw from n where regexp_matches(line, '[=:]')),
c as (select *, {FIELD_SQL.format(n='name')} as category, trim(raw) = '' or regexp_matches(trim(raw), '^"[^"]*$') as open from k)"""


@query("f2_assignments", f"""
with {ASSIGNED} select doc_id, category, case when open then substr(text, strpos(text, line) + length(line) - length(raw)) else trim(raw) end as value
from c where category is not null""")
def f2(spark, folder):
    rows = logs(spark, folder).select("doc_id", "text", F.explode_outer(S.col(D.assignments(T, CONFIG))).alias("s")).where("s is not null")
    return rows.select("doc_id", F.col("s.category").alias("category"),
                       F.expr("substring(text, s.start + 1, s.`end` - s.start)").alias("value"))


@query("f3_authorization", f"""
with l as ({L}), m as (select doc_id, text, regexp_extract(text, '(?i)bearer[ :=]*([A-Za-z0-9_.~+/-][A-Za-z0-9_.~+/=-]{{7,}})', 1) as value from l)
select doc_id, 'secret.authorization' as detector_id, {at('value')} as start_char, value from m where value <> ''""")
def f3(spark, folder):
    return spans_of(logs(spark, folder), D.authorization(T, S.lower(T)))


@query("f4_database_urls", f"""
with l as ({L}), m as (select doc_id, text, regexp_extract(text, '(?i)(mysql|mariadb|postgres|postgresql)://[^:/?# ]*:([^/?# ]*)@', 2) as value from l)
select doc_id, 'secret.database_url' as detector_id, {at('value')} as start_char, value from m where value <> ''""")
def f4(spark, folder):
    return spans_of(logs(spark, folder), D.database_urls(T, S.lower(T)))


TOKENS = [("secret.github_token", "gh[pousr]_[A-Za-z0-9_.~+/=-]{32,}"), ("secret.gitlab_token", "glpat-[A-Za-z0-9_.~+/=-]{14,}"),
          ("secret.aws_access_key", "A[KS]IA[A-Za-z0-9_.~+/=-]{16,}"), ("secret.slack_token", "xox[bpar]-[A-Za-z0-9_.~+/=-]{15,}")]


@query("f5_provider_tokens", "with l as (" + L + ") " + " union all ".join(
    f"select doc_id, '{d}' as detector_id, {at('value')} as start_char, value from (select doc_id, text, regexp_extract(text, '{rx}') as value from l) "
    "where value <> ''" for d, rx in TOKENS))
def f5(spark, folder):
    return spans_of(logs(spark, folder), D.provider_tokens(T))


@query("f6_configured_tokens", f"""
with l as ({L}), m as (select doc_id, text, regexp_extract(text, 'npm_[A-Za-z0-9_.~+/=-]{{8,}}') as value from l)
select doc_id, 'configured.secret_prefix' as detector_id, {at('value')} as start_char, value from m where value <> ''""")
def f6(spark, folder):
    return spans_of(logs(spark, folder), D.configured_tokens(T, CONFIG))


@query("f7_jwts", f"""
with l as ({L}), w as (select doc_id, text, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f{{}}\\[\\]:=]+')) as value from l)
select doc_id, 'secret.jwt' as detector_id, {at('value')} as start_char, value from w
where regexp_matches(value, '^[A-Za-z0-9_-]{{8,}}[.][A-Za-z0-9_-]{{8,}}[.][A-Za-z0-9_-]{{8,}}$')""")
def f7(spark, folder):
    return spans_of(logs(spark, folder), D.jwts(T))


EMAIL = r"""
w as (select doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r\f{}\[\]:=]+')) as raw from t),
v as (select doc_id, regexp_replace(raw, '^[<>(),;"'']+|[<>(),;"'']+$', '', 'g') as value from w where contains(raw, '@'))
select doc_id, value from v where regexp_matches(value, '^[A-Za-z0-9._+-]+@[A-Za-z0-9@_+-][A-Za-z0-9@._+-]*$')
  and contains(substr(value, strpos(value, '@')), '.') and right(value, 1) <> '.'"""


@query("f8_emails", f"with t as (select doc_id, text from documents union all select doc_id + 1000000000, text from ({L})), {EMAIL}")
def f8(spark, folder):
    both = documents(spark, folder).unionAll(logs(spark, folder).select(F.expr("doc_id + 1000000000"), "text"))
    return spans_of(both, D.emails(T)).select("doc_id", "value")


@query("f9_context_values", f"""
with l as ({L}), m as (
 select doc_id, text, 'authentication.structured_value' as detector_id, regexp_extract(text, '(?i)(cookie|session)[ \\t\\n:=]*([A-Za-z0-9_.~+/-][A-Za-z0-9_.~+/=-]{{7,}})', 2) as value from l
 union all
 select doc_id, text, 'personal.context_value', regexp_extract(text, '(?i)(phone|date_of_birth|birth_date)[ \\t\\n:=]*([A-Za-z0-9_.~+/-][A-Za-z0-9_.~+/=-]{{7,}})', 2) from l)
select doc_id, detector_id, {at('value')} as start_char, value from m where value <> ''""")
def f9(spark, folder):
    return spans_of(logs(spark, folder), D.context_values(T, S.lower(T)))


LUHN = """
d as (select doc_id, trim(run) as value, regexp_replace(run, '[^0-9]', '', 'g') as digits
  from (select doc_id, unnest(regexp_extract_all(text, '[0-9 -]+')) as run from t) where regexp_matches(run, '([0-9][ -]*){13}')),
x as (select *, list_sum(list_transform(range(1, length(digits) + 1), lambda i: case when i % 2 = 1 then cast(substr(reverse(digits), i, 1) as int)
   else case when cast(substr(reverse(digits), i, 1) as int) > 4 then 2 * cast(substr(reverse(digits), i, 1) as int) - 9
        else 2 * cast(substr(reverse(digits), i, 1) as int) end end)) as total from d where length(digits) between 13 and 19)
select doc_id, value from x where total % 10 = 0"""


@query("f10_payment_cards", f"with t as (select doc_id, text from documents union all select doc_id + 1000000000, text from ({L})), {LUHN}")
def f10(spark, folder):
    both = documents(spark, folder).unionAll(logs(spark, folder).select(F.expr("doc_id + 1000000000"), "text"))
    return spans_of(both, D.payment_cards(T)).select("doc_id", "value")


ACCOUNTS = "select o_orderkey as doc_id, 'pay BE' || lpad(cast(o_orderkey % 100 as string), 2, '0') || ' ' || lpad(cast(o_custkey as string), 4, '0') || ' 0000 ' || lpad(cast(o_orderkey as string), 8, '0') || ' now' as text from {orders}"
MOD97 = """
a as (select doc_id, regexp_replace(substr(text, 5), ' ', '', 'g') as compact from t),
k as (select doc_id, substr(compact, 5, n - 4) || substr(compact, 1, 4) as moved from a, range(15, 24) r(n)),
n as (select doc_id, cast(replace(replace(replace(replace(moved, 'n', '23'), 'o', '24'), 'w', '32'), 'BE', '1114') as hugeint) % 97 as rest from k)
select count(distinct doc_id) as n_valid, min(doc_id) as first_doc, max(doc_id) as last_doc from n where rest = 1"""


@query("f11_ibans", f"with t as ({sql(ACCOUNTS)}), {MOD97}")
def f11(spark, folder):
    texts = derive(spark, folder, ACCOUNTS)
    return spans_of(texts, D.ibans(T)).agg(
        F.count("*").alias("n_valid"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("f12_text_tables", f"""
with l as ({L}) select doc_id, case when kind = {len(LOG_KINDS) - 2} then 'a b' else cast(100000 + doc_id % 899999 as varchar) end as value from l where kind >= {len(LOG_KINDS) - 2}
union all select doc_id, case when kind = {len(LOG_KINDS) - 2} then {letters('cast(doc_id as varchar)')} else cast(100000 + doc_id % 899999 as varchar) end from l where kind >= {len(LOG_KINDS) - 2}""")
def f12(spark, folder):
    return spans_of(logs(spark, folder), D.tables(T, CONFIG)).select("doc_id", "value")


IPV4 = r"""
r as (select doc_id, trim(unnest(regexp_extract_all(text, '[0-9A-Fa-f.:]+')), '.') as value from t),
p as (select *, string_split(value, '.') as o from r where regexp_matches(value, '^[0-9]{1,3}([.][0-9]{1,3}){3}$'))
select doc_id, value from p where len(list_filter(o, lambda x: cast(x as int) > 255 or (length(x) > 1 and x[1] = '0'))) = 0"""


@query("f13_ip_addresses", f"with t as (select doc_id, text from documents union all select doc_id + 1000000000, text from ({L})), {IPV4}")
def f13(spark, folder):
    both = documents(spark, folder).unionAll(logs(spark, folder).select(F.expr("doc_id + 1000000000"), "text"))
    return spans_of(both, D.ip_addresses(T)).where("not contains(value, ':')").select("doc_id", "value")


@query("f14_open_context", f"""
with {ASSIGNED}, o as (select doc_id, bool_or(category is not null and open) as open from c group by doc_id)
select l.doc_id, cast(coalesce(o.open, false) as int) as open_context from l left join o using (doc_id)""")
def f14(spark, folder):
    return logs(spark, folder).select("doc_id", S.col(D.open_context(T, CONFIG).cast("int")).alias("open_context"))


@query("f15_strip_ansi", f"with l as ({L}) select doc_id, regexp_replace(text, chr(27) || '\\[[^@-~]*[@-~]', '', 'g') as plain from l")
def f15(spark, folder):
    return logs(spark, folder).select("doc_id", S.col(D.strip_ansi(T)).alias("plain"))


# What each log line must look like once redacted, by its kind; written by hand.
REDACTED = [
    None, "password: [C]", "DB_PASSWORD=[C]", "api-key = [C]", None, "Authorization: [A]", "url mysql://app:[C]@db.example.test/shop?x=1",
    "push [C] done", "key [C] end", "[C]", "[C]", "cookie [A]; path=/", "phone [P]", "jwt [A] end", "mail to <[P]>, thanks", None,
    "card [F] ok", None, "run [F]", "from [P] to 256.1.1.1", "[C]", "first_name: [P]", "my_address=[P]", None,
    "[C]‹n›after", "password=[C]", "secret:[C]", "‹e›[31mtoken: [C]‹e›[0m", "id | email | city‹n›---+---+---‹n›1 | [P] | x‹n›2 | [P] | y‹n›end",
    "name\tphone‹n›Ann\t[P]‹n›Bob\t[P]",
]


def _redacted_sql() -> str:
    packed = "¦".join(r or "-" for r in REDACTED)
    text = f"split_part('{packed}', '¦', kind + 1)"
    for mark, value in (("[C]", "'[REDACTED:CREDENTIAL]'"), ("[A]", "'[REDACTED:AUTHENTICATION]'"), ("[P]", "'[REDACTED:PERSONAL_DATA]'"),
                        ("[F]", "'[REDACTED:FINANCIAL_DATA]'"), ("‹n›", "chr(10)"), ("‹e›", "chr(27)")):
        text = f"replace({text}, '{mark}', {value})"
    return text


@query("f16_redacted_text", f"""
with l as ({L}), r as (select *, {_redacted_sql()} as content from l)
select doc_id, case when content = '-' then text else content end as content,
  case when content = '-' then 'allow' else 'sanitize' end as decision from r""")
def f16(spark, folder):
    return scan.verdicts(logs(spark, folder), "text", "doc_id", CONFIG).select("doc_id", "content", "decision")


@query("p26_field_category", f"""
with n as (select unnest(string_split('password,DB_PASSWORD,api-key,api key,auth_token,token,my_address,mailbox,e-mail,Set-Cookie,hash,rehash,'
  || 'card_number,iban,customer_profile,date_of_birth,date.of.birth,first_name,first-name,tokens,secret_access_key,pass,compass', ',')) as word, o_custkey % 7 as part
  from orders), f as (select case when part % 2 = 0 then word else 'x_' || word end as name from n),
m as (select name, lower(regexp_replace(name, '[^A-Za-z0-9]', '_', 'g')) as normal from f)
select name, coalesce({FIELD_SQL.format(n='normal')}, '-') as category, count(*) as n from m group by all""")
def p26(spark, folder):
    words = ("password,DB_PASSWORD,api-key,api key,auth_token,token,my_address,mailbox,e-mail,Set-Cookie,hash,rehash,card_number,iban,"
             "customer_profile,date_of_birth,date.of.birth,first_name,first-name,tokens,secret_access_key,pass,compass")
    names = load(spark, folder, "orders").select(
        F.explode(F.split(F.lit(words), ",")).alias("word"), (F.col("o_custkey") % 7).alias("part"))
    names = names.select(F.when(F.col("part") % 2 == 0, F.col("word")).otherwise(F.concat(F.lit("x_"), "word")).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).select(
        "name", S.col(S.coalesce(field_category(R("name"), CONFIG), S.lit("-"))).alias("category"), "n")


# Spans from every order row: starts and lengths follow from its keys.
SPANS = ("select o_orderkey % 500 as doc_id, cast(o_custkey % 97 as int) as s, cast(o_custkey % 97 + 1 + o_orderkey % 9 as int) as e, "
         "cast(o_orderkey % 8 as int) as c from {orders}")
RANKS = "[8, 7, 6, 5, 4, 3, 2, 1]"


@query("w5_merged_spans", f"""
with s as (select distinct * from ({sql(SPANS)})),
o as (select *, max(e) over (partition by doc_id order by s, e, c rows between unbounded preceding and 1 preceding) as before from s),
g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by doc_id order by s, e, c) as island from o)
select doc_id, min(s) as start_char, max(e) as end_char, max(({RANKS})[c + 1]) as top_rank from g group by doc_id, island""")
def w5(spark, folder):
    from warden.functions.spans import SPAN
    from warden.vocab import CATEGORY_RANK
    by_rank = sorted(CATEGORY_RANK, key=CATEGORY_RANK.get, reverse=True)
    rows = derive(spark, folder, SPANS).distinct()
    category = F.element_at(F.array(*[F.lit(c) for c in by_rank]), F.col("c") + 1)
    one = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.lit(0).alias("ord"), (F.lit(8) - F.col("c")).alias("rank"),
                   category.alias("category"), F.lit("d").alias("detector"), F.lit("high").alias("confidence")).cast(SPAN)
    packed = rows.groupBy("doc_id").agg(F.collect_list(one).alias("spans"))
    merged = packed.select("doc_id", F.explode_outer(S.col(merge(R("spans")))).alias("m"))
    return merged.select("doc_id", F.col("m.start").alias("start_char"), F.col("m.end").alias("end_char"), F.col("m.rank").alias("top_rank"))


def _three(name: str) -> str:
    """Documents with e-mails, cards or IPv4 addresses: the kinds the given corpus holds."""
    return (f"with t as (select doc_id, text from documents), email as (with {EMAIL}), card as (with {LUHN}), ip as (with {IPV4}),"
            " found as (select doc_id, 'personal.email' as detector_id, value from email union all select doc_id, 'financial.payment_card', value"
            " from card union all select doc_id, 'personal.ip_address', value from ip) " + name)


DETECTORS3 = ("personal.email", "financial.payment_card", "personal.ip_address")


def corpus_findings(spark, folder):
    """Findings of three detectors, which is what O2 ranks by its statement."""
    found = scan.findings(documents(spark, folder), "text", "doc_id", CONFIG)
    return found.where(F.col("detector_id").isin(*DETECTORS3))


@query("a12_detector_report", FINDINGS + """select detector_id, category, count(*) as n_findings,
  count(distinct coalesce(cast(doc_id as varchar), '')) as n_docs from found group by all""")
def a12(spark, folder):
    return scan.detector_report(scan.findings(documents(spark, folder), "text", "doc_id", CONFIG), "doc_id")


@query("a12_daily_sketches")
def a12_sketches(spark, folder):
    found = scan.findings(documents(spark, folder), "text", "doc_id", CONFIG).withColumn("day", F.col("doc_id") % 7)
    return scan.sketch_report(scan.detector_sketches(found, "doc_id", ["day"]))


@query("o1_ordered_findings")
def o1(spark, folder):
    return scan.findings(documents(spark, folder), "text", "doc_id", CONFIG)


@query("o2_top_documents", _three("""select doc_id, count(*) as n_findings, max(case when detector_id like 'fin%' then 6 else 4 end) as top_rank
  from found group by all order by 2 desc, 3 desc, 1 limit 20"""))
def o2(spark, folder):
    return scan.top_texts(corpus_findings(spark, folder), "doc_id", 20)


@query("a10_document_verdicts")
def a10(spark, folder):
    return scan.verdicts(documents(spark, folder), "text", "doc_id", CONFIG).select(
        "doc_id", "decision", "rule_id", F.array_join("categories", ",").alias("categories"), "n_findings")


# Long texts made of whole customer rows: lists of addresses, one of them beyond the cap of findings.
@query("a11_finding_cap", """select least(c_nationkey, 12) as doc_id, case when count(*) > 256 then 'block' else 'sanitize' end as decision,
  case when count(*) > 256 then 'result.finding_limit' else 'result.sensitive_output' end as rule_id from customer
  group by 1""")
def a11(spark, folder):
    texts = load(spark, folder, "customer").groupBy(F.least("c_nationkey", F.lit(12)).alias("doc_id")).agg(F.array_join(
        F.collect_list(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.test"))), " ").alias("text"))
    return scan.verdicts(texts, "text", "doc_id", CONFIG).select("doc_id", "decision", "rule_id")


STREAMS = ("select o_orderkey as doc_id, case o_orderkey % 5 when 0 then 'password=' when 1 then 'token: ' || md5(cast(o_orderkey as string)) "
           "when 2 then '' when 3 then '{{' else 'plain' end as out, case o_custkey % 3 when 0 then '' when 1 then 'secret: |' else 'ok' end as err "
           "from {orders}")


@query("a13_two_stream_verdicts", f"""
with s as ({sql(STREAMS)}), f as (select *, out = 'password=' as open_out, err = 'secret: |' as open_err, out like 'token:%' as hit, out = '{{' as broken from s)
select doc_id, case when (open_out and err <> '') or (open_err and out <> '') then 'result.cross_stream_context' when broken then 'result.inspection_failed'
  when hit or open_err then 'result.sensitive_output' else 'result.clean' end as rule_id,
 case when (open_out and err <> '') or (open_err and out <> '') or broken then 'block' when hit or open_err then 'sanitize' else 'allow' end as decision from f""")
def a13(spark, folder):
    return scan.two_stream_verdicts(derive(spark, folder, STREAMS), "doc_id", "out", "err", CONFIG)


@query("s9_corpus_limits", """
select doc_id, case when octet_length(encode(text)) > 1048576 then 'result.scan_limit'
  when length(text) - length(replace(text, chr(10), '')) > 16384 then 'result.structure_limit'
  when list_max(list_transform(string_split(text, chr(10)), lambda x: length(x) - length(replace(replace(x, '|', ''), chr(9), '')))) > 4096
   then 'result.structure_limit' else '' end as rule_id
from (select doc_id, text from documents union all select -1 - c_nationkey, repeat('|', 2 * cast(count(*) as int) * 40) from customer group by c_nationkey)""")
def s9(spark, folder):
    wide = load(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).select(
        (-1 - F.col("c_nationkey")).cast("bigint").alias("doc_id"), F.expr("repeat('|', cast(2 * n * 40 as int))").alias("text"))
    return documents(spark, folder).unionByName(wide).select(
        "doc_id", S.col(S.coalesce(scan.limit_rule(T), S.lit(""))).alias("rule_id"))


PROTECTED = ("select o_orderkey as doc_id, case o_orderkey % 4 when 0 then 'free words ' || cast(o_custkey as string) "
             f"when 1 then 'id | name' || chr(10) || '---+---' || chr(10) || '1 | ' || {letters('cast(o_custkey as string)')} || chr(10) || 'tail' "
             "when 2 then '  ' else 'id | name' || chr(10) || '1 | no ruler' end as text from {orders}")


@query("f18_protected_sources", f"""
with p as ({sql(PROTECTED)}) select doc_id, case doc_id % 4 when 2 then 'allow' when 1 then 'sanitize' else 'block' end as decision,
 case doc_id % 4 when 2 then 'result.clean' when 1 then 'result.sensitive_output' else 'result.unstructured_sensitive_source' end as rule_id,
 case doc_id % 4 when 2 then text when 1 then 'id | name' || chr(10) || '---+---' || chr(10) || '[REDACTED:UNKNOWN_SENSITIVE] | [REDACTED:UNKNOWN_SENSITIVE]'
   || chr(10) || '[REDACTED:UNKNOWN_SENSITIVE]' end as content from p""")
def f18(spark, folder):
    return scan.protected_verdicts(derive(spark, folder, PROTECTED), "text", "doc_id", CONFIG)


JSON = ("select event_id as doc_id, case event_id % 4 when 0 then props when 1 then '{{\"user\":{{\"mail\":\"a' || cast(user_id as string) || '\"}}}}' "
        "when 2 then '{{\"note\":[\"x\",\"b@example.test\"],\"pass\":null}}' else '{{\"broken\":' end as text from {events}")


@query("f22_json_verdicts", """select event_id as doc_id, case event_id % 4 when 0 then 'allow' when 3 then 'block' else 'sanitize' end as decision,
 case event_id % 4 when 0 then 'result.clean' when 3 then 'result.sanitization_error' else 'result.sensitive_output' end as rule_id,
 case event_id % 4 when 0 then '' when 3 then 'unknown_sensitive' else 'personal_data' end as categories from events""")
def f22(spark, folder):
    return scan.verdicts(derive(spark, folder, JSON), "text", "doc_id", CONFIG).select(
        "doc_id", "decision", "rule_id", F.array_join("categories", ",").alias("categories"))


@query("redaction_leaves_nothing", "select 0 as n_leaks, count(*) as n_docs from documents")
def leftover(spark, folder):
    """Every detector over every redacted text; what it finds may hold nothing but placeholders."""
    redacted = scan.verdicts(documents(spark, folder), "text", "doc_id", CONFIG).select("doc_id", F.col("redacted").alias("text"))
    rest = lambda s: S.regexp_replace(T.substr(s["start"] + 1, s["end"] - s["start"]), r"\[REDACTED:[A-Z_]+\]", "")
    left = S.filter(D.detect(T, CONFIG), lambda s: rest(s).rlike("[0-9A-Za-z]"))
    counted = redacted.select("doc_id", S.col(S.coalesce(S.size(left), S.lit(0))).alias("n"))
    return counted.agg(F.count_if(F.col("n") > 0).cast("int").alias("n_leaks"), F.count("*").alias("n_docs"))


# Lists of addresses, a line per customer; every other list is far beyond the cap of findings.
ADDRESSES = """select c_custkey as doc_id, case when c_custkey % 2 = 0 then 400 else 3 end as n, array_join(transform(
  sequence(1, case when c_custkey % 2 = 0 then 400 else 3 end), i -> concat('u', cast(i * 7 + c_custkey as string), '@example.test')), ' ') as text
  from {customer} where c_custkey % 10 < 2"""


@query("f16_complete_redaction", """
select c_custkey as doc_id, case when c_custkey % 2 = 0 then 'result.finding_limit' else 'result.sensitive_output' end as rule_id,
  case when c_custkey % 2 = 0 then 400 else 3 end as n_findings,
  rtrim(repeat('[REDACTED:PERSONAL_DATA] ', case when c_custkey % 2 = 0 then 400 else 3 end)) as redacted
from customer where c_custkey % 10 < 2""")
def f16_complete(spark, folder):
    return scan.verdicts(derive(spark, folder, ADDRESSES), "text", "doc_id", CONFIG).select(
        "doc_id", "rule_id", "n_findings", "redacted")
