"""All merged findings of the documents as one statement (A12): every detector, the second look for cards, the merge.

Written apart from the detectors, for an engine whose patterns know no look-around. ``found`` has a row per finding.
"""

from __future__ import annotations

#: White space but the line feed, and characters that part tokens.
W = r"\t\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAK = r" \t\n\f\r{}\[\]:="
TOKEN = r"[A-Za-z0-9_\-.~+/=]"
TRIMMED = "<>(),;\"''"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
QUAD = rf"({OCTET}\.){{3}}{OCTET}"
CLASS = """case when regexp_matches({n}, '(^|_)(password|passwd|secret|api_key|private_key)$') or {n} in ('pass','token','access_token',
   'refresh_token','accountkey','access_key_id','secret_access_key') then 'structured.credential_field'
  when regexp_matches({n}, '(^|_)(authorization|cookie|session|session_id|hash)$') then 'structured.authentication_field'
  when regexp_matches({n}, '(^|_)(card_number|iban|bank_account|payment_method)$') then 'structured.financial_field'
  when regexp_matches({n}, '(^|_)(billing_address|shipping_address|customer_profile|webform_submission|comment_author)$') then 'structured.customer_field'
  when regexp_matches({n}, '(^|_)(email|mail|phone|telephone|address|postal_code|birth_date|date_of_birth)$') then 'structured.personal_field'
  when {n} = 'first_name' then 'configured.sensitive_field' end"""
CATEGORY = """case when detector in ('secret.authorization', 'secret.jwt') or contains(detector, 'authentication') then 'authentication'
  when detector like 'secret.%' or detector in ('structured.credential_field', 'configured.secret_prefix') then 'credential'
  when contains(detector, 'financial') then 'financial_data' when contains(detector, 'customer') then 'customer_data' else 'personal_data' end"""


def trimmed(text: str) -> str:
    return rf"regexp_replace({text}, '^[{W}\n]+|[{W}\n]+$', '', 'g')"


def normal(name: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({name}, '[^\x00-\x7f]', '__', 'g'), '[^A-Za-z0-9]', '_', 'g'))"


def hits(regex: str, of: str = "t", where: str = "true") -> str:
    """doc, pos and value of the matches, none of them empty; the pieces between them give the offsets."""
    return f"""(select doc, cast(before + length(gap) as bigint) as pos, value from (select doc, gap, value, coalesce(sum(length(gap) + length(value)) over (
    partition by doc order by i rows between unbounded preceding and 1 preceding), 0) as before
  from (select doc, unnest(regexp_split_to_array(text, '{regex}')) as gap, unnest(regexp_extract_all(text, '{regex}')) as value,
    generate_subscripts(regexp_split_to_array(text, '{regex}'), 1) as i from {of} where {where} and regexp_matches(text, '{regex}'))) where value is not null)"""


def after_key(keys: str, ord_: int, detector: str) -> list[str]:
    found = []
    for key in keys.split():
        head = rf"(?i){key}[ \t\n\f\r:=]*"
        lead = f"length(regexp_extract(value, '{head}'))"
        found.append(f"select doc, pos + {lead} as s, pos + length(value) as e, {ord_} as ord, '{detector}' as detector from "
                     f"{hits(head + TOKEN + '*')} where length(value) - {lead} >= 8")
    return found


def tokens(regex: str, ord_: int, detector: str) -> str:
    return f"select doc, pos, pos + length(value), {ord_}, '{detector}' from {hits(regex)}"


def cards(of: str) -> str:
    """Whole runs of digits, blanks and hyphens with 13 to 19 digits that pass the Luhn test."""
    return rf"""(select doc, pos + length(value) - length(ltrim(value, ' ')) as s, pos + length(rtrim(value, ' ')) as e, 10 as ord, 'financial.payment_card' as detector
  from (select *, reverse(regexp_replace(value, '[ -]', '', 'g')) as digits from {hits('[0-9 -]+', of, "regexp_matches(text, '([0-9][ -]*){13}')")}
    where regexp_matches(value, '^[ -]*([0-9][ -]*){{13,19}}$'))
  where list_sum(list_transform(range(1, length(digits) + 1), lambda i: case when i % 2 = 1 then cast(substr(digits, i, 1) as int)
    else cast(substr(digits, i, 1) as int) * 2 - case when cast(substr(digits, i, 1) as int) > 4 then 9 else 0 end end)) % 10 = 0)"""


def islands(spans: str) -> str:
    """Spans with the island of overlapping and touching ones that they are in."""
    return f"""(select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by doc order by s, e, ord, detector rows unbounded preceding) as island
  from (select *, max(e) over (partition by doc order by s, e, ord, detector rows between unbounded preceding and 1 preceding) as before
    from (select *, case {CATEGORY} when 'credential' then 8 when 'authentication' then 7 when 'financial_data' then 6 when 'customer_data' then 5 else 4 end as rank
      from {spans})))"""


_TEXTS = r"""t as materialized (select row_number() over () as doc, doc_id, regexp_replace(text, '\x1b\[[^@-~]*[@-~]?', '', 'g') as text
  from documents where not regexp_matches(text, '^[ \t\n\x0b\f\r]*[{\["]'))"""
# A key block up to its own footer, else to the end; what follows a block is searched again.
_PEM = rf"""pem as (
  select doc, text, 0 as base, cast(0 as bigint) as s, cast(0 as bigint) as e from t where regexp_matches(text, '-----BEGIN [^\n]*PRIVATE KEY')
  union all
  select doc, text, e2, base + pos, e2 from (select *, base + pos + case when label_end > 0 and foot > 0 then 11 + label_end + foot + length(footer) - 1 else length(rest) - pos end as e2
    from (select *, strpos(substr(tail, label_end + 1), footer) as foot
      from (select *, length(regexp_extract(tail, '^[^\n]*-----[{W}]*\n')) as label_end, '-----END ' || regexp_extract(tail, '^([^\n]*)-----[{W}]*\n', 1) || '-----' as footer
        from (select *, substr(rest, pos + 12) as tail
          from (select doc, text, base, rest, strpos(rest, regexp_extract(rest, '-----BEGIN [^\n]*?PRIVATE KEY')) - 1 as pos
            from (select doc, text, e as base, substr(text, e + 1) as rest from pem) where regexp_matches(rest, '-----BEGIN [^\n]*PRIVATE KEY')))))))"""
_LINES = rf"""lines as materialized (select *, cast(coalesce(sum(length(line) + 1) over (partition by doc order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as pos
  from (select doc, length(text) as size, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
    from t where regexp_matches(text, '[=:|\t]'))),
keys as (select *, {CLASS.format(n='name')} as detector, {trimmed('raw')} as v, regexp_replace(raw, '\r+$', '') as after
  from (select *, {normal(f"right({trimmed('key')}, 160)")} as name, substr(line, length(key) + 2) as raw, pos + length(key) + 1 as mark
    from (select *, regexp_extract(line, '^[^=:]*') as key from lines where regexp_matches(line, '[=:]')))),
assigned as (select *, v = '' or v in ('|', '>', '|-', '>-', '|+', '>+') or right(v, 1) = chr(92)
    or (left(v, 1) in ('"', '''') and (length(v) < 2 or right(v, 1) <> left(v, 1))) as open from keys where detector is not null),
assignment as (select doc, case when open then mark else mark + length(regexp_extract(after, '^[{W}]*')) end as s,
    case when open then size else mark + length(after) end as e, 1 as ord, detector
  from (select *, min(case when open then i end) over (partition by doc) as first_open from assigned) where first_open is null or i <= first_open)"""
_TABLES = rf"""cells as (select doc, i, pos, line, own, string_split(line, own) as parts
  from (select doc, i, pos, regexp_replace(line, '\r+$', '') as line, case when contains(line, '|') then '|' else chr(9) end as own from lines)),
kinds as materialized (select doc, i, own, len(parts) as n, place, {CLASS.format(n='name')} as detector
  from (select *, {normal(trimmed('part'))} as name from (select *, unnest(parts) as part, generate_subscripts(parts, 1) as place
    from cells where contains(line, own) and len(parts) > 1))),
headers as materialized (select doc, i, any_value(own) as own, any_value(n) as n from kinds where detector is not null group by doc, i),
ruled as materialized (select * from cells where doc in (select doc from headers)),
walk as (
  select r.doc, r.i, case when h.i is null then 0 else r.i end as head, h.own as delim, h.n as n, false as is_row
  from ruled r left join headers h on h.doc = r.doc and h.i = r.i where r.i = 1
  union all
  select doc, i, case when held or is_row then head when new_own is not null then i else 0 end,
    case when held or is_row then delim else new_own end, case when held or is_row then n else new_n end, is_row
  from (select *, not held and head > 0 and contains(line, delim) and len(string_split(line, delim)) = n as is_row
    from (select r.doc, r.i, r.line, w.head, w.delim, w.n, h.own as new_own, h.n as new_n,
        w.head > 0 and regexp_matches(r.line, '^[ \t\x0b\f\r|+\-=:]*$') and regexp_matches(r.line, '[|+\-=:]') as held
      from walk w join ruled r on r.doc = w.doc and r.i = w.i + 1 left join headers h on h.doc = r.doc and h.i = r.i))),
cell as (select doc, head, i, unnest(parts) as part, generate_subscripts(parts, 1) as place, pos
  from (select w.*, r.pos, string_split(r.line, w.delim) as parts from walk w join ruled r on r.doc = w.doc and r.i = w.i where w.is_row)),
tabled as (select c.doc, start + length(regexp_extract(part, '^[{W}]*')) as s, start + length(regexp_replace(part, '[{W}]+$', '')) as e, 2 as ord, k.detector
  from (select *, pos + coalesce(sum(length(part) + 1) over (partition by doc, i order by place rows between unbounded preceding and 1 preceding), 0) as start from cell) c
  join kinds k on k.doc = c.doc and k.i = c.head and k.place = c.place where k.detector is not null)"""
# Account numbers: from every word start the longest prefix with remainder 1.
_IBANS = r"""starts as (select doc, text, unnest(range(1, length(text) - 13)) as p
  from t where regexp_matches(text, '(^|[^A-Za-z0-9])[A-Za-z]{2}[0-9]{2}([ -]*[A-Za-z0-9]){11}')),
accounts as (select doc, p, regexp_extract(substr(text, p), '^[A-Za-z]{2}[0-9]{2}([ -]*[A-Za-z0-9]){11,30}') as value
  from starts where regexp_matches(substr(text, p, 4), '^[A-Za-z]{2}[0-9]{2}$') and not regexp_matches(substr(text, p - 1, 1), '^[A-Za-z0-9]') or
    (p = 1 and regexp_matches(substr(text, 1, 4), '^[A-Za-z]{2}[0-9]{2}$'))),
signs as (select doc, p, value, upper(regexp_replace(value, '[ -]', '', 'g')) as compact from accounts where value <> ''),
prefixes as (select doc, p, value, n, list_reduce(list_prepend(0, list_transform(string_split(substr(compact, 5, n - 4) || substr(compact, 1, 4), ''),
    lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)),
    lambda r, x: (r * case when x > 9 then 100 else 10 end + x) % 97) as rest
  from (select *, unnest(range(15, length(compact) + 1)) as n from signs)),
iban as (select doc, p - 1 as s, p - 1 + list_filter(range(1, length(value) + 1), lambda i: regexp_matches(substr(value, i, 1), '[A-Za-z0-9]'))[size] as e,
    11 as ord, 'financial.iban' as detector
  from (select doc, p, value, max(n) as size from prefixes where rest = 1 group by all))"""
# Addresses: whole runs; of the second kind at most one gap, eight groups without it, seven at most beside it.
_ADDRESSES = rf"""runs as (select doc, pos + length(value) - length(ltrim(value, '.')) as s, pos + length(rtrim(value, '.')) as e, trim(value, '.') as value
  from {hits('[0-9A-Fa-f.:]+', 't', r"regexp_matches(text, '[.][0-9]{1,3}[.][0-9]|:[0-9A-Fa-f]{0,4}:')")}),
six as (select *, regexp_replace(value, ':{QUAD}$', ':0:0') as groups from runs where contains(value, ':')),
address as (select doc, s, e, 12 as ord, 'personal.ip_address' as detector from runs where regexp_matches(value, '^{QUAD}$')
  union all select doc, s, e, 12, 'personal.ip_address' from six where
    regexp_matches(groups, '^([0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$') or
    (regexp_matches(groups, '^([0-9A-Fa-f]{{1,4}}(:[0-9A-Fa-f]{{1,4}})*)?::([0-9A-Fa-f]{{1,4}}(:[0-9A-Fa-f]{{1,4}})*)?$')
      and len(list_filter(string_split(groups, ':'), lambda g: g <> '')) <= 7))"""
_PREFIXES = [
    ("secret.github_token", "|".join(f"gh{c}_{TOKEN}{{32,}}" for c in "pousr") + f"|github_pat_{TOKEN}{{13,}}"),
    ("secret.gitlab_token", f"glpat-{TOKEN}{{14,}}"), ("secret.aws_access_key", f"A[KS]IA{TOKEN}{{16,}}"),
    ("secret.google_api_key", f"AIza{TOKEN}{{35,}}"), ("secret.stripe_key", f"[sr]k_(live|test)_{TOKEN}{{12,}}"),
    ("secret.slack_token", f"xox[bpar]-{TOKEN}{{15,}}"), ("secret.oauth_token", rf"ya29\.{TOKEN}{{15,}}"),
]
_TOKEN = f"[^{BREAK}]+"
_MAIL = r"[A-Za-z0-9._\-+]+@[A-Za-z0-9@._\-+]+"
_DOMAIN = r"regexp_extract(value, '^[^@]+@([A-Za-z0-9@._\-+]+)', 1)"
_URL = "^[A-Za-z]+://[^:]*:"
_SPANS = [
    "select doc, s, e, 0 as ord, 'secret.pem_private_key' as detector from pem where e > 0",
    "select * from assignment", "select * from tabled",
    *after_key("authorization bearer", 3, "secret.authorization"),
    *[rf"""select doc, pos + length(regexp_extract(value, '{_URL}')), pos + length(regexp_extract(value, '(?s)^([A-Za-z]+://[^:]*:.*)@', 1)), 4, 'secret.database_url'
  from {hits(rf"(?i){scheme}://[^/?# \n\r]*")} where regexp_matches(value, '(?s){_URL}.*@')""" for scheme in ("mysql", "mariadb", "postgres", "postgresql")],
    *[tokens(regex, 5, detector) for detector, regex in _PREFIXES],
    tokens(f"npm_{TOKEN}{{8,}}", 6, "configured.secret_prefix"),
    f"""select doc, pos, pos + length(value), 7, 'secret.jwt' from {hits(_TOKEN, 't', "regexp_matches(text, '[.][A-Za-z0-9_-]{8,}[.]')")}
  where regexp_matches(value, '^[A-Za-z0-9_-]{{8,}}[.][A-Za-z0-9_-]{{8,}}[.][A-Za-z0-9_-]{{8,}}$')""",
    f"""select doc, pos + length(regexp_extract(value, '^[{TRIMMED}]*')), pos + length(regexp_extract(value, '^[{TRIMMED}]*{_MAIL}')), 8, 'personal.email'
  from {hits(_TOKEN, 't', "contains(text, '@')")} where regexp_matches(value, '^[{TRIMMED}]*{_MAIL}[{TRIMMED}]*$')
    and contains({_DOMAIN}, '.') and left({_DOMAIN}, 1) <> '.' and right({_DOMAIN}, 1) <> '.'""",
    *after_key("phone telephone date_of_birth birth_date", 9, "personal.context_value"),
    *after_key("cookie session", 9, "authentication.structured_value"),
    f"select * from {cards('t')}", "select * from iban", "select * from address",
]
#: CTEs up to ``found`` (doc_id, detector_id, category); the statement goes on behind them.
FINDINGS = f"""with recursive {_TEXTS}, {_PEM}, {_LINES}, {_TABLES}, {_IBANS}, {_ADDRESSES},
raw as materialized (select * from ({' union all '.join(_SPANS)}) where s < e),
merged as (select doc, min(s) as s, max(e) as e from {islands('raw')} group by doc, island),
-- Digits of a card may run on into another finding: a second look with all findings taken out.
blanked as (select doc, string_agg(substr(text, last + 1, s - last) || repeat(']', e - s), '' order by s) || substr(any_value(text), max(e) + 1) as text
  from (select m.doc, cast(s as bigint) as s, cast(e as bigint) as e, text, cast(coalesce(lag(e) over (partition by m.doc order by s), 0) as bigint) as last
    from merged m join t on t.doc = m.doc where regexp_matches(text, '([0-9][ -]*){{13}}')) group by doc),
every as (select * from raw union all select * from {cards('blanked')} where s < e),
named as (select doc, first(detector order by rank desc, s, e, ord, detector) as detector from {islands('every')} group by doc, island),
found as (select t.doc_id, detector as detector_id, {CATEGORY} as category from named join t on t.doc = named.doc)
"""
