"""Statements of the text operators that SQL can express, over whole tables."""

EXACT = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))"""

_FIELDS = "concat(" + ", ".join(
    f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    for c in ("doc_id", "source", "lang", "n_chars")) + ", coalesce(strlen({text}) || ':' || {text}, '-'))"

#: Levels go up run by run; a leaf then climbs with all nodes that share its run, and folds them.
MERKLE = f"""
with recursive d as (
  select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
rows_ as (
  select doc_id, coalesce('=' || source, '') as tree, sha256({_FIELDS.format(text="text")}) as leaf,
         sha256({_FIELDS.format(text="low")}) as changed from d),
leaves as (
  select *, row_number() over (partition by tree order by doc_id, leaf) - 1 as pos, count(*) over (partition by tree) as n
  from rows_),
up as (
  select tree, 0 as level, pos, n, leaf as h from leaves
  union all
  select tree, level + 1, pos // 16, (any_value(n) - 1) // 16 + 1, sha256(string_agg(h, '' order by pos))
  from up where n > 1 group by tree, level, pos // 16),
subroots as (
  select tree, h, row_number() over (order by encode(tree)) - 1 as pos, count(*) over () as n from up where n = 1),
top as (
  select 0 as level, pos, n, h from subroots
  union all
  select level + 1, pos // 16, (any_value(n) - 1) // 16 + 1, sha256(string_agg(h, '' order by pos))
  from top where n > 1 group by level, pos // 16),
root as (select h from top where n = 1),
climb as (
  select doc_id, leaf, tree, 0 as level, pos, n, '' as seen,
         case when crc.v % 5 = 0 then changed else leaf end as node
  from leaves join (select doc_id as id, {{crc}} as v from documents) crc on crc.id = doc_id
  union all
  select c.doc_id, any_value(c.leaf), any_value(c.tree), any_value(c.level) + 1, any_value(c.pos) // 16,
         (any_value(c.n) - 1) // 16 + 1,
         any_value(c.seen) || coalesce(string_agg(u.h, '' order by u.pos) filter (where u.pos <> c.pos), ''),
         sha256(string_agg(case when u.pos = c.pos then c.node else u.h end, '' order by u.pos))
  from climb c join up u on u.tree = c.tree and u.level = c.level and u.pos // 16 = c.pos // 16
  where c.n > 1 group by c.doc_id),
beyond as (
  select c.doc_id, c.leaf, s.h as subroot, 0 as level, s.pos, s.n, c.seen, c.node
  from climb c join subroots s on s.tree = c.tree where c.n = 1
  union all
  select c.doc_id, any_value(c.leaf), any_value(c.subroot), any_value(c.level) + 1, any_value(c.pos) // 16,
         (any_value(c.n) - 1) // 16 + 1,
         any_value(c.seen) || coalesce(string_agg(t.h, '' order by t.pos) filter (where t.pos <> c.pos), ''),
         sha256(string_agg(case when t.pos = c.pos then c.node else t.h end, '' order by t.pos))
  from beyond c join top t on t.level = c.level and t.pos // 16 = c.pos // 16
  where c.n > 1 group by c.doc_id)
select doc_id, leaf, subroot, root.h as root, sha256(seen) as proof_sha256, node as folded_root, node = root.h as verified
from beyond, root where n = 1"""

#: crc32 of a decimal id, bit by bit over its bytes.
_CRC = """xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint),
    lambda c, b: list_reduce(range(8), lambda r, i: case when r % 2 = 1 then xor(r // 2, 3988292384::bigint) else r // 2 end,
    xor(c, b)), 4294967295::bigint), 4294967295::bigint)"""
MERKLE = MERKLE.replace("{crc}", _CRC)

COLLOCATIONS = """
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
spans as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, unnest(range(1, 5)) as t(k)),
grams as (
  select lang, k, list_slice(w, i, i + k - 1) as g, count(*) as f from spans group by all having k = 1 or f >= 30),
total as (select lang, sum(f)::bigint as n from grams where k = 1 group by lang),
longer as (
  select lang, g, max(f) as f from (
    select lang, list_slice(g, i, i + j - 1) as g, f
    from (select lang, g, f, k, unnest(range(2, k)) as j from grams where k > 2) as x, unnest(range(1, k - j + 2)) as t(i))
  group by all),
whole as (
  select c.* from grams c left join longer o on o.lang = c.lang and o.g = c.g
  where c.k > 1 and not coalesce(100 * o.f::hugeint >= 80 * c.f::hugeint, false)),
cuts as (
  select c.lang, c.g, c.f as a, x.f as l, r.f as r, j, (2000000 * c.f::hugeint) // (x.f + r.f) as score
  from (select *, unnest(range(1, k)) as j from whole) c
  join grams x on x.lang = c.lang and x.g = list_slice(c.g, 1, j)
  join grams r on r.lang = c.lang and r.g = list_slice(c.g, j + 1, c.k)),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n,
       score::bigint as score
from (select *, array_to_string(g, ' ') as phrase from best) join total using (lang)
qualify rank <= 2000"""
