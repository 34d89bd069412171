"""Registered queries on calls and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from warden.functions import sql as S
from warden.functions.calls import candidates, capability, is_mcp, patch_paths, query_not_text
from warden.functions.decisions import BUILT_IN, PathRule, RuleSet
from warden.functions.paths import bad_component, covers, normalize
from warden.functions.globs import compile_path, table_regex
from warden.operators import commands, paths as path_ops, replay, rules as rule_ops
from warden.plans import derived
from warden.plans.derived import (
    CALLS, COMMANDS, CONFIGURED_TABLES, PATHS, SQL_TEXTS, TOOLS, calls, derive, golden, pick, sql)
from warden.plans.registry import query

R = S.ref
C = sql(CALLS)

# What the built-in rules match, written out by hand for paths without a leading slash.
BUILT_IN_SQL = [
    ("drupal.secret.env", "read", r"(^|/)\.env(\.[^/]*)?$"),
    ("composer.secret.auth_json", "read", r"(^|/)(composer-)?auth\.json$"),
    ("drupal.secret.settings_php", "read", r"(^|/)(sites/[^/]*|env(/.*)?)/settings(\.local)?\.php$"),
    ("filesystem.secret.private_key", "read", r"(^|/)[^/]*\.(pem|key)$"),
    ("filesystem.secret.credential_store", "read",
     r"(^|/)(\.ssh/id_(rsa|dsa|ecdsa|ecdsa_sk|ed25519|ed25519_sk)|\.aws/credentials|\.azure/(accessTokens|msal_token_cache)\.json"
     r"|\.config/gcloud/(credentials\.db[^/]*|application_default_credentials\.json)|\.kube/config|\.docker/config\.json"
     r"|\.netrc|_netrc|\.npmrc|\.pypirc)$"),
    ("filesystem.write.core", "write", r"(^|/)core(/.*)?$"),
    ("filesystem.write.vendor", "write", r"(^|/)vendor(/.*)?$"),
    ("filesystem.write.contrib_module", "write", r"(^|/)web/modules/contrib(/.*)?$"),
    ("filesystem.write.contrib_theme", "write", r"(^|/)web/themes/contrib(/.*)?$"),
]
READS = "('file_read','file_move','file_search','mcp_call','unknown')"
WRITES = "('file_write','file_delete','file_move','mcp_call','unknown')"


def rule_ladder(path: str, capability_: str = "capability", fallback: str = "'default.no_matching_rule'",
                rules=None) -> str:
    lines = " ".join(
        f"when {capability_} in {READS if op == 'read' else WRITES} and regexp_matches(ltrim({path}, '/'), '{rx}') then '{id_}'"
        for id_, op, rx in (rules or BUILT_IN_SQL))
    return f"case {lines} else {fallback} end"


ORG = RuleSet(
    BUILT_IN + (
        PathRule("organization", "organization.path.deny_read", "deny", "high", "filesystem", "", "read", ("**/private/**",)),
        PathRule("organization", "organization.path.deny_write", "deny", "high", "filesystem", "", "write", ("**/build/**",)),
        PathRule("organization", "org.ask.docs", "ask", "medium", "policy", "Docs need a look.", "match",
                 ("**/docs/**", "**/*.md"), ("file_write", "file_read"), ord=0),
        PathRule("organization", "org.deny.secrets", "deny", "high", "policy", "No secrets.", "match",
                 ("**/secrets/**",), ord=1),
        PathRule("organization", "org.deny.readme", "deny", "high", "policy", "Pilot.", "match",
                 ("**/README.md",), ("file_write",), candidate=True, ord=2),
    ) + tuple(
        PathRule("project", "project.custom", "deny", "high", "policy", "Project.", "match",
                 ("**/custom/**",), project=f"p{n}", ord=n) for n in (1, 3)
    ), unknown_tool="ask")


def file_calls(spark, folder):
    return calls(spark, folder).withColumn("paths", F.array("path")).withColumn(
        "project", F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")))


@query("p1_capability", f"""
with c as ({C}), t as (select *, lower(native_tool) as low from c)
select call_id, native_tool, case agent
 when 'codex' then case when native_tool = 'Bash' then 'shell_execute' when native_tool = 'apply_patch' then 'file_write'
   when regexp_matches(low, '(^|__)(read|read_file|read_text_file|get_file)$') then 'file_read'
   when regexp_matches(low, '(^|__)(write|write_file|write_text_file|create_file|edit_file)$') then 'file_write'
   when regexp_matches(low, '(^|__)(delete|delete_file|remove_file)$') then 'file_delete'
   when low like 'mcp\\_\\_%' escape '\\' then 'mcp_call' else 'unknown' end
 when 'cursor' then case when low = 'shell' then 'shell_execute' when low = 'read' then 'file_read'
   when low in ('write','edit') then 'file_write' when low = 'delete' then 'file_delete'
   when low like 'mcp:%' then 'mcp_call' else 'unknown' end
 else case when low = 'bash' then 'shell_execute' when low in ('apply_patch','write','edit') then 'file_write'
   when low = 'read' then 'file_read' when low in ('webfetch','websearch') then 'network_read' else 'unknown' end
 end as capability from t""")
def p1(spark, folder):
    return calls(spark, folder).select(
        "call_id", "native_tool", S.col(capability(R("agent"), R("native_tool"))).alias("capability"))


@query("p2_is_mcp", f"""
with c as ({C}) select native_tool, cast(regexp_matches(native_tool, '(?i)^mcp(__|:)') as int) as is_mcp, count(*) as n
from c group by all""")
def p2(spark, folder):
    kinds = calls(spark, folder).withColumn("kind", S.col(capability(R("agent"), R("native_tool"))))
    return kinds.groupBy("native_tool", S.col(is_mcp(R("native_tool"), R("kind")).cast("int")).alias("is_mcp")).agg(
        F.count("*").alias("n"))


INPUT_JSON = ("'{\"path\":\"' || path || '\",\"opts\":{\"files\":[\"a' || cast(k as string) || '\",\"b\"],\"n\":' || cast(k as string) "
              "|| ',\"cmd\":\"ls ' || cast(k as string) || '\"},\"Query\":' || case when k % 10 = 0 then '7' else '\"select 1\"' end || '}'")


@query("p3_candidate_fields", f"""
with c as ({C}), j as (select call_id, path, k from c)
select call_id, path || ',a' || cast(k as string) || ',b' as paths, 'ls ' || cast(k as string) as commands,
  case when k % 10 = 0 then '' else 'select 1' end as queries, cast(k % 10 = 0 as int) as broken from j""")
def p3(spark, folder):
    calls_ = calls(spark, folder).withColumn("v", F.try_parse_json(F.expr(INPUT_JSON)))
    joined = lambda kind: S.col(S.array_join(S.array_sort(candidates(R("v"), kind)), ","))
    ordered = S.col(S.concat_ws(",", R("path"), S.array_join(
        S.filter(candidates(R("v"), "path"), lambda p: p != R("path")), ",")))
    return calls_.select("call_id", ordered.alias("paths"), joined("command").alias("commands"),
                         joined("query").alias("queries"), S.col(query_not_text(R("v")).cast("int")).alias("broken"))


PATCH = ("'*** Begin Patch' || chr(10) || '*** Update File: ' || path || chr(10) || '@@ -1 +1 @@' || chr(10) || "
         "'*** Move to:  moved/' || cast(k as string) || '.txt ' || chr(10) || '+*** Add File: no' || chr(10) || "
         "'*** Delete File: old_' || cast(user_id as string)")


@query("p5_patch_paths", f"""
with c as ({C}) select call_id, path || ',moved/' || cast(k as string) || '.txt,old_' || cast(user_id as string) as files from c""")
def p5(spark, folder):
    return calls(spark, folder).select(
        "call_id", S.col(S.array_join(patch_paths(S.expr(PATCH)), ",")).alias("files"))


@query("p6_normalize_path", f"with c as ({C}) select call_id, normal_path from c")
def p6(spark, folder):
    return calls(spark, folder).select("call_id", S.col(normalize(R("cwd"), R("path"))).alias("normal_path"))


WINDOWS = [
    ("web\\modules\\..\\x.php", "C:/Users/Dev/web/x.php"), ("D:\\other\\.\\a\\..\\README.md", "D:/other/README.md"),
    ("c:relative.txt", "-"), ("\\rooted\\file", "C:/rooted/file"), ("..\\..\\..\\..\\up.txt", "C:/up.txt"),
    ("//server/share/../a/b", "//server/share/a/b"), ("dir/CON.txt", "-"), ("bad:name", "-"), ("trailing.", "-"),
    ("ok/./deep//file.TXT", "C:/Users/Dev/ok/deep/file.TXT"), ("aux", "-"), ("COM5.log", "-"), ("COM10", "C:/Users/Dev/COM10"),
    ("C:\\", "C:/"), ("what?", "-"), ("LPT¹", "-"),
]


@query("p7_normalize_windows_path", f"""
with c as ({C}) select call_id, {pick([w[1] for w in WINDOWS], 'k + call_id')} as normal_path from c""")
def p7(spark, folder):
    raw = calls(spark, folder).withColumn("raw", F.expr(pick([w[0] for w in WINDOWS], "k + call_id")))
    return raw.select("call_id", S.col(S.coalesce(
        normalize(S.lit("c:\\Users\\Dev"), R("raw")), S.lit("-"))).alias("normal_path"))


@query("p8_bad_windows_component", f"""
with c as ({C}), w as (select call_id, unnest(string_split(p, '/')) as part from (
  select call_id, replace({pick([w[0] for w in WINDOWS], 'k + call_id')}, chr(92), '/') as p from c))
select part, cast(upper(split_part(part, '.', 1)) in ('CON','PRN','AUX','NUL','CONIN$','CONOUT$')
    or regexp_matches(upper(split_part(part, '.', 1)), '^(COM|LPT)([1-9]|¹|²|³)$')
    or right(part, 1) in ('.', ' ') or regexp_matches(part, '[:<>"|?*~]') as int) as bad, count(*) as n
from w where part not in ('', '.', '..') group by all""")
def p8(spark, folder):
    raw = calls(spark, folder).select(F.explode(F.split(F.replace(
        F.expr(pick([w[0] for w in WINDOWS], "k + call_id")), F.lit("\\"), F.lit("/")), "/")).alias("part"))
    return raw.where("part not in ('', '.', '..')").groupBy(
        "part", S.col(bad_component(R("part")).cast("int")).alias("bad")).agg(F.count("*").alias("n"))


GLOBS = {
    "**/*.php": r"(^|/)[^/]*\.php$", "**/sites/*/settings*.php": r"(^|/)sites/[^/]*/settings[^/]*\.php$",
    "workspace/p?/**": r"^workspace/p[^/](/.*)?$", "**/[ck]e*/**": r"(^|/)[ck]e[^/]*/.*$", "**/{docs,src}/**": r"(^|/)(docs|src)(/.*)?$",
    "home/**/.ssh/*": r"^home/(.*/)?\.ssh/[^/]*$", "**/custom": r"(^|/)custom$",
}


@query("p9_glob_match", f"""
with c as ({C}), g(pattern, rx) as (values {', '.join(f"('{p}', '{r}')" for p, r in GLOBS.items())})
select pattern, count(*) as n from c join g on regexp_matches(ltrim(normal_path, '/'), rx)
group by pattern""")
def p9(spark, folder):
    paths = calls(spark, folder).withColumn("path", S.col(normalize(R("cwd"), R("path"))))
    hits = S.filter(
        S.array(*[S.when(R("path").rlike(compile_path(p).regex), p) for p in GLOBS]), lambda x: x.isNotNull())
    return paths.select(F.explode(S.col(hits)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


@query("p10_covers_descendants", f"""
with c as ({C}), d as (select call_id, regexp_replace(normal_path, '/[^/]*$', '') as dir from c)
select dir, cast(dir = '' or regexp_matches(lower(dir), '(^|/)(web|web/modules)$')
   or regexp_matches(dir, '(^|/)web/modules/contrib(/.*)?$') as int) as covered, count(*) as n
from (select case when dir = '' then '/' else dir end as dir from d) group by all""".replace("dir = '' or regexp", "regexp"))
def p10(spark, folder):
    folders = calls(spark, folder).select(S.col(S.regexp_replace(
        normalize(R("cwd"), R("path")), "/[^/]*$", "")).alias("dir")).withColumn(
        "dir", F.when(F.col("dir") == "", "/").otherwise(F.col("dir")))
    glob = compile_path("**/web/modules/contrib/**")
    return folders.groupBy("dir", S.col(covers(
        R("dir"), list(glob.prefix), R("dir").rlike(glob.regex)).cast("int")).alias("covered")).agg(F.count("*").alias("n"))


NAMES = "lower(replace(p_name, ' ', '_')) || '_' || cast(p_size as string)"


@query("p11_table_glob", f"""
with t as (select {NAMES} as name from part), g(pattern) as (values ('ring_*'), ('*widget*'), ('small_*_1'), ('*_7'))
select pattern, prefixed, count(*) as n from t, g, (values (0), (1)) f(prefixed)
where name like replace(replace(pattern, '_', '!_'), '*', '%') escape '!'
  or (prefixed = 1 and name like '%!_' || replace(replace(pattern, '_', '!_'), '*', '%') escape '!')
group by all""")
def p11(spark, folder):
    names = derive(spark, folder, f"select {NAMES} as name from {{part}}")
    tests = [
        S.when(R("name").rlike(table_regex(p, False)) | (R("name").rlike(table_regex(p, True)) if pre else S.lit(False)),
               S.struct(S.lit(p).alias("pattern"), S.lit(pre).alias("prefixed")))
        for p in ("ring_*", "*widget*", "small_*_1", "*_7") for pre in (0, 1)]
    hits = S.filter(S.array(*tests), lambda x: x.isNotNull())
    return names.select(F.explode(S.col(hits)).alias("h")).groupBy("h.pattern", "h.prefixed").agg(F.count("*").alias("n"))


@query("j1_path_rules", f"with c as ({C}) select call_id, {rule_ladder('normal_path')} as rule_id from c")
def j1(spark, folder):
    return replay.decide(file_calls(spark, folder).drop("project")).select("call_id", "rule_id")


BIG_RULES = "select p_partkey as rule_no, '**/' || replace(p_name, ' ', '/') || '/**/*.' || lower(substr(p_type, 1, 3)) as pattern from {part}"
BIG_PATHS = ("select l_orderkey * 10 + l_linenumber as call_id, l_partkey, '/repo/' || replace(p_name, ' ', case when l_linenumber % 2 = 0 "
             "then '/' else '_' end) || '/v' || cast(l_linenumber as string) || '/f.' || lower(substr(p_type, 1, 3)) as path "
             "from {lineitem} join {part} on l_partkey = p_partkey")


@query("j2_anchored_rules", f"""
with r as ({sql(BIG_RULES)}), u as (select pattern, min(rule_no) as rule_no, count(*) as copies from r group by pattern),
p as ({sql(BIG_PATHS)})
select path, min(u.rule_no) as first_rule, cast(sum(u.copies) as bigint) as n_rules from (select distinct path from p) p join u
 on regexp_matches(path, '/' || replace(replace(replace(u.pattern, '.', '[.]'), '**/*', '(.*/)?[^/]*'), '**/', '') || '$')
group by path""")
def j2(spark, folder):
    rules = derive(spark, folder, BIG_RULES)
    paths = derive(spark, folder, BIG_PATHS).select("path").distinct()
    return path_ops.first_rules(paths, rules, order="rule_no").select("path", "first_rule", "n_rules")


PROJECT_RULES = ("select concat('p', cast(s_suppkey % 5 as string)) as project, s_suppkey as ord, "
                 "'**/' || case s_suppkey % 3 when 0 then 'custom' when 1 then 'docs' else 'app' end || '/**' as pattern from {supplier}")


@query("j3_project_rules", f"""
with c as ({C}), r as ({sql(PROJECT_RULES)})
select call_id, min(ord) as first_rule, count(*) as n_rules from c join r
 on r.project = 'p' || cast(user_id % 5 as string) and contains(normal_path || '/', '/' || split_part(pattern, '/', 2) || '/')
group by call_id""")
def j3(spark, folder):
    own = file_calls(spark, folder).select("call_id", "project", S.col(normalize(R("cwd"), R("path"))).alias("path"))
    return path_ops.first_rules(own, derive(spark, folder, PROJECT_RULES), by=("project",)).select(
        "call_id", "first_rule", "n_rules")


DELETES = ["web", "web/modules", "docs", "web/themes/contrib", ".", "/", "VENDOR", "a/vendor/b", "Web/Modules", "core"]


@query("j5_tree_writes", f"""
with c as ({C}), d as (select call_id, cwd, {pick(DELETES, 'k + call_id')} as target from c)
select call_id, target, case
  when target in ('web', 'core') then 'filesystem.write.core' when target = 'a/vendor/b' then 'filesystem.write.vendor'
  when lower(target) = 'web/modules' then 'filesystem.write.contrib_module'
  when target = 'web/themes/contrib' then 'filesystem.write.contrib_theme'
  when target = '/' then 'filesystem.write.ancestor' else 'default.no_matching_rule' end as rule_id from d""")
def j5(spark, folder):
    deletes = calls(spark, folder).select(
        "call_id", "cwd", F.lit("rm").alias("tool_name"), F.lit("file_delete").alias("capability"),
        F.expr(pick(DELETES, "k + call_id")).alias("target"))
    return replay.decide(deletes.withColumn("paths", F.array("target"))).select("call_id", "target", "rule_id")


ORG_SQL = f"""
with c as ({C}), d as (select *, 'p' || cast(user_id % 5 as string) as project, ltrim(normal_path, '/') as p,
  {rule_ladder('normal_path', fallback="''")} as built_in from c),
e as (select *, case
   when capability in {READS} and regexp_matches(p, '(^|/)private(/.*)?$') then 'organization.path.deny_read'
   when capability in {WRITES} and regexp_matches(p, '(^|/)build(/.*)?$') then 'organization.path.deny_write'
   when regexp_matches(p, '(^|/)secrets(/.*)?$') then 'org.deny.secrets'
   when {{candidate}} and capability = 'file_write' and regexp_matches(p, '(^|/)README[.]md$') then 'org.deny.readme'
   when capability in ('file_write','file_read') and regexp_matches(p, '(^|/)docs(/.*)?$|[.]md$') then 'org.ask.docs' else '' end as org,
  case when project in ('p1','p3') and regexp_matches(p, '(^|/)custom(/.*)?$') then 'project.custom' else '' end as own from d)
select call_id, case when built_in <> '' then built_in when org not in ('', 'org.ask.docs') then org
  when org = 'org.ask.docs' and own = '' then org when own <> '' then own else 'default.no_matching_rule' end as rule_id from e"""


@query("a4_layered_decisions", f"""
select call_id, rule_id, case when rule_id = 'default.no_matching_rule' then 'allow' when rule_id = 'org.ask.docs' then 'ask'
  else 'deny' end as effect, case when rule_id = 'default.no_matching_rule' then 'default' when rule_id like 'org%' then 'organization'
  when rule_id = 'project.custom' then 'project' else 'built_in' end as policy_layer
from ({ORG_SQL.format(candidate='true')})""")
def a4(spark, folder):
    return replay.decide(file_calls(spark, folder), ORG).select("call_id", "rule_id", "effect", "policy_layer")


def full_calls(spark, folder):
    """Calls with what each kind brings: commands, queries or paths."""
    none = F.expr("cast(array() as array<string>)")
    given = lambda kind, column: F.when(F.col("capability") == kind, F.array(column)).otherwise(none)
    return file_calls(spark, folder).select(
        "call_id", "cwd", "tool_name", "capability", "project", given("shell_execute", "command").alias("commands"),
        given("mcp_call", "query").alias("queries"),
        F.when(F.col("capability") == "shell_execute", none).otherwise(F.array("path")).alias("paths"))


FULL = RuleSet(ORG.rules, CONFIGURED_TABLES, ORG.unknown_tool)
FULL_SQL = f"""
select call_id, case
  when capability = 'shell_execute' then
    case when {golden(COMMANDS, 1, 'command_no')} = 'allow' then 'default.no_matching_rule' else {golden(COMMANDS, 2, 'command_no')} end
  when capability = 'mcp_call' and {golden(SQL_TEXTS, 1, 'query_no')} <> 'allow' then {golden(SQL_TEXTS, 2, 'query_no')}
  else rule_id end as rule_id, {golden(COMMANDS, 1, 'command_no')} as by_command, capability
from ({ORG_SQL.replace('{candidate}', '{{candidate}}')}) join ({C}) using (call_id)"""
EFFECT_SQL = """case when {rule} = 'default.no_matching_rule' then 'allow' when {rule} = 'org.ask.docs' then 'ask'
  when {kind} = 'shell_execute' then {command} else 'deny' end"""


@query("a4_full_replay", f"""
with a as ({FULL_SQL.replace('{{candidate}}', 'true')}), b as ({FULL_SQL.replace('{{candidate}}', 'false')})
select a.call_id, a.rule_id, {EFFECT_SQL.format(rule='a.rule_id', kind='a.capability', command='a.by_command')} as effect,
  {EFFECT_SQL.format(rule='b.rule_id', kind='b.capability', command='b.by_command')} as enforcement_decision,
  b.rule_id as enforcement_rule_id
from a join b using (call_id)""")
def a4_full(spark, folder):
    """Commands, queries, paths, project rules and candidates of every call in one projection."""
    calls_ = commands.with_call_decision(full_calls(spark, folder), "by_command", FULL)
    return replay.candidate_decisions(calls_, FULL, "by_command").select(
        "call_id", "rule_id", "effect", "enforcement_decision", "enforcement_rule_id")


#: Rules that the calls' paths never meet, one per part, so that the rule table grows with the data.
MANY_RULES = """select 'organization' as layer, cast(null as string) as project, cast(10 + p_partkey as int) as ord,
  'org.part.' || cast(p_partkey as string) as rule_id, 'deny' as effect, 'high' as severity, 'policy' as category, '' as reason,
  'match' as operation, cast(array() as array<string>) as capabilities, false as candidate, 0 as pat_ord,
  '**/' || replace(p_name, ' ', '/') || '/**' as pattern from {part}"""


@query("j1_rule_table", f"""
select call_id, case when capability = 'file_delete' then case
    when regexp_matches(target, '^(web/themes|web|core)$') then 'filesystem.write.' || case target when 'web/themes' then 'contrib_theme' else 'core' end
    when target = '.' then 'filesystem.write.ancestor' else 'default.no_matching_rule' end
  else rule_id end as rule_id
from (select call_id, rule_id from ({ORG_SQL.format(candidate='true')})) join (select call_id, {pick(['web', 'docs', '.', 'core', 'web/themes'], 'k')} as target,
  case when event_type = 'purchase' then 'file_delete' else '' end as capability from ({C})) using (call_id)""")
def j1_table(spark, folder):
    """Layered decisions, deletes of folders included, by a rule table that grows with the data."""
    table = rule_ops.as_table(spark, ORG).unionByName(derive(spark, folder, MANY_RULES))
    removing = F.col("event_type") == "purchase"
    log = file_calls(spark, folder).withColumn("capability", F.when(removing, "file_delete").otherwise(F.col("capability"))).withColumn(
        "paths", F.when(removing, F.array(F.expr(pick(["web", "docs", ".", "core", "web/themes"], "k")))).otherwise(F.col("paths")))
    return replay.decide_by_table(log.select("call_id", "cwd", "project", "tool_name", "capability", "paths"), table,
                                  unknown_tool="ask").select("call_id", "rule_id")


MATCHED = f"""
with c as ({C}), d as (select *, ltrim(normal_path, '/') as p from c where capability in ('file_read','file_write'))"""


@query("a3_matched_path", f"""
with c as ({C}) select call_id, rule_id, case when rule_id = 'default.no_matching_rule' then '' else hit end as matched_path from (
  select call_id, case when second = 'default.no_matching_rule' and first = 'default.no_matching_rule' then first
     when first_no <= second_no then first else second end as rule_id,
     case when first_no < second_no then p1 when second_no < first_no then p2 when first_pat <= second_pat then p1 else p2 end as hit
  from (select *, list_position({[r[0] for r in BUILT_IN_SQL] + ['default.no_matching_rule']}, first) as first_no,
     list_position({[r[0] for r in BUILT_IN_SQL] + ['default.no_matching_rule']}, second) as second_no,
     cast(not regexp_matches(p1, '[.]env$|/auth[.]json$|[.]pem$|sites/[^/]*/settings[.]php$') as int)
       + cast(regexp_matches(p1, 'env/.*settings') as int) as first_pat,
     cast(not regexp_matches(p2, '[.]env$|/auth[.]json$|[.]pem$|sites/[^/]*/settings[.]php$') as int)
       + cast(regexp_matches(p2, 'env/.*settings') as int) as second_pat from (
    select call_id, normal_path as p1, cwd || '/web/sites/a/settings.local.php' as p2, {rule_ladder('normal_path')} as first,
      {rule_ladder("(cwd || '/web/sites/a/settings.local.php')")} as second from c)))""")
def a3(spark, folder):
    two = file_calls(spark, folder).drop("project").withColumn(
        "paths", F.array("path", F.lit("web/sites/a/settings.local.php")))
    return replay.decide(two).select("call_id", "rule_id", F.coalesce("matched_path", F.lit("")).alias("matched_path"))


@query("j15_policy_diff", f"""
with a as (select call_id, {rule_ladder('normal_path')} as rule_before from ({C})), b as ({ORG_SQL.format(candidate='true')})
select a.call_id, rule_before, rule_id as rule_after,
  case when rule_before = 'default.no_matching_rule' then 'allow' else 'deny' end as effect_before,
  case when rule_id = 'default.no_matching_rule' then 'allow' when rule_id = 'org.ask.docs' then 'ask' else 'deny' end as effect_after
from a join b using (call_id) where rule_before <> rule_id""")
def j15(spark, folder):
    return replay.diff(file_calls(spark, folder), RuleSet(), ORG)


@query("a14_candidate_report", f"""
with a as ({ORG_SQL.format(candidate='true')}), b as ({ORG_SQL.format(candidate='false')})
select a.rule_id, count(*) as n_evaluated, cast(count_if(b.rule_id = 'default.no_matching_rule') as bigint) as n_would_deny,
  cast(count_if(b.rule_id not in ('default.no_matching_rule', 'org.ask.docs')) as bigint) as n_overlap
from a join b using (call_id) where a.rule_id = 'org.deny.readme' group by all""")
def a14(spark, folder):
    both = replay.candidate_decisions(file_calls(spark, folder), ORG)
    return replay.candidate_report(both, ["org.deny.readme"])


__all__ = ["PATHS", "SQL_TEXTS", "TOOLS", "derived"]
