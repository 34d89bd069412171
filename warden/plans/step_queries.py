"""Registered queries on single steps of the command log and on set operations.

The commands are golden rows with the expected result beside them; every event row
gets one of them, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from warden.functions import sql as S
from warden.functions.programs import args_of, literal, search_paths, uploads
from warden.functions.shell import program, segments, strip_wrappers
from warden.operators import commands, queries, replay, taint
from warden.plans.derived import CALLS, CONFIGURED_TABLES, SQL_TEXTS, calls, golden, sql
from warden.plans.path_queries import ORG, ORG_SQL, file_calls
from warden.plans.registry import query
from warden.plans.taint_queries import FLAGS, SOURCES_SQL, source_rows, tainted_calls
from warden.vocab import CATEGORIES

R = S.ref
C = sql(CALLS)
INDEX = "k + call_id"


def with_command(spark, folder, rows):
    return calls(spark, folder).withColumn("command", F.expr(golden(rows, 0, INDEX)))


def argv() -> S.Sql:
    return S.get(segments(R("command"), R("cwd")), 0)["argv"]


WRAPPED = [
    ("env -u X FOO=1 ls -l", "ls -l"), ("nice -n 5 nohup make all", "make all"), ("timeout -k 1 5 cat a", "cat a"), ("A=1 B=2 git log", "git log"),
    ("stdbuf -oL --error=0 grep x y", "grep x y"), ("busybox sh", "sh"), ("command -p ls", "ls"), ("env --weird ls", "-"), ("ENV=/x ls", "-"),
    ("xargs ls", "-"), ("timeout 5", "-"), ("setsid -f -- run me", "run me"), ("/usr/bin/env python3 a.py", "python3 a.py"), ("cat a b", "cat a b"),
]


@query("p15_strip_wrappers", f"with c as ({C}) select call_id, {golden(WRAPPED, 1, INDEX)} as argv from c")
def p15(spark, folder):
    return with_command(spark, folder, WRAPPED).select("call_id", S.col(S.coalesce(
        S.array_join(strip_wrappers(argv()), " "), S.lit("-"))).alias("argv"))


NESTED = [
    ("sh -c 'ls a'", "run:ls a"), ("bash -lc 'cd x && cat y; z'", "rule:shell.ambiguous"), ("sh -c \"bash -c 'id; pwd'\"", "run:id|run:pwd"),
    ("ddev exec -d /srv ls", "text:"), ("ddev exec -d /srv a b", "run:a b"), ("echo x > f", "writes:f|run:echo x f"), ("ddev drush cr", "run:drush cr"), ("", ""),
]
NESTED_WANT = [(c, w if not w.startswith("text") else "run:ls") for c, w in NESTED]


@query("p16_nested_commands", f"with c as ({C}) select call_id, {golden(NESTED_WANT, 1, INDEX)} as units from c where {golden(NESTED_WANT, 1, INDEX)} not in ('', 'rule:shell.ambiguous')")
def p16(spark, folder):
    units = commands.segments(with_command(spark, folder, NESTED).withColumn("commands", F.array("command")))
    shown = units.where("audible and kind <> 'rule'").withColumn("u", F.concat("kind", F.lit(":"), F.array_join("argv", " ")))
    return shown.groupBy("call_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "u"))), lambda x: x["u"]), "|").alias("units"))


SEARCHES = [
    ("grep -r pat src lib", "src,lib"), ("grep -e pat a.txt", "a.txt"), ("rg -f words.txt dir", "words.txt,dir"), ("rg pat", ""), ("grep -A 3 pat f", "f"),
    ("rg -r new old f", "f"), ("grep -r new f", "f"), ("grep -- -x f", "f"), ("grep --file=w f", "w,f"), ("rg -tphp pat a b", "a,b"), ("grep pat -", "-"),
]


@query("p19_search_operands", f"with c as ({C}) select call_id, {golden(SEARCHES, 1, INDEX)} as paths from c")
def p19(spark, folder):
    found = S.let(argv(), lambda a: search_paths(program(a), args_of(a)))
    return with_command(spark, folder, SEARCHES).select("call_id", S.col(S.array_join(found, ",")).alias("paths"))


UPLOADS = [
    ("curl -d @a.json http://x", "a.json"), ("curl -d plain http://x", ""), ("curl --data-urlencode n@b.txt http://x", "b.txt"), ("curl -F f=@c.pdf;type=x http://x", "c.pdf"),
    ("curl -F 'f=@c.pdf;type=x' http://x", "c.pdf"), ("curl -F 'f=<d' http://x", "d"), ("curl -Te.bin http://x", "e.bin"), ("curl --upload-file=f http://x", "f"),
    ("curl -K cfg http://x", "cfg"), ("wget --post-file=g -i list http://x", "g,list"), ("curl --form=x=@h http://x", "h"),
]


@query("p20_upload_files", f"with c as ({C}) select call_id, {golden(UPLOADS, 1, INDEX)} as files from c")
def p20(spark, folder):
    found = S.let(argv(), lambda a: uploads(program(a), args_of(a)))
    return with_command(spark, folder, UPLOADS).select("call_id", S.col(S.array_join(found, ",")).alias("files"))


OBJECTS = [
    ("git show HEAD:a/b.txt", "/a/b.txt"), ("git -C sub show :2:c.txt", "/sub/c.txt"), ("git cat-file -p HEAD:x", "/x"), ("git show HEAD", "!git.read.opaque_object"),
    ("git --work-tree=/x show HEAD:a", "!git.context.unknown"), ("git -c a=b show HEAD^1:d", "/d"), ("git log -p", ""),
]


@query("p21_git_objects", f"""
with c as ({C}), g as (select call_id, cwd, {golden(OBJECTS, 1, INDEX)} as want from c) select call_id, case when want like '!%' then want else cwd || want end as object from g where want <> ''""")
def p21(spark, folder):
    found = commands.operands(commands.segments(with_command(spark, folder, OBJECTS).withColumn("commands", F.array("command"))))
    return found.select("call_id", F.when(F.col("rule").isNotNull(), F.concat(F.lit("!"), "rule")).otherwise(
        F.concat("cwd", F.lit("/"), "path")).alias("object"))


LITERALS = [("echo plain", 1), ("echo 'a b'", 1), ("echo 'a $b c'", 0), ("echo 'a;b'", 0), ("echo 'x#y'", 1), ("echo ''", 0), ("echo 'a\\b'", 0), ("echo \"it's ok\"", 1), ("echo 'x|y z'", 1)]


@query("p23_literal_reconstruction", f"with c as ({C}) select call_id, cast({golden([(c, str(v)) for c, v in LITERALS], 1, INDEX)} as int) as literal from c")
def p23(spark, folder):
    return with_command(spark, folder, LITERALS).select("call_id", S.col(literal(argv()).cast("int")).alias("literal"))


CONTAINER = [
    ("ddev exec --raw cat docs/a.txt", "ddev.context.unknown"), ("ddev exec --raw cat /srv/a.txt", ""), ("ddev exec --raw -d /srv touch themes/contrib/x", "filesystem.write.contrib"),
    ("ddev exec --raw -d /srv cat themes/contrib/x", ""), ("ddev exec --raw cat .env", "drupal.secret.env"), ("touch themes/contrib/x", ""),
]


@query("p24_container_paths", f"with c as ({C}) select call_id, {golden(CONTAINER, 1, INDEX)} as rule_id from c where {golden(CONTAINER, 1, INDEX)} <> ''")
def p24(spark, folder):
    found = commands.verdicts(with_command(spark, folder, CONTAINER).withColumn("commands", F.array("command"))).where("decision is not null")
    return found.select("call_id", "decision.rule_id")


TIES = [
    ("git commit -m x && composer require y", "composer.dependencies.modify"), ("composer require y && git commit -m x", "git.write.review"),
    ("cat .env; git push -f", "git.force_push"), ("git push -f; cat .env", "drupal.secret.env"), ("git commit; cat .env; composer update", "drupal.secret.env"),
]


@query("a2_strongest_segment", f"with c as ({C}) select call_id, {golden(TIES, 1, INDEX)} as rule_id from c")
def a2(spark, folder):
    found = commands.verdicts(with_command(spark, folder, TIES).withColumn("commands", F.array("command"))).where("decision is not null")
    return found.select("call_id", "decision.rule_id")


@query("a1_strongest_rule", f"select call_id, rule_id from ({ORG_SQL.format(candidate='true')}) where rule_id like 'org.%'")
def a1(spark, folder):
    return replay.decide(file_calls(spark, folder), ORG).where("rule_id like 'org.%'").select("call_id", "rule_id")


@query("o4_rules_without_candidates", f"select call_id, rule_id from ({ORG_SQL.format(candidate='false')})")
def o4(spark, folder):
    return replay.decide(file_calls(spark, folder), ORG, omit_candidates=True).select("call_id", "rule_id")


@query("a5_category_union", f"""
with {SOURCES_SQL}, x as (select distinct session_id, unnest(string_split(categories, ',')) as category from s)
select session_id, category from x""")
def a5(spark, folder):
    marks = [F.max(F.array_contains("categories", c)).alias(c) for c in CATEGORIES]
    flags = source_rows(spark, folder).groupBy("session_id").agg(*marks)
    names = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in CATEGORIES]), lambda c: c.isNotNull())
    return flags.select("session_id", F.explode(names).alias("category"))


@query("o6_distinct_tables", f"""
with c as ({C}), t as (select session_id, unnest(string_split({golden(SQL_TEXTS, 3, 'query_no')}, ',')) as table_name from c)
select distinct session_id, table_name from t where table_name <> ''""")
def o6(spark, folder):
    log = calls(spark, folder).withColumn("both", F.concat("session_id", F.lit("/"), F.col("call_id").cast("string")))
    found = queries.sources(log, CONFIGURED_TABLES, id_="both")
    return found.select(F.substring_index("both", "/", 1).alias("session_id"), "table_name").dropDuplicates()


@query("j7_state_before_call", f"with {FLAGS} select call_id, cast(prior <> '' as int) as tainted from w")
def j7(spark, folder):
    return taint.prior(tainted_calls(spark, folder)).select("call_id", (F.size("prior") > 0).cast("int").alias("tainted"))
