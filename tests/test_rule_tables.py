"""Rule tables of any size against the rules inside a row, and the index of literal parts."""

import random
import re

from pyspark.sql import functions as F

from warden.functions.decisions import PathRule, RuleSet
from warden.functions.globs import compile_path
from warden.operators import paths as path_ops, replay, rules
from warden.plans.path_queries import ORG

NAMES = ["web", "core", "vendor", "docs", "src", "a.md", "settings.php", ".env", "private", "custom", "secrets", "build", "x.PEM",
         "modules", "contrib", "auth.json", "README.md"]


def random_calls(spark, n=600):
    draw = random.Random(4)
    kinds = ["file_read", "file_write", "file_delete", "file_move", "file_search", "mcp_call", "unknown", "shell_execute"]
    rows = []
    for i in range(n):
        paths = ["/".join(draw.choices(NAMES + ["..", "."], k=draw.randint(1, 4))) for _ in range(draw.randint(0, 3))]
        paths += draw.choice([[], [], [], ["."], ["/"], ["a\0"]])
        rows.append((i, draw.choice(["/repo", "/", "C:/Work"]), draw.choice(["read", "mcp__x", "tool"]), draw.choice(kinds),
                     draw.choice(["p1", "p2", None]), paths))
    return spark.createDataFrame(rows, "call_id long, cwd string, tool_name string, capability string, project string, "
                                       "paths array<string>").repartition(4)


def test_table_decides_like_the_row(spark):
    extra = tuple(PathRule(layer, f"{layer}.{n}", effect, "high", "policy", "", op, patterns, caps, project, False, 100 + n)
                  for n, (layer, effect, op, patterns, caps, project) in enumerate([
                      ("organization", "ask", "match", ("web/**", "**/src/*.md"), ("file_read",), None),
                      ("organization", "deny", "match", ("**/*.p?m", "*"), (), None),
                      ("project", "deny", "match", ("**/{docs,src}/**", "**/[ck]ore/**"), (), "p1"),
                      ("project", "deny", "write", ("src/modules/contrib/**", "**/docs/private/x/**"), (), "p2"),
                      ("organization", "deny", "write", ("**/*ocs*/**",), (), None)]))
    policy = RuleSet(ORG.rules + extra, unknown_tool="ask")
    calls = random_calls(spark)
    want = sorted(map(str, replay.decide(calls, policy).drop("paths", "reason").collect()))
    got = replay.decide_by_table(calls, rules.as_table(spark, policy), unknown_tool="ask").drop("paths", "reason")
    assert sorted(map(str, got.collect())) == want
    held = sorted(map(str, replay.decide(calls, policy, omit_candidates=True).select("call_id", "rule_id").collect()))
    got = replay.decide_by_table(calls, rules.as_table(spark, policy), unknown_tool="ask", omit_candidates=True)
    assert sorted(map(str, got.select("call_id", "rule_id").collect())) == held


def test_a_hundred_thousand_patterns(spark):
    many = spark.range(100_000).select(
        F.lit("organization").alias("layer"), F.lit(None).cast("string").alias("project"), F.col("id").cast("int").alias("ord"),
        F.concat(F.lit("r"), "id").alias("rule_id"), F.lit("deny").alias("effect"), F.lit("high").alias("severity"),
        F.lit("policy").alias("category"), F.lit("").alias("reason"), F.lit("match").alias("operation"),
        F.expr("cast(array() as array<string>)").alias("capabilities"), F.lit(False).alias("candidate"), F.lit(0).alias("pat_ord"),
        F.concat(F.lit("**/src/n"), "id", F.lit("/*.txt")).alias("pattern"))
    calls = spark.range(2000).select(
        F.col("id").alias("call_id"), F.lit("/repo").alias("cwd"), F.lit("read").alias("tool_name"),
        F.lit("file_read").alias("capability"), F.array(F.concat(F.lit("src/n"), F.col("id") * 99, F.lit("/f.txt"))).alias("paths"))
    table = many.unionByName(rules.built_in_rules(spark))
    got = {r.call_id: r.rule_id for r in replay.decide_by_table(calls, table).collect()}
    assert got == {i: f"r{i * 99}" if i * 99 < 100_000 else "default.no_matching_rule" for i in range(2000)}


def test_every_match_holds_the_parts_of_its_pattern():
    draw = random.Random(9)
    pieces = ["**", "*", "web", "core", "*.php", "a?c", "[ab]x", "{docs,src}", "set*.p?", "doc", "*.tar.gz", "se*ng"]
    paths = ["/" + "/".join(draw.choices(["web", "core", "abc", "ax", "docs", "x.php", "settings.py", "y.tar.gz", "sewing", "doc"],
                                         k=draw.randint(1, 4))) for _ in range(3000)]
    seen = 0
    for _ in range(150):
        pattern = "/".join(draw.choices(pieces, k=draw.randint(1, 3)))
        regex = re.compile(compile_path(pattern).regex.replace("\\z", "\\Z").replace("(?s)", "", 1).replace("*+", "*").replace(
            "(?i:", "(?:"), re.S)
        for path in paths:
            if regex.match(path):
                seen += 1
                names = {"name:" + p for p in path.lower().split("/")} | {"ext:" + path.lower().rsplit(".", 1)[-1]}
                names |= {"run:" + path.lower()[i:i + 3] for i in range(len(path))}
                assert set(path_ops.parts_of(pattern)) <= names, (pattern, path)
    assert seen > 300


def test_common_parts_are_no_keys_where_rarer_ones_are_at_hand(spark):
    paths = spark.range(5000).select(F.concat(F.lit("/src/p"), F.col("id") % 50, F.lit("/f"), "id", F.lit(".txt")).alias("path"))
    table = spark.createDataFrame([("**/src/p7/*.txt",), ("**/src/none/*.txt",), ("src/**/f7.txt",)], "pattern string")
    got = path_ops.match_patterns(paths, table)
    assert sorted(r.pattern for r in got.groupBy("pattern").count().collect()) == ["**/src/p7/*.txt", "src/**/f7.txt"]
    assert got.where("pattern like '%p7%'").count() == 100


