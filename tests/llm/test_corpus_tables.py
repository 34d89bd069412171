"""Collocations, the Merkle manifest and exact dedup against plain Python; awkward and empty input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from warden.llm import collocations, common, exact, merkle, queries

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- 11: collocations -----------------------------------------------------------------------------------------------

def plain_collocations(rows, least, top):
    """{lang: [(phrase, a, l, r, n, score)]}, by counting every phrase in a dictionary."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang][tuple(words[i:i + k])] += 1
    out = {}
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = any(100 * b >= 80 * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))
                         for q, b in candidates.items())
            if not inside:
                cuts = [(2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                found.append((" ".join(p), a, left, right, n[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out[lang] = found[:top]
    return {lang: found for lang, found in out.items() if found}


def as_lists(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.lang, r["rank"])):
        out[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
        assert r["rank"] == len(out[r.lang])
    return dict(out)


@pytest.mark.parametrize("chunk", [1 << 22, 40])
def test_collocations_against_a_dictionary(spark, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK_TOKENS", chunk)
    draw = random.Random(chunk)
    words = ["a", "A", "b", "c\x01", "c", "é", "É", "z!", "x,y", "\x1c", "日本", "of the", "of\tthe\tday", "e:", "\n"]
    rows = [(draw.choice(["en", "de", None, "und", ""]), " ".join(draw.choices(words, range(15, 0, -1), k=draw.randint(0, 60))))
            for _ in range(120)] + [("en", None), ("en", ""), ("en", " \t\n.,")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert as_lists(collocations.ranked(docs, least=4, top=50)) == plain_collocations(rows, 4, 50)


def test_collocations_of_the_table(spark):
    docs = common.read(spark, FOLDER, "documents")
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert as_lists(queries.QUERIES["op11_count_streams"](spark, FOLDER)) == plain_collocations(rows, 30, 2000)


def test_ranges_that_begin_inside_a_prefix(spark):
    """All phrases hang on one hot word; every range but the first begins under it."""
    rows = [("en", f"hot w{i} t{i % 3}. " * 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert as_lists(collocations.ranked(docs, least=2, top=1000)) == plain_collocations(rows, 2, 1000)


# --- 12: Merkle manifest --------------------------------------------------------------------------------------------

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def plain_manifest(rows, fan):
    """Sorted rows of the audit, from whole trees in memory."""
    def leaf(row, text):
        values = (row[0], row[3], row[2], row[4], text)
        return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    trees = defaultdict(list)
    for row in rows:
        low = row[1] if row[1] is None else row[1].translate(LOWER)
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        trees[row[3]].append((row[0], leaf(row, row[1]), leaf(row, low) if tampered else None))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: plain_levels([x[1] for x in sorted(trees[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fan)
             for s in order}
    top = plain_levels([built[s][-1][0] for s in order], fan)
    out = []
    for at, s in enumerate(order):
        for pos, (doc_id, own, changed) in enumerate(sorted(trees[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            seen, node = [], changed or own
            for levels, place in ((built[s], pos), (top, at)):
                for level in levels[:-1]:
                    first = place // fan * fan
                    run = level[first:first + fan]
                    seen += run[:place - first] + run[place - first + 1:]
                    node = digest(*run[:place - first], node, *run[place - first + 1:])
                    place //= fan
            root = top[-1][0]
            out.append((doc_id, own, built[s][-1][0], root, digest(*seen), node, node == root))
    return sorted(out, key=str)


def audited(docs):
    return sorted([tuple(r) for r in merkle.audit(docs).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


@pytest.mark.parametrize("fan, stride", [(16, 3), (2, 2), (3, 1)])
def test_manifest_against_whole_trees(spark, monkeypatch, fan, stride):
    monkeypatch.setattr(merkle, "FAN", fan)
    monkeypatch.setattr(merkle, "STRIDE", stride)
    draw = random.Random(fan)
    sources = [None, "", "a", "b", "é", "one"] + ["hot"] * 6
    rows = [(i, draw.choice(["Some Text", "low", "", None, "Ünï " * 9]), draw.choice(["en", None]),
             draw.choice(sources) if i else "alone", draw.choice([None, 3, -7])) for i in range(130)]
    rows += [rows[5], rows[5], (None, "No Id", None, "a", None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("clash")).repartition(4)
    assert audited(docs) == plain_manifest(rows, fan)


def test_a_deep_tree(spark):
    """One source with more than one subtree of checkpoints."""
    rows = [(i, f"T{i}", "en", "s", i) for i in range(4500)]
    got = audited(spark.createDataFrame(rows, DOCS).repartition(6))
    assert got == plain_manifest(rows, 16)
    assert sum(not r[6] for r in got) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(4500))


def test_only_every_third_level_is_written(spark):
    rows = [(i, "t", "en", "s", i) for i in range(300)]
    made = merkle.build(spark.createDataFrame(rows, DOCS))
    assert [level.count() for level in made.rows] == [300, 1] and [level.count() for level in made.sources] == [1]


# --- 13: exact dedup ------------------------------------------------------------------------------------------------

def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, doc_id in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0))):
            out.append((doc_id, keep, len(ids), k == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups_against_a_dictionary(spark):
    draw = random.Random(8)
    base = ["", "a", "b", "A", "é", "long " * 400, "long " * 399 + "lonk ", "x" * 200 + "1", "x" * 200 + "2", "\x00", " "]
    rows = [(i, draw.choice(base + [None, f"own {i}", f"own {i % 7}"])) for i in range(400)] + [(3, "a"), (None, "b"), (None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1)).repartition(6)
    got = exact.groups(docs, digests=True)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_groups(rows)
    left = exact.dedup(docs)
    assert left.columns == docs.columns
    assert sorted(str(r[0]) for r in left.collect()) == sorted(str(r[0]) for r in plain_groups(rows) if r[3])


def test_exact_groups_read_in_full_only_what_shares_length_and_start(spark):
    rows = [(1, "same start, other end 1"), (2, "same start, other end 2"), (3, "short"), (4, "shore"), (5, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    read = exact._decided(docs, "doc_id", "text", 10, False, False).where("full is not null")
    assert sorted(r.doc_id for r in read.select("doc_id").collect()) == [1, 2]


def test_exact_plan_is_native_and_shuffles_no_text(spark):
    plan = exact.groups(common.read(spark, FOLDER, "documents"), digests=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- awkward input --------------------------------------------------------------------------------------------------

def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in awkward.collect()]
    assert as_lists(collocations.ranked(awkward, least=2, top=300)) == plain_collocations([(r[2], r[1]) for r in rows], 2, 300)
    assert audited(awkward) == plain_manifest(rows, 16)
    assert sorted([tuple(r) for r in exact.groups(awkward, digests=True).collect()], key=str) == plain_groups(
        [r[:2] for r in rows])


def test_empty_tables(nothing):
    assert collocations.ranked(nothing).collect() == []
    assert merkle.audit(nothing).collect() == [] and merkle.build(nothing).root is None
    assert exact.groups(nothing).collect() == [] and exact.dedup(nothing).collect() == []
