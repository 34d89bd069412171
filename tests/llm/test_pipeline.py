"""The corpus pipeline: what each stage keeps, on the given tables and on awkward rows."""

import random

import numpy as np
import pytest

import corpus_pipeline
from warden.llm import common, machine, near, templates

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.read(spark, FOLDER, "documents")
    kept = {None: docs}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.saved(stage(spark, docs, FOLDER), f"test-{name}")
        kept[name] = docs
        if name != "tokens":
            assert docs.columns == before.columns
        assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    model = machine.train(kept[None], common.read(spark, FOLDER, "labels"))
    good = machine.score(kept[None], model).where("predicted = 1").select("doc_id")
    assert sorted(r[0] for r in good.collect()) == sorted(r[0] for r in kept["quality"].select("doc_id").collect())
    assert kept["line_dedup"].count() == kept["quality"].count()
    classes = near.classes(kept["line_dedup"])
    assert kept["near_dedup"].count() == classes.select("component_id").distinct().count()
    found = templates.contamination(kept["near_dedup"], common.read(spark, FOLDER, "benchmark")).select("doc_id").distinct()
    assert kept["decontamination"].count() == kept["near_dedup"].count() - found.count()
    assert kept["tokens"].count() == kept["decontamination"].count()
    run = corpus_pipeline.run(spark, FOLDER).select("doc_id", "ids_crc32").collect()
    assert sorted(run) == sorted(kept["tokens"].select("doc_id", "ids_crc32").collect())


def test_awkward_documents(spark, awkward, nothing):
    docs, left = awkward, nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = common.saved(stage(spark, docs, FOLDER), f"awkward-{name}")
        left = common.saved(stage(spark, left, FOLDER), f"empty-{name}")
        assert left.count() == 0
    assert docs.count() > 0


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_against_all_pairs(spark):
    """Of all pairs of similarity 0.8 or more, 0.9 at least are in one class; no class joins texts without such a chain."""
    draw = random.Random(11)
    texts = []
    for _ in range(150):
        base = [draw.choice("abcdefgh") + str(draw.randint(0, 900)) for _ in range(draw.randint(20, 300))]
        texts.append(" ".join(base))
        for _ in range(draw.randint(1, 3)):
            other = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 40))):
                other[draw.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    own = [plain_shingles(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near.classes(docs).collect()}
    linked = [(i, j) for i in range(len(own)) for j in range(i) if similarity(own[i], own[j]) >= 0.8]
    assert sum(got[i] == got[j] for i, j in linked) >= 0.9 * len(linked)
    reach = list(range(len(own)))
    for i, j in linked * 3:
        reach[i] = reach[j] = min(reach[i], reach[j])
    for i, root in got.items():
        assert reach[i] == reach[root]


def test_every_link_at_the_threshold_is_found(spark):
    """Pairs just above similarity 0.8: all of them are in one class, those just below in none."""
    draw = random.Random(3)
    texts = []
    for _ in range(200):
        base = [draw.choice("abcdefgh") + str(draw.randint(0, 900)) for _ in range(draw.randint(40, 120))]
        texts.append(" ".join(base))
        cut = draw.randint(len(base) // 8, len(base) // 5)
        texts.append(" ".join(base[:-cut] + [f"new{draw.randint(0, 10 ** 6)}" for _ in range(draw.randint(0, 3))]))
    own = [plain_shingles(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near.classes(docs).collect()}
    alike = [similarity(own[i], own[i + 1]) >= 0.8 for i in range(0, len(own), 2)]
    assert 50 < sum(alike) < 190
    assert [got[i] == got[i + 1] for i in range(0, len(own), 2)] == alike


@pytest.mark.parametrize("chunk", [2048, 2])
def test_crowded_buckets(spark, monkeypatch, chunk):
    """One text with many near copies, and unrelated texts that share a long passage: chunks change nothing."""
    monkeypatch.setattr(near, "CHUNK", chunk)
    base, passage = [f"w{i}" for i in range(200)], " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(base[:i] + ["x"] + base[i + 1:]) for i in range(0, 200, 5)]
    texts += [passage + " " + " ".join(f"u{n}-{i}" for i in range(30)) for n in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.classes(docs).collect()}
    assert [got[i] for i in range(40)] == [0] * 40 and [got[i] for i in range(40, 70)] == list(range(40, 70))


def test_near_copies_of_awkward_rows(spark, awkward):
    got = sorted((r.doc_id, r.component_id) for r in near.classes(awkward).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9), (10, 1)]
    left = near.representatives(awkward)
    assert left.columns == awkward.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 5, 7, 8, 9] and ids.count(None) == 2


def test_pairs_that_only_share_passages_are_not_made_into_sets(spark):
    """Parities of any two sizes never rule out a pair at the threshold, and rule out nearly all that share less."""
    draw = np.random.default_rng(5)
    sets = []
    for n in [1, 3, 40, 63, 64, 65, 300, 1000, 4000] * 12:
        base = draw.integers(0, 2 ** 64, n, np.uint64)
        sets.append(np.unique(base))
        for share in (0.97, 0.8, 0.78, 0.3):
            own = base[:max(1, round(n * share))]
            sets.append(np.unique(np.r_[own, draw.integers(0, 2 ** 64, draw.integers(0, 3), np.uint64)]))
    texts = spark.createDataFrame([(i, len(s), bytearray(near.parity(s))) for i, s in enumerate(sets)],
                                  "rep long, size int, parity binary")
    alike = {}
    for i in range(0, len(sets), 5):
        for j in (*range(i + 1, i + 5), *range(i + 5, min(i + 50, len(sets)))):
            shared = len(np.intersect1d(sets[i], sets[j]))
            alike[j, i] = shared / (len(sets[i]) + len(sets[j]) - shared)
    pairs = spark.createDataFrame(list(alike), "a long, b long")
    kept = {tuple(r) for r in near.possible(pairs, texts, 0.8).collect()}
    assert {p for p, s in alike.items() if s >= 0.8} <= kept
    assert sum(alike[p] < 0.7 for p in kept) <= 0.01 * len(alike)


def test_shared_passages_are_known_to_the_order_of_a_large_table(spark, monkeypatch):
    """A passage's share of the texts decides, not how many texts there are; exact passes then meet on other shingles."""
    monkeypatch.setattr(near, "ORDER_TEXTS", 20)
    passages = [" ".join(f"p{k}x{i}" for i in range(12)) for k in range(10)]
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i} " + (passages[i % 10] if i < 1600 else f"g{i} h{i}"))
                                  for i in range(2000)], "doc_id long, text string")
    known, counts = near.frequent(docs, "text")
    want = np.concatenate([near.shingles(p.encode()) for p in passages])
    assert np.isin(want, known).all()
    assert (np.diff(known.astype(object)) > 0).all() and (counts > 1).all()


def test_the_order_keeps_to_its_room(spark, monkeypatch):
    monkeypatch.setattr(near, "ORDER_SHINGLES", 9)
    docs = spark.createDataFrame([(i, f"u{i} " + "one two three four five six seven eight " * (i < 6) + "v w x y z a b c")
                                  for i in range(9)], "doc_id long, text string")
    known, counts = near.frequent(docs, "text")
    assert set(near.shingles(b"v w x y z a b c").tolist()) <= set(known.tolist()) and len(known) <= 9


@pytest.mark.parametrize("similar", [0.5, 0.8])
def test_no_pair_at_the_threshold_is_missed(spark, similar):
    """Sets of sizes around every level, of equal frequency and shared, each a class of its own or with others."""
    random = np.random.default_rng(11)
    sets = []
    for n in list(range(1, 26)) + [40, 50, 64, 80, 100, 125]:
        base = np.unique(random.integers(1, 1 << 60, n).astype(np.uint64))
        sets.append(base)
        sets.append(base[:max(1, int(np.ceil(similar * len(base))))])
        sets.append(np.unique(np.r_[base, random.integers(1, 1 << 60, max(0, int(len(base) / similar) - len(base))).astype(np.uint64)]))
    roots = [i if i % 5 else i - i % 2 for i in range(len(sets))]
    order = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rows = [(i, roots[i], len(s), near.prefix(s, order, similar).view(np.int64).tolist()) for i, s in enumerate(sets)]
    placed = spark.createDataFrame(rows, "rep long, root long, size int, prefix array<long>")
    alike = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i])
             if roots[i] != roots[j] and len(np.intersect1d(x, y)) >= similar * len(np.union1d(x, y)) - 1e-9}
    found = {tuple(r) for r in near.missed(placed, similar).collect()}
    assert len(alike) > 40 and alike <= found


def test_texts_of_far_apart_sizes_do_not_meet(spark):
    """One shingle in many texts gives join rows for those only that sizes and places allow."""
    rows = [(i, i, 10 + 3 * i, [7, 1000 + i]) for i in range(300)]
    placed = spark.createDataFrame(rows, "rep long, root long, size int, prefix array<long>")
    pairs = near.missed(placed, 0.8)
    want = {(j, i) for i, _, n, _ in rows for j, _, m, _ in rows if i < j and n >= 0.8 * m - 1e-6}
    assert {tuple(r) for r in pairs.collect()} == want
    joined = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert any("meets" in line and "other_level" in line for line in joined)
