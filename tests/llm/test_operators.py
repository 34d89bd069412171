"""Each text operator against plain Python, exact round trips or held-out labels; awkward and empty input for all."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from warden.llm import (bootstrap, coder, common, grammar, gray, lines, machine, ngrams, pieces, queries, templates, tiff,
                        tokenfile)

FOLDER = "/root/testdata/sf0.001"
PIECES = queries.vocabulary("piece_bpe_32k.model")
WORDS = queries.vocabulary("word_bpe_49k.json")


def texts(spark):
    return {r.doc_id: r.text for r in common.read(spark, FOLDER, "documents").collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


# --- 1: quality -----------------------------------------------------------------------------------------------------

def test_pairs_in_linear_time_equal_all_pairs():
    random = np.random.default_rng(3)
    m = machine.Machine(0.3, random.normal(size=5), random.normal(size=(5, 3)), np.zeros(0), np.ones(0))
    x = random.normal(size=(4, 5))
    want = [m.bias + row @ m.weights + sum(m.vectors[i] @ m.vectors[j] * row[i] * row[j]
                                           for i in range(5) for j in range(i)) for row in x]
    assert np.allclose(m.margin(x), want)


def test_quality_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op1_quality_machine"](spark, folder)
    rows = got.join(common.read(spark, folder, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())


# --- 2: pieces ------------------------------------------------------------------------------------------------------

def best_path(scores, text, unknown):
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        found = [(best[a][0] + scores[text[a:end]][1], best[a][1] + [scores[text[a:end]][0]])
                 for a in range(max(0, end - 40), end) if text[a:end] in scores]
        found.append((best[end - 1][0] + unknown, best[end - 1][1] + [-1]))
        best.append(max(found, key=lambda f: f[0]))
    return best[-1]


def test_best_path_and_round_trip(spark):
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.load(PIECES)
    scores = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    draw = random.Random(5)
    for _ in range(150):
        text = "".join(draw.choice("thein  aé日\n🙂er") for _ in range(draw.randint(1, 30)))
        ids, total = own.encode(text)
        assert math.isclose(total, best_path(scores, "▁" + text.replace(" ", "▁"), own.unknown_score)[0], rel_tol=1e-9)
        assert own.decode(ids) == text
    got = pieces.encode(common.read(spark, FOLDER, "documents"), PIECES)
    back = {r.doc_id: r.text for r in pieces.decode(got, PIECES).collect()}
    assert back == texts(spark) and all(r.round_trip for r in got.select("round_trip").collect())


# --- 3: templates ---------------------------------------------------------------------------------------------------

def test_templates(spark):
    item = "Anna has 3 apples and buys 5 kg of pears, then Anna gives 3 of them away to a friend of hers."
    bench = spark.createDataFrame([(1, item), (2, "What is the capital of France"), (3, None), (None, "nobody"), (4, "")],
                                  "item_id long, text string")
    other = "Bella has 7 apples and buys 9 kg of pears, then {} gives {} of them away to a friend of hers."
    rows = [(1, f"Before it all. {item} And after."), (2, "Noise here. " + other.format("Bella", 7)),
            (3, "Noise here. " + other.format("Carla", 8)), (4, "A text on apples, pears and friends of hers."),
            (5, "so WHAT is the Capital of Rome, he asked"), (6, None), (7, item.upper())]
    got = {(r.doc_id, r.item_id): r for r in templates.contamination(frame(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 1)}
    assert got[1, 1].exact and not got[2, 1].exact
    again = templates.contamination(frame(spark, [(5, "so WHAT is the capital of France, he asked"),
                                                  (6, "so what is the price of France, he asked")]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in again] == [(5, 2)]
    left = templates.decontaminated(frame(spark, rows), bench)
    assert {r.doc_id for r in left.collect()} == {3, 4, 5, 6}


def test_questions_of_several_sentences_and_of_few_words(spark):
    bench = spark.createDataFrame([(1, "Anna has 3 apples. Carl has 5 pears. Dora has 2 plums."), (2, "What is 17 + 25?")],
                                  "item_id long, text string")
    rows = [(1, "Well. Anna has 3 apples. Carl has 5 pears. Dora has 2 plums. So."),
            (2, "Well. Bert has 7 apples. Emma has 4 pears. Fred has 9 plums. So."),
            (4, "He asked: what is 17 + 25? Nobody knew."),
            (5, "He asked: what is 18 + 26? Nobody knew."), (6, "The cat has 7 lives. A dog has one life. We have 2 of each.")]
    got = {(r.doc_id, r.item_id, r.exact) for r in templates.contamination(frame(spark, rows), bench).collect()}
    assert got == {(1, 1, True), (2, 1, False), (4, 2, True)}


def test_benchmark_passages_against_a_plain_search(spark):
    folder = "/root/testdata/sf0.01"
    plain = lambda s: " " + " ".join(re.findall(r"\w+", s.lower())) + " "
    docs = {r.doc_id: plain(r.text) for r in common.read(spark, folder, "documents").collect()}
    items = {r.item_id: plain(r.text) for r in common.read(spark, folder, "benchmark").collect()}
    want = {(d, i) for d, t in docs.items() for i, s in items.items() if s in t}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op3_template_contamination"](spark, folder).collect()}
    assert want and got == want


# --- 4: near-duplicates ---------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    import xxhash

    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_against_all_pairs(spark):
    draw, rows = random.Random(2), []
    for i in range(60):
        base = [f"w{draw.randint(0, 4000)}" for _ in range(draw.choice((2, 9, 120, 400)))]
        for k in range(draw.choice((1, 1, 6))):
            if k % 3 == 2:
                base[draw.randrange(len(base))] = "changed"
            rows.append((len(rows), " ".join(base)))
    rows += [(900, ""), (901, None), (902, "\n \t")]
    fps = {i: plain_fingerprint(t or "") for i, t in rows}
    want = classes(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    got = {r.doc_id: r for r in gray.near_duplicates(frame(spark, rows)).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == want
    kept = {r.doc_id for r in gray.representatives(frame(spark, rows)).collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize("chunk", [7, 64, gray.CHUNK])
def test_links_of_crowded_fingerprints(spark, chunk):
    draw, fps = random.Random(chunk), set()
    for _ in range(6):
        base = draw.getrandbits(64)
        for _ in range(60):
            fps.add(base ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(0, 5))}))
    fps = sorted(fps)
    want = classes(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a)
                                     if (fps[a] ^ fps[b]).bit_count() <= 4])
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(signed, "fp long, rep long")
    roots = {r.node: r.root for r in gray.components(gray.links(nodes, chunk=chunk)).collect()}
    assert {i: roots.get(i, i) for i in range(len(fps))} == want


def test_a_run_of_several_chunks_that_begins_inside_a_partition():
    # Key 1 ends in the first frame; key 2 fills several chunks. Any two of its fingerprints differ in two bits.
    fps = np.array([1 << i for i in range(40)], np.uint64)
    ranks = fps.copy()
    for step in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(step)
    ranks = np.r_[[5, 6, 9], np.sort(ranks).view(np.int64)]
    whole = pd.DataFrame({"key": [1] * 3 + [2] * 40, "rank": ranks, "rep": np.arange(43)})
    frames = [whole[at:at + 4] for at in range(0, len(whole), 4)]
    found = pd.concat(gray._chunks(gray.MOST_BITS, 8)(iter(frames)))
    linked = found[found["key"].isna()][["a", "b"]]
    parts = found[found["key"] == 2].sort_values("low")
    assert len(parts) > 2
    pairs = [{"ranks": x.ranks, "reps": x.reps, "other_ranks": y.ranks, "other_reps": y.reps}
             for i, x in enumerate(parts.itertuples()) for y in parts.iloc[i + 1:].itertuples()]
    linked = pd.concat([linked, *gray._across(gray.MOST_BITS)(iter([pd.DataFrame(pairs)]))]).astype(int)
    labels = gray.merge(np.arange(43), linked["a"].to_numpy(), linked["b"].to_numpy())
    assert set(labels[3:]) == {3}


# --- 5: token files -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("high", [1, 300, 49_408, 2 ** 31])
def test_coder_round_trip(high):
    draw = np.random.default_rng(high)
    for n in (0, 1, 2047, 2048, 5000):
        ids = draw.integers(0, high, n)
        ids[n // 2:] = ids[:n - n // 2]
        data = coder.encode(ids)
        assert (coder.decode(data) == ids).all()
    hurt = bytearray(data)
    hurt[-len(hurt) // 3] ^= 8
    with pytest.raises(coder.Damaged):
        coder.decode(bytes(hurt))
    with pytest.raises(coder.Damaged):
        coder.decode(data[:-2])


def test_token_files_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    docs = common.read(spark, FOLDER, "documents").unionByName(
        spark.createDataFrame([(100_000, "odd\x1cblank  and wide"), (100_001, None)], "doc_id long, text string"),
        allowMissingColumns=True)
    path = str(tmp_path / "ids")
    tokenfile.write(docs, path, WORDS, segment=20_000)
    got = {r.doc_id: r for r in tokenfile.read(spark, path).collect()}
    start = 0
    for i, text in sorted({r.doc_id: r.text for r in docs.collect()}.items()):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4


def test_names_of_special_tokens_are_coded_as_by_the_library():
    from tokenizers import Tokenizer

    tokenizer, some = Tokenizer.from_file(WORDS), ["a <|endoftext|> b", "x<|startoftext|>y<|endoftext|>", "<|EndOfText|> z"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert 49407 in want[0]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in tokenfile.word_tokenizer(WORDS)(some)] == want


# --- 6: lines -------------------------------------------------------------------------------------------------------

def plain_dedup(rows, least):
    """All runs of lines of all texts: what lies in a run with `least` characters seen before goes."""
    seen, out = {}, {}
    for key, text in sorted(rows):
        lines_of = text.split("\n")
        own = [(n, t.strip(" ")) for n, t in enumerate(lines_of) if t.strip(" ")]
        gone = set()
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = tuple(t for _, t in own[a:b])
                if sum(map(len, run)) >= least and seen.setdefault(run, (key, a)) != (key, a):
                    gone.update(range(a, b))
        between = {n for g in gone if g + 1 in gone for n in range(own[g][0], own[g + 1][0])}
        between |= {own[g][0] for g in gone}
        out[key] = ("\n".join(t for n, t in enumerate(lines_of) if n not in between), len(between))
    return out


def stocked(seed, words, blank):
    """Texts of lines from a small stock, with runs of it in order; some lines are blank."""
    draw, rows = random.Random(seed), []
    stock = [" ".join(f"{draw.choice('abcdefgh')}{draw.randint(0, 30)}" for _ in range(draw.choice(words)))
             for _ in range(60)]
    for i in range(120):
        at = draw.randrange(50)
        own = draw.choices(stock, k=draw.randint(0, 6)) + stock[at:at + draw.randint(0, 8)]
        rows.append((i, "\n".join(x for t in own for x in [t] + ["", "  "][:draw.randint(0, 2)] * (draw.random() < blank))))
    return rows


@pytest.mark.parametrize("seed,words,blank", [(4, (1, 2, 4, 14), 0.0), (5, (1, 2, 3), 0.3), (6, (1, 1, 16), 0.5)])
def test_lines_against_all_runs(spark, seed, words, blank):
    rows = stocked(seed, words, blank)
    got = lines.dedup_lines(frame(spark, rows))
    want = plain_dedup(rows, lines.MIN_CHARS)
    assert {r.doc_id: (r.text, r.n_lines_removed) for r in got.collect()} == want
    assert {k: v[0] for k, v in want.items()} != dict(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_runs_whose_lines_stand_first_elsewhere_go_whole(spark):
    short = [f"k{i} = {i}" for i in range(12)]  # no line is long, every neighbouring pair stands in another text first
    rows = [(i, f"{short[i]}\n{short[i + 1]}") for i in range(11)]
    rows += [(20, "own head\n" + "\n\n".join(short) + "\nown tail"), (21, "a head\n" + "\n".join(short) + "\na tail")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got.pop(21) == "a head\na tail" and got == {k: v for k, v in rows if k != 21}


def test_repeated_passages_go_and_the_first_stays(spark):
    passage = "\n".join(f"line {i} of a passage that many documents share" for i in range(5))
    rows = [(i, f"own start {i}\n{passage}\nown end {i}") for i in range(40)] + [(99, "short\nshort\nshort")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got[0] == dict(rows)[0] and got[7] == "own start 7\nown end 7" and got[99] == "short\nshort\nshort"


# --- 7: n-grams -----------------------------------------------------------------------------------------------------

def test_filter_never_reads_too_low():
    draw = np.random.default_rng(1)
    grams = np.unique(draw.integers(0, 2 ** 63, 4000).astype(np.uint64))
    counts = draw.integers(1, 5000, len(grams))
    bits = np.zeros(ngrams.BLOCKS * ngrams.BLOCK_BITS, bool)
    levels = ngrams.level(counts)
    for q in range(1, int(levels.max()) + 1):
        own = grams[levels >= q]
        for at in ngrams._bits(own, q):
            bits[(ngrams._block(own) * np.uint64(ngrams.BLOCK_BITS) + at)] = True
    made = ngrams.Filter(np.packbits(bits, bitorder="little"))
    read = made.levels(grams)
    assert (read >= levels).all() and (read == levels).mean() > 0.99
    assert (made.levels(draw.integers(0, 2 ** 63, 4000).astype(np.uint64)) == 0).mean() > 0.99


def test_base_scores_are_exact_and_the_model_is_better(spark):
    count, own = Counter(), {}
    for i, text in texts(spark).items():
        own[i] = text.encode().lower().split() + [None]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(own[i])
    n, v = sum(count.values()), len(count)
    got = ngrams.score(common.read(spark, FOLDER, "documents")).collect()
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own[r.doc_id]), sum(count[w] > 0 for w in own[r.doc_id]), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own[r.doc_id]), rel_tol=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_scores_against_plain_counts(spark):
    """The model's score from dictionaries; the filter may only read a pair's level too high, and rarely does."""
    words_of = lambda t: t.encode().lower().split() + [None]
    own = {i: words_of(t) for i, t in texts(spark).items()}
    single, pair = Counter(), Counter()
    for i, w in own.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            single.update(w)
            pair.update(zip([None, *w[:-1]], w))
    n, v = sum(single.values()), len(single)

    def middle(c):
        low = 2.0 ** math.floor(math.log2(c)) if c else 0.0
        return c if c < 2 else (low + 2 * low - 1) / 2

    def plain(w):
        out = 0.0
        for a, b in zip([None, *w[:-1]], w):
            share = (single[b] + 1) / (n + v + 1)
            follows = min(middle(pair[a, b]), single[a]) / single[a] if single[a] else 0.0
            out += math.log10(0.25 * follows + 0.75 * share if single[a] else share)
        return out

    gaps = []
    for r in ngrams.score(common.read(spark, FOLDER, "documents")).collect():
        want = plain(own[r.doc_id])
        assert r.score >= want - 1e-6 * abs(want)
        gaps.append((r.score - want) / abs(want))
    assert sum(gaps) / len(gaps) < 0.02


def test_filter_grows_with_its_entries(spark):
    rows = spark.range(60_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    for n in (6_000, 60_000):
        some = rows.limit(n).select(F.col("text").cast("binary").alias("text"))
        made = ngrams.gathered(ngrams.built(some, least=64))
        unseen = ngrams.singles(ngrams.words(" ".join(f"x{i}" for i in range(20_000)).encode())[:-1])
        assert (made.levels(unseen) > 0).mean() < 1.5 * ngrams.ERROR
    assert ngrams.level(np.array([1 << 20, 1 << 40])).tolist() == [21, 41]


def test_a_filter_that_stays_dealt_gives_the_same_scores(spark, awkward, monkeypatch):
    docs = common.read(spark, FOLDER, "documents").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    want = sorted(map(str, ngrams.score(docs).select("doc_id", "n_tokens", "n_known", F.round("score", 6)).collect()))
    monkeypatch.setattr(ngrams, "BROADCAST", 0)
    monkeypatch.setattr(ngrams, "CHUNK_BYTES", 100_000)
    got = sorted(map(str, ngrams.score(docs).select("doc_id", "n_tokens", "n_known", F.round("score", 6)).collect()))
    assert got == want


# --- 8: TIFF --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("order", "<>")
def test_files_round_trip(scheme, order):
    draw = np.random.default_rng(scheme)
    for predictor in (1, 2):
        for tile in (0, 16):
            for kind in (np.uint8, np.uint16):
                want = [draw.integers(0, 9, size).astype(kind) for size in ((1, 1, 1), (33, 47, 3), (64, 20, 1), (700, 64, 1))]
                got = list(tiff.read(tiff.write(want, scheme, predictor, tile, order, strip=9000)))
                assert all(e is None and (p == w).all() for (_, p, e), w in zip(got, want)) and len(got) == len(want)


def test_known_codes():
    # The example of the format's description: runs and literals in one row.
    packed = bytes.fromhex("fe aa 02 80 00 2a fd aa 03 80 00 2a 22 f7 aa".replace(" ", ""))
    assert tiff.unpack_bits(packed) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)
    # 7 7 7 8 8 7 7 6 6: clear 7 258 8 8 258 6 6 end, nine bits each.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes).ljust(88, "0")
    assert tiff.lzw_decode(int(bits, 2).to_bytes(11, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_broken_files(spark):
    good = tiff.write([np.zeros((4, 4), np.uint8), np.ones((4, 4), np.uint8)])
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    rows = [(1, bytearray(good)), (2, bytearray(b"no")), (3, None), (4, loop), (5, bytearray(good[:-30])), (6, bytearray())]
    got = tiff.pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    by = {i: sorted((r.page, r.error is None) for r in got if r.doc_id == i) for i in range(1, 7)}
    assert by[1] == [(0, True), (1, True)] and by[2] == by[3] == by[6] == [(0, False)]
    assert by[4] == [(0, True), (1, True), (2, False)] and not all(ok for _, ok in by[5])


def test_texts_in_files(spark):
    got = {r.doc_id: r for r in tiff.digests(common.read(spark, FOLDER, "documents")).collect()}
    for i, text in texts(spark).items():
        raw = text.encode()
        raw = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (
            len(text.encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))


# --- 9: toxicity ----------------------------------------------------------------------------------------------------

def test_clauses():
    reader, weights = grammar.Grammar(), grammar.Weights()
    score = lambda t: weights.score(reader.features(t)[None])[0]
    assert reader.clauses("You are an idiot. Nice day!") == ["pook"]
    assert score("You are an idiot") > score("What an idiot") > score("She is not an idiot")
    assert score("You are an idiot") > score("He said you are an idiot") > score("He said nothing")
    assert score("I will kill you") > score("Time to kill")
    first, second = grammar.governed("n", {"a": "b"}, "nabo", 2), grammar.governed("o", {"b": "c"}, "nabco", None)
    both, draw = grammar.compose(first, second, "nabo"), random.Random(1)
    for _ in range(300):
        word = "".join(draw.choice("nabo") for _ in range(draw.randint(0, 12)))
        assert both.run(word) == second.run(first.run(word))


def test_toxicity_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op9_clause_grammar"](spark, folder).join(
        common.read(spark, folder, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97


# --- 10: personal data ----------------------------------------------------------------------------------------------

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_seeds(text):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text):
            digits = re.sub(r"\D", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255
                    or kind == "card" and not (12 <= len(digits) <= 19 and bootstrap.luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_seeds_against_the_forms():
    draw = random.Random(9)
    for _ in range(20_000):
        text = "".join(draw.choice("1234a.@_- +()5@.b") for _ in range(draw.randint(0, 40)))
        assert bootstrap.seeds(text) == plain_seeds(text)
    bootstrap.seeds("a" * 300_000 + "@" + "1" * 300_000 + " " + "1." * 100_000)  # stays linear


def test_trust_travels_along_a_long_chain(spark):
    # Pattern k holds three instances of level k five times each and three of level k + 1 once; level 0 are seeds.
    levels = 8
    rows = [(10 * k + i, k, 1 if k == 0 else -1, 5) for k in range(levels) for i in range(3)]
    rows += [(10 * (k + 1) + i, k, -1, 1) for k in range(levels) for i in range(3)]
    rows += [(900 + i, 50, -1, 1) for i in range(9)]  # a pattern without known instances
    graph = spark.createDataFrame(rows, "instance long, pattern long, kind int, n long")
    places = graph.groupBy("pattern").agg(F.sum("n").alias("places"))
    got = sorted((r.instance, r.kind) for r in bootstrap.trusted(graph, places).collect())
    assert got == [(10 * k + i, 1) for k in range(1, levels + 1) for i in range(3)]


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please write to user{i}@mail.example.org for details number {i}") for i in range(12)]
    rows += [(100 + i, f"please write to user{i}-at-mail for details again") for i in range(3)]
    rows += [(200 + i, f"the shelf holds box{i}-at-left of the room and more") for i in range(9)]
    got = {r.doc_id: r for r in bootstrap.personal_data(frame(spark, rows)).collect()}
    for i, text in rows:
        base = bootstrap.spelled(plain_seeds(text))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert got[101].spans == "email:16:29" and not got[203].spans


# --- all of them on awkward and empty input ---------------------------------------------------------------------------

def applied(spark, docs, labels, tmp):
    bench = spark.createDataFrame([(1, "twice over and over"), (2, None)], "item_id long, text string")
    tokenfile.write(docs, str(tmp), WORDS)
    return {"quality": machine.score(docs, machine.train(docs, labels)), "pieces": pieces.encode(docs, PIECES),
            "templates": templates.contamination(docs, bench), "near": gray.near_duplicates(docs),
            "tokens": tokenfile.read(spark, str(tmp)), "lines": lines.dedup_lines(docs), "ngrams": ngrams.score(docs),
            "tiff": tiff.digests(docs), "toxic": grammar.score(docs, grammar.train(docs, labels)),
            "personal": bootstrap.personal_data(docs)}


def test_awkward_rows(spark, awkward, labels, tmp_path):
    n = awkward.count()
    got = {name: df.collect() for name, df in applied(spark, awkward, labels, tmp_path / "ids").items()}
    pairs = got.pop("templates")
    assert sorted((r.doc_id, r.item_id) for r in pairs) == [(5, 1), (6, 1)]
    assert {name: len(rows) for name, rows in got.items()} == dict.fromkeys(got, n)
    assert {r.component_id for r in got["near"] if r.doc_id in (1, 2, 3, 10)} == {1}
    assert all(0 <= r.score <= 1 for name in ("quality", "toxic") for r in got[name])


def test_empty_tables(spark, nothing, labels, tmp_path):
    assert {n: d.count() for n, d in applied(spark, nothing, labels, tmp_path / "ids").items()} == dict.fromkeys(
        ("quality", "pieces", "templates", "near", "tokens", "lines", "ngrams", "tiff", "toxic", "personal"), 0)


def test_parts_of_many_texts_stay_known():
    """A corpus has several hundred thousand different parts; those met stay known, and each is worked out once."""
    known = pieces.Pieces(queries.vocabulary("piece_bpe_32k.model"))
    parts = [f"{n:x}" for n in range(300_000)]
    made = []
    known.part.function = lambda part: made.append(part) or (b"", 0.0, True)
    for _ in range(2):
        for a in range(0, len(parts), 1000):
            known.encode(" ".join(parts[a:a + 1000]))
    assert len(made) == len(parts)


def test_phrases_are_counted_as_columns_of_word_numbers():
    """A scan makes no text per phrase in Python: numbers of words come back, a column per place, with exact counts."""
    from warden.llm import collocations

    draw = np.random.default_rng(4)
    words = [b"\xff", *(f"w{i}".encode() for i in range(1, 9))]
    ids, everything = draw.integers(0, 9, 3000).astype(np.int32), np.full(1 << 12, 255, np.uint8)
    hashes = draw.integers(0, 2 ** 63, 9).astype(np.uint64)
    for order in (1, 2, 3, 4):
        want = Counter(row for row in zip(*[ids[k:].tolist() for k in range(order)]) if 0 not in row)
        columns, n = collocations._counts(ids, order, words, hashes, 7, everything)
        assert len(columns) == order and Counter(dict(zip(zip(*[c.tolist() for c in columns]), n.tolist()))) == want
