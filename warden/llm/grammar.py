"""Toxicity by a weighted grammar of finite-state transducers over the words of a clause.

Words become classes: insult, threat, target, negation, reporting verb, other. Small transducers rewrite the classes of
a clause one after the other: reported speech, negation and target each mark what they govern. They are composed into one
machine, which reads a clause once and gives the marked matches. What a match weighs depends on its marks; a document is
scored by its matched clauses, with weights fitted on labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from warden.llm import common, learn

# The lexicon, by class.
INSULTS = """idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool loser losers pathetic worthless
scum trash garbage clown clowns disgusting imbecile cretin jerk bastard asshole bitch pig pigs vermin filth filthy dirtbag
lowlife creep freak retard retarded scumbag subhuman useless ugly liar coward idiota imbécil estúpido estúpida basura
inútil asqueroso payaso idiote imbécile stupide minable ordure déchet clochard bouffon dégoûtant blödmann dummkopf trottel
dreckig abschaum widerlich wertlos versager arschloch mistkerl""".split()
THREATS = """kill murder hurt beat punch stab shoot hang burn destroy crush strangle rape lynch bomb matar golpear quemar
tuer frapper brûler töten schlagen umbringen verbrennen""".split()
TARGETS = """you your yours yourself he she him her they them their u ur tú usted ustedes vosotros él ella ellos tu toi
vous il elle ils elles du dich dir sie ihr euch er""".split()
NEGATIONS = """not no never neither nor isn't aren't wasn't don't doesn't didn't won't can't nobody none nunca jamás pas
jamais ne nicht kein keine nie niemals""".split()
REPORTS = """said says say saying wrote writes called calls claimed claims quoted reported reports tweeted alleged
according dijo dice escribió según dit disait écrit selon sagte sagt schrieb laut""".split()

OTHER, INSULT, THREAT, STEM, TARGET, NEGATION, REPORT, BOUNDARY = "oiaspnr."
#: Words that a negation or target governs.
REACH = 4
# What governs a match; a match is an insult or threat with a set of these.
REPORTED, NEGATED, ADDRESSED = 1, 2, 4
#: A match's symbol: a letter of its kind's row, at the place of its set of marks. The first of a row is the class.
#: The kinds are insults and threats of the lexicon, and words of stems induced from labels.
ROWS = {INSULT: "iIjJkKlL", THREAT: "aAbBcCdD", STEM: "sSuUvVwW"}
#: What a clause weighs by its strongest match before any label is seen, and how far labels may move it.
BIAS, SPREAD = -3.0, 2.0
#: Induced stems: how long, how many at most, and how rare among clean documents against the open toxic ones.
STEM_LENGTHS = range(3, 9)
MOST_STEMS = 64
CLEAN_SHARE = 0.02
#: A stem explains at least one in so many open documents.
SUPPORT = 20
# --- transducers ----------------------------------------------------------------------------------------------------

@dataclass
class Transducer:
    """Reads a symbol at a time: `moves[state, symbol]` is (next state, symbols written); `ends[state]` is written last."""

    moves: dict
    ends: dict = field(default_factory=dict)
    start: object = 0

    def run(self, symbols: str) -> str:
        state, out = self.start, []
        for s in symbols:
            state, written = self.moves[state, s]
            out.append(written)
        return "".join(out) + self.ends.get(state, "")


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """One machine that does what `first` and then `second` do; only reachable pairs of states are made."""
    def feed(state, written):
        out = []
        for s in written:
            state, more = second.moves[state, s]
            out.append(more)
        return state, "".join(out)

    start = (first.start, second.start)
    moves, ends, todo = {}, {}, [start]
    seen = {start}
    while todo:
        a, b = here = todo.pop()
        last, tail = feed(b, first.ends.get(a, ""))
        ends[here] = tail + second.ends.get(last, "")
        for s in symbols:
            a2, written = first.moves[a, s]
            b2, out = feed(b, written)
            moves[here, s] = ((a2, b2), out)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer(moves, ends, start)


def governed(trigger: str, change: dict[str, str], symbols: str, reach: int | None) -> Transducer:
    """After `trigger`, matches within `reach` further words (None: to the clause's end) are rewritten by `change`."""
    states = range(0, 2 if reach is None else reach + 1)
    moves = {}
    for state in states:
        for s in symbols:
            left = state if reach is None else max(0, state - 1)
            if s == trigger:
                moves[state, s] = (1 if reach is None else reach, s)
            else:
                moves[state, s] = (left, change.get(s, s) if state else s)
    return Transducer(moves)


def marked(mark: int) -> dict[str, str]:
    """Symbols without a mark to those with it."""
    return {row[marks]: row[marks | mark] for row in ROWS.values() for marks in range(8) if not marks & mark}


def grammar(reach: int = REACH) -> tuple[Transducer, Transducer]:
    """The machine that reads a clause forwards (reported speech, negation, target before) and the one that then reads
    it backwards (target after)."""
    classes = OTHER + INSULT + THREAT + STEM + TARGET + NEGATION + REPORT
    every = OTHER + TARGET + NEGATION + REPORT + "".join(ROWS.values())
    forwards = compose(governed(REPORT, marked(REPORTED), classes, None),
                       compose(governed(NEGATION, marked(NEGATED), every, reach),
                               governed(TARGET, marked(ADDRESSED), every, reach), every), classes)
    return forwards, governed(TARGET, marked(ADDRESSED), every, reach)


def prior(symbol: str) -> float:
    """Weight of a clause whose strongest match is this one: addressed ones weigh more, governed ones less."""
    kind = next(k for k, row in ROWS.items() if symbol in row)
    marks = ROWS[kind].index(symbol)
    weight = {INSULT: 5.0, THREAT: 2.0, STEM: 1.0}[kind]
    weight += 2.0 if marks & ADDRESSED else 0.0
    return max(0.0, weight - (2.5 if marks & NEGATED else 0.0) - (2.0 if marks & REPORTED else 0.0))


#: Matches from the strongest to the weakest; a feature row counts clauses by their strongest match.
MATCHES = "".join(sorted("".join(ROWS.values()), key=lambda s: (-prior(s), s)))
#: A row ends with the matches of each kind per hundred words; what they weigh before any label is seen.
DENSITIES = {INSULT: 0.5, THREAT: 0.0, STEM: 2.0}
WIDTH = len(MATCHES) + len(DENSITIES)
_CLAUSES = re.compile(f"[^{BOUNDARY}]*[{INSULT}{THREAT}{STEM}][^{BOUNDARY}]*")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_STOP = re.compile(r"[.!?;:]\W*$")
_CLASS = {word: symbol for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT),
                                             (THREATS, THREAT), (INSULTS, INSULT)) for word in words}


def word_class(word: str, stems: tuple[str, ...] = ()) -> str:
    """Class of a lower-cased word, and the clause's end if the word closes one; or belongs to an induced stem."""
    bare = _EDGES.sub("", word)
    known = _CLASS.get(bare, STEM if stems and bare.startswith(stems) else OTHER)
    return (known if bare else "") + (BOUNDARY if _STOP.search(word) else "")


class Grammar:
    """Matched clauses of texts."""

    def __init__(self, stems: tuple[str, ...] = (), reach: int = REACH):
        self.forwards, self.backwards = grammar(reach)
        self.classes = common.Cache(lambda word: word_class(word, stems))

    def clauses(self, text: str) -> list[str]:
        """The rewritten classes of each clause of a whole text that holds an insult or threat."""
        symbols = "".join(map(self.classes.__getitem__, text.lower().replace("\n", " . ").split()))
        return [self.backwards.run(self.forwards.run(c)[::-1])[::-1] for c in _CLAUSES.findall(symbols)]

    def features(self, text: str) -> np.ndarray:
        """Clauses by their strongest match, and matches by kind per hundred words, all as logarithms."""
        row, found = np.zeros(WIDTH), self.clauses(text)
        for clause in found:
            row[min(MATCHES.index(s) for s in clause if s in MATCHES)] += 1
        if found:
            n = len(text.split())
            row[len(MATCHES):] = [100 / n * sum(c.count(s) for c in found for s in ROWS[kind]) for kind in DENSITIES]
        return np.log2(1 + row)


@dataclass
class Weights:
    """Weight of each match, and the bias; `score` is the probability of label 1."""

    bias: float = BIAS
    stems: tuple[str, ...] = ()
    matches: np.ndarray = field(default_factory=lambda: np.array([*map(prior, MATCHES), *DENSITIES.values()]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return learn.sigmoid(self.bias + x @ self.matches)


def fit(x: np.ndarray, y: np.ndarray, stems: tuple[str, ...] = (), spread: float = SPREAD, rounds: int = 30) -> Weights:
    """Logistic regression by Newton steps, with each weight held near its prior value; matches never seen keep it."""
    weights = Weights()
    full = np.c_[np.ones(len(x)), x]
    at = middle = np.r_[weights.bias, weights.matches]
    for _ in range(rounds if len(x) else 0):
        p = learn.sigmoid(full @ at)
        slope = full.T @ (p - y) + (at - middle) / spread ** 2
        curve = (full * (p * (1 - p))[:, None]).T @ full + np.eye(len(at)) / spread ** 2
        at = at - np.clip(np.linalg.solve(curve, slope), -1, 1)
    return Weights(float(at[0]), stems, np.maximum(at[1:], 0.0))


def _mapped(rows: DataFrame, schema: str, stems: tuple[str, ...], finish) -> DataFrame:
    """Feature rows of (doc_id, text, ...) given to `finish` batch by batch."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Grammar(stems)
        for batch in batches:
            if batch.num_rows:
                yield finish(batch, np.stack([reader.features(t) for t in batch.column(1).to_pylist()]))

    return common.map_arrow(rows, work, schema)


def _beginnings(text: str) -> set[str]:
    """What at least two words of a text begin with."""
    words = Counter(text.lower().split())
    count: Counter = Counter()
    for word, times in words.items():
        bare = _EDGES.sub("", word)
        for n in STEM_LENGTHS:
            if len(bare) >= n:
                count[bare[:n]] += times
    return {b for b, times in count.items() if times > 1}


def induced_stems(sample: DataFrame, most: int = MOST_STEMS) -> tuple[str, ...]:
    """Word beginnings that explain labelled documents in which the lexicon finds nothing.

    `sample` is the bounded sample (doc_id, text, label); copies count once. A beginning is a candidate if it stands in
    enough of those documents and hardly in documents of label 0. Candidates are taken greedily: the one that explains
    most documents still open, of equal ones the longest.
    """
    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Grammar()
        for batch in batches:
            rows = [(i, b) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    if not reader.clauses(t) for b in sorted(_beginnings(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.string())], ["doc_id", "stem"])

    rows = sample.dropDuplicates(["text"])
    toxic = common.map_arrow(rows.where("label = 1").select("doc_id", "text"), open_rows, "doc_id long, stem string")
    toxic = common.saved(toxic, "beginnings")
    n_open = toxic.agg(F.countDistinct("doc_id")).first()[0]
    least = max(3, n_open // SUPPORT)
    held = toxic.groupBy("stem").agg(F.collect_list("doc_id").alias("docs")).where(F.size("docs") >= least)
    found = {r["stem"]: set(r["docs"]) for r in held.collect()}
    if not found:
        return ()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = Counter(b for t in batch.column(1).to_pylist() for b in _beginnings(t) if b in found)
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()),
                                              pa.array(list(count.values()), pa.int64())], ["stem", "n"])

    clean = rows.where("label = 0").select("doc_id", "text")
    n_clean = max(1, clean.count())
    counts = common.map_arrow(clean, seen, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    for row in counts.collect():
        if row["n"] / n_clean > CLEAN_SHARE * len(found[row["stem"]]) / n_open:
            del found[row["stem"]]
    stems: list[str] = []
    while found and len(stems) < most:
        best = max(found, key=lambda s: (len(found[s]), len(s), s))
        explained = found[best]
        if len(explained) < least:
            break
        stems.append(best)
        found = {s: left for s, docs in found.items() if (left := docs - explained)}
    return tuple(sorted(stems))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = learn.SAMPLE_ROWS,
          doc_id: str = "doc_id", text: str = "text") -> Weights:
    """Stems and weights learned from at most `rows` labelled documents, which the executors read."""
    sample = learn.labelled_sample(docs, labels, label, rows, doc_id, text)
    sample = common.saved(sample.select("doc_id", F.col("text").cast("string").alias("text"), "label"), "sample")
    stems = induced_stems(sample)
    made = _mapped(sample, "doc_id long, label int, row array<double>", stems, lambda batch, x:
                   pa.RecordBatch.from_arrays([batch.column(0), batch.column(2),
                                               pa.array(list(x), pa.list_(pa.float64()))],
                                              ["doc_id", "label", "row"])).toArrow().sort_by("doc_id")
    x = np.array(made.column("row").to_pylist(), np.float64).reshape(-1, WIDTH)
    return fit(x, made.column("label").to_numpy().astype(np.float64), stems)


def score(docs: DataFrame, weights: Weights, threshold: float = 0.5, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_clauses) of every whole text; n_clauses are the matched ones.

    Null texts count as empty; a text without a match has the bias's score; repeated rows give repeated rows; an empty
    table gives an empty table; other columns are not read. Without labelled rows the prior weights are used.
    """
    def finish(batch, x):
        value = weights.score(x)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(value), pa.array((value >= threshold).astype(np.int32)),
             pa.array(np.rint((2 ** x[:, :len(MATCHES)] - 1).sum(axis=1)).astype(np.int64))],
            ["doc_id", "score", "predicted", "n_clauses"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return (_mapped(rows, "doc_id long, score double, predicted int, n_clauses long", weights.stems, finish)
            .select("doc_id", common.held_out().alias("held_out"), "score", "predicted", "n_clauses"))
