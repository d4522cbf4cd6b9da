"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read a text's words and marks from left to right: reported speech (said, wrote, quotation marks; to
the end of the sentence), negation (its effect lasts a few words of the clause), targets (you, they, ...; near for a few
words of the clause), threats (phrases, found as by an Aho-Corasick automaton) and insults (weighted words and word
stems). They are composed once, when a grammar is made, into one table of states and arcs; a target that follows its
insult is seen by a sixth one that reads the clause from right to left. An accepted insult or threat gets a label from
the states it is accepted in: plain, aimed at a target, negated, reported or threat. The score is a logistic function of
the weights under each label, never of single words without their clause.

Arcs come from fixed lists and from labelled rows of the training fold: a bounded sample of each class (max_rows rows of
least hash) gives words, stems and pairs of words that only toxic texts use; a greedy cover of the toxic texts keeps the
few that explain them, so that words that are merely copied along drop out, and what a 25th of the toxic texts share
stays too. Words and stems become insult arcs, pairs threat arcs, and what mostly stands beside insults a target arc.
Label weights are fitted by logistic regression on the same sample. The fitted model is a few kB and goes to the
workers; scoring is one pass over the texts without a shuffle.

Words are cut in one way everywhere: maximal runs of letters and digits, with apostrophes inside, lower-cased as Unicode
says; a curly apostrophe counts as a straight one.

Defined results: null and empty texts get the score of a text without matches; without labels (or with
one class only) the fixed lists and default weights are used; a text with both labels counts as toxic; rows repeat as
they come; further columns are ignored or, in `drop_toxic`, returned untouched; a null doc_id counts as held out; very
long texts take time in proportion and the memory of their words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.plans.lineage import kept

SLICE = 256
STEMS = (4, 5, 6)  # lengths of word beginnings that may be entries, written "lowei*"
SEED_INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile cretin filth vermin bastard scumbag jerk dummkopf abschaum imbécile ordure salaud idiota escoria".split()
SEED_THREATS = ("kill you", "kill them", "hurt you", "destroy you", "find you", "hunt you", "beat you", "shoot you", "burn you", "you will die", "you should die", "you deserve to die", "going to pay", "cut you", "end you",
                "bringe dich um", "mach dich fertig", "vais te tuer", "vais te trouver", "voy a matar", "te voy a encontrar")
TARGETS = frozenset("you your yours yourself u ur they them their he him his she her these those people everyone tu toi vous ton votre du dich dir ihr euch sie usted ustedes te tus".split())
NEGATIONS = frozenset("not no never neither nor isn't aren't wasn't weren't don't doesn't didn't cannot can't won't nicht kein keine nie pas jamais nunca".split())
REPORTS = frozenset("said says wrote writes called calls claimed claims reported reports quoted quote alleged stated tells told dit sagte schrieb dijo".split())
NEGATION_SPAN = 3
TARGET_SPAN = 5
LABELS = ("plain", "aimed", "negated", "reported", "threat")
PLAIN, AIMED, NEGATED, REPORTED, THREAT = range(5)
CACHED = 200_000  # words whose symbols a task remembers
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;,:\n\"“”«»]")

# what a symbol means to the transducers
TARGET, NEGATION, REPORT, INSULT, BREAK, STOP, LINE, QUOTE = (1 << i for i in range(8))
MARKS = dict.fromkeys(",;:", BREAK) | dict.fromkeys(".!?", STOP) | {"\n": LINE} | dict.fromkeys('"“”«»', QUOTE)
ENDS = BREAK | STOP | LINE | QUOTE  # of a clause


def tokens(text: str | None) -> list[str]:
    """Words and marks of a text."""
    return _TOKEN.findall((text or "").lower().replace("’", "'"))


def words_of(text: str | None) -> list[str]:
    return [t for t in tokens(text) if t not in MARKS]


def _table(states: int, roles: list[int], arc) -> np.ndarray:
    """arcs[state, symbol] of one transducer; arc(state, role) is the next state."""
    return np.array([[arc(s, r) for r in roles] for s in range(states)], np.int64)


def _reports(s: int, role: int) -> int:
    """Bit 0: after a verb of report; bit 1: inside quotation marks."""
    if role & QUOTE:
        return s ^ 2
    if role & LINE:
        return 0
    return s & 2 if role & STOP else s | 1 if role & REPORT else s


def _negations(s: int, role: int) -> int:
    """Words for which a negation still holds."""
    return 0 if role & ENDS else NEGATION_SPAN if role & NEGATION else max(0, s - 1)


def _targets(s: int, role: int) -> int:
    """Words for which a target still counts as near."""
    return 0 if role & ENDS else TARGET_SPAN if role & TARGET else max(0, s - 1)


class _Phrases:
    """Aho-Corasick automaton of word sequences: children, next states by failure, and what each state accepts."""

    def __init__(self, phrases: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.accepts: list[list[str]] = [[]]
        for phrase in sorted(phrases):
            at = 0
            for word in phrase.split():
                if word not in self.children[at]:
                    self.children[at][word] = len(self.children)
                    self.children.append({})
                    self.accepts.append([])
                at = self.children[at][word]
            self.accepts[at].append(phrase)
        self.failure = [0] * len(self.children)
        queue = list(self.children[0].values())
        for at in queue:
            for word, child in self.children[at].items():
                self.failure[child] = self.after(self.failure[at], word)
                self.accepts[child] += self.accepts[self.failure[child]]
                queue.append(child)

    def after(self, at: int, word: str | None) -> int:
        while at and word not in self.children[at]:
            at = self.failure[at]
        return self.children[at].get(word, 0)


@dataclass
class Grammar:
    """Weighted entries, phrases and the weight of each label; score = logistic(bias + sum of label weight * mass)."""

    terms: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_INSULTS, 3.0))
    phrases: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_THREATS, 3.0))
    targets: frozenset[str] = TARGETS
    weights: tuple[float, ...] = (2.2, 2.6, 0.9, 0.9, 2.4)
    bias: float = -2.5

    def __post_init__(self):
        self.words = {t for t in self.terms if not t.endswith("*")}
        self.stems = {t[:-1] for t in self.terms if t.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self._compose()

    def entry(self, word: str) -> str | None:
        """The entry that the insult transducer takes for the word: itself, else its longest stem."""
        if word in self.words:
            return word
        return next((f"{word[:n]}*" for n in self.lengths if word[:n] in self.stems), None)

    def _role(self, word: str) -> int:
        if word in MARKS:
            return MARKS[word]
        role = TARGET * (word in self.targets) | NEGATION * (word in NEGATIONS) | REPORT * (word in REPORTS)
        # a verb of report or a negation is read as such
        return role if role & (NEGATION | REPORT) else role | INSULT * (self.entry(word) is not None)

    def _compose(self) -> None:
        """One table of all transducers. A symbol is a role and, for the words of phrases, the word."""
        spoken = {w for p in self.phrases for w in p.split()}
        known = [(self._role(w), w) for w in sorted(spoken)]
        roles = {0, TARGET, NEGATION, REPORT, INSULT, TARGET | INSULT, TARGET | NEGATION, TARGET | REPORT, NEGATION | REPORT, BREAK, STOP, LINE, QUOTE}
        symbols = [(r, None) for r in sorted(roles)] + known
        self.symbol = {s: i for i, s in enumerate(symbols)}
        self.spoken = spoken
        of = [r for r, _ in symbols]
        tables = [_table(4, of, _reports), _table(NEGATION_SPAN + 1, of, _negations), _table(TARGET_SPAN + 1, of, _targets)]
        machine = _Phrases(self.phrases)
        tables.append(np.array([[0 if r & ENDS else machine.after(s, w) for r, w in symbols] for s in range(len(machine.children))], np.int64))
        sizes = [len(t) for t in tables]
        states = np.stack(np.unravel_index(np.arange(int(np.prod(sizes))), sizes))
        after = np.stack([t[s] for t, s in zip(tables, states, strict=True)])  # transducer x state x symbol
        nexts = np.ravel_multi_index(tuple(after), sizes)
        report, negation, near, phrase = after
        insult = np.array([bool(r & INSULT) for r in of])
        ends = np.array([bool(a) for a in machine.accepts])
        own = np.where(negation > 0, NEGATED, np.where(report > 0, REPORTED, np.where(near > 0, AIMED, PLAIN)))
        threat = np.where(negation > 0, NEGATED, np.where(report > 0, REPORTED, THREAT))
        self.width = len(symbols)
        self.nexts = nexts.ravel().astype(np.int32)
        # an arc's output: 0 none, else the insult's label + 1 and, eight times, the threat's label + 1
        self.outputs = (np.where(insult, own + 1, 0) + 8 * np.where(ends[phrase], threat + 1, 0)).ravel().astype(np.int8)
        self.accepted = [tuple(a) for a in machine.accepts]
        self.inner = sizes[-1]
        self.back = _table(TARGET_SPAN + 1, of, _targets).tolist()
        self.speaks = {i for i, (r, w) in enumerate(symbols) if r & INSULT or w is not None}
        self.breaks = {i for i, (r, _) in enumerate(symbols) if r & ENDS}
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def symbols(self, found: list[str]) -> list[int]:
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        out = []
        for word in found:
            at = cache.get(word)
            if at is None:
                cache[word] = at = self.symbol[self._role(word), word if word in self.spoken else None]
            out.append(at)
        return out

    def matches(self, text: str | None) -> list[tuple[str, int]]:
        """(entry or phrase, label number) of each one accepted."""
        read = tokens(text)
        symbols = self.symbols(read)
        if self.speaks.isdisjoint(symbols):
            return []
        found: list[tuple[str, int]] = []
        state, nexts, outputs, width = 0, self.nexts, self.outputs, self.width
        for i, symbol in enumerate(symbols):
            arc = state * width + symbol
            state = int(nexts[arc])
            if output := int(outputs[arc]):
                if output & 7:
                    label = (output & 7) - 1
                    found.append((self.entry(read[i]), AIMED if label == PLAIN and self._followed(symbols, i) else label))
                if output >> 3:
                    found += [(phrase, (output >> 3) - 1) for phrase in self.accepted[state % self.inner]]
        return found

    def _followed(self, symbols: list[int], i: int) -> bool:
        """Whether a target stands within reach behind word i, by the transducer that reads backwards."""
        state = 0
        reach = symbols[i + 1 : i + 1 + TARGET_SPAN]
        stop = next((n for n, s in enumerate(reach) if s in self.breaks), len(reach))
        for symbol in reversed(reach[:stop]):
            state = self.back[state][symbol]
        return state > 0

    def masses(self, found: list[tuple[str, int]]) -> np.ndarray:
        out = np.zeros(len(LABELS))
        for entry, label in found:
            out[label] += self.terms[entry] if entry in self.terms else self.phrases[entry]
        return np.log1p(out)

    def score(self, text: str | None) -> float:
        found = self.matches(text)
        x = self.bias + (float(self.masses(found) @ np.array(self.weights)) if found else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, toxic): of the training fold, the max_rows rows of each class with the least hash."""
    fold = labels.where("doc_id is not null and toxic in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    part = lambda c: fold.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return part(0).unionByName(part(1))


def _pairs(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _stems(words: set[str]) -> set[str]:
    return {f"{w[:n]}*" for w in words for n in STEMS if n < len(w) < 40}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, n): texts of each class that have the word or stem; pairs of words of toxic texts only."""
    counts: Counter = Counter()

    def give() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts]), pa.array([c for _, c in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["term", "toxic", "n"])
        counts.clear()
        return out

    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            some = batch.slice(start, SLICE)
            for text, toxic in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                read = words_of(text)
                words = set(read)
                counts.update((t, toxic) for t in {w for w in words if 2 < len(w) < 40} | _stems(words))
                if toxic:
                    counts.update((t, 1) for t in _pairs(read) if len(t) < 80)
            if len(counts) > 300_000:
                yield give()
    if counts:
        yield give()


def _clean_pairs(wanted: set[str]):
    """mapInArrow over (text, toxic): (term, n), clean texts of a batch that have the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                for text, toxic in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if not toxic:
                        counts.update(_pairs(words_of(text)) & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return run


def _beside(entries: Grammar):
    """mapInArrow over (text, toxic): (term, beside, n), occurrences of words next to insults and at all, toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, every = Counter(), Counter()
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                for text, toxic in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if toxic:
                        read = words_of(text)
                        every.update(read)
                        insults = [i for i, w in enumerate(read) if entries.entry(w) is not None]
                        near.update(read[j] for j in {i + d for i in insults for d in (-1, 1)} if 0 <= j < len(read))
            terms = [t for t in near if len(t) < 40 and entries.entry(t) is None]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([near[t] for t in terms], pa.int64()), pa.array([every[t] for t in terms], pa.int64())], ["term", "beside", "n"])

    return run


def _cover(hits: list[set[str]], odds: dict[str, float], least: int) -> dict[str, float]:
    """Greedy cover of toxic texts by their candidate entries; ties go to the longer entry, then by name."""
    where: dict[str, set[int]] = {}
    for i, entries in enumerate(hits):
        for e in entries:
            where.setdefault(e, set()).add(i)
    chosen: dict[str, float] = {}
    while where:
        best = max(where, key=lambda e: (len(where[e]), odds[e], len(e), e))
        gained = where.pop(best)
        if len(gained) < least:
            break
        chosen[best] = odds[best]
        where = {e: rest for e, own in where.items() if (rest := own - gained)}
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 60, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Newton's method for logistic regression with a ridge; row i stands for n[i] rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (n * p * (1 - p))[:, None]).T @ x1 + np.diag(keep), x1.T @ (n * (p - y)) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000) -> Grammar:
    """Fit arcs and label weights on at most max_rows labelled rows of each class. The driver gets the candidates, each
    of which is in a 300th of the sample's toxic texts at least, and each sampled text's matches of them."""
    spark = docs.sparkSession
    sample = F.broadcast(_sample(labels, max_rows))  # 2 * max_rows rows of two numbers
    read = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("text", "toxic")
    read = kept(read.groupBy("text").agg(F.max("toxic").alias("toxic")))  # copies would pass their rare words off as toxic
    counted = read.mapInArrow(_count_terms, "term string, toxic int, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    sizes = dict(read.groupBy("toxic").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return Grammar()
    odds = lambda bad, good: math.log((bad + 0.5) / (sizes[1] + 1.0)) - math.log((good + 0.5) / (sizes[0] + 1.0))
    least, strong = max(2, sizes[1] // 300), max(4, sizes[1] // 25)
    # as shares of their classes, toxic texts have it so many times as often; stems stand for words not seen yet
    pure = lambda term, bad, good: good * (1000 if term.endswith("*") else 200) * sizes[1] <= bad * sizes[0]
    paired = F.instr("term", " ") > 0
    own_shares = F.col("good") * F.when(F.col("term").endswith("*"), 1000).otherwise(200) * sizes[1] <= F.col("bad") * sizes[0]
    scored = kept(counted.where((F.col("bad") >= F.when(paired, strong).otherwise(least)) & own_shares | F.col("term").isin(SEED_INSULTS)))
    top = [r for r in scored.collect() if r.bad >= least and pure(r.term, r.bad, r.good)]
    seeds = {r.term: odds(r.bad, r.good) for r in scored.where(F.col("term").isin(SEED_INSULTS)).collect()}
    alone = {r.term for r in top if " " not in r.term}
    told = lambda term: any(w in alone or not alone.isdisjoint(_stems({w})) for w in term.split())
    pairs = {r.term for r in top if " " in r.term and not told(r.term)}  # what its words alone don't tell
    clean = dict(read.mapInArrow(_clean_pairs(pairs), "term string, n long").groupBy("term").agg(F.sum("n")).collect()) if pairs else {}
    top = [(r.term, r.bad, r.good) for r in top if " " not in r.term] + [(r.term, r.bad, clean.get(r.term, 0)) for r in top if r.term in pairs]
    top = [x for x in top if pure(*x)]
    known = {term: odds(bad, good) for term, bad, good in top}
    candidates = spark.sparkContext.broadcast(set(known))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = candidates.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                out = []
                for text in some.column(0).to_pylist():
                    words = words_of(text)
                    out.append(sorted((set(words) | _stems(set(words)) | _pairs(words)) & wanted))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["entries"])

    found = read.where("toxic = 1").select("text").mapInArrow(hits, "entries array<string>").distinct().collect()
    chosen = _cover([set(r.entries) for r in found], known, least)
    # what many toxic texts have and hardly any other is an entry even where the cover had no need of it
    chosen |= {term: known[term] for term, bad, _ in top if bad >= strong}
    usual = float(np.median(list(chosen.values()))) if chosen else 3.0
    terms = {t: seeds.get(t, usual) for t in SEED_INSULTS if seeds.get(t, usual) > 0} | {t: w for t, w in chosen.items() if " " not in t}
    phrases = dict.fromkeys(SEED_THREATS, usual) | {t: w for t, w in chosen.items() if " " in t}
    beside = read.mapInArrow(_beside(Grammar(terms, phrases)), "term string, beside long, n long").groupBy("term").agg(F.sum("beside").alias("beside"), F.sum("n").alias("n"))
    targets = {r.term for r in beside.where((F.col("beside") >= strong) & (F.col("beside") * 2 >= F.col("n"))).collect()}
    grammar = Grammar(terms, phrases, TARGETS | targets)
    shared = spark.sparkContext.broadcast(grammar)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                out = [shared.value.masses(shared.value.matches(t)).tolist() for t in some.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), some.column(1)], ["masses", "toxic"])

    rows = read.mapInArrow(masses, "masses array<double>, toxic int").groupBy("masses", "toxic").count().orderBy("masses", "toxic").collect()
    x, y, n = np.array([r.masses for r in rows]), np.array([float(r.toxic) for r in rows]), np.array([float(r["count"]) for r in rows])
    weights, bias = _logistic(x, y, n)
    # what a label lacks examples for keeps part of the plain weight; a match never lowers a score
    seen = ((x > 0) * n[:, None]).sum(axis=0)
    plain = max(weights[0], weights[1], 1.0)
    share = (1.0, 1.2, 0.4, 0.4, 1.2)
    final = [float(max(0.0, w)) if s >= 30 else plain * k for w, s, k in zip(weights, seen, share, strict=True)]
    return Grammar(terms, phrases, grammar.targets, tuple(final), min(bias, -1.0))


def scores(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text, ...)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out: list[float] = []
            for start in range(0, batch.num_rows, SLICE):
                out += [own.score(t) for t in batch.column(1).slice(start, SLICE).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, untouched."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                yield some.filter(pa.array([own.score(t) < threshold for t in some.column(at).cast(pa.string()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_clause_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scores(docs, fit(docs, labels))
