"""Toxicity by a weighted finite-state grammar of clauses.

Every word of a sentence becomes a symbol (insult, threat, target, negation, report, other), every clause end another.
Five weighted transducers read such symbols: ``insult`` turns an insult into an attack; ``threat`` turns a threat word
into one only where a target follows closely in its clause; ``target`` marks the attacks that have a target near them;
``negation`` turns attacks right behind a negation into negated ones; ``reported`` turns attacks into quoted ones, if a
report word stands before them in their sentence or opens the clause behind them. The five are composed into one
transducer; the output of its heaviest path over a sentence tells the kinds of the attacks in each clause. A clause
weighs what its attacks of a kind weigh together, and a text's score is a logistic function of the weights of its
clauses by kind: a threat word without a target makes no clause at all.

Insults are seed words and what labelled rows teach: words and word stems (prefixes of 4 and 5 characters) whose rows
are toxic far more often than others, more often than chance would make any of the candidates. About ``sample``
labelled rows at most are learned from, picked by a hash; language, source and id are never inputs of a score. There
is no other limit: whatever entries those rows bear out are in the lexicon, which travels with the tasks.

Edge cases: null and empty texts score as a text without clauses; without any labelled row the seeds alone and
the prior weights are used; null labels, and labels other than 0 and 1, don't count; copies of a labelled text are learned from once
and repeated rows get equal scores; texts are read whole, in time proportional to their length; entries of equal evidence are all
kept; an empty table gives an empty result; extra columns stay as they are, but ``score`` and ``predicted``, which the
result has of its own, are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.tables import cut, held_out, slices
from lakeproof.llm.workers import kept, serving

# Seed words of the classes, in lower case.
INSULTS = "idiot moron stupid loser scum dumm idiota imbécile estúpido".split()
THREATS = "kill hurt destroy burn töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours u him her them people du dich dir ihr euch tu te toi vous tú te vosotros ustedes".split()
NEGATIONS = "not never no isn aren wasn weren don doesn nicht kein keine nie ne pas jamais nunca".split()
REPORTS = "said says called wrote quoted reported sagte nannte dit appelait dijo llamó".split()
BREAKS = "but because although aber denn mais car pero porque".split()

OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT, BREAK = "otnrihc"
#: What the transducers write: attacks without and with a target, threats, negated and quoted attacks.
PLAIN, AIMED, THREATENED, NEGATED, QUOTED = "xakdq"
ATTACKS = PLAIN + AIMED + THREATENED

TOKEN = re.compile(r"\w+|[.!?…]+|\n\s*\n|[^\w\s'’.!?…]+")
STEMS = (4, 5)
Step = Callable[[object, str], Iterable[tuple[str, float, object]]]


@dataclass(frozen=True)
class Transducer:
    """A weighted finite-state transducer over single symbols: ``arcs[state, read]`` holds ``(write, weight, state)``."""

    arcs: dict[tuple[int, str], list[tuple[str, float, int]]]
    final: frozenset[int]

    @classmethod
    def of(cls, alphabet: str, start: object, step: Step, final: Callable[[object], bool] = lambda state: True) -> Transducer:
        """All states that can be reached from ``start``, numbered; the start is 0."""
        numbers, todo, arcs = {start: 0}, [start], {}
        for state in todo:
            for read in alphabet:
                own = arcs.setdefault((numbers[state], read), [])
                for write, weight, to in step(state, read):
                    if to not in numbers:
                        numbers[to] = len(numbers)
                        todo.append(to)
                    own.append((write, weight, numbers[to]))
        return cls(arcs, frozenset(n for state, n in numbers.items() if final(state)))

    def compose(self, then: Transducer) -> Transducer:
        """The transducer that does what ``then`` does with this one's output; weights add up."""

        def step(state, read):
            for middle, weight, a in self.arcs.get((state[0], read), ()):
                for write, more, b in then.arcs.get((state[1], middle), ()):
                    yield write, weight + more, (a, b)

        alphabet = "".join(sorted({read for _, read in self.arcs}))
        return Transducer.of(alphabet, (0, 0), step, lambda state: state[0] in self.final and state[1] in then.final)

    def best(self, symbols: str) -> tuple[float, str] | None:
        """Weight and output of the heaviest path, the least output among equals; None if no path accepts."""
        held: dict[int, tuple[float, str]] = {0: (0.0, "")}
        for read in symbols:
            new: dict[int, tuple[float, str]] = {}
            for state, (weight, out) in held.items():
                for write, more, to in self.arcs.get((state, read), ()):
                    found = (weight + more, out + write)
                    if to not in new or (-found[0], found[1]) < (-new[to][0], new[to][1]):
                        new[to] = found
            held = new
        ends = [x for state, x in held.items() if state in self.final]
        return min(ends, key=lambda x: (-x[0], x[1])) if ends else None


def transducers(reach: int = 4) -> list[Transducer]:
    """The five transducers, in the order in which they are composed."""

    def insult(state, read):
        yield (PLAIN if read == INSULT else read), 0.0, state

    def threat(left, read):  # ``left``: words within which the guessed target must come, else 0
        if read == THREAT:
            if not left:
                yield OTHER, 0.0, 0
                yield THREATENED, 1.0, 3
        elif left and read in (TARGET, PLAIN):
            yield read, 0.0, 0
        elif left:
            if read != BREAK and left > 1:
                yield read, 0.0, left - 1
        else:
            yield read, 0.0, 0

    def target(state, read):
        since, owed = state  # words since the last target, words within which a guessed one must come
        after = min(since + 1, reach + 1) if read != BREAK else reach + 1
        if read == TARGET:
            yield read, 0.0, (0, 0)
        elif read == PLAIN:
            if owed != 1:
                left = max(owed - 1, 0)
                yield PLAIN, 0.0, (after, left)
                yield AIMED, 1.0, (after, reach if after > reach and not owed else left)
        elif not owed:
            yield read, 0.0, (after, 0)
        elif owed > 1 and read != BREAK:
            yield read, 0.0, (after, owed - 1)

    def negation(left, read):  # ``left``: words that the last negation still reaches
        if read == NEGATION:
            yield read, 0.0, 3
        elif read in ATTACKS and left:
            yield NEGATED, 0.0, 0
        else:
            yield read, 0.0, 0 if read == BREAK else max(left - 1, 0)

    def reported(state, read):
        # "": nothing yet; "r": a report has been seen; "claim": no report may open the next clause; "owed": one must.
        mode, left = state
        if mode == "r" or mode == "" and read == REPORT:
            yield (QUOTED if read in (*ATTACKS, NEGATED) else read), 0.0, ("r", 0)
        elif mode == "":
            if read in ATTACKS:
                yield read, 0.0, ("claim", 0)
                yield QUOTED, 0.0, ("owed", 0)
            else:
                yield read, 0.0, state
        elif read == BREAK:
            if left in (0, 3):  # a clause without words doesn't count
                yield read, 0.0, (mode, 3)
            elif mode == "claim":
                yield read, 0.0, ("", 0)
        elif read == REPORT:
            if mode == "owed" and left or mode == "claim" and not left:
                yield read, 0.0, ("r", 0)
        elif mode == "owed":
            if left != 1:
                yield (QUOTED if read in ATTACKS else read), 0.0, (mode, max(left - 1, 0))
        elif not left:
            yield read, 0.0, (mode, 0)
        elif left == 1 or read in ATTACKS:  # no report opened this clause
            yield from reported(("", 0), read)
        else:
            yield read, 0.0, (mode, left - 1)

    words = OTHER + TARGET + NEGATION + REPORT
    return [
        Transducer.of(words + INSULT + THREAT + BREAK, 0, insult),
        Transducer.of(words + PLAIN + THREAT + BREAK, 0, threat, lambda left: not left),
        Transducer.of(words + PLAIN + THREATENED + BREAK, (reach + 1, 0), target, lambda state: not state[1]),
        Transducer.of(words + ATTACKS + BREAK, 0, negation),
        Transducer.of(words + ATTACKS + NEGATED + BREAK, ("", 0), reported, lambda state: state[0] != "owed"),
    ]


@lru_cache(maxsize=4)
def composed(reach: int = 4) -> Transducer:
    out, *rest = transducers(reach)
    for then in rest:
        out = out.compose(then)
    return out


kept(composed.cache_clear)


@dataclass(frozen=True)
class ToxicityParams:
    #: Labelled rows to learn from, about, at most.
    sample: int = 50_000
    #: Least labelled toxic rows of an entry, and least share of toxic rows among all its rows.
    min_rows: int = 4
    min_precision: float = 0.85
    #: Words on either side of an attack that a target may stand in.
    reach: int = 4
    #: Strength of the prior weights, in rows.
    prior_rows: float = 4.0


#: Prior weights: of direct clauses, of those with a target or a threat besides, of negated and of quoted ones.
PRIOR, PRIOR_BIAS = np.array([3.5, 2.0, 0.0, 0.0]), -3.0


class _Symbols(dict):
    """Word -> symbol, looked up once each."""

    def __init__(self, grammar: Grammar):
        super().__init__()
        self.grammar = grammar

    def __missing__(self, token: str) -> str:
        if not (token[0].isalnum() or token[0] == "_"):
            found = "." if token[0] in ".!?…\n" else BREAK
        else:
            found = INSULT if self.grammar.weight(token) else _CLASSES.get(token, OTHER)
        if len(self) > 200_000:
            self.clear()
        self[token] = found
        return found


_CLASSES = {w: s for s, own in ((BREAK, BREAKS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in own}
_LONG_RUN = re.compile(f"{OTHER}{{9,}}")


@dataclass
class Grammar:
    """Lexicon of insults (word or stem -> weight) and the weights of clause kinds."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=PRIOR.copy)
    bias: float = PRIOR_BIAS
    reach: int = 4

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def weight(self, word: str) -> float:
        """How surely a word is an insult; 0 for other words."""
        own = self.words.get(word, 0.0)
        if not own and self.stems and len(word) >= STEMS[0]:
            own = max(self.stems.get(word[:n], 0.0) for n in STEMS)
        return own

    def kinds(self, sentence: str) -> str:
        """The transducer's output for a sentence's symbols."""
        machine = composed(self.reach)
        known = self.__dict__.setdefault("_known", {})
        found = known.get(sentence)
        if found is None:
            if len(known) > 20_000:
                known.clear()
            best = machine.best(sentence)
            found = known[sentence] = best[1] if best else ""
        return found

    def clauses(self, text: str) -> np.ndarray:
        """Weights of the clauses: of direct attacks, of those with a target or a threat, of negated and of quoted ones."""
        symbols = self.__dict__.get("_symbols") or self.__dict__.setdefault("_symbols", _Symbols(self))
        tokens = TOKEN.findall(text.lower())
        line = "".join([symbols[t] for t in tokens])
        out = np.zeros(len(PRIOR))
        if INSULT not in line and THREAT not in line:
            return out
        at = 0
        for sentence in line.split("."):
            if INSULT in sentence or THREAT in sentence:
                # Longer runs of other words do the same as nine.
                places, short = [], sentence
                if _LONG_RUN.search(sentence):
                    short, last = "", 0
                    for run in _LONG_RUN.finditer(sentence):
                        short += sentence[last : run.start() + 9]
                        places.extend(range(last, run.start() + 9))
                        last = run.end()
                    short += sentence[last:]
                places.extend(range(len(places) and last, len(sentence)))
                for place, kind in zip(places, self.kinds(short)):
                    if kind in ATTACKS + NEGATED + QUOTED:
                        weight = self.weight(tokens[at + place]) or 1.0
                        out += weight * np.array([kind in ATTACKS, kind in AIMED + THREATENED, kind == NEGATED, kind == QUOTED])
            at += len(sentence) + 1
        return out

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights @ np.log1p(self.clauses(text)))
        return float(1 / (1 + np.exp(-z)))


def seeded(words: dict[str, float] | None = None, stems: dict[str, float] | None = None, reach: int = 4) -> Grammar:
    """A grammar of the seed insults and the given entries."""
    return Grammar(dict.fromkeys(INSULTS, 1.0) | (words or {}), stems or {}, reach=reach)


_ENTRIES = pa.schema([("stem", pa.bool_()), ("entry", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])


def _entries(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows per word and stem by label, added up over ``most`` entries at a time."""
    total: dict[tuple[bool, str], list[int]] = {}

    def held() -> pa.RecordBatch:
        columns = [[k[0] for k in total], [k[1] for k in total], [v[0] for v in total.values()], [v[1] for v in total.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRIES)], schema=_ENTRIES)

    for batch in batches:
        for part in slices(batch, 0):
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = {w for w in TOKEN.findall((text or "").lower()) if w[0].isalnum()}
                for stem, own in ((False, words), (True, {w[:n] for w in words for n in STEMS if len(w) >= n})):
                    for k in own:
                        total.setdefault((stem, k), [0, 0])[toxic] += 1
                if len(total) > most:
                    yield held()
                    total.clear()
    yield held()


def _featured(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                rows = [np.log1p(grammar.clauses(t or "")).tolist() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), part.column(1)], names=["x", "y"])

    return run


def _sampled(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` of the rows at most, picked by a hash of the key."""
    share = min(1.0, most / max(1, rows.count()))
    return rows if share == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))


def _divergence(k: Column, n: Column, share: float) -> Column:
    """A bound of -ln(P) that ``k`` of ``n`` rows are toxic by chance, ``share`` of all rows being so."""
    p = k / n
    clean = F.when(p < 1, (1 - p) * F.ln((1 - p) / (1 - share))).otherwise(0.0)
    return n * (p * F.ln(p / share) + clean)


def fit(rows: DataFrame, params: ToxicityParams = ToxicityParams(), text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Learn the lexicon and the clause weights from labelled rows."""
    rows = rows.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    rows = cut(_sampled(cut(rows, "labelled"), F.col("text"), params.sample).distinct(), "distinct-labelled")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < n:
        return seeded(reach=params.reach)
    sums = rows.mapInArrow(serving("toxicity", _entries), "stem boolean, entry string, clean long, toxic long").groupBy("stem", "entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = cut(sums, "entries")
    candidates = sums.where(F.col("toxic") > 0).count()
    total = F.col("toxic") + F.col("clean")
    seed = ~F.col("stem") & F.col("entry").isin(INSULTS)
    sure = (F.col("toxic") >= params.min_rows) & (F.col("toxic") >= params.min_precision * total) & (_divergence(F.col("toxic"), total, toxic / n) >= log(max(candidates, 2)))
    held: tuple[dict, dict] = ({}, {})
    dropped = []
    for r in sums.where(sure | seed).collect():  # what a sample of bounded size bears out
        if r.stem or r.entry not in INSULTS or r.toxic >= params.min_precision * (r.toxic + r.clean):
            held[r.stem][r.entry] = float(r.toxic / (r.toxic + r.clean + 1))
        elif r.toxic + r.clean >= params.min_rows:
            dropped.append(r.entry)
    grammar = seeded(*held, reach=params.reach)
    for word in dropped:  # a seed that the labels don't bear out
        grammar.words.pop(word, None)
    data = rows.mapInArrow(serving("toxicity", _featured(grammar)), "x array<double>, y int").toArrow()  # at most about ``sample`` short rows
    y = data.column("y").to_numpy().astype(float)
    x = np.column_stack([np.ones(len(y)), np.array(data.column("x").to_pylist())])
    prior = np.concatenate([[PRIOR_BIAS], PRIOR])
    w, pull = prior.copy(), np.concatenate([[1e-2], np.full(len(PRIOR), params.prior_rows)])
    for _ in range(30):  # Newton steps of a logistic regression that is drawn to the prior weights
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(pull), x.T @ (p - y) + pull * (w - prior))
    grammar.bias, grammar.weights = float(w[0]), np.maximum(w[1:], 0.0)
    return grammar


def labelled(docs: DataFrame, labels: DataFrame, parts: int = 5, id_col: str = "doc_id", sample: int = ToxicityParams.sample) -> DataFrame:
    """``text, toxic`` of the labelled rows that may be learned from: crc32 of the id's text is no multiple of ``parts``.

    About ``sample`` labels at most, picked by a hash of the id, are sent to every executor to pick the texts."""
    own = labels.select(id_col, F.col("toxic").alias("toxic")).where(F.col("toxic").isNotNull() & ~held_out(F.col(id_col), parts))
    own = _sampled(own, F.col(id_col), sample)
    return docs.select(id_col, "text").join(F.broadcast(own), id_col).select("text", "toxic")


def _scorer(grammar: Grammar):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in texts:
            yield pa.array([grammar.score(t or "") for part in slices(own) for t in part.to_pylist()], pa.float64())

    task = serving("toxicity", run)
    task.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(task, "double")


def toxic_score(grammar: Grammar, text: Column | str = "text") -> Column:
    """The score of a text column, 0 to 1: only the texts are sent to Python, and only numbers come back."""
    return _scorer(grammar)(text)


def toxicity(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``score`` (0 to 1) and ``predicted`` (1 from 0.5)."""
    rest = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    out = docs.select(*rest, toxic_score(grammar, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
