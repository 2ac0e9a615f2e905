"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists of the grammar, in English, German, French and Spanish.
TARGETS = "you your yours u ur du dich dir ihr euch tu toi vous te ti usted ustedes vosotros they them he she him her these those people".split()
NEGATIONS = "not no never isn't aren't don't wasn't nicht kein keine nie niemals pas jamais ni nunca jamás".split()
REPORTING = "said says say wrote writes called claims claimed quoted quote reported asked shouted yelled sagte sagt schrieb rief meinte dit écrit cria dijo dice escribió gritó".split()
CONTRASTS = "but however yet aber sondern doch mais pero sino".split()
THREATS = "kill killing hurt destroy shoot stab beat murder burn strangle smash töten töte schlagen schlage erschießen erwürgen umbringen umbringe bringe tuer tue tuerai frapper frappe étrangler matar mato mataré golpear golpeo".split()
#: What makes no threat of one: it is no living thing that dies, or a manner of speaking.
IDIOMS = "for time".split()
#: Dying is a threat only after one of these: "die" is an article in German.
MODALS = "should must shall gonna".split()
DYING = "die".split()
INSULTS = "idiot moron loser scum trash stupid pathetic worthless disgusting clown fool dumb imbecile".split()

#: Documents of each class that a fit reads at most, smallest hash of the id first.
SAMPLE = {1: 4000, 0: 6000}
#: A cue is a word, or the first letters of words, seen in so many toxic sample documents at least.
LEAST_DOCUMENTS = 6
#: ... and in such a share of them, so that copies of one document make no cues.
LEAST_SHARE = 0.02
#: A beginning gives way to a longer form that covers this share of its documents.
COVERED = 0.9
#: Its log odds, less so many standard errors, reach LEAST_WEIGHT.
ERRORS = 1.64
LEAST_WEIGHT = 2.0
PREFIXES = (4, 5, 6, 7, 8)
CONTEXTS = ("plain", "negated", "reported")
FEATURES = tuple(f"{c}_{x}" for c in CONTEXTS for x in ("top", "sum")) + ("aimed_top", "threat", "aimed_threat")

_CLAUSE_ENDS = ".!?;\n|"
_CLAUSE = re.compile(r"[.!?;\n|]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SYMBOL = re.compile(rf"{_WORD.pattern}|,")
_QUOTES = {"\"": "\"", "“": "”", "«": "»", "„": "“"}
_POINT = re.compile("[\"“”«»„.!?;\n|]")
_AFTER_QUOTE = re.compile(r"[\s,]*(?:[^\W\d_]+\s+){0,2}[^\W\d_]+")
_REPORTING = frozenset(REPORTING)


class Transducer:
    """A sequential transducer: step(state, symbol) -> (state, symbol), and the weights of its last states."""

    def __init__(self, start, step, last=lambda state: {}):
        self.start, self.step, self.last = start, step, last

    def __rshift__(self, other: Transducer) -> Transducer:
        """Composition: what self writes, other reads."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Transducer((self.start, other.start), step, lambda s: self.last(s[0]) | other.last(s[1]))

    def table(self, symbols: list) -> tuple[dict, dict]:
        """All reachable transitions and last weights, so that running takes look-ups only."""
        arcs, todo, seen = {}, [self.start], {self.start}
        while todo:
            state = todo.pop()
            for x in symbols:
                to, out = self.step(state, x)
                arcs[state, x] = (to, out)
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return arcs, {s: self.last(s) for s in seen}


# A symbol is (kind, marks): the kind of a word and what the machines so far say of it.
KINDS = ("word", "insult", "threat", "target", "negation", "reporting", "contrast", "comma", "idiom", "modal", "dying")


_MARKED = ("insult", "threat", "dying")


def _negation(state: int, x):
    """A negation lasts to the end of the clause (1), or to a contrast, or to a target right after a comma (2), as in "..., you ...\"."""
    kind, marks = x
    if kind == "negation":
        return 1, x
    if kind == "contrast" or (state == 2 and kind == "target"):
        return 0, x
    return (2 if kind == "comma" else 1) if state else 0, (kind, marks | {"negated"}) if state and kind in _MARKED else x


def _reported(state: bool, x):
    kind, marks = x
    return state or kind == "reporting", (kind, marks | {"reported"}) if state and kind in _MARKED else x


def _target(state: bool, x):
    return state or x[0] == "target", x


def _threat(state: int, x):
    """A plain threat is pending (1) until the next word, and stands (2) unless that makes an idiom of it, as in \"kill for\"; 3 is right after a modal."""
    if state == 2 or x[1]:
        return 2 if state in (1, 2) else 0, x
    if x[0] == "threat" or (x[0] == "dying" and state == 3):
        return 1, x
    if state == 1:
        return 0 if x[0] == "idiom" else 2, x
    return 3 if x[0] == "modal" else 0, x


GRAMMAR = (
    Transducer(0, _negation)
    >> Transducer(False, _reported)
    >> Transducer(False, _target, lambda aimed: {"aimed": aimed})
    >> Transducer(0, _threat, lambda threat: {"threat": threat in (1, 2)})
)
_START = GRAMMAR.start
_ARCS, _LAST = GRAMMAR.table([(k, frozenset()) for k in KINDS])
_CONTEXT = {frozenset(m for m, on in zip(("negated", "reported"), bits, strict=True) if on): ("negated" if bits[0] else "reported" if bits[1] else "plain") for bits in product((0, 1), repeat=2)}
_FIXED = {w: k for k, ws in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("reporting", REPORTING), ("contrast", CONTRASTS), ("comma", [","]), ("idiom", IDIOMS), ("modal", MODALS), ("dying", DYING)) for w in ws}


class Reading:
    """Walks a text once from left to right and knows where the clause and the quotation begin that a place is in.

    A quotation ends with its line at the latest.
    """

    def __init__(self, low: str):
        self.low, self.at, self.clause = low, 0, 0
        self.opened, self.closer, self.lead = -1, "", 0
        self.line_end = -1
        self._marks: dict[int, tuple] = {}

    def to(self, place: int) -> None:
        for m in _POINT.finditer(self.low, self.at, place):
            c = m[0]
            if c in _CLAUSE_ENDS:
                self.clause = m.end()
                self.opened = -1 if c == "\n" else self.opened
            elif self.opened >= 0 and c == self.closer:
                self.opened = -1
            elif self.opened < 0 and c in _QUOTES:
                self.opened, self.closer, self.lead = m.start(), _QUOTES[c], self.clause
        self.at = place

    def before(self) -> str:
        """What leads up to the quotation that the clause goes on with, as in: she said: "One. Two": nothing outside quotations."""
        return self.low[self.lead : self.opened] if 0 <= self.opened < self.clause else ""

    def reported_after(self) -> bool:
        """Whether words of saying follow the quotation here, as in: "One. Two", she said."""
        if self.opened < 0:
            return False
        if self.line_end < self.at:
            end = self.low.find("\n", self.at)
            self.line_end = end if end >= 0 else len(self.low)
        end = self.low.find(self.closer, max(self.at, self.opened + 1), self.line_end)
        tail = _AFTER_QUOTE.match(self.low, end + 1) if end >= 0 else None
        return bool(tail) and any(w in _REPORTING for w in _WORD.findall(tail[0]))

    def remembered(self, key: str, make):
        """``make()``, once for each quotation."""
        if key not in self._marks or self._marks[key][0] != self.opened:
            self._marks[key] = (self.opened, make())
        return self._marks[key][1]


class Scorer:
    """The composed grammar with the weights of learned cues: whole words and beginnings of words."""

    def __init__(self, cues: dict[str, float]):
        self.words = {c: w for c, w in cues.items() if not c.endswith("*")}
        self.heads = {c[:-1]: w for c, w in cues.items() if c.endswith("*")}
        self.finder = ahocorasick.Automaton()
        for c in {*self.words, *self.heads, *THREATS, *MODALS}:
            self.finder.add_word(c, len(c))
        if cues or THREATS:
            self.finder.make_automaton()

    def weight(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.heads.get(word[:n], 0.0) for n in PREFIXES if len(word) >= n)])

    def __call__(self, text: str | None) -> np.ndarray:
        """FEATURES of a whole text.  Clauses without a cue or a threat weigh nothing and are passed over."""
        f = dict.fromkeys(FEATURES, 0.0)
        low = (text or "").lower()
        done, reading = 0, Reading(low)
        for at, n in self.finder.iter(low):
            begin = at - n + 1
            if begin < done or (begin and low[begin - 1].isalpha()):
                continue
            reading.to(begin)
            left = reading.clause
            right = _CLAUSE.search(low, at)
            done = right.start() if right else len(low)
            state = _START
            if reading.opened >= 0:
                state = reading.remembered("before", lambda: self._run(_START, reading.before())[0])  # noqa: B023
                if reading.remembered("after", reading.reported_after):
                    state = _ARCS[state, ("reporting", frozenset())][0]
            self._clause(state, low[left:done], f)
        for c in CONTEXTS:
            f[f"{c}_sum"] = math.log1p(f[f"{c}_sum"])
        return np.array([f[k] for k in FEATURES])

    def _run(self, state, clause: str) -> tuple:
        """The state after a clause, and the contexts and weights of its insults."""
        found = []
        for word in _SYMBOL.findall(clause):
            w = self.weight(word)
            kind = "insult" if w else _FIXED.get(word, "word")
            state, (kind, marks) = _ARCS[state, (kind, frozenset())]
            if kind == "insult":
                found.append((_CONTEXT[marks], w))
        return state, found

    def _clause(self, state, clause: str, f: dict) -> None:
        state, found = self._run(state, clause)
        last = _LAST[state]
        for context, w in found:
            f[f"{context}_top"] = max(f[f"{context}_top"], w)
            f[f"{context}_sum"] += w
            if last["aimed"] and context == "plain":
                f["aimed_top"] = max(f["aimed_top"], w)
        if last["threat"]:
            f["threat"] = 1.0
            f["aimed_threat"] = max(f["aimed_threat"], float(last["aimed"]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) is a multiple of 5; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(toxic, text): the labelled documents outside the held-out fold with the smallest hashes, SAMPLE of a class at most.

    The ids are few by SAMPLE, so they are broadcast to the documents.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")))
    one = lambda c: known.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(SAMPLE[c])
    chosen = one(1).unionByName(one(0)).select("doc_id", "toxic")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text").distinct()


def _forms(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by = (Counter(), Counter())
    for b in batches:
        for toxic, text in zip(b["toxic"].to_pylist(), b["text"].to_pylist(), strict=True):
            by[toxic].update(_forms(text))
    keep = [x for x in by[1]]  # forms of clean documents alone are no cues
    yield pa.RecordBatch.from_pydict({"form": pa.array(keep, pa.string()), "t": pa.array([by[1][x] for x in keep], pa.int64())})


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], np.ndarray]:
    """Cue weights and the logistic weights (bias first) of FEATURES, from a bounded sample of labelled documents.

    A form's weight is its log odds of document frequency, toxic against clean, smoothed by one half.
    Forms in LEAST_SHARE of the toxic sample reach the driver, of which there are at most the mean
    number of forms of a sample document / LEAST_SHARE.  Of the features, SAMPLE rows at most do.
    """
    sample = sample_of(docs, labels, id_col, text_col).persist()
    n = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    cues = dict.fromkeys(INSULTS, LEAST_WEIGHT)
    if n[0] and n[1]:
        often = sample.where("toxic = 1").mapInArrow(_count_forms, "form string, t long").groupBy("form").agg(F.sum("t").alias("t")).where(F.col("t") >= max(LEAST_DOCUMENTS, LEAST_SHARE * n[1]))
        wanted = [r["form"] for r in often.orderBy(F.desc("t"), "form").collect()]
        cues |= _weigh(sample, wanted, n)
    scorer = Scorer(cues)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scorer(t).tolist() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": b["toxic"].cast(pa.int32()), "x": pa.array(rows, pa.list_(pa.float64()))})

    rows = sample.mapInArrow(features, "toxic int, x array<double>").collect()
    sample.unpersist()
    return cues, _logistic(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["toxic"] for r in rows]))


def _weigh(sample: DataFrame, wanted: list[str], n: dict[int, int]) -> dict[str, float]:
    known = set(wanted)

    def count(batches):
        by = (Counter(), Counter())
        for b in batches:
            for toxic, text in zip(b["toxic"].to_pylist(), b["text"].to_pylist(), strict=True):
                by[toxic].update(_forms(text) & known)
        forms = sorted(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_pydict({"form": pa.array(forms, pa.string()), "c": pa.array([by[0][x] for x in forms], pa.int64()), "t": pa.array([by[1][x] for x in forms], pa.int64())})

    counts = sample.mapInArrow(count, "form string, c long, t long").groupBy("form").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).where(F.col("t") >= LEAST_DOCUMENTS)
    weight = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    found = counts.withColumn("w", weight).where(F.col("w") - ERRORS * error >= LEAST_WEIGHT).orderBy(F.desc("w"), "form")
    rows = {r["form"]: (r["w"], r["t"]) for r in found.collect()}
    longer = lambda head, t: any(x.rstrip("*").startswith(head) and len(x.rstrip("*")) > len(head) and rows[x][1] >= COVERED * t for x in rows)
    return {x: w for x, (w, t) in rows.items() if not (x.endswith("*") and longer(x[:-1], t))}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; classes count alike.  Without both classes: a prior."""
    prior = np.array([-3.0, *(1.5 if k in ("plain_top", "aimed_top") else 0.4 for k in FEATURES)])
    if len(set(y.tolist())) < 2:
        return prior
    x = np.hstack([np.ones((len(x), 1)), x])
    share = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (share * p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (share * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with ``score_col``, a double from 0 to 1: the fitted grammar over the whole text.

    The grammar composes transducers for negation, reported speech, targets and
    threats; insults weigh what ``learn`` finds, and a clause scores by the context in
    which its insults stand.  Labels, language and source are no input of a score.
    Null and empty texts have no clause and get the score of the bias alone.  Null
    and repeated ids are scored row by row.  Without labels of both classes the
    fixed word lists score with prior weights.  A column of ``docs`` named ``score_col`` gives way.
    """
    cues, weights = learn(docs, labels, id_col, text_col)
    scorer = Scorer(cues)

    @F.pandas_udf("double")
    def toxicity(texts):
        x = np.array([scorer(t) for t in texts]).reshape(-1, len(FEATURES))
        return texts.__class__(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))), index=texts.index)

    return docs.withColumn(score_col, toxicity(F.col(text_col).cast("string")))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
