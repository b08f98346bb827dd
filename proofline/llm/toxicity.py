"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep_rows, load, release, ship, unsigned_crc

#: Labelled rows that are learned from: at most so many of each label, whole texts.
TRAIN_ROWS = 1_500
#: Lengths of word beginnings that may become entries of the insult lexicon, besides whole words.
STEMS = range(4, 9)
#: An entry needs so many labelled texts that nothing chosen before explains, and such a share of toxic ones.
MIN_TEXTS, MIN_SHARE, MOST_ENTRIES = 6, 0.8, 400
#: The same for entries whose texts others explain already, the texts as a share of all toxic ones.
MORE_TEXTS, MORE_SHARE = 0.02, 0.97
#: Words that a negation reaches, within which a target belongs to an insult, and that a denial at the clause's end reaches back.
NEGATION_SCOPE, TARGET_SCOPE, DENIAL_SCOPE = 3, 4, 4

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n|]+")
LETTERS = re.compile(r"[^\W\d_]*")

#: Seeds, in English, French, German and Spanish; learned entries come to them.
THREATS = ["kill", "murder", "stab", "strangle", "tuerai", "tuer", "umbringen", "töten", "matar", "mataré"]
TARGETS = ["you", "your", "he", "she", "they", "them", "him", "her", "tu", "toi", "vous", "il", "elle", "du", "dich", "ihr", "er", "sie", "tú", "usted", "ellos"]
NEGATIONS = ["not", "no", "never", "isn", "aren", "pas", "jamais", "nicht", "kein", "keine", "nie", "nunca", "jamás"]
REPORTS = ["said", "says", "wrote", "quoted", "called", "dit", "écrit", "sagte", "schrieb", "dijo", "escribió"]

# Symbols. The lexicon gives o: other, I: insult, T: threat, Y: target, N: negation, R: report.
# The transducers below turn I and T into: i, t: negated; q: reported; J: insult at a target; U: threat at a target.
LEXICAL = "oITYNR"
OUTPUT = "oITYNRitqJU"


@dataclass
class Transducer:
    """Reads a word's symbol, writes one, goes to a state. What is not listed is copied and keeps the state."""

    arcs: dict[tuple[int, str], tuple[int, str]] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def scope(opener: str, width: int, changed: dict[str, str], alphabet: str) -> Transducer:
    """After `opener`, rewrites `changed` in the next `width` words."""
    arcs = {}
    for s in range(width + 1):
        for x in alphabet:
            out = changed.get(x, x) if s else x
            arcs[s, x] = (width if x == opener else max(0, s - 1), out)
    return Transducer(arcs)


def reported(alphabet: str) -> Transducer:
    """After a verb of report, what follows in the clause is another's."""
    arcs = {(0, x): (1 if x == "R" else 0, x) for x in alphabet}
    return Transducer(arcs | {(1, x): (1, "q" if x in "ITit" else x) for x in alphabet})


def compose(*parts: Transducer, alphabet: str = LEXICAL) -> Transducer:
    """One transducer that does what the parts do one after another; its states are those reached from the start."""
    start = (0,) * len(parts)
    number, open_, arcs = {start: 0}, [start], {}
    while open_:
        states = open_.pop()
        for x in alphabet:
            to, y = [], x
            for part, s in zip(parts, states, strict=True):
                s, y = part.step(s, y)
                to.append(s)
            key = tuple(to)
            if key not in number:
                number[key] = len(number)
                open_.append(key)
            arcs[number[states], x] = (number[key], y)
    return Transducer(arcs)


def denied(width: int, changed: dict[str, str], alphabet: str) -> Transducer:
    """Read from the clause's end: a negation that ends it rewrites `changed` in the `width` words before."""
    shut = width + 1
    arcs = {(0, x): (width if x == "N" else shut, x) for x in alphabet} | {(shut, x): (shut, x) for x in alphabet}
    return Transducer(arcs | {(s, x): (s - 1 if s > 1 else shut, changed.get(x, x)) for s in range(1, width + 1) for x in alphabet})


def weighted(t: Transducer, weights: dict[str, float]) -> dict[tuple[int, str], tuple[int, str, float]]:
    """The arcs of a transducer, each with what its output adds to the clause."""
    return {k: (to, y, weights.get(y, 0.0)) for k, (to, y) in t.arcs.items()}


#: Read in the order of the words, and then, what that has written, from the clause's end.
GRAMMAR = compose(
    scope("N", NEGATION_SCOPE, {"I": "i", "T": "t"}, OUTPUT),
    reported(OUTPUT),
    scope("Y", TARGET_SCOPE, {"I": "J", "T": "U"}, OUTPUT),
)
BACKWARD = compose(
    scope("Y", TARGET_SCOPE, {"I": "J", "T": "U"}, OUTPUT),
    denied(DENIAL_SCOPE, {"I": "i", "J": "i", "T": "t", "U": "t"}, OUTPUT),
    alphabet=OUTPUT,
)
#: What a symbol adds to its clause, times the weight of the word's entry: the weights of the last arcs.
WEIGHTS = {"I": 1.0, "J": 1.3, "T": 0.4, "U": 1.5, "i": 0.3, "t": 0.1, "q": 0.4}
ARCS = weighted(BACKWARD, WEIGHTS)
#: Where the reading from the end starts if the clause goes on.
OPEN_END = BACKWARD.step(0, "o")[0]


class Model:
    """Lexicon (entry -> weight; an entry that ends in * is a beginning), and a logistic curve over clause scores."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.coefficients, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self._tables()

    def _tables(self) -> None:
        self.symbols = {w: ("T", 1.0) for w in THREATS} | {w: ("Y", 0.0) for w in TARGETS} | {w: ("N", 0.0) for w in NEGATIONS} | {w: ("R", 0.0) for w in REPORTS}
        self.symbols |= {k: ("I", v) for k, v in self.lexicon.items() if k[-1] != "*"}
        self.stems = {k[:-1]: v for k, v in self.lexicon.items() if k[-1] == "*"}
        self.lengths = sorted({len(k) for k in self.stems})
        self.finder = ahocorasick.Automaton()
        for w in [*THREATS, *(k.rstrip("*") for k in self.lexicon)]:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def __getstate__(self) -> tuple:
        return self.lexicon, self.coefficients, self.scale

    def __setstate__(self, state: tuple) -> None:
        self.lexicon, self.coefficients, self.scale = state
        self._tables()

    def read(self, word: str) -> tuple[str, float]:
        got = self.symbols.get(word)
        if not got or got[0] != "I":
            for n in self.lengths:
                if (v := self.stems.get(word[:n])) is not None and len(word) >= n:
                    return "I", v
        return got or ("o", 0.0)

    def clauses(self, text: str) -> list[tuple[int, int, float, str]]:
        """(start, end, score, output symbols) of each clause of the lower-cased text that has an insult or threat.

        What lies over REACH characters after the last entry of a clause is beyond any scope and is not read; the
        grammar's state goes on to the next entry there.
        """
        low, out, done, state, k = text.lower(), [], 0, 0, 0
        hits = [(end + 1 - n, end + 1) for end, n in self.finder.iter(low) if end + 1 == n or not low[end - n].isalpha()]
        while k < len(hits):
            if hits[k][0] < done:
                k += 1
                continue
            start = done
            for m in CLAUSE.finditer(low, done, hits[k][0]):
                start, state = m.end(), 0
            while True:
                limit = LETTERS.match(low, min(len(low), hits[k][1] + REACH)).end()
                close = CLAUSE.search(low, hits[k][1], limit)
                stop = close.start() if close else limit
                k += 1
                if close or k == len(hits) or hits[k][0] >= stop:
                    break
            score, symbols, state = self.score_clause(low[start:stop], state, bool(close) or stop == len(low))
            if score:
                out.append((start, stop, score, symbols))
            done = stop
        return out

    def score_clause(self, clause: str, state: int = 0, ended: bool = True) -> tuple[float, str, int]:
        """(score, output symbols, state after it) of a clause; `ended` tells whether its last word is the clause's last."""
        written, values = [], []
        for m in WORD.finditer(clause):
            symbol, value = self.read(m[0])
            state, out = GRAMMAR.step(state, symbol)
            written.append(out)
            values.append(value)
        if not any(map(WEIGHTS.__contains__, written)):
            return 0.0, "".join(written), state
        total, back = 0.0, 0 if ended else OPEN_END
        for at in range(len(written) - 1, -1, -1):
            back, written[at], weight = ARCS[back, written[at]]
            total += weight * values[at]
        return total, "".join(written), state

    def features(self, scores: list[float]) -> np.ndarray:
        return np.array([1.0, max(scores, default=0.0), math.log1p(sum(scores)), float(bool(scores))])

    def score_text(self, text: str) -> float:
        return round(self.score_of([c[2] for c in self.clauses(text)]), 9)

    def score_of(self, scores: list[float]) -> float:
        z = float(self.coefficients @ (self.features(scores) / self.scale))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


FEATURES = 4
#: Characters after an entry within which what may bear on it is read, on to the end of a word; a scope is a few words.
REACH = 2_000


def learn_lexicon(texts: list[str], toxic: list[int]) -> dict[str, float]:
    """Entries chosen greedily: ever the word or beginning that most toxic texts not yet explained have.

    Then come those that are as good as sure and common. Near-copies count once, so that a much copied text
    brings none of its own words in. The weight is the log odds of the entry's texts.
    """
    use = _originals(texts)
    texts, toxic = [texts[k] for k in use], [toxic[k] for k in use]
    has = [_entries(t) for t, y in zip(texts, toxic, strict=True) if y]
    pos = Counter(x for s in has for x in s)
    pos = Counter({x: n for x, n in pos.items() if n >= MIN_TEXTS})
    neg: Counter = Counter()
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            neg.update(x for x in _entries(t) if x in pos)
    base = max(1, sum(toxic)) / max(1, len(toxic) - sum(toxic))
    share = {x: (n / base) / (n / base + neg[x] + 0.5) for x, n in pos.items()}
    good = {x for x in pos if share[x] >= MIN_SHARE}
    has = [s & good for s in has]
    where: dict[str, set[int]] = {}
    for k, s in enumerate(has):
        for x in s:
            where.setdefault(x, set()).add(k)
    out: dict[str, float] = {}
    left = set(range(len(has)))
    counts = {x: len(w) for x, w in where.items()}
    while counts and len(out) < MOST_ENTRIES:
        best = max(counts, key=lambda x: (counts[x] * share[x] ** 4, share[x], len(x), x))
        if counts[best] < MIN_TEXTS:
            break
        best = _tighter(best, pos, good)
        out[best] = min(5.0, math.log(1 + pos[best] / base / (neg[best] + 0.5)))
        gone = where[best] & left
        left -= gone
        for k in gone:
            for x in has[k]:
                if x in counts:
                    counts[x] -= 1
                    if counts[x] < MIN_TEXTS:
                        del counts[x]
    for x in sorted(good, key=lambda x: (-pos[x], -len(x), x)):
        if len(out) >= MOST_ENTRIES or pos[x] < max(2 * MIN_TEXTS, MORE_TEXTS * len(has)):
            break
        if share[x] < MORE_SHARE:
            continue
        kin = any(x.startswith(y[:-1]) if y[-1] == "*" else x == y for y in out) or any(y.startswith(x.rstrip("*")) for y in out)
        x = _tighter(x, pos, good)
        if x not in out and not kin:
            out[x] = min(5.0, math.log(1 + pos[x] / base / (neg[x] + 0.5)))
    return out


def _tighter(entry: str, pos: Counter, good: set[str]) -> str:
    """The longest entry that begins as this one and has nearly as many toxic texts."""
    near = [x for x in good if x.startswith(entry.rstrip("*")) and pos[x] >= 0.9 * pos[entry] and (entry[-1] == "*" or x == entry)]
    return max(near, key=lambda x: (len(x.rstrip("*")), x[-1] == "*", x), default=entry)


def _originals(texts: list[str], keep: int = 8) -> list[int]:
    """Numbers of the texts that are no near-copies of earlier ones: of the smallest hashes of five-word shingles, under three are known."""
    seen: set[int] = set()
    out = []
    for k, text in enumerate(texts):
        w = text.lower().split()
        own = sorted({xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))})[:keep]
        if sum(x in seen for x in own) < min(3, len(own)):
            out.append(k)
        seen.update(own)
    return out


def _entries(text: str) -> set[str]:
    words = {m for m in WORD.findall(text.lower()) if len(m) >= 4}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def fit(texts: list[str], toxic: list[int], prior: float | None = None) -> Model:
    """Lexicon, then the curve by Newton steps on ridge-penalised likelihood; `prior` is the share of toxic rows that scores are to reflect."""
    model = Model(learn_lexicon(texts, toxic) if texts else {})
    y = np.array(toxic, float)
    share = float(y.mean()) if y.size else 0.0
    prior = share if prior is None else prior
    x = np.array([model.features([c[2] for c in model.clauses(t)]) for t in texts]).reshape(-1, FEATURES)
    model.scale = np.maximum(1.0, np.abs(x).max(0)) if len(x) else np.ones(FEATURES)
    x = x / model.scale
    weight = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    beta, ridge = np.zeros(FEATURES), np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(30 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
    if not len(x):
        beta[0] = -30.0
    model.coefficients = beta
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled documents whose crc32(id) mod 5 is not 0, at most `rows` of each label, chosen by hash of the id.

    Rows without label (other than 0 or 1) or text are left out. With none at all every score is 0.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (unsigned_crc(F.col("id")) % 5 != 0))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chance = (F.xxhash64("id").bitwiseAND(F.lit((1 << 30) - 1)) / (1 << 30)).cast("double")
    take = F.element_at(F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, 1.5 * rows / max(1, counts.get(k, 1)))]), F.col("toxic"))
    some = known.withColumn("chance", chance).where(F.col("chance") < take)
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    joined = text.join(F.broadcast(some), F.col("__id") == F.col("id")).where("text is not null")  # 3 x rows, about
    w = Window.partitionBy("toxic").orderBy("chance", "id", F.xxhash64("text"))
    got = joined.withColumn("k", F.row_number().over(w)).where(F.col("k") <= rows).orderBy("chance", "id").select("text", "toxic").toPandas()
    total = sum(counts.values())
    model = fit(got["text"].tolist(), got["toxic"].astype(int).tolist(), counts.get(1, 0) / total if total else None)
    release(collect=True)
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, predicted int, n_clauses int) of each row.

    A null text is an empty one, which scores as a text without any matched clause. A very long text, or clause, is
    read whole. There are no ties to break. Equal rows each get a row, a null id stays. An empty table gives no rows;
    further columns, whatever their names, go.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MOST_ENTRIES entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            scores, clauses = [], []
            for t in b.column(1):
                found = own.clauses(t.as_py() or "")
                clauses.append(len(found))
                scores.append(round(own.score_of([c[2] for c in found]), 9))
            s = np.array(scores, float)
            cols = [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(np.array(clauses, np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "score", "predicted", "n_clauses"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int, n_clauses int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    out = toxicity(docs, learn(docs, labels))
    return out.select(F.col("id").alias("doc_id"), (unsigned_crc(F.col("id")) % 5 == 0).alias("held_out"), "score", "predicted", "n_clauses")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic.

    Null and empty texts stay. Repeated rows and null ids are rows like any other. An empty table stays empty, and
    without labels all stay. Columns other than doc_id and text stay as they are, whatever their names.
    """
    ship(spark)
    sent = spark.sparkContext.broadcast(learn(docs, load(spark, sf_dir, "labels")))
    return keep_rows(docs, "text", lambda texts: [sent.value.score_text(t or "") < 0.5 for t in texts])
