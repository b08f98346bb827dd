"""Personal data in texts: spans by fixed patterns, and those that a semi-Markov conditional random field adds."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, release, ship, small

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most: bounds the dynamic programme, which is linear in the text.
MOST_TOKENS = 24
#: Different stretches of text that are learned from at most, and the characters of the longest.
TRAIN_ROWS, TRAIN_CHARS = 2_000, 200
EPOCHS, RATE, RIDGE = 5, 0.5, 1e-3
#: Weights are held by hash of the feature.
BUCKETS = 1 << 14
#: Chance that a segment must have, all segmentations considered, to be added.
MIN_CHANCE = 0.8
SPANS = "array<struct<kind:string,start:int,end:int>>"

# --- spans by patterns; each is linear in the text --------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*+")
CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A domain is looked for at each @, the name before it by walking back: no text is walked twice."""
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def small_numbers(parts: Iterable[str]) -> bool:
    return all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") <= 255 for x in parts)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """A number without three more behind it is passed over whole, as no match can begin within it."""
    for m in DOTTED.finditer(text):
        if len(parts := m[0].split(".")) == 4 and small_numbers(parts):
            yield m.span()


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[::-2]) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        if 13 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in CALL.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; kinds may overlap, spans of a kind do not."""
    numbers = re.search("[0-9]", text) is not None
    found = [("email", emails, "@" in text), ("ip", addresses, numbers), ("card", cards, numbers), ("phone", phones, numbers and "+" in text)]
    return [(kind, *span) for kind, f, there in found if there for span in f(text)]


# --- stretches of text that can hold a segment -------------------------------------------------------------------------

NUMERIC = re.compile(r"[+(]{0,2}[0-9]++(?:[ ().+/-]{1,3}[0-9]++)*")
AT = re.compile(r"@|[\[({] ?at ?[\])}]")
BEFORE, AFTER = re.compile(r"[\w.%+-]+ ?\Z"), re.compile(r" ?[\w-]+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[\w-]+)*")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
#: Characters about an @ that can be a segment's, far over MOST_TOKENS tokens of usual length.
REACH = 256


def stretches(text: str) -> list[tuple[int, int]]:
    """Where segments can lie, joined where they meet. All else is outside of any segment, whatever the weights."""
    found = [m.span() for m in NUMERIC.finditer(text) if m.end() - m.start() >= 7]
    if "@" in text or "at" in text:
        for m in AT.finditer(text):
            before, after = BEFORE.search(text[max(0, m.start() - REACH) : m.start()]), AFTER.match(text[m.end() : m.end() + REACH])
            if before and after:
                found.append((m.start() - len(before[0]), m.end() + after.end()))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def sort_of(c: str) -> str:
    return "9" if "0" <= c <= "9" else "a" if c.isalpha() else c if c else "^"


class Stretch:
    """Tokens of a stretch and the segments that can be in it, each with the features of the whole of it."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.tokens = [(start + m.start(), start + m.end()) for m in TOKEN.finditer(text[start:end])]
        self.left = "".join(sort_of(c) for c in text[max(0, start - 2) : start]) or "^"
        word = re.search(r"([^\W\d_]{1,12})\W{0,3}\Z", text[max(0, start - 16) : start])
        self.word = word[1].lower() if word else ""
        self.outside = [[feature(f"out:{sort_of(text[a])}{min(b - a, 20)}")] for a, b in self.tokens]
        self.segments = [(i, j, kind, feats) for i, j in self._bounds(text) for kind, feats in self._kinds(text, i, j)]

    def _bounds(self, text: str) -> Iterator[tuple[int, int]]:
        """First token and the one after the last: from a letter, digit, plus or bracket to a letter or digit."""
        first = [i for i, (a, _) in enumerate(self.tokens) if text[a].isalnum() or text[a] in "+("]
        for i in first:
            for j in range(i + 1, min(i + MOST_TOKENS, len(self.tokens)) + 1):
                if text[self.tokens[j - 1][1] - 1].isalnum():
                    yield i, j

    def _kinds(self, text: str, i: int, j: int) -> Iterator[tuple[int, list[int]]]:
        a, b = self.tokens[i][0], self.tokens[j - 1][1]
        own = text[a:b]
        before, after = text[a - 1 : a] if a else "", text[b : b + 1]
        near = [f"left:{sort_of(before)}", f"right:{sort_of(after)}", f"right2:{''.join(map(sort_of, text[b : b + 2]))}"]
        if i == 0:
            near += [f"left2:{self.left}", f"word:{self.word}"]
        signs = AT.findall(own)
        if signs:
            if len(signs) == 1 and text[a].isalnum():
                name, domain = own.split(signs[0])
                ends = re.split(r" ?(?:\.|[\[({] ?dot ?[\])}]) ?", domain.strip())
                said = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "9", own.replace("dot", ".").replace(signs[0], "@")))
                yield 0, [feature(f"email:{x}") for x in (*near, "", f"sign:{signs[0][0]}", f"labels:{min(len(ends), 5)}", f"end:{len(ends[-1])}{ends[-1].isalpha()}", f"gaps:{name.strip().count(' ') + domain.strip().count(' ') > 2}", f"said:{said[:24]}")]
            return
        if any(c.isalpha() for c in own) or not any(c.isdigit() for c in own):
            return
        groups = re.findall("[0-9]+", own)
        digits = "".join(groups)
        seps = "".join(sorted(set(re.sub("[0-9]", "", own))))
        shape = re.sub("[0-9]+", lambda m: str(min(len(m[0]), 20)), own)
        shared = [*near, "", f"digits:{min(len(digits), 24)}", f"groups:{min(len(groups), 9)}", f"seps:{seps}", f"shape:{shape[:32]}", f"whole:{i == 0 and j == len(self.tokens)}", f"opens:{own[0] in '+('}{own.count('(') == own.count(')')}"]
        if len(groups) == 4 and seps == ".":
            yield 1, [feature(f"ip:{x}") for x in (*shared, f"octets:{small_numbers(groups)}")]
        if 12 <= len(digits) <= 19:
            yield 2, [feature(f"card:{x}") for x in (*shared, f"luhn:{luhn(digits)}")]
        if 7 <= len(digits) <= 15:
            yield 3, [feature(f"phone:{x}") for x in shared]

    def signature(self) -> tuple:
        return tuple((i, j, k, *f) for i, j, k, f in self.segments), tuple(f[0] for f in self.outside)


def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


# --- the field -----------------------------------------------------------------------------------------------------------

OUTSIDE = len(KINDS)


def log_add(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


class Field:
    """Weights of features of whole segments, of single outside tokens, and of a label following another."""

    def __init__(self) -> None:
        self.weights = np.zeros(BUCKETS)
        self.follows = np.zeros((OUTSIDE + 1, OUTSIDE + 1))

    def _arcs(self, s: Stretch) -> list[list[tuple[int, int, float, list[int]]]]:
        """By token after the end: (start, label, score, features) of what can end there."""
        w = self.weights
        arcs: list[list] = [[] for _ in range(len(s.tokens) + 1)]
        for t, feats in enumerate(s.outside):
            arcs[t + 1].append((t, OUTSIDE, float(w[feats].sum()), feats))
        for i, j, kind, feats in s.segments:
            arcs[j].append((i, kind, float(w[feats].sum()), feats))
        return arcs

    def best(self, s: Stretch) -> list[tuple[int, int, int]]:
        """(first token, token after the last, kind) of the segments of the likeliest segmentation; ties leave tokens outside."""
        n, follows = len(s.tokens), self.follows.tolist()
        score = [[-math.inf] * (OUTSIDE + 1) for _ in range(n + 1)]
        back: list[list] = [[None] * (OUTSIDE + 1) for _ in range(n + 1)]
        score[0][OUTSIDE] = 0.0
        for t, arcs in enumerate(self._arcs(s)):
            for start, label, value, _ in arcs:
                for last in range(OUTSIDE, -1, -1):
                    v = score[start][last] + follows[last][label] + value
                    if v > score[t][label]:
                        score[t][label], back[t][label] = v, (start, last)
        label = max(range(OUTSIDE, -1, -1), key=lambda k: score[n][k])
        t, out = n, []
        while t:
            start, last = back[t][label]
            if label != OUTSIDE:
                out.append((start, t, label))
            t, label = start, last
        return out[::-1]

    def chances(self, s: Stretch) -> tuple[float, list[tuple[int, int, int, float, list[int]]], np.ndarray]:
        """Log of the sum over all segmentations; (start, end, label, chance, features) of all arcs; chances of labels that follow another."""
        n, follows, arcs = len(s.tokens), self.follows.tolist(), self._arcs(s)
        labels = range(OUTSIDE + 1)
        ahead = [[-math.inf] * (OUTSIDE + 1) for _ in range(n + 1)]
        ahead[0][OUTSIDE] = 0.0
        entry = {}
        for t in range(1, n + 1):
            ways: list[list[float]] = [[] for _ in labels]
            for k, (start, label, value, _) in enumerate(arcs[t]):
                entry[t, k] = log_add([ahead[start][last] + follows[last][label] for last in labels])
                ways[label].append(entry[t, k] + value)
            ahead[t] = [log_add(w) if w else -math.inf for w in ways]
        total = log_add(ahead[n])
        behind = [[-math.inf] * (OUTSIDE + 1) for _ in range(n + 1)]
        behind[n] = [0.0] * (OUTSIDE + 1)
        leaving: list[list] = [[] for _ in range(n + 1)]
        for t in range(n, 0, -1):
            if t < n:
                behind[t] = [log_add([follows[last][label] + v for label, v in leaving[t]]) if leaving[t] else -math.inf for last in labels]
            for start, label, value, _ in arcs[t]:
                leaving[start].append((label, value + behind[t][label]))
        out, pairs = [], np.zeros((OUTSIDE + 1, OUTSIDE + 1))
        for t in range(1, n + 1):
            for k, (start, label, value, feats) in enumerate(arcs[t]):
                rest = value + behind[t][label] - total
                out.append((start, t, label, math.exp(entry[t, k] + rest), feats))
                for last in labels:
                    if ahead[start][last] > -math.inf:
                        pairs[last, label] += math.exp(ahead[start][last] + follows[last][label] + rest)
        return total, out, pairs

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Segments of the best segmentation that meet no span of `base` and have MIN_CHANCE."""
        out: list[tuple[str, int, int]] = []
        taken = sorted((a, b) for _, a, b in base)
        at = 0
        for start, end in stretches(text):
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            held = [x for x in itertools.takewhile(lambda x: x[0] < end, itertools.islice(taken, at, None)) if x[1] > start]
            if (start, end) in held:
                continue
            s = Stretch(text, start, end)
            new = [(s.tokens[i][0], s.tokens[j - 1][1], kind, i, j) for i, j, kind in self.best(s)] if s.segments else []
            new = [x for x in new if not any(a < x[1] and x[0] < b for a, b in held)]
            if new:
                sure = {(i, j, k): p for i, j, k, p, _ in self.chances(s)[1]}
                out += [(KINDS[kind], a, b) for a, b, kind, i, j in new if sure[i, j, kind] >= MIN_CHANCE]
        return out


def fit(examples: list[tuple[Stretch, set[tuple[int, int, int]]]]) -> Field:
    """Likelihood with a ridge, by gradients scaled by their history; equal stretches are learned from once."""
    field = Field()
    distinct = {}
    for s, gold in examples:
        distinct.setdefault((s.signature(), tuple(sorted(gold))), (s, gold))
    rows = list(distinct.values())
    past, past_follows = np.full(BUCKETS, 1e-6), np.full(field.follows.shape, 1e-6)
    rng = random.Random(7)
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for s, gold in rows:
            step, follow = {}, np.zeros(field.follows.shape)
            inside = {t for i, j, _ in gold for t in range(i, j)}
            order = sorted([(i, j, k) for i, j, k in gold] + [(t, t + 1, OUTSIDE) for t in range(len(s.tokens)) if t not in inside])
            for last, label in itertools.pairwise([OUTSIDE, *[k for _, _, k in order]]):
                follow[last, label] += 1
            chosen = set(order)
            _, arcs, pairs = field.chances(s)
            for i, j, k, p, feats in arcs:
                for f in feats:
                    step[f] = step.get(f, 0.0) + ((i, j, k) in chosen) - p
            at = np.fromiter(step, int, len(step))
            grad = np.fromiter(step.values(), float, len(step)) - RIDGE * field.weights[at]
            past[at] += grad**2
            field.weights[at] += RATE * grad / np.sqrt(past[at])
            follow -= pairs + RIDGE * field.follows
            past_follows += follow**2
            field.follows += RATE * follow / np.sqrt(past_follows)
    return field


# --- examples: what the patterns find in the corpus, its variants, and numbers that are none of these ---------------------


def variants(kind: str, said: str, rng: random.Random) -> list[str]:
    """Other ways to write the same thing, most of which the patterns do not know."""
    d = digits_of(said)
    if kind == "email":
        name, domain = said.rsplit("@", 1)
        o, c = rng.choice(["()", "[]", "{}"])
        host = rng.choice([domain, domain.replace(".", f" {o}dot{c} "), domain.replace(".", f"{o}dot{c}")])
        return [f"{name}{rng.choice(['', ' '])}{o}{rng.choice(['at', ' at '])}{c}{rng.choice(['', ' '])}{host}", f"{name} {o}at{c} {domain.replace('.', f' {o}dot{c} ')}"]
    if kind == "card":
        sep = rng.choice([" ", "-", "."])
        return [sep.join(d[k : k + 4] for k in range(0, len(d), 4)), d]
    if kind == "phone" and len(d) == 11:
        a, b, c = d[1:4], d[4:7], d[7:]
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", rng.choice([f"{a}.{b}.{c}", f"({a}){b}-{c}", f"+{d[0]}-{a}-{b}-{c}", f"+{d}", f"00{d[0]} {a} {b} {c}"])]
    return []


def other_numbers(rng: random.Random) -> str:
    """A number that is no personal data: a date, a time, an amount, a version, a book, a range, an order."""
    n = rng.randrange
    return rng.choice([
        lambda: f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", lambda: f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", lambda: f"{n(1, 13):02}/{n(1, 29):02}/{n(1900, 2100)}", lambda: f"{n(1900, 2100)}-{n(1900, 2100)}",
        lambda: f"{n(1900, 2100)}{n(1, 13):02}{n(1, 29):02}", lambda: f"{n(1, 999)}.{n(1000):03}.{n(1000):03}", lambda: f"{n(1, 20)}.{n(30)}.{n(500)}", lambda: f"{n(256, 3000)}.{n(300, 999)}.{n(999)}.{n(999)}",
        lambda: f"97{n(8, 10)}-{n(10)}-{n(10, 99)}-{n(10**5, 10**6)}-{n(10)}", lambda: f"{n(10**6, 10**12)}", lambda: f"{n(1000)} {n(1000):03} {n(1000):03}", lambda: f"{n(10)}.{n(10**6, 10**9)}",
        lambda: f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02} {n(24):02}", lambda: " ".join(str(n(100)) for _ in range(n(5, 12))), lambda: f"{n(10**12, 10**13)}", lambda: unlucky(rng),
    ])()


def other_signs(rng: random.Random) -> str:
    """An @ that is in no address: a mention, a price, a host without domain, a word in brackets."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    return rng.choice([f"{word()} @{word()}", f"{rng.randrange(100)} @ {rng.randrange(100)}", f"{word()}@{word()}", f"{word()} (at) {word()}", f"{word()} [at] {word()} {word()}", f"{word()} @ {word()}"])


def unlucky(rng: random.Random) -> str:
    """Digits as many as a card's that fail its check."""
    d = str(rng.randrange(10**15, 10**16))
    return d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)


def labelled(before: str, parts: list[tuple[str | None, str]], after: str) -> list[tuple[Stretch, set[tuple[int, int, int]]]]:
    """Stretches of a text made of parts (kind or None, text), with their segments in tokens. Those with a segment that tokens do not bound are left out."""
    text, spans = before, []
    for kind, said in parts:
        if kind:
            spans.append((len(text), len(text) + len(said), KINDS.index(kind)))
        text += said
    out = []
    text += after
    for start, end in stretches(text):
        s = Stretch(text, start, end)
        first, last = {a: i for i, (a, _) in enumerate(s.tokens)}, {b: i + 1 for i, (_, b) in enumerate(s.tokens)}
        own = [x for x in spans if x[0] < end and start < x[1]]
        gold = {(first.get(a), last.get(b), k) for a, b, k in own}
        if gold <= {(i, j, k) for i, j, k, _ in s.segments}:
            out.append((s, gold))
    return out


def examples(found: list[tuple[str, str, str]], seed: int = 3) -> list[tuple[Stretch, set[tuple[int, int, int]]]]:
    """From (before, stretch, after) of the corpus: as they are where patterns agree, other ways to write them, pairs of them, other numbers and signs."""
    rng = random.Random(seed)
    out, known = [], []
    for before, said, after in found:
        whole = before + said + after
        spans = sorted((a, b, k) for k, a, b in base_spans(whole))
        inside = [(a, b, k) for a, b, k in spans if a >= len(before) and b <= len(before) + len(said)]
        apart = all(x[1] <= y[0] for x, y in itertools.pairwise(spans))
        longest = max((len(digits_of(m[0])) for m in itertools.chain(DIGITS.finditer(said), CALL.finditer(said))), default=0)
        if not apart or longest > 19 or len(inside) < len(spans):
            continue  # a pattern has failed on more than one thing at a time, which tells nothing of either
        parts, at = [], len(before)
        for a, b, k in inside:
            parts += [(None, whole[at:a]), (k, whole[a:b])]
            at = b
        out += labelled(before, [*parts, (None, whole[at : len(before) + len(said)])], after)
        known += [(before, k, whole[a:b], after) for a, b, k in inside]
    for before, kind, said, after in known:
        for other in variants(kind, said, rng):
            out += labelled(before, [(kind, other)], after)
    for (before, k, said, after), (_, k2, said2, _) in zip(known, rng.sample(known, len(known)), strict=True):
        joint = rng.choice([" ", " ", ", ", " / ", "\n"])
        second = rng.choice([said2, *variants(k2, said2, rng)])
        out += labelled(before, [(k, said), (None, joint), (k2, second)], after)
        out += labelled(before, [(None, other_numbers(rng))], after)
        out += labelled(before, [(None, other_signs(rng))], after)
        out += labelled(before, [(k, said), (None, joint + other_numbers(rng))], after)
    return out


def learn(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS) -> Field:
    """A field from different stretches of the corpus, at most `rows`, chosen by hash; without any, one that adds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            cut = [(t[max(0, s - 24) : s], t[s:e], t[e : e + 8]) for t in b.column(0).to_pylist() for s, e in stretches(t) if e - s <= TRAIN_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*cut, strict=True)] if cut else [pa.array([], pa.string())] * 3, ["before", "said", "after"])

    ship(docs.sparkSession)
    given = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    shown = given.mapInArrow(run, "before string, said string, after string").groupBy("said").agg(F.min(F.struct("before", "after")).alias("about"))
    some = shown.orderBy(F.xxhash64("said"), "said").limit(rows).select("about.before", "said", "about.after").collect()
    field = fit(examples([tuple(r) for r in some]))
    release(collect=True)
    return field


# --- the operator --------------------------------------------------------------------------------------------------------


def find_personal(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of each row: arrays of (kind, start, end) in code points, by kind as in KINDS, then start.

    base has what the patterns find, spans those and what the field adds where no pattern has found anything.

    A null text is an empty one. A very long text is read whole: patterns and stretches are linear, and a segment has
    MOST_TOKENS tokens at most. There are no ties: spans of a kind do not overlap. Equal rows each get a row, null
    ids stay, an empty table gives no rows. Further columns, whatever their names, are not read.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS weights
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def arrays(rows: list[list[tuple]]) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in r] for r in rows], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            base, spans = [], []
            for text in b.column(1).to_pylist():
                base.append(base_spans(text))
                new = sent.value.added(text, base[-1])
                spans.append(sorted([*base[-1], *new], key=lambda x: (KINDS.index(x[0]), x[1])))
            yield pa.RecordBatch.from_arrays([b.column(0), arrays(base), arrays(spans)], ["id", "base", "spans"])

    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, base {SPANS}, spans {SPANS}")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = find_personal(docs, learn(docs))
    many = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("id").alias("doc_id"), *map(many, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
