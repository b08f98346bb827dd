"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, release, ship, small, unsigned_crc
from .letters import MULT, Words, mixed, ngrams

#: Weights are held by hash of the feature.
BUCKETS = 1 << 17
#: Words of a piece of a text. Pieces are worked on side by side; what they hand on to one another makes a text one chain.
CHAIN = 64
#: Labelled rows that are learned from: at most so many a language, whole texts.
TRAIN_ROWS = 400
EPOCHS, RATE, MINI = 3, 0.3, 40
#: Largest weight of a transition either way, so that a switch stays possible when each text learned from has one language.
MOST_TRANSITION = 2.0
#: Words of the lexicon at most for each language, and the share of their texts that must be in it.
LEXICON_WORDS, LEXICON_SHARE = 400, 0.9
#: Words scored at a time, whatever the length of the text.
SLICE = 1 << 15
#: Languages that may be learned: bounds the model (BUCKETS x languages x 4 bytes); more are an error.
MOST_LANGUAGES = 256
UNKNOWN = "und"
#: Mean chance of the likeliest language under which the pipeline rejects a text.
MIN_SHARE = 0.3


class Lexicon:
    """Words that tell a language, by hash: the most frequent ones of each language that hardly any other has."""

    def __init__(self, hashes: np.ndarray | None = None, labels: np.ndarray | None = None) -> None:
        self.hashes = np.zeros(0, np.uint64) if hashes is None else hashes
        self.labels = np.zeros(0, np.int64) if labels is None else labels

    @classmethod
    def learn(cls, texts: list[str], gold: list[int], labels: int) -> Lexicon:
        """Counts texts, not occurrences, so that one text brings in nothing by repeating it."""
        once = [np.unique(word_hashes(w, 0, len(w))) if len(w) else np.zeros(0, np.uint64) for w in map(Words, texts)]
        if not sum(x.size for x in once):
            return cls()
        label = np.repeat(np.array(gold, np.int64), [x.size for x in once])
        hashes, at = np.unique(np.concatenate(once), return_inverse=True)
        n = np.bincount(at * labels + label, minlength=hashes.size * labels).reshape(-1, labels)
        share = np.bincount(gold, minlength=labels) / max(1, len(gold))
        rate = n / np.maximum(share, 1e-9)
        best = rate.argmax(1)
        good = np.flatnonzero((n[np.arange(best.size), best] > 1) & (rate.max(1) >= LEXICON_SHARE * rate.sum(1)))
        own, many = best[good], n[good, best[good]]
        order = np.lexsort((hashes[good], -many, own))
        place = np.arange(order.size) - np.searchsorted(own[order], own[order])  # of each word among its language's
        take = np.sort(good[order[place < LEXICON_WORDS]])
        return cls(hashes[take], best[take])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the language whose word each is, from 1; 0 for a word that is not in the lexicon."""
        if not self.hashes.size:
            return np.zeros(hashes.size, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.hashes.size - 1)
        return np.where(self.hashes[at] == hashes, self.labels[at] + 1, 0)


def word_hashes(words: Words, lo: int, hi: int) -> np.ndarray:
    a, b = words.starts[lo] - 1, words.ends[hi - 1] + 1
    chars, starts, n = words.chars[a:b], words.starts[lo:hi] - a, words.ends[lo:hi] - words.starts[lo:hi]
    inside = np.arange(chars.size - 1) - np.repeat(starts - 1, n + 1)
    powers = mixed(np.arange(int(n.max()) + 2).astype(np.uint64) + np.uint64(77)) | np.uint64(1)
    return mixed(np.add.reduceat((chars[:-1] + np.uint64(1)) * powers[inside], starts - 1))


def features(words: Words, lo: int, hi: int, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word): the features of words lo..hi-1, and where each word's begin among them.

    Letters and threes of letters with the word's edges; prefixes and suffixes of three; the word itself; the
    language whose lexicon has it.
    """
    a, b = words.starts[lo] - 1, words.ends[hi - 1] + 1
    chars, starts, ends = words.chars[a:b], words.starts[lo:hi] - a, words.ends[lo:hi] - a
    one, three = ngrams(chars, 1), ngrams(chars, 3)
    n = ends - starts
    word = word_hashes(words, lo, hi)
    first = np.cumsum(2 * n + 4) - (2 * n + 4)
    out = np.empty(int((2 * n + 4).sum()), np.uint64)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, spot = np.repeat(first, n) + place, np.repeat(starts, n) + place
    out[at] = one[spot]
    out[at + np.repeat(n, n)] = three[spot - 1]
    for k, base in enumerate((starts - 1, ends - 3)):
        h = np.full(n.size, 5 + k, np.uint64)
        for d in range(4):
            i = base + d
            h = (h + np.where((i >= starts - 1) & (i <= ends), chars[np.minimum(i, chars.size - 1)], 0) + np.uint64(1)) * MULT
        out[first + 2 * n + k] = mixed(h)
    out[first + 2 * n + 2] = word
    out[first + 2 * n + 3] = mixed(lexicon.find(word).astype(np.uint64) + np.uint64(12_345))
    return (out >> np.uint64(47)).astype(np.int32), first


class Model:
    """Weights by (feature, language), transitions by (language before, language), the lexicon, and the languages in order."""

    def __init__(self, languages: list[str], lexicon: Lexicon | None = None) -> None:
        self.languages, self.lexicon = languages, lexicon or Lexicon()
        self.weights = np.zeros((BUCKETS, len(languages)), np.float32)
        self.transitions = np.zeros((len(languages), len(languages)))

    def emissions(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[buckets], first, axis=0).astype(np.float64)

    def scores(self, words: Words, lo: int, hi: int) -> np.ndarray:
        return self.emissions(*features(words, lo, hi, self.lexicon))

    def marginals(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(chances by word and language, number of each word's text), SLICE words at a time: by forward-backward over each whole text."""
        lowered = [t.lower() for t in texts]
        words = Words("\n".join(lowered))
        own = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), words.text_starts, "right")
        if not len(words):
            return
        if len(words) <= SLICE:
            yield chain_marginals(self.scores(words, 0, len(words)), self.transitions, np.bincount(own, minlength=len(texts)))[0], own
            return
        counts, step = np.bincount(own, minlength=len(texts)), SLICE // CHAIN * CHAIN
        if len(texts) > 1:
            raise ValueError("a text of more than SLICE words comes alone")
        hand = [handed(self.scores(words, lo, min(len(words), lo + step)), self.transitions, np.array([min(len(words), lo + step) - lo])) for lo in range(0, len(words), step)]
        into, back = boundaries(np.concatenate(hand), self.transitions, -(-counts // CHAIN))
        for k, lo in enumerate(range(0, len(words), step)):
            hi = min(len(words), lo + step)
            at = slice(k * (step // CHAIN), k * (step // CHAIN) + -(-(hi - lo) // CHAIN))
            yield chain_marginals(self.scores(words, lo, hi), self.transitions, np.array([hi - lo]), ends=(into[at], back[at]))[0], own[lo:hi]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, mean chance of it over the words, words) of each text; of equal chances the first language in order."""
        if not self.languages:
            return [(UNKNOWN, 0.0, len(Words(t or ""))) for t in texts]
        out: list[tuple[str, float, int]] = []
        for some in _groups([t or "" for t in texts]):
            n, sums = np.zeros(len(some), np.int64), np.zeros((len(some), len(self.languages)))
            for chances, own in self.marginals(some):
                n += np.bincount(own, minlength=len(some))
                sums += np.stack([np.bincount(own, chances[:, c], len(some)) for c in range(len(self.languages))], axis=1)
            mean = sums / np.maximum(1, n)[:, None]
            for row, k in zip(mean, n.tolist(), strict=True):
                best = int(row.argmax())
                out.append((self.languages[best], round(min(1.0, float(row[best])), 6), k) if k else (UNKNOWN, 0.0, k))
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of each word in the lower-cased text: what a code-switched text is made of."""
        words, chances = Words(text), np.concatenate([np.zeros((0, len(self.languages))), *(p for p, _ in self.marginals([text]))])
        return [(int(a), int(b), self.languages[k]) for a, b, k in zip(words.text_starts, words.text_ends, chances.argmax(1), strict=True)]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of 2 x SLICE characters at most once they are lower-cased, so of SLICE words; a longer one by itself."""
    some: list[str] = []
    n = 0
    for t in texts:
        size = 1 + (len(t) if t.isascii() else len(t.lower()))  # some letters become two
        if some and n + size > 2 * SLICE:
            yield some
            some, n = [], 0
        some.append(t)
        n += size
    if some:
        yield some


def _pieces(scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(factors by piece, place and label; which places have a word; pieces of each text): words are dealt to pieces of CHAIN."""
    n, m = scores.shape
    rows = -(-counts // CHAIN)
    base = (np.cumsum(rows) - rows) * CHAIN
    spot = np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(n)
    total = int(rows.sum())
    e, real = np.ones((total * CHAIN, m)), np.zeros(total * CHAIN, bool)
    e[spot] = np.exp(scores - scores.max(1, keepdims=True))
    real[spot] = True
    width = min(CHAIN, int(counts.max()))
    return e.reshape(total, CHAIN, m)[:, :width], real.reshape(total, CHAIN)[:, :width], rows


def handed(scores: np.ndarray, transitions: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What each piece hands on: by label at its first and label at its last word, the sum over what lies between, scaled."""
    e, real, _ = _pieces(scores, counts)
    return _handed(e, real, np.exp(transitions))


def _handed(e: np.ndarray, real: np.ndarray, t: np.ndarray) -> np.ndarray:
    m = e.shape[2]
    q = e[:, 0, :, None] * np.eye(m)
    for k in range(1, e.shape[1]):
        x = (q.reshape(-1, m) @ t).reshape(q.shape) * e[:, k, None, :]
        q = np.where(real[:, k, None, None], x / x.sum((1, 2), keepdims=True), q)
    return q


def boundaries(hand: np.ndarray, transitions: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what comes to each piece's first word from before, what comes to its last word from after), scaled; `rows` pieces a text."""
    t, m = np.exp(transitions), transitions.shape[0]
    into, back = np.ones((hand.shape[0], m)), np.ones((hand.shape[0], m))
    first = np.cumsum(rows) - rows
    for j in range(1, int(rows.max(initial=0))):
        at = first[rows > j] + j
        x = (into[at - 1, None, :] @ hand[at - 1])[:, 0] @ t
        into[at] = x / x.sum(1, keepdims=True)
        at = (first + rows)[rows > j] - j
        x = (hand[at] @ back[at, :, None])[:, :, 0] @ t.T
        back[at - 1] = x / x.sum(1, keepdims=True)
    return into, back


def chain_marginals(scores: np.ndarray, transitions: np.ndarray, counts: np.ndarray, gold: np.ndarray | None = None, ends: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(chances by word and label, transitions that gold has beyond those expected), by scaled forward-backward over whole texts.

    `counts` has the words of each text, gold each text's label. Texts are worked on in pieces: first what each hands
    on, then along the pieces what comes to either end of each (given as `ends` if more lies before or after), then
    all pieces at once.
    """
    e, real, rows = _pieces(scores, counts)
    m, t = scores.shape[1], np.exp(transitions)
    into, last = ends or (boundaries(_handed(e, real, t), transitions, rows) if rows.max() > 1 else (np.ones((e.shape[0], m)),) * 2)
    ahead, back = np.empty_like(e), np.empty_like(e)
    x = into * e[:, 0]
    ahead[:, 0] = x / x.sum(1, keepdims=True)
    for k in range(1, e.shape[1]):
        x = (ahead[:, k - 1] @ t) * e[:, k]
        ahead[:, k] = x / x.sum(1, keepdims=True)
    back[:, -1] = last
    for k in range(e.shape[1] - 2, -1, -1):  # what fills the last piece says nothing of its words
        x = (e[:, k + 1] * back[:, k + 1]) @ t.T
        back[:, k] = np.where(real[:, k + 1, None], x / x.sum(1, keepdims=True), last)
    p = ahead * back
    p /= p.sum(2, keepdims=True)
    pairs = np.zeros((m, m))
    if gold is not None:
        xi = ahead[:, :-1, :, None] * t * (e[:, 1:] * back[:, 1:])[:, :, None, :]
        xi /= xi.sum((2, 3), keepdims=True)
        pairs = -(xi * real[:, 1:, None, None]).sum((0, 1))
        np.add.at(pairs, (np.repeat(gold, rows), np.repeat(gold, rows)), real[:, 1:].sum(1))
        over = np.flatnonzero(np.arange(e.shape[0]) > np.repeat(np.cumsum(rows) - rows, rows))  # pieces with one before
        if over.size:
            xi = ahead[over - 1, -1, :, None] * t * (e[over, 0] * back[over, 0])[:, None, :]
            pairs -= (xi / xi.sum((1, 2), keepdims=True)).sum(0)
            own = np.repeat(gold, rows)[over]
            np.add.at(pairs, (own, own), 1)
    return p[real], pairs


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS) -> Model:
    """Conditional maximum likelihood by adaptive gradient steps; every word of a text has the text's language."""
    languages = sorted(set(langs))
    gold = [languages.index(x) for x in langs]
    model = Model(languages, Lexicon.learn(texts, gold, len(languages)))
    order = np.random.default_rng(3).permutation(len(texts))
    seen, seen_t = np.full_like(model.weights, 1e-3), np.full_like(model.transitions, 1.0)
    for _ in range(epochs):
        for lo in range(0, order.size, MINI):
            some = order[lo : lo + MINI].tolist()
            grad_at, grad, grad_t, total = [], [], np.zeros_like(model.transitions), 0
            lowered = [texts[k].lower() for k in some]
            words, label = Words("\n".join(lowered)), np.array([gold[k] for k in some])
            own = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), words.text_starts, "right")
            for a in range(0, len(words), SLICE):  # a text longer than that is learned from in parts
                b = min(len(words), a + SLICE)
                buckets, first = features(words, a, b, model.lexicon)
                p, pairs = chain_marginals(model.emissions(buckets, first), model.transitions, np.bincount(own[a:b], minlength=len(some)), label)
                delta = -p
                delta[np.arange(b - a), label[own[a:b]]] += 1
                grad_at.append(buckets)
                grad.append(np.repeat(delta, np.diff(np.append(first, buckets.size)), axis=0).astype(np.float32))
                grad_t += pairs
                total += b - a
            if not total:
                continue
            at, g = np.concatenate(grad_at), np.concatenate(grad)
            step = np.stack([np.bincount(at, g[:, c], BUCKETS) for c in range(g.shape[1])], axis=1).astype(np.float32) / np.float32(total**0.5)
            seen += step * step
            model.weights += np.float32(RATE) * step / np.sqrt(seen)
            grad_t /= total**0.5
            seen_t += grad_t * grad_t
            model.transitions = np.clip(model.transitions + RATE * grad_t / np.sqrt(seen_t), -MOST_TRANSITION, MOST_TRANSITION)
    return model


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """A model from documents whose crc32(id) mod 4 is not 2, at most `rows` of each language, chosen by hash of the id.

    Rows without text or language are left out; with none at all every text is `und`.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where((F.coalesce(unsigned_crc(F.col("id")), F.lit(0)) % 4 != 2) & F.col("lang").isNotNull())
    known = known.where(F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    chance = (F.xxhash64(F.col("id")).bitwiseAND(F.lit((1 << 30) - 1)) / (1 << 30)).cast("double")
    take = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, 2.0 * rows / n)]), F.col("lang")) if counts else F.lit(0.0)
    some = known.withColumn("chance", chance).where(F.col("chance") < take)  # before any shuffle: 2 x rows a language, about
    w = Window.partitionBy("lang").orderBy("chance", "id", F.xxhash64("text"))
    got = some.withColumn("k", F.row_number().over(w)).where(F.col("k") <= rows).orderBy("lang", "k").select("text", "lang").toPandas()
    model = fit(got["text"].tolist(), got["lang"].tolist())
    release(collect=True)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred string, score double, n_words long) of each row.

    A null or empty text, one without letters, or any text if nothing was learned, is `und` with score 0. Of equal
    chances the first language in order counts. A very long text is one chain like any other, read SLICE words at a
    time. Equal rows each get a row, a null id stays. An empty table gives no rows; further columns, whatever their
    names, go.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages x 4 bytes, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = sent.value.predict(b.column(1).to_pylist())
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "lang_pred", "score", "n_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, n_words long")


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = identify(docs, learn(docs))
    return out.select(F.col("id").alias("doc_id"), (unsigned_crc(F.col("id")) % 4 == 2).alias("held_out"), "lang_pred", "score", "n_words")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that can be told; a null `lang` becomes the language predicted.

    Rejected are texts without a letter and those of which no language has MIN_SHARE of the words' chances. Null and
    empty texts go; repeated rows and null ids are rows like any other; an empty table stays empty. Other columns
    stay as they are, whatever their names.
    """
    ship(spark)
    sent = spark.sparkContext.broadcast(learn(docs))
    names, schema = docs.columns, docs.schema
    at, to = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = sent.value.predict(b.column(at).to_pylist())
            columns = b.columns
            columns[to] = pc.coalesce(columns[to], pa.array([x[0] for x in out], columns[to].type))
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([x[0] != UNKNOWN and x[1] >= MIN_SHARE for x in out], pa.bool_()))

    return docs.mapInArrow(run, schema)
