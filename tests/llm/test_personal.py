import itertools
import math
import random
import re

import pytest
from proofline.llm import personal as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            odd, even = d[::-1][0::2], d[::-1][1::2]
            sums = sum(map(int, odd)) + sum(int(x) * 2 // 10 + int(x) * 2 % 10 for x in even)
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and sums % 10 == 0 or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    parts = ["a", "é", "@", ".", "-", " ", "+", "(", ")", "4", "25", "255", "256", "0007", "4539578763621486", "b.c", "@b.c", "x@y.z", "1.2.3.4", "+1 (555) 555-1234", "%", "_", "\n", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert P.base_spans(text) == plain_base(text), text


def test_patterns_are_linear_in_the_text():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "@" * 300_000, "a@" * 150_000, "1 " * 150_000, "+1 " * 100_000):
        P.base_spans(text)


def random_field(seed):
    rng = P.np.random.default_rng(seed)
    field = P.Field()
    field.weights = rng.normal(size=P.BUCKETS)
    field.follows = rng.normal(size=field.follows.shape)
    return field


def segmentations(s, at=0):
    """Every way to cut a stretch from a token on into segments and outside tokens."""
    if at == len(s.tokens):
        yield []
        return
    for rest in segmentations(s, at + 1):
        yield [(at, at + 1, P.OUTSIDE, s.outside[at]), *rest]
    for i, j, k, feats in s.segments:
        if i == at:
            for rest in segmentations(s, j):
                yield [(i, j, k, feats), *rest]


@pytest.mark.parametrize("text", ["1.2.3.4", "+1 (555) 555", "5555555 7777777", "ab@c.de", "a (at) b.c"])
def test_the_programme_against_all_segmentations(text):
    for seed in range(3):
        field, s = random_field(seed), P.Stretch(text, 0, len(text))
        assert s.segments

        def score(way):
            labels = [P.OUTSIDE, *[k for _, _, k, _ in way]]
            return sum(field.weights[f].sum() for *_, f in way) + sum(field.follows[a, b] for a, b in itertools.pairwise(labels))

        ways = list(segmentations(s))
        scores = [score(w) for w in ways]
        total, arcs, pairs = field.chances(s)
        assert abs(total - math.log(sum(map(math.exp, scores)))) < 1e-9
        for i, j, k, p, _ in arcs:
            want = sum(math.exp(x - total) for x, w in zip(scores, ways, strict=True) if (i, j, k) in [y[:3] for y in w])
            assert abs(p - want) < 1e-9
        assert abs(pairs.sum() - sum(p for *_, p, _ in arcs)) < 1e-9
        best = ways[max(range(len(ways)), key=scores.__getitem__)]
        assert field.best(s) == [x[:3] for x in best if x[2] != P.OUTSIDE]


def card(rng):
    body = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(body + str(k) for k in range(10) if P.luhn(body + str(k)))


def said(kind, rng):
    n = rng.randrange
    return {"email": lambda: f"{rng.choice(['joe', 'ann.lee', 'x'])}{n(100)}@mail{n(9)}.example.com", "ip": lambda: ".".join(str(n(256)) for _ in range(4)), "card": lambda: card(rng), "phone": lambda: f"+1 ({n(1000):03}) 555-{n(10000):04}"}[kind]()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    filler = ["the", "over", "of", "and", "mail", "in", "ship", "4.0", "1999", "token", "at", "x = 3;"]
    words = lambda: " ".join(rng.choice(filler) for _ in range(rng.randrange(3, 12)))
    return [f"{words()} {said(rng.choice(P.KINDS), rng)}{rng.choice(['', '.', ','])} {words()} {rng.choice(['', P.unlucky(rng), said(rng.choice(P.KINDS), rng)])} {words()}" for _ in range(300)]


@pytest.fixture(scope="module")
def field(corpus):
    found = {t[s:e]: (t[max(0, s - 24) : s], t[s:e], t[e : e + 8]) for t in corpus for s, e in P.stretches(t)}
    return P.fit(P.examples(list(found.values())))


def test_held_out(field):
    rng = random.Random(77)
    right = wrong = missed = 0
    for _ in range(400):
        kind = rng.choice(P.KINDS)
        this = said(kind, rng)
        other = rng.choice(P.variants(kind, this, rng) or [this])
        text = f"so we said {other} and went {P.other_numbers(rng)} on"
        spans = {(k, a, b) for k, a, b in [*P.base_spans(text), *field.added(text, P.base_spans(text))]}
        want = {(kind, 11, 11 + len(other))}
        right, wrong, missed = right + len(spans & want), wrong + len(spans - want), missed + len(want - spans)
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.95


def test_what_the_patterns_run_together_is_told_apart(field):
    rng = random.Random(5)
    for _ in range(40):
        parts = [said("phone", rng), said("ip", rng)] if rng.random() < 0.5 else [card(rng), card(rng)]
        text = f"then {parts[0]} {parts[1]} end"
        base = P.base_spans(text)
        spans = {text[a:b] for _, a, b in [*base, *field.added(text, base)]}
        assert spans == set(parts)


def test_clean_texts_are_left_alone(field):
    rng = random.Random(12)
    for _ in range(300):
        text = f"on {P.other_numbers(rng)} or {P.other_numbers(rng)}; at 4.0, see (at) once {P.unlucky(rng)} or {P.other_signs(rng)}."
        added = field.added(text, P.base_spans(text))
        assert all(k == "card" and P.luhn(P.digits_of(text[a:b])) for k, a, b in added)  # a number may pass for a card by chance


def test_rows(spark, corpus, field):
    texts = [*corpus[:40], None, "", "no data", "é" * 5 + " joe (at) mail.example (dot) com", "1 2 " * 20_000 + corpus[0], corpus[0], corpus[0]]
    rows = [*enumerate(texts), (None, corpus[1])]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, spans string, base int")
    got = P.find_personal(df, field).collect()
    assert sorted(r.id for r in got if r.id is not None) == list(range(len(texts))) and len(got) == len(rows)
    known = dict(rows)
    for r in got:
        text = known[r.id] or ""
        base = plain_base(text)
        assert [tuple(x) for x in r.base] == base
        spans = sorted([*base, *field.added(text, base)], key=lambda x: (P.KINDS.index(x[0]), x[1]))
        assert [tuple(x) for x in r.spans] == spans
        for k, a, b in set(spans) - set(base):
            assert all(b <= c or d <= a for _, c, d in base)
    assert P.find_personal(df.limit(0), field).count() == 0
    own = P.learn(df)
    assert [tuple(x) for x in P.find_personal(df, own).where("id = 0").first().base] == plain_base(texts[0])
    assert not P.learn(df.limit(0)).weights.any()
    assert P.Field().added("joe (at) b.c, 555-555-1234", []) == []
