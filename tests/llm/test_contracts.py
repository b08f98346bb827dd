"""Every opN_ query itself, over whole small tables, against plain versions of what its result must be."""

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from proofline.llm import registry
from test_mixing import plain_targets
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def documents():
    return {r[0]: r[1:] for r in table("documents", "doc_id, text, lang, source")}


def run(spark, name, types):
    df = registry.QUERIES[name](spark, SF)
    have = dict(df.dtypes)
    assert {c: have.get(c) for c in types} == types
    return df.collect()


def crc(x):
    return zlib.crc32(str(x).encode())


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_op1(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op1_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})}

    def fingerprint(text):
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum((sum((h >> b) & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64)) if hashes else 0

    prints = {d: fingerprint(t) for d, (t, *_) in documents.items()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{x:016x}" for d, x in prints.items()}
    root = {d: d for d in prints}
    changed = True
    while changed:  # the smallest id spreads along the links
        changed = False
        for a, x in prints.items():
            for b, y in prints.items():
                if root[b] < root[a] and (x ^ y).bit_count() <= 3:
                    root[a], changed = root[b], True
    assert {d: r.component_id for d, r in got.items()} == root and len(set(root.values())) < len(root)


def test_op2(spark):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for more in ("", "UNION ALL SELECT -9, NULL, 'user', 'x' UNION ALL SELECT -9, 1, 'user', '###' UNION ALL SELECT -9, 1, 'user', 'A' UNION ALL SELECT -9, 1, 'user', '\\</turn> \\\\###'"):
        c.execute(f"CREATE OR REPLACE TABLE given AS SELECT conv_id, turn, role, text FROM conversations {more}")
        want = c.execute(registry.ORACLES["op2_chat"].replace("FROM conversations", "FROM given"))
        names = [d[0] for d in want.description]
        want = {r[names.index("conv_id")]: dict(zip(names, r, strict=True)) for r in want.fetchall()}
        if more:
            from proofline.llm.chat import format_chat, read_chat

            rows = spark.createDataFrame(c.execute("SELECT * FROM given").fetchall(), "conv_id long, turn long, role string, text string")
            got = {r.conv: r.asDict() | {"conv_id": r.conv} for r in read_chat(format_chat(rows)).collect()}
            del want[-7]
        else:
            got = {r.conv_id: r.asDict() for r in run(spark, "op2_chat", {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"})}
        assert {k: {n: r[n] for n in names} for k, r in got.items()} == want


def test_op3(spark):
    got = run(spark, "op3_neighbours", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    rows = [(i, np.array(v, float)) for i, v in table("embeddings", "vec_id, embedding") if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    want = {a: [i for _, i in sorted((-float((v * x).sum()), i) for i, v in rows if i != a)[:20]] for a, x in rows if a % 20 == 0}
    vectors, found = dict(rows), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r)
        assert r.score == float((vectors[r.vec_id] * vectors[r.query_id]).sum()) and r.vec_id != r.query_id
    assert set(found) == set(want) and all([r.rank for r in x] == list(range(1, len(want[a]) + 1)) for a, x in found.items())
    assert all(sorted(x, key=lambda r: (-r.score, r.vec_id)) == x for x in found.values())
    assert sum(len({r.vec_id for r in found[a]} & set(x)) for a, x in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_op4(spark):
    got = {r.page_id: r for r in run(spark, "op4_main_text", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"})}
    pages = {i: (u, h) for i, u, h in table("pages", "page_id, url, html")}
    assert set(got) == set(pages)
    for i, r in got.items():
        assert r.url == pages[i][0] and r.n_chars == len(r.text)
        assert not re.search(r"<script|</|\s{2}|^\s|\s$|[^\S \n]", r.text)
    assert sum(bool(r.text) for r in got.values()) >= 0.9 * len(got)


def test_op5(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op5_digests", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"})}
    order = sorted(documents, reverse=True)
    texts, by_text = {d: documents[d][0] or "" for d in order}, {}
    for k, d in enumerate(order):
        after, r, n = texts[order[(k + 1) % len(order)]], got[d], len(texts[d])
        edited = texts[d][: n - n // 2] + after[: n // 2]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(texts[d], r.fingerprint) == r.fingerprint
        if edited == texts[d]:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1
        if after == texts[d]:
            assert r.near_next == 1
    long = [d for d in order if len(texts[d]) > 500]
    assert np.mean([got[d].near_edited for d in long]) > 0.3 + np.mean([got[d].near_next for d in long])


def test_op6(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op6_mixing", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})}
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, (t, _, s) in documents.items():
        assert got[d].size == len(WORDS.findall(t or "")) and 0 <= got[d].taken <= 2 * got[d].size
        sizes[s] += got[d].size
        taken[s] += got[d].taken
    want = plain_targets(sizes)
    assert set(got) == set(documents)
    for d, (_, _, s) in documents.items():
        assert got[d].source_size == sizes[s] and abs(got[d].target - want[s]) <= 1e-9 * max(1, want[s])
    assert all(abs(taken[s] - x) <= 0.5 + 1e-6 for s, x in want.items())
    again = {r.doc_id: r for r in registry.QUERIES["op6_mixing"](spark, SF).collect()}
    assert again == got


def test_op7(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op7_languages", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})}
    known = {lang for d, (t, lang, _) in documents.items() if lang and t is not None and crc(d) % 4 != 2}
    assert set(got) == set(documents)
    for d, (t, _, _) in documents.items():
        r = got[d]
        assert r.held_out == (crc(d) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred == "und" if not any(c.isalpha() for c in t or "") else r.lang_pred in known
    held = [d for d, (t, lang, _) in documents.items() if got[d].held_out and t and lang]
    assert sum(got[d].lang_pred == documents[d][1] for d in held) >= 0.95 * len(held) > 20


def test_op8(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op8_packed_ids", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})}
    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for d in sorted(documents):
        ids = ids_of(tokenizer, documents[d][0], 2)
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, ids.size, zlib.crc32(ids.tobytes()))
        at += ids.size
    assert set(got) == set(documents)


def test_op9(spark, documents):
    got = run(spark, "op9_packing", {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"})
    tokenizer, pieces, sequences, total = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list), defaultdict(list), 0
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(documents)
    for d, (t, *_) in documents.items():
        ids, at = ids_of(tokenizer, t, 1), 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, ids.size, zlib.crc32(ids[at : at + r.length].tobytes())) and r.length > 0
            at += r.length
        assert at == ids.size
        total += at
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) * 2048 <= 1.1 * total + 2 * 2048


def test_op10(spark):
    """On sf0.1, where some 350 toxic rows are there to learn from; judged by held-out rows of both labels."""
    sf = SF.replace("sf0.001", "sf0.1")
    got = {r.doc_id: r for r in registry.QUERIES["op10_toxicity"](spark, sf).select("doc_id", "held_out", "score", "predicted").collect()}
    assert len(got) == duckdb.sql(f"SELECT count(DISTINCT doc_id) FROM '{sf}/documents.parquet'").fetchone()[0]
    for d, r in got.items():
        assert r.held_out == (crc(d) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = {d: y for d, y in duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet' WHERE toxic IS NOT NULL").fetchall() if d in got and got[d].held_out}
    right = sum(got[d].predicted == 1 for d, y in held.items() if y)
    assert right >= 0.7 * sum(held.values()) > 10 and right >= 0.7 * sum(got[d].predicted for d in held)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_resampling"])
def test_queries_with_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, SF)
    kinds = {"lang": "string", "source": "string", "part": "string", "item": "string", "rank": "int" if name == "op11_divergence" else "bigint"}
    assert dict(got.dtypes) == {n: kinds.get(n, "bigint") for n in names}
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_op13(spark, documents):
    from test_personal import plain_base

    types = {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}
    got = {r.doc_id: r for r in run(spark, "op13_personal", types)}
    assert set(got) == set(documents)
    for d, (t, *_) in documents.items():
        base = plain_base(t or "")
        said = [":".join(map(str, x)) for x in base]
        r = got[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in base) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(filter(None, r.spans.split(",")))
