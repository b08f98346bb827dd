"""Token ids of whole texts by a public tokenizer, with the words met so far remembered."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space between two other characters. For both kinds of tokenizer used here no token crosses the place
#: before it, and what lies on either side has no say in how the other is split. A lone line end is alike.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Letters, then other signs: always tokens of their own. Letters here are those Latin-1 has.
WORD = re.compile(r"(\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Stand between new pieces, the first that a tokenizer gives one id: neither joins what is around it.
MARKS = ("\n", " \x01")
#: Remembered pieces and their most characters: bounds the memory of a worker, not what is encoded.
KNOWN, LONGEST = 700_000, 64
#: Bytes a text must have to be cut, code points of its pieces, bytes of short texts taken together.
SLICE, TOGETHER = 1 << 20, 1 << 20
#: Texts taken together at most.
BATCH = 1024
#: A tokenizer that gives other ids for one of these in pieces than as a whole gets all texts as a whole.
PROBES = ("It's 12,5 % of A-b_c (x).\n\n  The end\n line, œuvre; Straße ñandú? «no» #tag x1y2 \t tab", " lead and trail ", "don't stop-gap e.g. U.S.A. $5.00 {a:[1]} 😀 日本語 a\u00a0b", "\n\na\n b \nc", "CAPS Words MiXed 2024-01-01 http://x.y/z?q=1&r=2")


class Encoder:
    """Ids as little-endian unsigned 32-bit integers: those the tokenizer gives for the whole text.

    `known` has the ids of pieces by what follows their space, or by the piece with its line end.
    """

    def __init__(self, path: str, most: int = KNOWN) -> None:
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.line = self._ids("\n").tobytes()
        self.mark, self.mark_id = next(((m, x[0]) for m in MARKS if len(x := self._ids(m)) == 1), ("", None))
        self.lower = self._ids("A").tobytes() == self._ids("a").tobytes()
        self.whole = any(next(self._encode_rows(pa.array([t]), True)) != self._ids(t).tobytes() for t in PROBES)

    def encode(self, text: str) -> bytes:
        return next(self.encode_column(pa.array([text], pa.string())))

    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a column, a null counting as empty. Short texts are encoded together."""
        column = pc.fill_null(column, "")
        if self.whole:
            yield from (self._ids(x.as_py()).tobytes() for x in column)
            return
        sizes = np.asarray(pc.binary_length(column))
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo : lo + BATCH]), TOGETHER, "right")) + lo)
            if sizes[lo] > SLICE:
                yield b"".join(x for part in slices(column[lo].as_py()) for x in self._encode_rows(pa.array([part[1:] if part[:1] == " " else part]), part[:1] != " "))
                hi = lo + 1
            else:
                yield from self._encode_rows(column.slice(lo, hi - lo), True)
            lo = hi

    def _encode_rows(self, rows: pa.Array, whole: bool) -> Iterator[bytes]:
        """Ids of each row; unless `whole`, a row goes on from a text before, a space between."""
        texts = rows
        if self.lower:  # where lower-casing is what the tokenizer does, letter by letter
            texts = pc.if_else(pc.match_substring_regex(texts, r"[^\x00-\x{ff}]"), texts, pc.utf8_lower(texts))
        texts = pc.binary_join_element_wise("\n" if whole else "", pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(texts, " ")
        pieces = lists.values.dictionary_encode()
        found, odd = self._find(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.array([len(x) for x in found], np.int64) // 4
        which = pieces.indices.to_numpy()
        starts, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts - ends + n, n) + np.arange(ends[-1] if ends.size else 0)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()].tolist()
        away = set()
        if odd:
            bad = np.flatnonzero(np.isin(which, odd))
            away = set((np.searchsorted(lists.offsets.to_numpy(), bad, "right") - 1).tolist())
        skip = len(self.line) // 4 if whole else 0
        for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            yield self._long_way(rows[k].as_py(), whole) if k in away else ids[lo + skip : hi].tobytes()

    def _find(self, pieces: list[str]) -> tuple[list[bytes], list[int]]:
        """(ids of each piece, numbers of those that a space could belong to, whose ids do not count)."""
        known = self.known
        ids = list(map(known.get, pieces))
        left = [k for k, y in enumerate(ids) if y is None]
        words: dict[str, None] = {}
        parts: list[tuple[int, str, str]] = []
        other, odd = [], []
        for k in left:
            x = pieces[k]
            if m := WORD.fullmatch(x):
                if m[2]:
                    stem, tail = m[1], "\n" + m[2]
                    parts.append((k, stem, tail))
                    if stem not in known:
                        words[stem] = None
                    if tail not in known:
                        words[tail] = None
                else:
                    words[x] = None
            elif _closed(x):
                other.append(x)
            else:
                odd.append(k)
                ids[k] = b""
        new = dict(zip(words, self._together(list(words)), strict=True))
        new.update((x, self._ids(_form(x)).tobytes()) for x in other)
        skip = len(self.line)
        for k, stem, tail in parts:
            a, b = new.get(stem), new.get(tail)
            ids[k] = (known[stem] if a is None else a) + (known[tail] if b is None else b)[skip:]
        for k in left:
            if ids[k] is None:
                ids[k] = new[pieces[k]]
        if len(known) < self.most:
            known.update((x, y) for x, y in new.items() if len(x) <= LONGEST)
            known.update((pieces[k], ids[k]) for k, _, _ in parts if len(pieces[k]) <= LONGEST)
        return ids, odd

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters and of runs of signs, encoded as one text with marks between."""
        if not words:
            return []
        if self.mark:
            gap = "" if self.line else " "  # a line end is the mark itself, or as good as a space
            ids = self._ids(self.mark.join([gap + x[1:] if x[0] == "\n" else " " + x for x in words]))
            at = np.flatnonzero(ids == self.mark_id)
            if len(at) == len(words) - 1:
                flat, ends, line = ids.tobytes(), [-4, *(4 * at).tolist(), 4 * ids.size], self.line
                return [line + flat[lo + 4 : hi] if x[0] == "\n" else flat[lo + 4 : hi] for x, lo, hi in zip(words, ends, ends[1:], strict=False)]
        return [self._ids(_form(x)).tobytes() for x in words]

    def _long_way(self, text: str, whole: bool) -> bytes:
        """Cuts only where it is safe, whatever the white space."""
        first, *rest = SAFE.split(text)
        out = [self._ids(first if whole else " " + first)]
        out += [np.frombuffer(self.known[x], "<u4") if x in self.known else self._ids(" " + x) for x in rest]
        return np.concatenate(out).astype("<u4").tobytes()


def _form(piece: str) -> str:
    """What a piece stands for in a text."""
    return piece if piece.startswith("\n") else f" {piece}"


def _closed(piece: str) -> bool:
    """Whether a piece, but for a line end before it, has characters and neither begins nor ends with white space."""
    body = piece[1:] if piece.startswith("\n") else piece
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


def slices(text: str) -> Iterator[str]:
    """The text in pieces that end before a safe place, for bounded lists of words."""
    at = 0
    while len(text) - at > SLICE and (m := SAFE.search(text, at + SLICE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@lru_cache(maxsize=2)
def encoder(path: str, most: int = KNOWN) -> Encoder:
    return Encoder(path, most)
