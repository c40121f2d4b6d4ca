"""Subword ids by a public vocabulary, with the words of a corpus encoded once each."""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pandas as pd
import tiktoken

from setaudit.llm import textcore as tc

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_CACHED = 400_000  # words held at once; the cache starts anew beyond that, which changes no result

_IRREGULAR = re.compile(r" (?=\s|$)")
_SPLIT = re.compile(r" (?=\S)")
_LONG = 64  # characters of a piece that is cut further where the pattern always cuts: from text to white space, and after CJK punctuation
_FINE = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])|(?<=[，。！？；：、])(?=[^\W_])")


class Encoder:
    """Ids of texts as little-endian uint16 bytes.

    The pattern that cuts a text for byte-pair encoding always cuts before a space that a non-space follows, so
    texts are cut there, and long pieces at other places where it always cuts; each piece is encoded on its own, from a cache
    where possible.
    """

    def __init__(self, folder: str = TOKENIZERS):
        with open(os.path.join(folder, VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.bytes_of = np.zeros(self.size, np.int64)
        self.bytes_of[list(ranks.values())] = list(map(len, ranks))
        self.encoding = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def ids(self, piece: str) -> bytes:
        got = self.cache.get(piece)
        if got is None:
            if len(self.cache) >= MOST_CACHED:
                self.cache.clear()
            got = np.array(self.encoding.encode_ordinary(piece), "<u2").tobytes()
            if len(piece) < 40:
                self.cache[piece] = got
        return got

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut before every space that a non-space follows, long pieces further; joined they are the text again."""
        if not text:
            return []
        parts = text.split(" ") if _IRREGULAR.search(text) is None else _SPLIT.split(text)
        pieces = ([parts[0]] if parts[0] else []) + [" " + p for p in parts[1:]]
        if len(max(pieces, key=len)) <= _LONG:
            return pieces
        return [x for p in pieces for x in ((p,) if len(p) <= _LONG else filter(None, _FINE.split(p)))]

    def encode(self, text: str) -> bytes:
        cache, missing = self.cache, self.ids
        pieces = self.pieces(text)
        return b"".join([cache.get(p) or missing(p) for p in pieces])


_JOINS = np.zeros(256, bool)  # bytes that white space can begin with: a space before one of them may not be a place to cut
_JOINS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True


_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[33:127] = True


class BatchEncoder:
    """Ids of all texts of a batch at once: spans of bytes are hashed together, and each distinct one is encoded once.

    Texts are cut before spaces that a byte follows which can't begin white space, where the pattern always cuts.
    Spans are told apart by 64 bits of hash next to their length. When as many as MOST_CACHED are held, those not met since the last such time go.
    """

    def __init__(self, enc: Encoder):
        self.enc, self.known, self.older = enc, {}, {}

    def _keep(self, key: int, ids: bytes) -> None:
        if len(self.known) >= MOST_CACHED:
            self.known, self.older = {}, self.known
        self.known[key] = ids

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(uint16 ids of the documents one after the other, ids of each) of UTF-8 documents within raw."""
        ids, counts = [], []
        for i, j in tc.slices(offsets, 1 << 20):
            got, n = self._slice(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(got)
            counts.append(n)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, "<u2"), np.zeros(0, np.int64))

    def _slice(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(buf)
        if not n:
            return np.zeros(0, "<u2"), np.zeros(len(off) - 1, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[: n - 1] = (buf[:-1] == 32) & ~_JOINS[buf[1:]]
        cut[off] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        keys = tc.span_hashes(buf, starts, ends)
        inverse, distinct = pd.factorize(keys)
        pieces = list(map(self.known.get, distinct.tolist()))
        new = [k for k, got in enumerate(pieces) if got is None]
        if new and self.older:
            older = list(map(self.older.get, distinct[new].tolist()))
            for k, key, got in zip(new, distinct[new].tolist(), older):
                if got is not None:
                    pieces[k] = got
                    self._keep(key, got)
            new = [k for k, got in zip(new, older) if got is None]
        if new:
            first = np.empty(len(distinct), np.int64)
            first[inverse[::-1]] = np.arange(len(keys) - 1, -1, -1)
            a, b = starts[first[new]], ends[first[new]]
            for k, key, size, got in zip(new, distinct[new].tolist(), (b - a).tolist(), self._encoded(buf, a, b)):
                pieces[k] = got
                if size < 48:
                    self._keep(key, got)
        flat = np.frombuffer(b"".join(pieces), "<u2")
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 2
        begin = (np.cumsum(size) - size)[inverse]
        size = size[inverse]
        before = np.cumsum(size) - size
        total = int(size.sum())
        out = flat[np.repeat(begin - before, size) + np.arange(total)]
        cum = np.concatenate([before, [total]])
        return out, np.diff(cum[np.searchsorted(starts, off, "left")])


    def _encoded(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of spans. Those that begin and end with ASCII text are encoded as lines of one text: the pattern cuts on both sides of such a line feed."""
        raw, encode = buf.tobytes(), self.enc.encoding.encode_ordinary
        texts = [raw[x:y] for x, y in zip(starts.tolist(), ends.tolist())]
        begin = np.where(buf[starts] == 32, buf[np.minimum(starts + 1, ends - 1)], buf[starts])
        lines = _GRAPHIC[begin] & _GRAPHIC[buf[ends - 1]]
        out = [b"" if line else np.array(encode(t.decode()), "<u2").tobytes() for line, t in zip(lines.tolist(), texts)]
        whole = np.flatnonzero(lines)
        if len(whole):
            ids = np.array(encode(b"\n".join([texts[k] for k in whole]).decode()), "<u2")
            size = (ends - starts)[whole]
            last = np.searchsorted(np.cumsum(self.enc.bytes_of[ids]), np.cumsum(size + 1) - 1)  # each line's last id; its line feed is the next
            flat, at = ids.tobytes(), (2 * last + 2).tolist()
            for k, x, y in zip(whole.tolist(), [0, *(z + 2 for z in at)], at):
                out[k] = flat[x:y]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(folder: str = TOKENIZERS) -> Encoder:
    """The process's encoder of this folder."""
    if folder not in _ENCODERS:
        _ENCODERS[folder] = Encoder(folder)
    return _ENCODERS[folder]


_BATCH_ENCODERS: dict[str, BatchEncoder] = {}


def batch_encoder(folder: str = TOKENIZERS) -> BatchEncoder:
    """The process's batch encoder of this folder, so that one task's words are known to the next."""
    if folder not in _BATCH_ENCODERS:
        _BATCH_ENCODERS[folder] = BatchEncoder(encoder(folder))
    return _BATCH_ENCODERS[folder]
