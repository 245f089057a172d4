"""Exact tokenisation of whole texts at a few times the library's own speed.

A byte-level BPE never merges across its pre-tokeniser's cuts. So a text is cut, by numpy over its UTF-8 bytes, at places
where the pre-tokeniser is sure to cut, and each distinct piece is given to the library once; a text's ids are its pieces' ids,
one after the other. Fewer cuts than the pre-tokeniser's are never wrong, only slower. Sure places are

- before a space or new line that follows anything but white space,
- after a new line that has anything but white space on both sides,
- between letters, digits and signs other than the apostrophe, and from letters or digits to an apostrophe.

Letters are ASCII's and those of two bytes led by C3 to C9. Characters that might be white space or combine (other bytes) take
part in no cut but before white space. Tokenizers of another make encode whole texts, and so does any text that holds the string of an
added token: the library cuts that out before the pre-tokeniser, as ``add_special_tokens=False`` only concerns what a template adds.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What is kept between segments: pieces, ids and bytes of pieces; beyond, the table starts anew. It bounds memory, not what is encoded.
KEPT_PIECES, KEPT_IDS, KEPT_BYTES = 1_000_000, 8_000_000, 48_000_000
#: Bytes of texts that are cut at once, unless one text alone has more.
SEGMENT = 8 << 20
_OTHER, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _SOLID, _SPACE, _LINE, _INNER = range(9)
#: A piece that keeps its ids between new lines: no white space, or one space before it.
_PLAIN = re.compile(rb" ?[!-~\x80-\xbf\xc3-\xe0\xe4-\xf4]+")
_loaded: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _kinds() -> np.ndarray:
    """The kind of each byte."""
    kind = np.full(256, _OTHER, np.uint8)
    for b in range(0x21, 0x7F):
        c = chr(b)
        kind[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _APOSTROPHE if c == "'" else _SIGN
    kind[0x20], kind[0x0A] = _SPACE, _LINE
    kind[0x80:0xC0] = _INNER
    kind[0xC3:0xCA] = _LETTER
    # white space beyond ASCII is led by C2, E1, E2 or E3 only
    kind[0xCA:0xE1] = kind[0xE4:0xF5] = _SOLID
    return kind


def _sure() -> np.ndarray:
    """Whether there is a cut between two kinds, at first * 9 + second."""
    cut = np.zeros((9, 9), bool)
    cut[_LETTER : _SOLID + 1, _SPACE : _LINE + 1] = True
    for a in (_LETTER, _DIGIT, _SIGN):
        for b in (_LETTER, _DIGIT, _SIGN):
            cut[a, b] = a != b
    cut[[_LETTER, _DIGIT], _APOSTROPHE] = True
    return cut.ravel()


_KIND, _SURE = _kinds(), _sure()


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a piece starts at a byte, inside one text."""
    kind = _KIND[data]
    if (data > 0x7F).any():
        for _ in range(3):  # a character has up to three bytes after its first
            inner = np.flatnonzero(kind == _INNER)
            if not len(inner):
                break
            kind[inner] = kind[np.maximum(inner - 1, 0)]
        signs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # the signs of multiplication and division
        kind[signs] = kind[signs + 1] = _OTHER
    out = np.zeros(len(data), bool)
    out[1:] = _SURE[kind[:-1] * np.uint8(9) + kind[1:]]
    line = np.flatnonzero(kind[1:-1] == _LINE) + 1
    a, b = kind[line - 1], kind[line + 1]
    out[line[(a >= _LETTER) & (a <= _SOLID) & (b >= _LETTER) & (b <= _SOLID)] + 1] = True
    return out


class Table:
    """Pieces' ids, end to end, with room to grow."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.starts, self.lens, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.bytes = 0

    def add(self, keys: list[bytes], ids: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(keys) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        k = slice(self.n, self.n + len(keys))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[k] = self.used + np.cumsum(lens) - lens
        self.lens[k] = lens
        self.at.update(zip(keys, range(self.n, self.n + len(keys)), strict=True))
        self.bytes += sum(map(len, keys))
        self.used, self.n = self.used + len(ids), k.stop

    def get(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these entries, one after the other, and where each ends."""
        lens = self.lens[idx]
        ends = np.cumsum(lens)
        return self.flat[np.repeat(self.starts[idx] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

    def full(self) -> bool:
        return self.n > KEPT_PIECES or self.used > KEPT_IDS or self.bytes > KEPT_BYTES


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.vocab = self.t.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.t.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.by_pieces = (
            spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex"))
            and not pre.get("add_prefix_space") and not spec["normalizer"] and all(a["special"] for a in spec["added_tokens"])
        )
        self.added = [a["content"].encode() for a in spec["added_tokens"]]
        line = self._whole(["\n"])[0]
        self.line = int(line[0]) if len(line) == 1 else None
        self.pieces = Table()

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())), lens

    def _library(self, pieces: list[bytes]) -> None:
        """Enters new pieces: plain ones many to a text, a new line between them, the others one by one."""
        plain = [p for p in pieces if _PLAIN.fullmatch(p)] if self.line is not None else []
        for lo in range(0, len(plain), 4000):
            some = plain[lo : lo + 4000]
            ids, _ = self._whole([b"\n".join(some).decode()])
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            if len(ends) != len(some):
                raise ValueError("pieces don't keep their ids between new lines")
            self.pieces.add(some, ids[ids != self.line], np.diff(ends, prepend=-1) - 1)
        rest = [p for p in pieces if p not in self.pieces.at]
        for lo in range(0, len(rest), 4000):
            some = rest[lo : lo + 4000]
            self.pieces.add(some, *self._whole([p.decode() for p in some]))

    def _segment(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per text, of texts that stand end to end in ``data``."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        if self.pieces.full():
            self.pieces = Table()
        start = cuts(data)
        start[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(start)
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        keys = coded.dictionary.to_pylist()
        at = self.pieces.at
        entry = np.fromiter(map(at.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(entry < 0)
        if len(new):
            absent = [keys[i] for i in new.tolist()]
            self._library(absent)
            entry[new] = np.fromiter(map(at.__getitem__, absent), np.int64, len(absent))
        ids, ends = self.pieces.get(entry[coded.indices.to_numpy()])
        return ids, np.diff(np.concatenate([[0], ends])[np.searchsorted(starts, bounds)])

    def _texts(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and their numbers; texts with strings of added tokens go to the library whole."""
        raw, odd = data[bounds[0] : bounds[-1]].tobytes(), set()
        for a in self.added:
            at = raw.find(a)
            while at >= 0:
                k = int(np.searchsorted(bounds, bounds[0] + at, side="right")) - 1
                odd.add(k)
                at = raw.find(a, int(bounds[k + 1] - bounds[0]))
        out, lo = [], 0
        for k in [*sorted(odd), len(bounds) - 1]:
            out.append(self._segment(data[bounds[lo] : bounds[k]], bounds[lo : k + 1] - bounds[lo]))
            if k in odd:
                out.append(self._whole([raw[bounds[k] - bounds[0] : bounds[k + 1] - bounds[0]].decode()]))
            lo = k + 1
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has. Null is empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "").cast(pa.large_string())
        if not self.by_pieces:
            return self._whole(texts.to_pylist())
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        parts, lo = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))], 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SEGMENT, side="right")) - 1)
            parts += self._texts(data, bounds[lo : hi + 1])
            lo = hi
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode_docs(e: Encoder, texts: list[str | None] | pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end`` after each document, and the documents' bounds in them."""
    ids, n = e.encode(texts)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(bounds[-1]), end, np.uint32)
    at = np.ones(len(out), bool)
    at[bounds[1:] - 1] = False
    out[at] = ids
    return out, bounds
