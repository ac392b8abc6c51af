"""Token ids of whole texts with the tokenizers library, one model call per distinct pre-token.

A byte-level BPE with the usual contraction/letters/numbers/other/space pattern encodes each
pre-token on its own.  Texts are cut at places where that pattern always ends a pre-token,
equal pieces of a batch are coded as one, and the library encodes each distinct piece once
per worker.  Any other tokenizer file is applied to whole texts.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from tensio.llm.batches import text_buffer

#: Bytes of pieces and ids that a worker keeps (with what an entry costs besides); beyond it the
#: memory is emptied and filled anew, so it never passes this by more than one slice of texts.
MEMORY_BYTES = 80 << 20
ENTRY_BYTES = 160

_CUT_LETTER = np.zeros(256, bool)
_CUT_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~\\"]] = True
#: What is surely one pre-token of the pattern.
_ONE = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where it is printable,
    else the next character from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}


class Encoder:
    """Encode batches of texts; ids equal those of ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already uses every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        self.special = [t["content"] for t in added]
        # Only a special string of one kind of characters can lie within a single pre-token.
        self.hidden = [s for s in self.special if _ONE.fullmatch(s)]
        plain = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}
        self.apart = (
            spec["normalizer"] is None
            and spec["model"]["type"] == "BPE"
            and all(pre.get(k) == v for k, v in plain.items())
            and all(regex.fullmatch(r"[!-~]+", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        )
        self.letters = _byte_letters()
        self.place: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.place.clear()
        self.held = 0
        self.known, self.size, self.begin = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        got = self._encode(pieces)
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        self.held += sum(map(len, pieces)) + ENTRY_BYTES * len(pieces) + flat.nbytes
        self.place.update(zip(pieces, range(len(self.size), len(self.size) + len(got)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.known) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.known = np.concatenate([self.known, flat])

    def _cuts(self, buf: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where a piece starts: at a text's start, at a space after something that is no white
        space, around a single line feed between such, and at ASCII punctuation after a Latin letter, but
        not inside a special string."""
        cut = np.zeros(len(buf), bool)
        if not len(buf):
            return cut
        letter, point, feed = _CUT_LETTER[buf], _POINT[buf], buf == 10
        # U+00C0 to U+017F are letters of two bytes, but for two signs.
        latin = (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC5)
        letter[1:] |= latin & ~((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))
        # What else lies beyond ASCII may be white space: no cut beside it.
        solid = (buf < 0x80) & ~_SPACE[buf] | letter
        cut[1:] = solid[:-1] & (buf[1:] == 32)
        alone = feed.copy()
        alone[1:] &= solid[:-1]
        alone[:-1] &= solid[1:] | (buf[1:] >= 0xC3) & (buf[1:] <= 0xC5)
        alone[[0, -1]] = False
        cut |= alone
        cut[1:] |= alone[:-1]
        cut[1:] |= letter[:-1] & point[1:]
        for special in self.special:  # a special string must stay in one piece
            cut &= ~self._inside(buf, special.encode())
        cut[heads] = True
        return cut

    @staticmethod
    def _inside(buf: np.ndarray, s: bytes) -> np.ndarray:
        """Bytes that lie in an occurrence of ``s``, its first one left out."""
        out = np.zeros(len(buf), bool)
        at = np.flatnonzero(buf[: max(len(buf) - len(s) + 1, 0)] == s[0])
        for i, c in enumerate(s):
            at = at[buf[at + i] == c]
        for i in range(1, len(s)):
            out[at + i] = True
        return out

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if not _ONE.fullmatch(t) or (self.hidden and any(s in t for s in self.hidden)):
                rest.append(i)
                continue
            if t.isascii() and t.isprintable():  # only the space is not its own stand-in
                t = self.letters[32] + t[1:] if t[0] == " " else t
            else:
                t = pieces[i].decode("latin-1").translate(self.letters)
            out[i] = [x.id for x in self.model.tokenize(t)]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32 bit) and the number of ids of each text; NULL counts as empty."""
        data, offsets = text_buffer(column)
        n = len(offsets) - 1
        if not self.apart:
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        full = np.flatnonzero(np.diff(offsets))
        heads = offsets[:-1][full]
        places = np.flatnonzero(self._cuts(data, heads))
        ends = np.append(places, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.held > MEMORY_BYTES:
            self._reset()
        new = [w for w in words if w not in self.place]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        each = self.size[at]
        total = np.concatenate([[0], np.cumsum(each)])
        index = np.repeat(self.begin[at] - total[:-1], each)
        index += np.arange(total[-1])
        counts = np.zeros(n, np.int64)
        edge = total[np.append(np.searchsorted(places, heads), len(places))]
        counts[full] = np.diff(edge)
        return self.known[index], counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder of this file; what it has met stays known to later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
