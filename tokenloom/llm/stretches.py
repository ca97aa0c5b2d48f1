"""Token ids and counts of whole texts by the library of a vocabulary file, each distinct stretch encoded once.

Texts are cut before every run of white space that follows a visible character, and between an ASCII letter and one of ``,.;:!?``.
For vocabularies of two shapes (see ``shape``) no token and no match of the pattern spans such a place, and what stands before
or after it does not change how the other side is split, so the ids of a text are those of its stretches in order.  A batch is cut and
dictionary-encoded in Arrow; only distinct stretches that are not remembered go to the library, a thousand in one call, and
results are gathered by index.

Two bounded generations of short stretches are remembered, with the same result whatever is forgotten.  Other vocabularies are
encoded text by text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import _SPACE

#: White space of Unicode outside ASCII as UTF-8, and the control characters that some libraries count as such: where white space
#: is a part of tokens, no cut follows them.
_ODD_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ODD = np.array([int.from_bytes(s) for s in _ODD_SPACES])
_CONTROL = (0x1C, 0x1F)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b",.;:!?"]] = True
#: Stretches of a call to the library, and the longest that is remembered.
CALL, LONGEST = 1000, 64


def shape(spec: dict) -> str | None:
    """``spaced`` for byte-level BPE with the common pattern, ``bare`` where a pattern's matches alone are kept and white space is not; None: texts are not cut."""
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s|[A-Za-z][,.;:!?]", t["content"])) for t in spec.get("added_tokens", []))
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if spec["model"]["type"] != "BPE" or not plain:
        return None
    if pre.get("type") == "ByteLevel":
        return "spaced" if not norm and not pre.get("add_prefix_space") and pre.get("use_regex", True) else None
    parts = pre.get("pretokenizers", [])
    inside = [n["type"] for n in (norm.get("normalizers", [norm]) if norm else [])]
    split = [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
    return "bare" if split and r"[\p{L}]+" in parts[0]["pattern"].get("Regex", "") and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex") and set(inside) <= {"NFC", "Replace", "Lowercase"} else None


def stretches(texts: pa.Array, bare: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All stretches of a column of strings as one binary array, and where each text's begin in it (one more at the end).

    Stretches keep the white space before them, unless ``bare``.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return pa.array([], pa.binary()), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if bounds[-1] == bounds[0]:
        return pa.array([], pa.binary()), np.zeros(len(bounds), np.int64)
    view = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    space = _SPACE[view]
    cut = np.zeros(len(view) + 1, dtype=bool)
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    if not bare:
        last = view[at - 1].astype(np.int32)
        two = np.where(at > 1, view[at - 2], 0).astype(np.int32) << 8 | last
        three = np.where(at > 2, view[at - 3], 0).astype(np.int32) << 16 | two
        at = at[~(np.isin(two, _ODD) | np.isin(three, _ODD) | (last >= _CONTROL[0]) & (last <= _CONTROL[1]))]
    cut[at] = True
    cut[1:-1] |= _STOP[view[1:]] & _LETTER[view[:-1]]
    cut[bounds] = True
    ends = np.flatnonzero(cut)
    ends = np.r_[0, ends[ends > 0]]
    first = np.searchsorted(ends, bounds)
    if bare:
        ends = np.r_[0, np.cumsum(~space, dtype=np.int32)][ends]
        view = view[~space]
    pieces = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(view)])
    return pieces, first


class StretchEncoder:
    """Ids and counts under one vocabulary file of the library for JSON descriptions, in its default handling of special strings."""

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            self.shape = shape(json.load(f))
        self.most = most
        self.memory: dict[str, tuple[dict, dict]] = {"ids": ({}, {}), "counts": ({}, {})}

    def _calls(self, keys: list[bytes], missing: list[int]):
        """The missing stretches in calls: what the library gets, such that its words are these stretches in order.

        A run of ASCII letters (with the space before it) is one match of the pattern, so many of them make one text, which
        costs less than a list of words.
        """
        bare = self.shape == "bare"
        single = [i for i in missing if (keys[i].isalpha() if bare else keys[i][:1] == b" " and keys[i][1:].isalpha())]
        rest = missing if not single else sorted(set(missing).difference(single))
        for a in range(0, len(single), CALL):
            some = single[a : a + CALL]
            yield some, (b" " if bare else b"").join([keys[i] for i in some]).decode("ascii")
        for a in range(0, len(rest), CALL):
            some = rest[a : a + CALL]
            yield some, [keys[i].decode("utf-8") for i in some]

    def _known(self, kind: str, keys: list[bytes]) -> list:
        """What ``kind`` has for each distinct stretch."""
        young, old = self.memory[kind]
        found = [young.get(k) for k in keys]
        new = {}
        missing = []
        for i, x in enumerate(found):
            if x is None:
                found[i] = x = old.get(keys[i])
                if x is None:
                    missing.append(i)
                elif len(keys[i]) < LONGEST:
                    new[keys[i]] = x
        for some, whole in self._calls(keys, missing):
            e = self.lib.encode(whole, is_pretokenized=isinstance(whole, list), add_special_tokens=False)
            place = np.array(e.word_ids, dtype=np.int64)
            if kind == "counts":
                got = np.bincount(place, minlength=len(some)).tolist()
            else:
                ids, ends = np.array(e.ids, dtype=f"<u{self.width}").tobytes(), (np.searchsorted(place, np.arange(len(some) + 1)) * self.width).tolist()
                got = [ids[p:q] for p, q in zip(ends, ends[1:], strict=False)]
            for i, x in zip(some, got, strict=True):
                found[i] = x
                if len(keys[i]) < LONGEST:
                    new[keys[i]] = x
        young.update(new)
        if len(young) > self.most:
            self.memory[kind] = ({}, young)
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin in it."""
        if self.shape is None:
            parts = [np.array(e.ids, dtype=f"<u{self.width}") for e in self.lib.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.empty(0, f"<u{self.width}"), *parts]), np.cumsum([0] + [len(p) for p in parts])
        pieces, first = stretches(texts, self.shape == "bare")
        coded = pieces.dictionary_encode()
        known = self._known("ids", coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(known), dtype=f"<u{self.width}")
        size = np.array([len(x) for x in known], dtype=np.int64) // self.width
        at, place = np.cumsum(size) - size, np.asarray(coded.indices)
        n = size[place]
        ends = np.r_[0, np.cumsum(n)]
        return flat[np.repeat(at[place] - ends[:-1], n) + np.arange(ends[-1])], ends[first]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many tokens each text has."""
        if self.shape is None:
            return np.diff(self.ids(texts)[1])
        pieces, first = stretches(texts, self.shape == "bare")
        coded = pieces.dictionary_encode()
        n = np.array(self._known("counts", coded.dictionary.to_pylist()), dtype=np.int64)
        sums = np.r_[0, np.cumsum(n[np.asarray(coded.indices)])]
        return sums[first[1:]] - sums[first[:-1]]


_ENCODERS: dict[str, StretchEncoder] = {}


def encoder(path: str) -> StretchEncoder:
    """One encoder a worker and file; workers outlive tasks, and so does what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = StretchEncoder(path)
    return _ENCODERS[path]
