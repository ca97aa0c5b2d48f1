"""Main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: stretches of text between block-level tags.  Each block has a tag-path vector (the
hashed tags and class or id words of its open elements, with depth from the leaf), a hashed-word vector and some
measures.  A bidirectional LSTM in numpy reads the sequence both ways, so each label draws on the whole page, and blocks
labelled as article are joined.  The weights beside this file come from ``html_training.py``, which makes its pages up.

What never is text (comments, scripts, styles, titles, templates) is left out while parsing; everything else is the
labeller's decision, but for pages without any tag, which are text as a whole.  As the HTML standard has it, an unclosed script, style
or comment reaches to the end of the page, and a head ends where something stands that cannot be in it.

Edge cases: a null or empty page gives an empty text; a page without tags is its text; tags left open or cut off at the end
of the page are taken as they are; pages of any length are processed whole; repeated rows are answered one by one;
an empty table gives no row; input columns named like an output, in any case of letters, give way.
"""

from __future__ import annotations

import html
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, without

PATH_DIM, WORD_DIM, EXTRA = 128, 48, 8
INPUT = PATH_DIM + WORD_DIM + EXTRA
HIDDEN = 24
WEIGHTS = os.path.join(os.path.dirname(__file__), "html_weights.npz")

#: Elements of the HTML standard that are laid out in a line with text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are never shown as text.
RAW = frozenset("script style noscript template title textarea svg math iframe object".split())
#: What can stand in a head.
IN_HEAD = frozenset("html head base basefont bgsound link meta title".split()) | RAW
#: An open one of these ends where the next of its kind begins.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PART = re.compile(r"[a-z]+", re.I)
SPACE = re.compile(r"[\s ]+")


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path, text, linked):
        self.path, self.text, self.linked = path, text, linked


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks in page order: the open elements (tag, names), the text, and how many of its characters are in links."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    inside: list[str] = []
    links, anchor, at = 0, 0, 0
    n = len(page)

    def leave_head():
        """The head ends, with or without an end tag, where something stands that cannot be in it."""
        at = next((i for i, (tag, _) in enumerate(stack) if tag == "head"), None)
        if at is not None:
            del stack[at:]

    def flush():
        nonlocal links
        if inside:
            text = SPACE.sub(" ", html.unescape("".join(inside))).strip(" ")
            if text:
                leave_head()
                out.append(Block(tuple(stack), text, min(links, len(text))))
        inside.clear()
        links = 0

    while at < n:
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            inside.append(piece)
            if anchor:
                links += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                anchor = max(0, anchor - 1)
            if tag not in INLINE:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            if tag != "svg":
                flush()
            continue
        if tag not in IN_HEAD:
            leave_head()
        if tag in INLINE:
            if tag == "br":
                inside.append(" ")
            elif tag == "a":
                anchor += 1
            continue
        flush()
        anchor = 0
        if tag in SELF_CLOSING:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] not in SELF_CLOSING:
                    break
        if tag not in VOID:
            names = tuple(p.lower() for a in NAMED.findall(m[3]) for p in PART.findall("".join(a))) if m[3] else ()
            stack.append((tag, names))
    flush()
    return out


_PATHS: dict[tuple, np.ndarray] = {}
_WORDS: dict[str, int] = {}


def path_vector(path) -> np.ndarray:
    v = _PATHS.get(path)
    if v is None:
        v = np.zeros(PATH_DIM, dtype=np.float32)
        for depth, (tag, names) in enumerate(reversed(path)):
            for name in (tag, *("." + x for x in names)):
                h = zlib.crc32(name.encode())
                v[h % (PATH_DIM // 2)] = 1
                v[PATH_DIM // 2 + zlib.crc32(f"{name}@{min(depth, 2)}".encode()) % (PATH_DIM // 2)] = 1
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        _PATHS[path] = v
    return v


def features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), INPUT), dtype=np.float32)
    words, get = _WORDS, _WORDS.get
    for i, b in enumerate(blocks):
        out[i, :PATH_DIM] = path_vector(b.path)
        split = b.text.split(" ")
        at = [get(w) for w in split]
        if None in at:
            if len(words) > 300_000:
                words.clear()
            for j, x in enumerate(at):
                if x is None:
                    at[j] = words[split[j]] = zlib.crc32(split[j].lower().encode("utf-8", "replace")) % WORD_DIM
        n, k = len(b.text), len(split)
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(at, minlength=WORD_DIM) / k
        out[i, PATH_DIM + WORD_DIM :] = (min(np.log1p(n) / 8, 1.5), min(np.log1p(k) / 6, 1.5), b.linked / n, b.text.endswith((".", "!", "?", ":", "…")), k <= 3, i / max(1, len(blocks) - 1), len(b.path) / 8, 1.0)
    return out


class BiLSTM:
    """One bidirectional layer and a logistic output; parameters in a dictionary of float32 arrays."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def new(cls, seed: int = 3) -> BiLSTM:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["x" + d] = (rng.normal(size=(INPUT, 4 * HIDDEN)) / np.sqrt(20)).astype(np.float32)
            w["h" + d] = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            w["c" + d] = np.zeros(4 * HIDDEN, dtype=np.float32)
            w["c" + d][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        w["o"] = (rng.normal(size=2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        w["d"] = np.zeros(1, dtype=np.float32)
        return cls(w)

    @classmethod
    def load(cls, path: str = WEIGHTS) -> BiLSTM:
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) for k in z.files})

    def direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, HIDDEN); where ``mask`` is 0 the state stays."""
        time, size, _ = x.shape
        gates = x.reshape(time * size, -1) @ self.w["x" + d] + self.w["c" + d]
        gates = gates.reshape(time, size, -1)
        h, c, out = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32), np.zeros((time, size, HIDDEN), np.float32)
        H = HIDDEN
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            g = gates[t] + h @ self.w["h" + d]
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * H], -30, 30)))
            u = np.tanh(g[:, 3 * H :])
            m = mask[t][:, None]
            new = s[:, H : 2 * H] * c + s[:, :H] * u
            if keep is not None:
                keep.append((t, h, c, s, u, new, m))
            c = m * new + (1 - m) * c
            h = m * (s[:, 2 * H :] * np.tanh(new)) + (1 - m) * h
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.concatenate((self.direction(x, mask, "f"), self.direction(x, mask, "b")), axis=2) @ self.w["o"] + self.w["d"]

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """True for article blocks, page by page; pages are batched by length, each read whole."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            take = order[at : at + 128]
            while len(take) > 1 and len(take) * len(pages[take[-1]]) > 20_000:
                take = take[: len(take) // 2]
            at += len(take)
            longest = len(pages[take[-1]])
            x, mask = np.zeros((longest, len(take), INPUT), np.float32), np.zeros((longest, len(take)), np.float32)
            for j, i in enumerate(take):
                x[: len(pages[i]), j], mask[: len(pages[i]), j] = pages[i], 1
            s = self.scores(x, mask)
            for j, i in enumerate(take):
                out[i] = s[: len(pages[i]), j] > 0
        return out


def extract(pages: list[str], model: BiLSTM) -> list[str]:
    blocks = [blocks_of(p) for p in pages]
    marks = model.labels([features(b) for b in blocks])
    # without a tag there is nothing but the text
    marks = [m if any(b.path for b in bs) or any(t[2] for t in TOKEN.finditer(p)) else np.ones(len(bs), bool) for p, bs, m in zip(pages, blocks, marks, strict=True)]
    return ["\n\n".join(b.text for b, m in zip(bs, ms, strict=True) if m) for bs, ms in zip(blocks, marks, strict=True)]


def main_text(df: DataFrame, *, page: str = "html", output: str = "text", weights: str | None = None) -> DataFrame:
    """``df`` without ``page``, with the main text and ``n_chars``, its code points.  ``weights`` must be a path on every executor."""
    kept = without(df, page, output, "n_chars")
    schema = T.StructType(kept + [T.StructField(output, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        model = BiLSTM.load(weights or WEIGHTS)
        for whole in batches:
            for batch in slices(whole, page, 4 << 20):
                texts = extract([x or "" for x in batch.column(page).to_pylist()], model)
                arrays = [batch.column(f.name) for f in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{page}`")).mapInArrow(run, schema)
