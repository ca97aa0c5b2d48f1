"""Merge kernels: what no built-in can say.  Each turns one piece into ids; a bounded memory of pieces serves repeats.

They run inside Arrow functions in the row's own task, so encoding moves no data between tasks: a corpus is encoded in
one narrow pass however large it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

MOST_REMEMBERED = 200_000
WORD = re.compile("▁+[^▁]*|[^▁]+")
#: What a piece model takes for something else: the end of a text, and a space.
LOST = re.compile("([\0▁])")


class EncodeFault(Exception):
    """A piece that has no encoding."""


@dataclass
class Kernel:
    known: dict = field(default_factory=dict, repr=False)

    def ids(self, piece: str) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            found = self.encode(piece)
            if len(self.known) > MOST_REMEMBERED:
                self.known.clear()
            if len(piece) < 128:
                self.known[piece] = found
        return found

    def encode(self, piece: str) -> list[int]:
        raise NotImplementedError


def merge_by_rank(parts: list, rank_of) -> list:
    """Joins the neighbours of least rank, the leftmost of equals, until no pair has a rank.

    Pairs wait in a heap by (rank, place); a pair whose parts have changed since is passed over.
    """
    parts, n = list(parts), len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = rank_of(parts[i], parts[i + 1])
        if rank is not None:
            heap.append((rank, i, parts[i], parts[i + 1]))
    heapify(heap)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        # a part that is gone is None, and one that has grown differs from what it was
        if parts[i] != left or j >= n or parts[j] != right:
            continue
        parts[i], parts[j], after[i] = left + right, None, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n:
                rank = rank_of(parts[x], parts[y])
                if rank is not None:
                    heappush(heap, (rank, x, parts[x], parts[y]))
    return [p for p in parts if p is not None]


@dataclass
class RankMerge(Kernel):
    """Rank BPE over bytes: a pair's rank is the id of its bytes.  An unknown single byte fails; an unknown leftover is id 0."""

    tokens: dict[bytes, int] = field(default_factory=dict)

    def encode(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogateescape")
        if not data:
            return []
        whole = self.tokens.get(data)
        if whole is not None:
            return [whole]
        if len(data) == 1:
            raise EncodeFault(repr(data))
        get = self.tokens.get
        return [get(p, 0) for p in merge_by_rank([data[i : i + 1] for i in range(len(data))], lambda a, b: get(a + b))]


@dataclass
class CharacterMerge(Kernel):
    """BPE over characters with ranks by merged text.  A first character without an id, or with id 0, drops the whole piece."""

    tokens: dict[bytes, int] = field(default_factory=dict)
    ranks: dict[str, int] = field(default_factory=dict)

    def encode(self, piece: str) -> list[int]:
        get = lambda t: self.tokens.get(t.encode("utf-8"))
        whole = get(piece)
        if whole is not None:
            return [whole]
        if any(not get(c) for c in piece):
            return []
        return [get(p) or 0 for p in merge_by_rank(list(piece), lambda a, b: self.ranks.get(a + b))]


def merge_by_score(ids: list[int], text_of, id_of, score_of) -> list[int]:
    """Joins the neighbours whose joined token scores highest, the leftmost of equals, until no pair makes a token.

    Pairs wait in a heap by (score, place); a pair whose parts have changed since is passed over.
    """
    ids, n = list(ids), len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if 0 <= i else n
        if j < n:
            new = id_of(text_of(ids[i]) + text_of(ids[j]))
            if new is not None and score_of(new) > -1e10:
                heappush(heap, (-score_of(new), i, ids[i], ids[j], new))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b, new = heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = new, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x, live in zip(ids, alive, strict=True) if live]


@dataclass
class ScoreMerge(Kernel):
    """Scored BPE over a whole text: the begin token takes part, a space stands in front, unknown characters fall back to bytes (+3)."""

    by_id: list[bytes] = field(default_factory=list)
    tokens: dict[bytes, int] = field(default_factory=dict)
    scores: dict[int, float] = field(default_factory=dict)

    def text(self, text: str, begin: list[int]) -> list[int]:
        if not text:
            raise EncodeFault("an empty text")
        space = self.tokens.get(b" ")
        if space is None:
            raise EncodeFault("no token for a space")
        ids = list(begin) + [space]
        for c in text:
            data = c.encode("utf-8", "surrogateescape")
            i = self.tokens.get(data)
            ids += [i] if i is not None else [b + 3 for b in data]
        of = lambda i: self.by_id[i] if i < len(self.by_id) else b""
        return merge_by_score(ids, of, self.tokens.get, lambda i: self.scores.get(i, 0.0))

    def encode(self, piece: str) -> list[int]:
        return self.text(piece, [])


@dataclass
class PieceMerge(Kernel):
    """Piece models over a whole text: scored BPE, or the best unigram segmentation; unknown characters as bytes where there are such pieces."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        self.id_of = {t: i for i, (t, _, kind) in enumerate(self.pieces) if kind in (1, 4)}
        self.bytes_of = {t: i for i, (t, _, kind) in enumerate(self.pieces) if kind == 6}
        users = sorted((t for t, _, kind in self.pieces if kind == 4), key=len, reverse=True)
        #: Pieces that the user defined stand for themselves wherever they occur, the longest first.
        self.own = re.compile(f"({'|'.join(map(re.escape, users))})") if users else None
        self.longest = max(map(len, self.id_of), default=1)
        self.least = min((s for _, s, k in self.pieces if k == 1), default=0.0) - 10

    def encode(self, piece: str) -> list[int]:
        exact = self.options.get("exact") and self.bytes_of
        text = piece if exact else piece.split("\0", 1)[0]
        if self.options.get("remove_extra_spaces"):
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        if self.options.get("add_dummy_prefix"):
            text = " " + text
        out: list[int] = []
        for n, stretch in enumerate(LOST.split(text) if exact else [text]):
            for p in [stretch] if n % 2 else self.parts(stretch.replace(" ", "▁")):
                i = None if n % 2 else self.id_of.get(p)
                if i is not None:
                    out.append(i)
                elif self.bytes_of:
                    out += [self.bytes_of[f"<0x{b:02X}>"] for b in p.encode("utf-8", "surrogateescape")]
                elif not out or out[-1] != self.options.get("unk", 0):
                    out.append(self.options.get("unk", 0))
        return out

    def parts(self, text: str) -> list[str]:
        cut = self.scored if self.options.get("algorithm") == 2 else self.best
        return cut(text) if self.own is None else [p for n, x in enumerate(self.own.split(text)) for p in ([x] if n % 2 else cut(x) if x else [])]

    def scored(self, text: str) -> list[str]:
        get, pieces = self.id_of.get, self.pieces

        def rank(a: str, b: str):
            i = get(a + b)
            return None if i is None else -pieces[i][1]

        # words are merged apart: no piece has the space mark but in front
        out: list[str] = []
        for w in WORD.findall(text):
            found = self.known.get(w)
            if found is None:
                found = merge_by_rank(list(w), rank)
                if len(self.known) > MOST_REMEMBERED:
                    self.known.clear()
                if len(w) < 128:
                    self.known[w] = found
            out += found
        return out

    def best(self, text: str) -> list[str]:
        score, back = [0.0] + [-1e18] * len(text), [0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                i = self.id_of.get(text[start:end])
                s = score[start] + (self.pieces[i][1] if i is not None else self.least if end - start == 1 else -1e18)
                if s > score[end]:
                    score[end], back[end] = s, start
        out, end = [], len(text)
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]
