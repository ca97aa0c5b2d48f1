"""Benchmark decontamination by the q-gram lemma.

Texts are folded to bytes of letters and digits (A-Z lower-cased, white space and ASCII punctuation left out, other bytes kept).
Items are cut into overlapping segments of ``SEGMENT`` folded bytes.  A stretch of a document within k edits of a segment of
length m shares at least m + 1 - Q(k + 1) of its q-grams with it, all within k + 1 neighbouring diagonals (position in
the document less position in the segment).  So shared q-grams are counted in overlapping bands of 2(k + 1)
diagonals; the bands that reach the bound are aligned, in a band about their diagonals, and those within k edits are regions.

The index of the items is sent to all executors in blocks of at most ``BLOCK_BYTES`` of item text; every block is one pass over
the documents.  Documents are never shuffled, and a passage that many of them hold costs each of them the same.

A passage of ``SEGMENT + STRIDE - 1`` folded bytes of an item holds a whole segment wherever it was cut from, so with few enough edits
it is always found; a shorter one may be.

Edge cases: null and empty texts hold nothing; an item shorter than a segment is looked for whole, and one of fewer than
``LEAST`` folded bytes (k is 0: all of its q-grams must be shared) without edits and where no letter or digit touches it; one of
fewer than ``Q`` letters and digits has no q-gram and is not looked for; repeated rows are answered one by one; of several alignments in
a region the fewest edits count; an empty table or benchmark gives no region; texts of any length are processed whole; other columns, whatever
their names, are ignored by ``contaminated_regions`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, texts_of, work_dir

Q, SEGMENT, STRIDE, LEAST = 8, 64, 16, 48
#: Edits for each folded byte of a segment.
EDIT_RATE = 0.09
BLOCK_BYTES = 4 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32


def folded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes and where each stood."""
    all_ = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    at = np.flatnonzero(all_)
    return all_[at], at


def qgrams(x: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes at each position as one uint64."""
    if len(x) < Q:
        return np.empty(0, dtype=np.uint64)
    v = x.astype(np.uint64)
    v = v[:-1] << np.uint64(8) | v[1:]
    v = v[:-2] << np.uint64(16) | v[2:]
    return v[:-4] << np.uint64(32) | v[4:]


class Index:
    """The segments of a block of items and where each q-gram stands in them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.segments, self.edits = [], [], []
        for item, text in items:
            x, _ = folded((text or "").encode("utf-8"))
            if len(x) < Q:
                continue
            last = max(0, len(x) - SEGMENT)
            for start in [*range(0, last, STRIDE), last]:
                part = x[start : start + SEGMENT]
                self.items.append(item)
                self.segments.append(part)
                self.edits.append(int(len(part) * EDIT_RATE) if len(x) >= LEAST else 0)
        grams = [qgrams(s) for s in self.segments]
        all_ = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        seg = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, dtype=np.int64)
        order = np.argsort(all_, kind="stable")
        self.grams, self.first, self.counts = np.unique(all_[order], return_index=True, return_counts=True)
        self.seg, self.pos = seg[order], pos[order]
        self.length = np.array([len(s) for s in self.segments], dtype=np.int64)
        self.k = np.array(self.edits, dtype=np.int64)
        self.need = self.length + 1 - Q * (self.k + 1)
        self.bits = max(16, (16 * len(self.grams) + 1).bit_length())
        self.filter = np.zeros(1 << self.bits, dtype=bool)
        self.filter[self.slot(self.grams)] = True

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def regions(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits), the span in code points; touching regions of an item are one."""
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        starts = np.cumsum([0] + [len(d) + 1 for d in data])
        x, at = folded(b" ".join(data))
        if not len(self.grams) or len(x) < Q:
            return []
        edge = np.searchsorted(at, starts)  # folded start of each text
        grams = qgrams(x)
        where = np.flatnonzero(self.filter[self.slot(grams)])
        place = np.searchsorted(self.grams, grams[where])
        place[place == len(self.grams)] = 0
        good = self.grams[place] == grams[where]
        where, place = where[good], place[good]
        text = np.searchsorted(edge, where, side="right") - 1
        good = where + Q <= edge[text + 1]
        where, place, text = where[good], place[good], text[good]
        n = self.counts[place]
        entry = np.repeat(self.first[place] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        seg, diagonal = self.seg[entry], np.repeat(where, n) - self.pos[entry]
        text = np.repeat(text, n)
        # two overlapping bands a hit; a band belongs to one text
        width = self.k[seg] + 1
        band = diagonal // width
        key = np.stack([np.concatenate((text, text)), np.concatenate((seg, seg)), np.concatenate((band, band - 1))])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        new = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]) if key.shape[1] else np.empty(0, np.int64)
        count = np.diff(np.r_[new, key.shape[1]])
        text, seg, band = key[:, new[count >= self.need[key[1, new]]]]
        found = []
        for m in np.unique(self.length[seg]):
            same = np.flatnonzero(self.length[seg] == m)
            for i in range(0, len(same), 4096):
                at_ = same[i : i + 4096]
                found += self.aligned(x, at, edge, text[at_], seg[at_], band[at_], int(m))
        return self.merged(found, at, starts, data)

    def aligned(self, x, at, edge, text, seg, band, m):
        """Bands that hold the whole segment of length ``m`` within its edits: (text, item, folded start, folded end, edits)."""
        k = int(self.k[seg[0]])
        low = band * (k + 1) - k  # the first diagonal that the alignment may start at
        span = 2 * (k + 1) + 2 * k + 1
        patterns = np.stack([self.segments[s] for s in seg])
        cols = np.arange(span)
        lo, hi = edge[text][:, None], edge[text + 1][:, None]
        dist = np.where((low[:, None] + cols >= lo) & (low[:, None] + cols <= hi), 0, m + 1).astype(np.int32)
        for i in range(m):
            j = low[:, None] + i + cols
            inside = (j >= lo) & (j < hi)
            same = x[np.clip(j, 0, len(x) - 1)] == patterns[:, i : i + 1]
            step = np.where(inside, dist + ~same, m + 1)
            step[:, :-1] = np.minimum(step[:, :-1], dist[:, 1:] + 1)
            dist = np.minimum.accumulate(step - cols, axis=1) + cols
        best = dist.argmin(axis=1)
        edits = dist[np.arange(len(best)), best]
        end = np.minimum(low + m + best, edge[text + 1])
        start = np.maximum(end - m, edge[text])
        good = edits <= k
        if m < LEAST:  # a short item is found where nothing follows on it on either side
            ahead, behind = np.minimum(end, len(x) - 1), np.maximum(start - 1, 0)
            good &= (start == edge[text]) | (at[behind] < at[np.minimum(start, len(x) - 1)] - 1)
            good &= (end == edge[text + 1]) | (at[ahead] > at[end - 1] + 1)
        return [(int(t), self.items[s], int(a), int(b), int(e)) for t, s, a, b, e, g in zip(text, seg, start, end, edits, good, strict=True) if g]

    @staticmethod
    def merged(found, at, starts, data):
        out = []
        for t, item, a, b, e in sorted(set(found)):
            if out and out[-1][0] == t and out[-1][1] == item and a <= out[-1][3] + STRIDE:
                out[-1] = (t, item, out[-1][2], max(b, out[-1][3]), min(e, out[-1][4]))
            else:
                out.append((t, item, a, b, e))
        result = []
        for t, item, a, b, e in out:
            first, last = int(at[a] - starts[t]), int(at[b - 1] - starts[t]) + 1
            chars = lambda i, d=data[t]: len(d[:i].decode("utf-8", "ignore"))
            result.append((t, item, chars(first), chars(last) if last == len(data[t]) or data[t][last] & 0xC0 != 0x80 else chars(last) + 1, e))
        return result


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[list[tuple[int, str]]]:
    """The items in blocks whose sizes are bounded; one block is in the driver at a time."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r["item"], r["text"]) for r in part.distinct().orderBy("item", "text").collect()]


REGION = "doc_id long, item_id long, start long, end long, edits int"


def contaminated_regions(df: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each region: doc_id, item_id, start and end in code points, and the least edits of a segment in it."""
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = None
    for items in blocks(benchmark, item_id, item_text, block_bytes):
        sent = df.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            index = Index(sent.value)
            for whole in batches:
                for batch in slices(whole, "text", 2 << 20):
                    found = index.regions(texts_of(batch.column("text")))
                    ids = batch.column("doc_id").to_pylist()
                    columns = list(zip(*((ids[t], i, a, b, e) for t, i, a, b, e in found), strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.int32()], strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

        part = rows.mapInArrow(run, REGION)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` without the rows that hold a region of a benchmark item."""
    path, done = work_dir(df.sparkSession), 0
    for items in blocks(benchmark, item_id, item_text, block_bytes):
        if done:  # a pass and an index at a time
            df = stored(df, f"{path}/{done}")
        done += 1
        sent = df.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            index = Index(sent.value)
            for whole in batches:
                for batch in slices(whole, text, 2 << 20):
                    hit = {t for t, *_ in index.regions(texts_of(batch.column(text)))}
                    yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)])) if hit else batch

        df = df.mapInArrow(run, df.schema)
    return df
