"""Quality rules: word and repetition measures, then n-gram perplexity bands for each language.

The language model is an interpolated modified Kneser-Ney model over the bytes of the text (white space runs as one space,
``ORDER`` - 1 zero bytes in front).  Documents are dealt to two halves by a hash of these bytes, and each half is scored with the
counts of the other: no document, nor an exact copy of it, has a part in the model that scores it.  A document whose language
has no text in the other half is scored by the uniform model, 8 bits a byte.

Spark counts the n-grams of all documents by language and half: each task sums its own batches,
and the sums are combined by a hash aggregate.  Orders below the highest count distinct left neighbours, so all follow
from the highest.  The model of a language and half is a sorted array of n-gram codes with probabilities and a sorted array
of contexts with backoff weights for each order; n-grams of a text are looked up by binary search.

No n-gram is left out, so the model grows with the corpus.  What a task holds does not: n-grams are dealt to blocks of about
``max_grams`` by the two bytes before the last, which an n-gram shares with all lower orders it backs off to (from the
third up; the two below have at most 65,792 entries a language and half and go with every block).  A block is thus a model of its own for the bytes that
follow its pairs; one pass over the documents for each block adds up their log probabilities, and only the models of one block
are sent at a time.  A single pair has at most 2^24 n-grams a language and half.

All documents are scored, then each language's bands follow from the quartiles of log perplexity of its documents that pass
the base rules: ``[q1 - low_width * iqr * s, q3 + width * iqr * s]`` with ``iqr`` at least ``LEAST_IQR``.  Documents outside are rejected.
``s`` is 1, and for a document shorter than the language's median the root of median over length: the mean over fewer bytes spreads
that much wider without the text being any worse.

Edge cases: a null or empty text has no words and fails the base rules; a null language is one of its own; repeated rows are
answered (and counted) one by one; texts of any length are processed whole; an empty table gives no row; input columns named
like an output, in any case of letters, give way in ``judged`` and stay as they are in ``quality_filter``.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, remove_dir, slices, stored, texts_of, windows, without, word_bounds, word_hashes, work_dir

ORDER = 5
#: N-grams in memory at a time; more of them take more passes.
MAX_GRAMS = 4_000_000
PAIRS = 1 << 16
#: Interquartile ranges above and below.  Text with lines that the corpus repeats often is predicted well without being bad, so
#: the lower band is the wider one.
WIDTH, LOW_WIDTH = 1.5, 2.0
LEAST_IQR = 0.02
#: Histogram bins for each bit of the score, and for each doubling of the length.
SCORE_BINS, LENGTH_BINS = 10_000, 64
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
FLUSH = 1_000_000


# --- base rules
def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "surrogatepass")
    starts, ends = word_bounds(data)
    n, chars = len(starts), int((ends - starts).sum())
    if not text.isascii():
        chars -= int(np.count_nonzero(np.frombuffer(data, dtype=np.uint8) & 0xC0 == 0x80))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    repeated = 0
    if n >= WINDOW:
        w = windows(word_hashes(data, starts, ends), WINDOW)
        s = np.sort(w)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(w, twice))
            cover = np.zeros(n + 1, dtype=np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(cover[:n])))
    return n, chars, symbols, dup, repeated


# --- n-grams
def cleaned(text: str) -> bytes:
    """The bytes of a text that the model sees."""
    return b" ".join(text.encode("utf-8", "surrogatepass").replace(b"\0", b"\1").split())


def half_of(part: bytes) -> int:
    """The half, 0 or 1, of a cleaned text; equal texts share it."""
    return zlib.crc32(part) & 1


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each after ORDER - 1 zero bytes, and the lengths of the texts."""
    return joined([cleaned(t) for t in texts])


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pad = b"\0" * (ORDER - 1)
    return np.frombuffer(b"".join(pad + p for p in parts), dtype=np.uint8), np.array([len(p) for p in parts], dtype=np.int64)


def codes(data: np.ndarray) -> np.ndarray:
    """The codes of the n-grams that end at each byte that is not padding, in order."""
    if len(data) < ORDER:
        return np.empty(0, dtype=np.int64)
    v = np.zeros(len(data) - ORDER + 1, dtype=np.int64)
    for i in range(ORDER):
        v = v << 8 | data[i : i + len(v)]
    return v[data[ORDER - 1 :] != 0]


def counted(df: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, half, gram, n): how often each n-gram stands in the documents of a language and half."""
    rows = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        sums: dict[tuple[str, int], list] = {}

        def emit():
            for (name, half), parts in sums.items():
                gram, n = added(parts)
                yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(len(gram), np.int32), [name]).cast(pa.string()), pa.array(np.full(len(gram), half, np.int32)), pa.array(gram), pa.array(n)], names=["lang", "half", "gram", "n"])
            sums.clear()

        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                by: dict[tuple[str, int], list[bytes]] = {}
                for name, t in zip(batch.column("lang").to_pylist(), map(cleaned, texts_of(batch.column("text"))), strict=True):
                    by.setdefault((name, half_of(t)), []).append(t)
                for key, texts in by.items():
                    place, gram = pd.factorize(codes(joined(texts)[0]))
                    if len(gram):
                        parts = sums.setdefault(key, [])
                        parts.append((gram, np.bincount(place, minlength=len(gram))))
                        if len(parts) > 8:
                            sums[key] = [added(parts)]
            if sum(len(p[0]) for x in sums.values() for p in x) > FLUSH:
                yield from emit()
        yield from emit()

    return rows.mapInArrow(run, "lang string, half int, gram long, n long").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n"))


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    place, gram = pd.factorize(np.concatenate([p[0] for p in parts]))
    return gram, np.bincount(place, weights=np.concatenate([p[1] for p in parts]), minlength=len(gram)).astype(np.int64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts by count (0, 1, 2, 3 and more) from the counts of counts, by the published estimate."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


class Model:
    """Sorted codes and probabilities, sorted contexts and backoff weights, from order 1 up."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def of(cls, gram: np.ndarray, n: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None, tops: dict[int, tuple] | None = None) -> Model:
        """From the counts of the highest order.

        Those of one block come with what lies beyond it: ``pairs``, the sorted codes and counts of order 2, and ``tops``, the
        counts of counts of the orders above.
        """
        order = np.argsort(gram)
        counts = [(gram[order], n[order].astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):
            low, c = pairs if pairs is not None and k == 2 else np.unique(counts[-1][0] & ((1 << 8 * k) - 1), return_counts=True)
            counts.append((low, c.astype(np.float64)))
        levels, below = [], None
        for k, (g, c) in enumerate(reversed(counts), 1):
            of = (tops or {}).get(k) or tuple(int((c == i).sum()) for i in (1, 2, 3, 4))
            d = discounts(*of)[np.minimum(c, 3).astype(np.int64)]
            context, first = np.unique(g >> 8, return_index=True)
            total = np.add.reduceat(c, first)
            gamma = np.add.reduceat(d, first) / total
            size = np.diff(np.r_[first, len(g)])
            under = 1 / 256 if below is None else below[1][np.searchsorted(below[0], g & ((1 << 8 * (k - 1)) - 1))]
            p = (c - d) / np.repeat(total, size) + np.repeat(gamma, size) * under
            below = (g, p)
            levels.append((g, p.astype(np.float32), context, gamma.astype(np.float32)))
        return cls(levels)

    def log2(self, gram: np.ndarray) -> np.ndarray:
        """log2 P(last byte | bytes before) of highest-order codes."""
        out = np.zeros(len(gram))
        todo = np.arange(len(gram))
        for k in range(len(self.levels), 0, -1):
            g, p, context, gamma = self.levels[k - 1]
            if not len(g):
                continue
            c = gram[todo] & ((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(g, c), len(g) - 1)
            hit = g[at] == c
            out[todo[hit]] += np.log2(p[at[hit]])
            todo, c = todo[~hit], c[~hit] >> 8
            at = np.minimum(np.searchsorted(context, c), len(context) - 1)
            known = context[at] == c
            out[todo[known]] += np.log2(gamma[at[known]])
        out[todo] += np.log2(1 / 256)
        return out

    def tobytes(self) -> bytes:
        """The lengths of the levels, all codes and contexts, then all probabilities and weights."""
        sizes = [len(self.levels), *(n for g, _, context, _ in self.levels for n in (len(g), len(context)))]
        whole = [a.astype("<i8") for g, _, context, _ in self.levels for a in (g, context)]
        parts = [a.astype("<f4") for _, p, _, gamma in self.levels for a in (p, gamma)]
        return b"".join(a.tobytes() for a in [np.array(sizes, dtype="<i8"), *whole, *parts])

    @classmethod
    def frombytes(cls, data: bytes) -> Model:
        """Views of ``data``: a worker holds a model once."""
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, arrays = np.frombuffer(data, "<i8", 2 * n, 8).tolist(), 8 + 16 * n, []
        for kind, width in (("<i8", 8), ("<f4", 4)):
            for size in sizes:
                arrays.append(np.frombuffer(data, kind, size, at) if size else np.empty(0, kind))
                at += width * size
        return cls([(arrays[2 * i], arrays[2 * (n + i)], arrays[2 * i + 1], arrays[2 * (n + i) + 1]) for i in range(n)])


def pair_of(gram):
    """The two bytes before the last, of codes in numpy or in a column."""
    return F.shiftright(gram, 8).bitwiseAND(PAIRS - 1) if isinstance(gram, Column) else gram >> 8 & PAIRS - 1


class Counts:
    """The n-gram counts of a table, and what a block needs to know of the others."""

    def __init__(self, df: DataFrame, *, lang: str = "lang", text: str = "text", max_grams: int = MAX_GRAMS):
        path = self.path = work_dir(df.sparkSession)
        self.table = stored(counted(df, lang, text), f"{path}/{ORDER}")
        orders = {ORDER: self.table}
        for k in range(ORDER - 1, 1, -1):
            low = F.col("gram").bitwiseAND((1 << 8 * k) - 1)
            orders[k] = stored(orders[k + 1].groupBy("lang", "half", low.alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"{path}/{k}")
        seen = [t.groupBy("lang", "half").agg(F.lit(k).alias("k"), *[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]) for k, t in orders.items() if k > 2]
        self.tops: dict[tuple[str, int], dict[int, tuple]] = {}
        for r in reduce(DataFrame.unionByName, seen).collect():  # a row a language, half and order
            self.tops.setdefault((r["lang"], r["half"]), {})[r["k"]] = tuple(r[f"n{i}"] for i in (1, 2, 3, 4))
        pairs = orders[2].toPandas().sort_values(["lang", "half", "gram"])  # at most 65,536 rows a language and half
        self.pairs = {key: (t["gram"].to_numpy(), t["n"].to_numpy()) for key, t in pairs.groupby(["lang", "half"])}
        #: The pairs (first, last) of each block.
        self.blocks, first, total = [], 0, 0
        for r in sorted(self.table.groupBy(pair_of(F.col("gram")).alias("pair")).count().collect()):  # at most 65,536 rows
            if total and total + r["count"] > max_grams:
                self.blocks.append((first, r["pair"] - 1))
                first, total = r["pair"], 0
            total += r["count"]
        self.blocks.append((first, PAIRS - 1))

    def models(self, block: tuple[int, int]) -> dict[tuple[str, int], bytes]:
        """The model of each language and half for the pairs of a block; one without n-grams there has the two lowest orders."""
        pairs, tops = self.pairs, self.tops

        def build(key, t):
            name, half = key[0].as_py(), key[1].as_py()
            data = Model.of(np.asarray(t.column("gram")), np.asarray(t.column("n")), pairs[name, half], tops[name, half]).tobytes()
            return pa.table({"lang": pa.array([name], pa.string()), "half": pa.array([half], pa.int32()), "data": pa.array([data], pa.binary())})

        rows = self.table if block == (0, PAIRS - 1) else self.table.where(pair_of(F.col("gram")).between(*block))
        made = {(r["lang"], r["half"]): bytes(r["data"]) for r in rows.groupBy("lang", "half").applyInArrow(build, "lang string, half int, data binary").collect()}
        none = np.empty(0, dtype=np.int64)
        return {key: made.get(key) or Model.of(none, none, pairs[key], tops[key]).tobytes() for key in pairs}


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_OUT = [T.StructField(m, T.LongType()) for m in MEASURES] + [T.StructField("base_failed", T.BooleanType()), T.StructField("log2_perplexity", T.DoubleType())]


def measured(df: DataFrame, models: Broadcast, block: tuple[int, int] = (0, PAIRS - 1), *, lang: str = "lang", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the base measures, ``base_failed`` and ``log2_perplexity`` (null without a byte of text)."""
    kept = [f for f in without(df, "kept", *[f.name for f in _OUT]) if keep_text or f.name != text]
    schema = T.StructType(kept + _OUT)
    score_of = _scorer(models, block, lang, text)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                texts = texts_of(batch.column(text))
                rows = [base_measures(t) for t in texts]
                failed = [r[0] < 10 or 100 * r[4] > 20 * r[0] for r in rows]
                arrays = [batch.column(f.name) for f in kept] + [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)] + [pa.array(failed, pa.bool_()), pa.array(score_of(batch, texts), pa.float64(), from_pandas=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def added_block(rows: DataFrame, models: Broadcast, block: tuple[int, int], *, lang: str = "lang", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``rows`` of an earlier pass, with the share of one more block in ``log2_perplexity``."""
    kept = [f for f in rows.schema.fields if keep_text or f.name != text]
    score_of = _scorer(models, block, lang, text)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                more = np.asarray(batch.column("log2_perplexity").to_numpy(zero_copy_only=False), dtype=np.float64) + score_of(batch, texts_of(batch.column(text)))
                arrays = [pa.array(more, pa.float64(), from_pandas=True) if f.name == "log2_perplexity" else batch.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept])

    return rows.mapInArrow(run, T.StructType(kept))


def _scorer(sent: Broadcast, block: tuple[int, int], lang: str, text: str):
    """A function from a batch and its texts to the share of a block in their log2 perplexities (NaN without a byte)."""
    made: dict[tuple[str, int], Model] = {}

    def score_of(batch, texts: list[str]) -> np.ndarray:
        score = np.full(len(texts), np.nan)
        langs = np.array([x if x is not None else "" for x in batch.column(lang).cast(pa.string()).to_pylist()], dtype=object)
        parts = [cleaned(t) for t in texts]
        other = np.array([1 - half_of(p) for p in parts])
        for key in set(zip(langs, other.tolist(), strict=True)):
            at = np.flatnonzero((langs == key[0]) & (other == key[1]))
            data, lengths = joined([parts[i] for i in at])
            gram = codes(data)
            inside = slice(None) if block == (0, PAIRS - 1) else np.flatnonzero((pair_of(gram) >= block[0]) & (pair_of(gram) <= block[1]))
            place, distinct = pd.factorize(gram[inside])
            bits = np.zeros(len(gram))
            if len(distinct):
                if key not in made:
                    made[key] = Model.frombytes(sent.value[key]) if key in sent.value else Model([])
                bits[inside] = made[key].log2(distinct)[place]
            ends, bits = np.cumsum(lengths), np.r_[0.0, np.cumsum(bits)]
            with np.errstate(invalid="ignore", divide="ignore"):
                score[at] = -(bits[ends] - bits[ends - lengths]) / lengths
        return score

    return score_of


def judged(df: DataFrame, *, lang: str = "lang", text: str = "text", keep_text: bool = True, width: float = WIDTH, low_width: float = LOW_WIDTH, max_grams: int = MAX_GRAMS) -> DataFrame:
    """``df`` with the measures, ``log2_perplexity`` and ``kept``."""
    counts, path, rows = Counts(df, lang=lang, text=text, max_grams=max_grams), work_dir(df.sparkSession), df
    for i, block in enumerate(counts.blocks):
        step = added_block if i else measured
        models = df.sparkSession.sparkContext.broadcast(counts.models(block))
        rows = stored(step(rows, models, block, lang=lang, text=text, keep_text=keep_text or i + 1 < len(counts.blocks)), f"{path}/{i}")
        models.destroy()
    remove_dir(df.sparkSession, counts.path)
    names, key = [f.name for f in rows.schema.fields], F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(""))
    packed = rows.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), key.alias("key"))
    of = lambda name: F.col("row").getField(name)
    length, score = F.greatest(of("word_chars") + of("n_words"), F.lit(1)), of("log2_perplexity")
    good = packed.where(~of("base_failed") & score.isNotNull())
    bounds = stored(bands(good, score, length), work_dir(df.sparkSession) + "/bands")
    out = packed.join(bounds, "key", "left")
    reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_IQR)) * F.sqrt(F.greatest(F.col("typical") / length, F.lit(1.0)))
    inside = F.coalesce(score.between(F.col("q1") - low_width * reach, F.col("q3") + width * reach), F.lit(False))
    return out.select(*[of(n).alias(n) for n in names], (~of("base_failed") & inside).alias("kept"))


def bands(rows: DataFrame, score: Column, length: Column) -> DataFrame:
    """(key, q1, q3, typical): quartiles of the score and the median length of each key.

    Read off histograms (``SCORE_BINS`` bins a bit, ``LENGTH_BINS`` a doubling), so they do not depend on the order in which
    partial results meet.
    """

    def quantiles(value: Column, shares: list[float], names: list[str]) -> DataFrame:
        bins = rows.groupBy("key", value.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        every = Window.partitionBy("key")  # some thousand bins a key
        upto = bins.select("key", "bin", F.sum("n").over(every.orderBy("bin")).alias("upto"), F.sum("n").over(every).alias("of"))
        return upto.groupBy("key").agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("of") * q), F.col("bin"))).alias(n) for q, n in zip(shares, names, strict=True)])

    scores = quantiles(F.round(score * SCORE_BINS), [0.25, 0.75], ["low", "high"]).select("key", (F.col("low") / SCORE_BINS).alias("q1"), (F.col("high") / SCORE_BINS).alias("q3"))
    lengths = quantiles(F.round(F.log2(length.cast("double")) * LENGTH_BINS), [0.5], ["middle"]).select("key", F.pow(F.lit(2.0), F.col("middle") / LENGTH_BINS).alias("typical"))
    return scores.join(lengths, "key")


def quality_filter(df: DataFrame, *, lang: str = "lang", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that are kept, with their columns, whatever these are called."""
    rows, name = numbered(df)
    kept = judged(rows, lang=name[lang], text=name[text], **options).where("kept")
    return kept.select(*[F.col(name[c]).alias(c) for c in df.columns])
