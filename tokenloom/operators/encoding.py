"""Encoding as one column expression: segments, normalizer, pieces, ids.

Segments and pieces are built-in expressions.  The last step is one Arrow function over ``array<struct<piece, special>>``
with a merge kernel and its memory of pieces, so a row is encoded where it is: no shuffle, no join, and the same
expression serves streaming frames.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import Error, TokenizerError
from ..functions.batches import in_parts, small_batches
from .merging import EncodeFault, Kernel
from .segments import segments, special_ids

RESULT = "struct<ids:array<bigint>,error:string,dropped:int>"


def pieces_of(text: Column, specials: dict[str, int], normalize: Callable[[Column], Column], cut: Callable[[Column], Column]) -> Column:
    """``array<struct<piece, special>>`` of a text: specials by id, everything else by piece."""
    known = special_ids(specials)
    named = F.transform(segments(text, specials), lambda s: F.struct(s.alias("text"), F.element_at(known, s).alias("special"))) if specials else F.transform(segments(text, specials), lambda s: F.struct(s.alias("text"), F.lit(None).cast("bigint").alias("special")))
    plain = normalize(F.transform(named, lambda s: s["text"]))
    both = F.zip_with(plain, named, lambda t, s: F.struct(t.alias("text"), s["special"].alias("special")))
    one = lambda p: F.struct(p.alias("piece"), F.lit(None).cast("bigint").alias("special"))
    return F.flatten(F.transform(both, lambda s: F.when(s["special"].isNotNull(), F.array(F.struct(F.lit("").alias("piece"), s["special"].alias("special")))).otherwise(F.transform(cut(s["text"]), one))))


def shared(value):
    """``value`` sent to each executor once; a worker unpacks it once, and what it remembers outlives a task."""
    small_batches()
    return SparkSession.active().sparkContext.broadcast(value)


def once(function):
    """Not deterministic to the optimizer, which else evaluates the function again for filters that it infers below a generator."""
    return function.asNondeterministic()


def kernel_function(kernel: Kernel, begin: list[int], end: list[int]) -> Callable:
    """An Arrow function from the pieces of a text to its ids, with begin and end ids, an error name and the number of pieces dropped."""
    sent = shared(kernel)

    @F.arrow_udf(RESULT)
    def encode(pieces: pa.Array) -> pa.Array:
        return kernel_rows(sent.value, pieces, begin, end)

    return once(encode)


def kernel_rows(kernel: Kernel, rows: pa.ListArray, begin: list[int], end: list[int]) -> pa.StructArray:
    """What ``kernel_function`` returns for a column of pieces."""
    return in_parts(lambda part: encoded(kernel, part, begin, end), rows)


def encoded(kernel: Kernel, rows: pa.ListArray, begin: list[int], end: list[int]) -> pa.StructArray:
    """The same of a part of the column: each distinct piece is merged once, and rows take ids by index."""
    flat, count = rows.flatten(), np.asarray(pc.fill_null(pc.list_value_length(rows), 0)).astype(np.int64)
    coded = pc.fill_null(flat.field("piece"), "").dictionary_encode()
    special = flat.field("special")
    is_special = np.asarray(special.is_valid())
    named = pc.fill_null(special, -1).dictionary_encode()
    # one list of ids for each distinct piece, each special, begin and end
    lists: list[list[int] | None] = []
    for text in coded.dictionary.to_pylist():
        try:
            lists.append(kernel.ids(text))
        except EncodeFault:
            lists.append(None)
    n = len(lists)
    lists += [[i] for i in named.dictionary.to_pylist()] + [begin, end]
    of_piece = np.where(is_special, n + np.asarray(named.indices), np.asarray(coded.indices)) if len(flat) else np.zeros(0, np.int64)
    size = np.array([len(x or ()) for x in lists], dtype=np.int64)
    ids = np.fromiter(chain.from_iterable(x or () for x in lists), dtype=np.int64, count=int(size.sum()))
    # the lists of each row: begin, its pieces, end
    last = np.cumsum(count + 2)
    place = np.full(int(last[-1]) if len(last) else 0, -1, dtype=np.int64)
    place[last - 1], place[last - count - 2] = len(lists) - 1, len(lists) - 2
    place[place < 0] = of_piece
    each = size[place]
    ends = np.r_[0, np.cumsum(each)]
    taken = ids[np.repeat((np.cumsum(size) - size)[place] - ends[:-1], each) + np.arange(ends[-1])]
    bounds = ends[np.r_[0, last]]
    row = np.repeat(np.arange(len(rows)), count)
    texts = pc.fill_null(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False) > 0
    odd = np.asarray(coded.indices)
    empty = np.array([x is not None and not x for x in lists[:n]], dtype=bool) & texts
    dropped = np.bincount(row[empty[odd] & ~is_special], minlength=len(rows)) if len(flat) else np.zeros(len(rows), np.int64)
    fault = np.array([x is None for x in lists[:n]], dtype=bool)
    bad = np.zeros(len(rows), dtype=bool)
    if len(flat):
        bad[row[fault[odd] & ~is_special]] = True
    none = bad | np.asarray(rows.is_null())
    out = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(taken), mask=pa.array(none))
    errors = pa.array(np.where(bad, Error.ENCODE_FAILURE.value, None), pa.string())
    return pa.StructArray.from_arrays([out, errors, pa.array(np.where(none, 0, dropped).astype(np.int32))], names=["ids", "error", "dropped"])


def text_function(kernel: Kernel, encode_text: Callable[[Kernel, str], list[int]], end: list[int]) -> Callable:
    """The same for kernels that take a whole text."""
    sent = shared(kernel)

    def encoded_texts(texts: pa.Array) -> pa.Array:
        ids, errors, own = [], [], sent.value
        for t in texts.to_pylist():
            try:
                ids.append(None if t is None else encode_text(own, t) + end)
                errors.append(None)
            except EncodeFault:
                ids.append(None)
                errors.append(Error.ENCODE_FAILURE.value)
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(errors, pa.string()), pa.array([0] * len(ids), pa.int32())], names=["ids", "error", "dropped"])

    @F.arrow_udf(RESULT)
    def encode(texts: pa.Array) -> pa.Array:
        return in_parts(encoded_texts, texts)

    return once(encode)


def repeats(id_: int, n: int) -> list[int]:
    """``n`` times an id; a negative number counts as 0."""
    return [int(id_)] * max(0, int(n))


def failfast(result: Column) -> Column:
    """The ids, or an error that ends the query."""
    return F.when(result["error"].isNotNull(), F.raise_error(result["error"]).cast("array<bigint>")).otherwise(result["ids"])


def check_loaded(artifact) -> None:
    if artifact is None:
        raise TokenizerError(Error.UNINITIALIZED, "nothing is loaded")
