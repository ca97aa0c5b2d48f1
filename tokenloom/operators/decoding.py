"""Decoding within the row: ids are taken from a table of pieces, and a row's pieces stand side by side in Arrow.

A piece can depend on the token before it only by that being the begin token, so two tables say everything.  Nothing is
exploded, joined or shuffled, at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Error
from ..functions.batches import in_parts
from .encoding import once, shared

RESULT = "struct<data:binary,error:string>"


class PieceTable:
    """Pieces by id, and as they are after the begin token; null where an id has none."""

    def __init__(self, pieces: dict[int, tuple[bytes | None, bytes | None]], bos: int, beyond: Error = Error.DECODE_FAILURE):
        self.size, self.bos, self.beyond = max(pieces, default=-1) + 1, bos, beyond
        row = lambda k: [pieces.get(i, (None, None))[k] for i in range(self.size)]
        #: Plain pieces, pieces after begin, and a null for every other id.
        self.pieces = pa.array([*row(0), *row(1), None], pa.binary())

    def places(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        known = (ids >= 0) & (ids < self.size)
        return np.where(known, ids + self.size * (before == self.bos), 2 * self.size)

    def piece(self, token: int, before: int) -> bytes | None:
        return self.pieces[int(self.places(np.array([token]), np.array([before]))[0])].as_py()

    def error(self, token: int) -> Error:
        return Error.DECODE_FAILURE if 0 <= token < self.size else self.beyond

    def decoded(self, lists: pa.ListArray) -> pa.StructArray:
        """The bytes of each list of ids, or the name of its first error; null stays null."""
        ids = np.asarray(pc.fill_null(lists.flatten(), -1)).astype(np.int64)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        ends = np.r_[0, np.cumsum(sizes)]
        before = np.r_[0, ids[:-1]] if len(ids) else ids
        before[ends[:-1][sizes > 0]] = 0
        taken = self.pieces.take(pa.array(self.places(ids, before)))
        bad = np.flatnonzero(np.asarray(taken.is_null()))
        errors: list[str | None] = [None] * len(lists)
        for i in bad[::-1].tolist():
            errors[int(np.searchsorted(ends, i, side="right")) - 1] = self.error(int(ids[i])).value
        taken = pa.concat_arrays([pc.fill_null(taken, b"")])
        at = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
        nulls = np.asarray(lists.is_null()) | np.array([e is not None for e in errors], dtype=bool)
        data = memoryview(taken.buffers()[2]) if len(taken) and taken.buffers()[2] is not None else memoryview(b"")
        rows = [None if n else bytes(data[a:b]) for n, a, b in zip(nulls.tolist(), at[ends[:-1]].tolist(), at[ends[1:]].tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(rows, pa.binary()), pa.array(errors, pa.string())], names=["data", "error"])


def decode_function(table: PieceTable):
    """An Arrow function from ids to ``struct<data, error>``."""
    sent = shared(table)

    @F.arrow_udf(RESULT)
    def decode(ids: pa.Array) -> pa.Array:
        return decoded_rows(sent.value, ids)

    return once(decode)


def decoded_rows(table: PieceTable, ids: pa.ListArray) -> pa.StructArray:
    """What ``decode_function`` returns for a column of ids."""
    return in_parts(table.decoded, ids)


def scored_piece(piece: Column, prev: Column, bos: int) -> Column:
    """A scored token's bytes: after the begin token one leading space goes, ``<0xHH>`` is a byte, and text ends at a NUL."""
    text = F.decode(piece, "UTF-8")
    text = F.when((prev == bos) & text.startswith(" "), F.regexp_replace(text, "^ ", "")).otherwise(text)
    byte = F.regexp_extract(text, "^<0x([0-9A-Fa-f]{2})>", 1)
    return F.when(byte != "", F.when(byte == "00", F.lit(b"")).otherwise(F.unhex(byte))).otherwise(F.encode(F.regexp_extract(text, "(?s)^[^\\x00]*", 0), "UTF-8"))


def model_piece(text: Column, prev: Column, bos: int, is_control: Column, is_byte: Column) -> Column:
    """A piece model's token: control is a space, the mark is a space, one goes after the begin token, and ``<0x0A>`` is a byte, as what ``is_byte`` says."""
    spaced = F.when(is_control, " ").otherwise(F.replace(text, F.lit("▁"), F.lit(" ")))
    spaced = F.when((prev == bos) & spaced.startswith(" "), F.regexp_replace(spaced, "^ ", "")).otherwise(spaced)
    return F.when(is_byte, F.unhex(F.substring(text, 4, 2))).otherwise(F.encode(F.when(text == "<0x0A>", "\n").otherwise(spaced), "UTF-8"))
