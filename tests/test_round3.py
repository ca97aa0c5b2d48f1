"""Findings of round 3: odd texts come back whole, and a worker's memory is bounded."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import batches, bytelevel, decoders, patterns
from tokenloom.operators import decoding, encoding, merging
from tokenloom.plans import catalogue, toy


def peak_mb(run) -> float:
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


ODD = ["日本 😀", "a\0b", "\0", "▁", " ▁ x▁▁y ", "", " ", "\t\r\n", "<0x41>", "</s>", "plain text", None]


@pytest.mark.parametrize("name", ["piece_vocabulary", "rank_vocabulary", "json_vocabulary"])
def test_odd_texts_come_back(spark, tmp_path, name):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["digest"], r["has_tokens"]) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert got == {i: (t and hashlib.md5(t.encode()).hexdigest() or (hashlib.md5(b"").hexdigest() if t == "" else None), None if t is None else t != "") for i, t in enumerate(ODD)}


def test_batches_of_pieces_in_parts():
    n, each = 400, 5000
    pieces = pa.StructArray.from_arrays([pa.array(["the", " of", "x", "yz"] * (n * each // 4)), pa.nulls(n * each, pa.int64())], names=["piece", "special"])
    rows = pa.ListArray.from_arrays(np.arange(0, n * each + 1, each, dtype=np.int32), pieces)
    kernel = merging.RankMerge(tokens=toy.rank_tokens())
    whole = encoding.encoded(kernel, rows, [7], [8])
    assert batches.in_parts(lambda r: encoding.encoded(kernel, r, [7], [8]), rows).equals(whole)
    assert peak_mb(lambda: encoding.kernel_rows(kernel, rows, [7], [8])) < 60


def test_parts_of_no_rows_long_rows_and_nulls():
    same = lambda r: r
    for rows in ([], [None], [[1] * 600_000, None, [], [2]], [[1]] * 3):
        a = pa.array(rows, pa.list_(pa.int64()))
        assert batches.in_parts(same, a).equals(a)


def test_small_batches_in_the_session(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        encoding.shared(1)
        assert spark.conf.get(name) == f"{batches.MOST_BYTES}b"
        spark.conf.set(name, "1000b")
        encoding.shared(1)
        assert spark.conf.get(name) == "1000b"
    finally:
        spark.conf.unset(name)


def test_byte_alphabet_by_tables(spark):
    texts = [bytes(range(128)).decode(), "", None, "é€日😀\0x", *ODD]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in rows.select("t", bytelevel.to_printable(F.col("t")).alias("want"), bytelevel.printable_rows(F.col("t")).alias("got")).collect():
        assert x["got"] == x["want"]
    slow, fast = (decoders.compile_decoder({"type": "ByteLevel"}, whole_columns=w) for w in (False, True))
    tokens = spark.createDataFrame([(t,) for t in ["Ġa b", "日x", "", None, "Ġ" * 9, "ßÄ€", *map(str, bytelevel.ALPHABET)]], "t string")
    for x in tokens.select("t", slow(F.col("t")).alias("want"), fast(F.col("t")).alias("got")).collect():
        assert x["got"] == x["want"], x
    both = pa.array(["a", "日x", None, "Ġ"], pa.string())
    assert bytelevel.byte_part(both.slice(1)).to_pylist() == [bytelevel.noted("日x"), None, b" "]
    assert bytelevel.byte_part(bytelevel.printable_part(pa.array(["ü", None, ""] * 3).slice(2))).to_pylist() == [b"", "ü".encode(), None] * 2 + [b""]


def test_byte_alphabet_looks_up_no_single_characters(spark):
    plan = catalogue.byte_alphabet_round_trip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan.lower() and "rlike" not in plan.lower()


def test_offsets_in_parts():
    n, each = 400, 5000
    lengths = lambda k: pa.ListArray.from_arrays(np.arange(0, n * (each + k) + 1, each + k, dtype=np.int32), pa.array(np.arange(n * (each + k), dtype=np.int32) % 7))
    matches, gaps = lengths(0), lengths(1)
    assert patterns.offset_rows(matches, gaps).equals(patterns._summed_part(matches, gaps))
    assert peak_mb(lambda: patterns.offset_rows(matches, gaps)) < 60 < peak_mb(lambda: patterns._summed_part(matches, gaps))


def test_specials_in_parts():
    n, each = 300, 5000
    pieces = pa.StructArray.from_arrays([pa.array(["", "the", " of", "x"] * (n * each // 4)), pa.array([300, None, None, None] * (n * each // 4), pa.int64())], names=["piece", "special"])
    rows = pa.ListArray.from_arrays(np.arange(0, n * each + 1, each, dtype=np.int32), pieces)
    kernel = merging.RankMerge(tokens=toy.rank_tokens())
    assert encoding.kernel_rows(kernel, rows, [7], [8]).equals(encoding.encoded(kernel, rows, [7], [8]))
    assert peak_mb(lambda: encoding.kernel_rows(kernel, rows, [7], [8])) < 60 < peak_mb(lambda: encoding.encoded(kernel, rows, [7], [8]))


def test_decoding_in_parts():
    n, each = 300, 5000
    table = decoding.PieceTable({i: (b"ab", b"b") for i in range(100)}, 1)
    ids = pa.ListArray.from_arrays(np.arange(0, n * each + 1, each, dtype=np.int32), pa.array(np.arange(n * each) % 101))
    assert decoding.decoded_rows(table, ids).equals(table.decoded(ids))
    ids = pa.ListArray.from_arrays(ids.offsets, pa.array(np.arange(n * each) % 100))
    assert peak_mb(lambda: decoding.decoded_rows(table, ids)) < 40 < peak_mb(lambda: table.decoded(ids))


def test_characters_in_parts():
    n, each = 300, 5000
    pieces = pa.StructArray.from_arrays([pa.array(["the", "!x", "zq", "a"] * (n * each // 4)), pa.nulls(n * each, pa.int64())], names=["piece", "special"])
    rows = pa.ListArray.from_arrays(np.arange(0, n * each + 1, each, dtype=np.int32), pieces)
    kernel = merging.CharacterMerge(tokens={b"!": 0, b"a": 1, b"z": 2, b"q": 3, b"the": 4}, ranks={})
    assert encoding.kernel_rows(kernel, rows, [], []).equals(encoding.encoded(kernel, rows, [], []))
    assert peak_mb(lambda: encoding.kernel_rows(kernel, rows, [], [])) < 60 < peak_mb(lambda: encoding.encoded(kernel, rows, [], []))
