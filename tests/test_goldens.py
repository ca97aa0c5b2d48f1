"""Known results of the operators, errors, laws and adversarial rows."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tokenloom import api
from tokenloom.errors import Error, TokenizerError
from tokenloom.functions import bytelevel, decoders, normalizers, patterns, splitters
from tokenloom.operators import merging
from tokenloom.operators.segments import segments
from tokenloom.plans import toy
from tokenloom.sources import artifacts


def value(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("v")).first()["v"]


split = lambda **k: splitters.compile_pretokenizer({"type": "Split", **k})
literal = lambda s, b="Removed": split(pattern={"String": s}, behavior=b)
# Published patterns, texts and their pieces.
QWEN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
NUMBERS = "The number 1 then 234 then 5."

PIECES = [
    (split(pattern={"Regex": patterns.RANK_PATTERN}), "How are you doing?", ["How", " are", " you", " doing", "?"]),
    (split(pattern={"Regex": QWEN}), "Hello's world\n  test", ["Hello", "'s", " world", "\n", " ", " test"]),
    (lambda c: splitters.digits(c, individual=True), NUMBERS, ["The number ", "1", " then ", "2", "3", "4", " then ", "5", "."]),
    (splitters.digits, NUMBERS, ["The number ", "1", " then ", "234", " then ", "5", "."]),
    (splitters.byte_level, "Hello World", ["ĠHello", "ĠWorld"]),
    (lambda c: splitters.byte_level(c, add_prefix_space=False), "Hello World", ["Hello", "ĠWorld"]),
    (lambda c: splitters.byte_level(c, add_prefix_space=False, pattern="o"), "Hello World", ["Hell", "o", "ĠW", "o", "rld"]),
    (splitters.compile_pretokenizer({"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, {"type": "ByteLevel", "add_prefix_space": False}]}), NUMBERS, ["The", "Ġnumber", "Ġ", "1", "Ġthen", "Ġ", "2", "3", "4", "Ġthen", "Ġ", "5", "."]),
    (literal(" "), "Hello world!", ["Hello", "world!"]),
    (literal("."), "Hello.world.test", ["Hello", "world", "test"]),
    (literal("+"), "a+b+c", ["a", "b", "c"]),
    (literal("["), "a[b[c", ["a", "b", "c"]),
    (literal("xyz"), "Hello world", ["Hello world"]),
    (literal("-"), "", [""]),
    (literal("-"), "a", ["a"]),
    (literal("-", "MergedWithPrevious"), "the-final--countdown", ["the-", "final-", "-", "countdown"]),
    (literal("-", "MergedWithPrevious"), "-hello-world", ["-", "hello-", "world"]),
    (literal("-", "MergedWithPrevious"), "hello-world-", ["hello-", "world-"]),
    (literal("-", "Isolated"), "the-final--countdown", ["the", "-", "final", "-", "-", "countdown"]),
    (literal("-", "Isolated"), "---", ["-", "-", "-"]),
    (literal("-", "Isolated"), "hello-", ["hello", "-"]),
    (literal("-", "Isolated"), "", [""]),
    (split(pattern={"Regex": patterns.RANK_PATTERN}), "  \u000b\u000b x", ["  ", "\u000b\u000b", " x"]),
    (split(pattern={"Regex": patterns.RANK_PATTERN}), "it'ſab", ["it", "'ſ", "ab"]),
]


@pytest.mark.parametrize("case", range(len(PIECES)))
def test_pieces(spark, case):
    make, text, want = PIECES[case]
    assert value(spark, text, make) == want


def test_refusals():
    for bad in ({"type": "Split", "pattern": {"String": "-"}, "behavior": "MergedWithNext"}, {"type": "Split", "pattern": {"String": "-"}, "invert": True}, {"type": "Whitespace"}, None):
        with pytest.raises(TokenizerError):
            splitters.compile_pretokenizer(bad)
    for bad in ("a*", "(", "x|"):
        with pytest.raises(TokenizerError) as e:
            patterns.to_java(bad)
        assert e.value.code is Error.REGEX_FAILURE
    with pytest.raises(TokenizerError):
        normalizers.compile_normalizer({"type": "Lowercase"})
    with pytest.raises(TokenizerError):
        decoders.compile_decoder({"type": "WordPiece"})
    assert patterns.escape("a.b") == "a\\.b" and patterns.tier(patterns.RANK_PATTERN) == 1 and patterns.tier(QWEN) == 2


def test_offsets(spark):
    pairs = lambda t, p: [(x["start"], x["end"]) for x in value(spark, t, lambda c: patterns.match_offsets(c, p))]
    assert pairs("Hello world", r"\w+") == [(0, 5), (6, 11)]
    assert pairs("user@example.com", r"(?<=@)\w+") == [(5, 12)]
    assert pairs("é b", r"[a-z]+") == [(3, 4)]


def test_normalizers(spark):
    norm = lambda t, s: value(spark, t, lambda c: normalizers.compile_normalizer(s)(F.array(c))[0])
    assert norm("Hello World Test", {"type": "Replace", "pattern": {"String": " "}, "content": "▁"}) == "Hello▁World▁Test"
    assert norm("Hello   World\t\tTest", {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": "_"}) == "Hello_World_Test"
    assert norm("banana split", {"type": "Sequence", "normalizers": [{"type": "Replace", "pattern": {"String": "a"}, "content": "X"}, {"type": "Replace", "pattern": {"String": " "}, "content": "▁"}]}) == "bXnXnX▁split"
    assert norm("é", {"type": "NFC"}) == "é" and norm("a$1", {"type": "Replace", "pattern": {"Regex": "a"}, "content": "$0\\"}) == "$0\\$1"


def test_decoders(spark):
    run = lambda t, s: bytes(value(spark, t, decoders.compile_decoder(s)))
    fallback = {"type": "ByteFallback"}
    assert [run(t, fallback) for t in ("<0x41>", "<0x00>", "<0xGG>", "<0x>", "<0x100>", "<0x4G>")] == [b"A", b"\0", b"<0xGG>", b"<0x>", b"<0x100>", b"\x04"]
    assert run("▁Hello▁world▁!", {"type": "Replace", "pattern": {"String": "▁"}, "content": " "}) == b" Hello world !"
    assert run("ĠHi", {"type": "ByteLevel"}) == b" Hi" and run("a世", {"type": "ByteLevel"}).startswith(b"a[UNK_BYTE_0xe4b896")
    assert run("x", {"type": "Sequence", "decoders": [{"type": "Fuse"}]}) == b"x"
    data = bytes(range(256)).decode("latin-1")
    assert value(spark, data, lambda c: bytelevel.to_bytes(bytelevel.to_printable(c))) == bytearray(data.encode())


@pytest.mark.parametrize("text,want", [("bGxhbWE=", b"llama"), ("", None), ("llama", None), ("tet", None), ("bGxh\nbWE=", None), ("bGxhbWE=\n", None), ("A===", None)])
def test_base64(spark, text, want):
    got = value(spark, text, artifacts.strict_base64)
    assert (bytes(got) if got is not None else None) == want


@pytest.mark.parametrize("name,code", [("base64", Error.BASE64_DECODE_FAILURE), ("rank", Error.ENCODE_FAILURE), ("space", Error.PARSE_FAILURE)])
def test_bad_rank_files(spark, tmp_path, name, code):
    line = {"base64": "tet 0", "rank": "ICAgICAgIA== 18446744073709551616", "space": "ICAgICAgIA==10"}[name]
    (tmp_path / "m").write_text(line)
    with pytest.raises(TokenizerError) as e:
        artifacts.read_rank_file(spark, str(tmp_path / "m"))
    assert e.value.code is code
    with pytest.raises(TokenizerError) as e:
        artifacts.read_rank_file(spark, str(tmp_path / "none"))
    assert e.value.code is Error.LOAD_FAILURE


def test_rank_tokenizer_laws(spark, tmp_path):
    import base64

    tokens = toy.rank_tokens()
    (tmp_path / "m").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for t, i in tokens.items()))
    t = api.Tiktoken(spark, specials=toy.SPECIALS, bos_index=2, eos_index=3).load(str(tmp_path / "m"))
    assert t.vocab_size == len(tokens) + 4 and t.bos_tok == len(tokens) + 2
    for text in ("the nation 😀 é\n", "[INST]Hello[/INST] 12", "x" * 300):
        ids = t.encode_text(text)
        assert t.decode_batch(ids) == text.encode()
        assert len(t.encode_text(text, bos=1, eos=1)) == len(ids) + 2 and t.encode_text(text, bos=-1) == ids
    assert t.encode_text("", bos=1, eos=1) == [t.bos_tok, t.eos_tok]
    assert t.encode_text("[INST]", allowed_special="none") != t.encode_text("[INST]") == [len(tokens)]
    with pytest.raises(TokenizerError) as e:
        t.decode_batch([10**6])
    assert e.value.code is Error.DECODE_FAILURE
    with pytest.raises(TokenizerError) as e:
        api.Tiktoken(spark).encode_text("a")
    assert e.value.code is Error.UNINITIALIZED


def description(**more):
    """A JSON description over the letters of a greeting: three specials, the space mark, then letters in order of code point."""
    vocab = {"<unk>": 0, "<s>": 1, "</s>": 2, "▁": 3} | {c: i for i, c in enumerate(sorted(set("Helloworld!")), 4)}
    vocab |= {"ll": len(vocab), "ell": len(vocab) + 1}
    added = [{"id": i, "content": c} for c, i in vocab.items() if i < 3]
    mark = {"type": "Replace", "pattern": {"String": " "}, "content": "▁"}
    split = {"type": "Split", "pattern": {"Regex": r"▁?[\p{L}]+|[^\p{L}]"}, "behavior": "MergedWithPrevious"}
    back = {"type": "Replace", "pattern": {"String": "▁"}, "content": " "}
    return {"added_tokens": added, "normalizer": {"type": "Sequence", "normalizers": [mark]}, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split]}, "decoder": back, "model": {"type": "BPE", "vocab": vocab, "merges": [["l", "l"], ["e", "ll"], "h e"]}} | more


def test_json_description(spark, tmp_path):
    spec = description()
    id_of = spec["model"]["vocab"]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    t = api.HFTokenizer(spark).load(str(tmp_path / "t.json"))
    ids = t.encode_text("Hello world!</s>", bos=1)
    assert ids == [t.bos_tok, *(id_of[x] for x in ("H", "ell", "o", "▁", "w", "o", "r", "l", "d", "!")), 2]
    assert t.decode_batch(ids[1:]) == b"Hello world!</s>" and t.decode(id_of["▁"]) == b" "
    rows = t.decode_df(spark.createDataFrame([(1, ids[1:]), (1, [id_of["H"]]), (2, []), (3, None), (4, [999])], "doc_id long, ids array<bigint>")).collect()
    assert sorted((x["doc"], x["text"] or "", x["error"] or "") for x in rows) == [(1, "H", ""), (1, "Hello world!</s>", ""), (2, "", ""), (3, "", ""), (4, "", "DecodeFailure")]
    # a folder, with and without a configuration
    (tmp_path / "tokenizer.json").write_text(json.dumps(spec))
    assert api.HFTokenizer(spark).load(str(tmp_path)).bos_tok == t.bos_tok
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"bos_token": {"content": "</s>"}, "eos_token": "<s>"}))
    named = api.HFTokenizer(spark).load(str(tmp_path))
    assert (named.bos_tok, named.eos_tok) == (2, 1)
    assert api.get_tokenizer(spark, str(tmp_path / "t.json"), str(tmp_path / "tokenizer_config.json")).bos_tok == 2
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"bos_token": "none", "eos_token": "<s>"}))
    for bad in (str(tmp_path), str(tmp_path / "absent.json")):
        with pytest.raises(TokenizerError) as e:
            api.HFTokenizer(spark).load(bad)
        assert e.value.code is Error.LOAD_FAILURE
    (tmp_path / "t.json").write_text(json.dumps(description(decoder=None)))
    with pytest.raises(TokenizerError):
        api.HFTokenizer(spark).load(str(tmp_path / "t.json"))


def test_cased_json(spark, tmp_path):
    import base64

    vocab = [{"rank": i, "token_bytes": base64.b64encode(bytes([i])).decode(), "token_str": None} for i in range(256)]
    spec = {"config": {"pattern": patterns.CASED_PATTERN, "num_vocab_tokens": 256, "default_vocab_size": 300, "default_num_special_tokens": 30, "version": "v3"}, "vocab": vocab}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    t = api.Tekken(spark).load(str(path))
    assert (t.vocab_size, t.bos_tok, t.eos_tok, t.version) == (286, 1, 2, "v3")
    assert t.encode_text("[INST]Hi[/INST]") == [3, 72 + 30, 105 + 30, 4]
    spec["vocab"][5]["rank"] = 9
    path.write_text(json.dumps(spec))
    with pytest.raises(TokenizerError):
        api.Tekken(spark).load(str(path))


def test_scored_binary(spark, tmp_path):
    rows = [(b"<unk>", 0.0), (b"<s>", 0.0), (b"</s>", 0.0), *[(b"<0x%02X>" % b, 0.0) for b in range(256)], ("▁".encode(), -1.0), (b"h", -1.0), (b"i", -1.0), (b"hi", -0.5), ("▁hi".encode(), -0.2)]
    path = str(tmp_path / "m.bin")
    artifacts.write_llama2c(rows, path, bos=1, eos=2)
    t = api.Llama2c(spark).load(path)
    assert (t.vocab_size, t.bos_tok, t.eos_tok) == (len(rows), 1, 2)
    ids = t.encode_text("hi é", bos=1, eos=1)
    assert ids == [1, 263, 259, 0xC3 + 3, 0xA9 + 3, 2]
    assert t.decode(263, 1) == b"hi" and t.decode(263, 5) == b" hi" and t.decode(0xC3 + 3, 1) == b"\xc3"
    for bad, code in ((lambda: t.decode(64000), Error.OUT_OF_RANGE), (lambda: t.encode_text(""), Error.ENCODE_FAILURE), (lambda: t.encode_text("a", bos=-1), Error.ENCODE_FAILURE)):
        with pytest.raises(TokenizerError) as e:
            bad()
        assert e.value.code is code
    (tmp_path / "short.bin").write_bytes(struct.pack("<4i", 3, 1, 2, 4) + struct.pack("<fi", 1.0, 1) + b"a")
    assert artifacts.load_llama2c(str(tmp_path / "short.bin")).options["by_id"] == [b"a", b"<pad>", b"<pad>"]


def test_piece_model(spark):
    sp = pytest.importorskip("sentencepiece")
    pub = pytest.importorskip("public_tokenizers")
    path = pub.path("piece_bpe_32k.model")
    lib, t = sp.SentencePieceProcessor(model_file=path), api.SentencePiece(spark).load(path)
    for text in ("Hello world!", "The quick  brown fox", "Grüße aus Köln", "日本 😀"):
        assert t.encode_text(text) == lib.encode(text)
    assert t.vocab_size == 32000 and t.encode_text("Hello world!", bos=1)[0] == 1


def test_kernels_agree_with_plain_search():
    import random

    r = random.Random(1)
    tokens = toy.rank_tokens()

    def plain(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best = min(((tokens[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in tokens), default=None)
            if best is None:
                return [tokens[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    kernel = merging.RankMerge(tokens=tokens)
    for _ in range(300):
        piece = "".join(r.choice([" the", "ing", "tion", "e", "n", " ", "ó", "t", "h"]) for _ in range(r.randint(1, 8)))
        assert kernel.encode(piece) == ([tokens[piece.encode()]] if piece.encode() in tokens else plain(piece.encode()))


def test_segments_and_long_input(spark):
    assert value(spark, "a<s>\nb</s><s>", lambda c: segments(c, {"<s>": 1, "</s>": 2})) == ["a", "<s>", "\nb", "</s>", "<s>"]
    text = "a" * 60 + " " * 9 + "b " * 20 + "c" * 31
    parts = value(spark, text, lambda c: splitters.long_input_parts(c, most_chars=50, most_run=12))
    assert "".join(parts) == text and all(len(x) <= 12 for p in parts for x in p.split())


def test_streaming_encode(spark, tmp_path):
    from tokenloom.streaming.encode import encode_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("the nation\nof men\n")
    stream = encode_stream(spark.readStream.schema("text string").text(str(tmp_path / "in")), toy.rank_tokenizer(spark))
    q = stream.writeStream.format("memory").queryName("encoded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(len(x["ids"]) > 0 for x in spark.table("encoded").collect()) == [True, True]


def test_public_vocabularies(spark):
    """Ids of whole documents against the libraries; ``!`` has id 0, which drops a piece by rule."""
    lib, pub, sp = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.replace("text", F.lit("!"), F.lit("?")).alias("text"))
    path = pub.path("byte_bpe_50k.json")
    t, want = api.HFTokenizer(spark).load(path), lib.Tokenizer.from_file(path)
    rows = t.encode_df(docs).collect()
    assert rows and all(x["ids"] == want.encode(x["text"], add_special_tokens=False).ids for x in rows)
    assert t.encode_text("!~!~") == [] != want.encode("!~!~").ids and t.encode_text("Hi!") == want.encode("Hi!").ids
    path = pub.path("piece_bpe_32k.model")
    t, want = api.SentencePiece(spark).load(path), sp.SentencePieceProcessor(model_file=path)
    assert all(x["ids"] == want.encode(x["text"]) for x in t.encode_df(docs).collect())
    hello = want.piece_to_id("▁Hello")
    assert [t.decode(hello, 1), t.decode(hello, 5), t.decode(1, 5), t.decode(want.piece_to_id("<0x0A>"), 5)] == [b"Hello", b" Hello", b" ", b"\n"]


def test_equal_tokens_all_decode(spark, tmp_path):
    rows = [(b"<unk>", 0.0), (b"<s>", 0.0), (b"</s>", 0.0), (b" ", -1.0), (b"a", -1.0), (b"a", -2.0), (b" b", -1.0)]
    path = str(tmp_path / "m.bin")
    artifacts.write_llama2c(rows, path, bos=1, eos=2)
    t = api.Llama2c(spark).load(path)
    assert t.decode(4) == t.decode(5) == b"a" and t.encode_text("a") == [3, 4]
    got = t.decode_df(spark.createDataFrame([(1, [1, 6, 5, 6]), (2, [99])], "doc_id long, ids array<bigint>")).orderBy("doc").collect()
    assert (bytes(got[0]["data"]), got[1]["error"]) == (b"<s>ba b", "OutOfRange")


def test_long_runs_merge_in_time():
    import time

    tokens = toy.rank_tokens() | {b"a" * 2**i: 1000 + i for i in range(1, 8)}
    start = time.time()
    ids = merging.RankMerge(tokens=tokens).encode("a" * 200_000 + "b")
    assert time.time() - start < 20 and ids == [1007] * 1562 + [1006, ord("b")]


def test_ids_are_worked_out_once(spark):
    rows = spark.createDataFrame([("the nation",)], "text string")
    out = toy.rank_tokenizer(spark).encode_df(rows).select(F.explode("ids").alias("id"))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and out.count() > 0


def test_padded_byte_digits(spark):
    run = lambda t: bytes(value(spark, t, decoders.byte_fallback))
    assert run("<0x" + "0" * 20 + "41>") == b"A" and run("<0x" + "1" * 20 + ">") == b"<0x" + b"1" * 20 + b">"


def test_fallback_hook():
    try:
        patterns.register_fallback(lambda p: "x+" if p == "(" else None)
        assert patterns.to_java("(") == "x+"
        with pytest.raises(TokenizerError):
            patterns.to_java("[")
    finally:
        patterns.register_fallback(None)


def test_wrappers(spark, tmp_path):
    import base64

    import tokenloom
    from tokenloom.tools import convert, tokenize

    pub = pytest.importorskip("public_tokenizers")
    assert all(hasattr(tokenloom, n) for n in tokenloom.__all__)
    (tmp_path / "m").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for t, i in toy.rank_tokens().items()))
    t = tokenloom.RankWrapper.get_instance(spark, str(tmp_path / "m"))
    assert t is tokenloom.RankWrapper.get_instance(spark, str(tmp_path / "m")) and t.n_words == len(toy.rank_tokens()) + 256
    special = list(t.model.artifact.specials)[5]
    rows = spark.createDataFrame([(f"the {special} nation",)], "text string")
    ids = lambda **k: rows.select(t.encode("text", bos=True, eos=False, **k)["ids"].alias("i")).first()["i"]
    plain, named = ids(), ids(allowed_special={special})
    assert plain[0] == t.bos_id and t.model.artifact.specials[special] in named and t.model.artifact.specials[special] not in plain
    assert ids(allowed_special="all") == named and t.model.decode_batch(plain[1:]).decode() == f"the {special} nation"
    assert t.model.decode_batch(ids(most_chars=7, most_run=3)[1:]).decode() == f"the {special} nation" and len(ids(most_chars=7, most_run=3)) > len(plain)
    with pytest.raises(Exception, match="disallowed"):
        ids(disallowed_special="all")
    p = tokenloom.PieceWrapper(spark, pub.path("piece_bpe_32k.model"))
    both = spark.createDataFrame([("Hello",)], "text string").select(p.encode("text", True, True)["ids"].alias("i")).first()["i"]
    assert (both[0], both[-1]) == (p.bos_id, p.eos_id)
    j = tokenloom.JsonWrapper(spark, pub.path("byte_bpe_50k.json"))
    got = rows.select(j.encode("text", bos=True, eos=True)["ids"].alias("i")).select("i", j.decode("i").alias("t")).first()
    assert got["t"] == f"the {special} nation" and got["i"][0] != j.bos_id
    # command lines
    assert convert.main(["-t", pub.path("piece_bpe_32k.model"), "-o", str(tmp_path / "p.bin")]) == 0
    p.export(str(tmp_path / "q.bin"))
    assert (tmp_path / "p.bin").read_bytes() == (tmp_path / "q.bin").read_bytes()
    assert api.Llama2c(spark).load(str(tmp_path / "p.bin")).vocab_size == 32000
    assert tokenize.main(["sentencepiece", pub.path("piece_bpe_32k.model"), "Hello"], spark) == 0 and tokenize.main(["none"], spark) == 1
    assert len(artifacts.default_rank_specials()) == 256
    with pytest.raises(TokenizerError) as e:
        api.Tiktoken(spark, specials=["a"], bos_index=0, eos_index=1)
    assert e.value.code is Error.OUT_OF_RANGE


def test_pieces_that_the_user_defined():
    pieces = [("<unk>", 0.0, 2), ("<x>", 0.0, 4), ("<x>y", 0.0, 4), ("▁", -1.0, 1), ("a", -1.0, 1), ("<", -1.0, 1), ("x", -1.0, 1), (">", -1.0, 1), ("y", -1.0, 1), ("aa", -0.5, 1)]
    for algorithm in (1, 2):
        kernel = merging.PieceMerge(pieces=pieces, options={"algorithm": algorithm, "add_dummy_prefix": True, "unk": 0})
        assert kernel.encode("aa<x>a<x>ya") == [3, 9, 1, 4, 2, 4] and kernel.encode("<x a") == [3, 5, 6, 3, 4]


def test_models_with_a_character_map_are_refused(tmp_path):
    piece = b"\x0a\x01a\x15\x00\x00\x80\xbf"
    data = b"\x0a" + bytes([len(piece)]) + piece
    (tmp_path / "plain").write_bytes(data)
    assert artifacts.load_pieces(str(tmp_path / "plain")).pieces == [("a", -1.0, 1)]
    (tmp_path / "mapped").write_bytes(data + b"\x1a\x04\x12\x02xx")
    with pytest.raises(TokenizerError) as e:
        artifacts.load_pieces(str(tmp_path / "mapped"))
    assert e.value.code is Error.LOAD_FAILURE
