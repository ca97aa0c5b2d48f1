"""Vocabulary files read into DataFrames (dimension tables) and checked: rank files, JSON descriptions, scored binaries, pieces.

Table schemas: vocabulary ``token BINARY, id BIGINT`` (scored ones also ``score FLOAT``), specials ``token STRING, id BIGINT``,
merges ``position BIGINT, first STRING, second STRING``.
"""

from __future__ import annotations

import base64
import json
import os
import re
import struct
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Error, TokenizerError

# --- base64 and rank lines
#: Non-empty, a multiple of four, the standard alphabet, padding at the end alone.
STRICT_BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{2}==)\z"


def strict_base64(text: Column) -> Column:
    """The decoded bytes, or null for text that is not strict base64."""
    return F.when(text.rlike(STRICT_BASE64), F.unbase64(text))


def parsed_rank_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``token, id, error`` of lines ``<base64> <rank>``; error names the code of a bad line, checked in this order."""
    line = F.col(column)
    space = F.instr(line, " ")
    left, right = F.substring_index(line, " ", 1), F.trim(F.expr(f"substring({column}, instr({column}, ' ') + 1)"))
    token = strict_base64(left)
    number = F.regexp_extract(right, r"^\+?([0-9]+)", 1)
    rank = (number != "") & (F.length(F.ltrim(number, F.lit("0"))) <= 19)
    value = number.try_cast("decimal(20,0)")
    good = rank & value.isNotNull() & (value <= F.lit("9223372036854775807").cast("decimal(20,0)"))
    error = (
        F.when(space == 0, Error.PARSE_FAILURE.value)
        .when(token.isNull(), Error.BASE64_DECODE_FAILURE.value)
        .when(~F.coalesce(good, F.lit(False)), Error.ENCODE_FAILURE.value)
    )
    return lines.select(F.when(error.isNull(), token).alias("token"), F.when(error.isNull(), value.try_cast("long")).alias("id"), error.alias("error"))


def check_bijection(vocabulary: DataFrame) -> DataFrame:
    """Tokens or ids that occur more than once: ``kind, key, n``; empty for a sound vocabulary."""
    one = lambda kind, key: vocabulary.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), "key", "n")
    return one("token", F.hex("token")).unionByName(one("id", F.col("id").cast("string")))


def read_rank_file(spark: SparkSession, path: str) -> DataFrame:
    """A rank file as a vocabulary; raises with the code of its first fault."""
    try:
        lines = spark.read.text(path)
        faults = parsed_rank_lines(lines).where("error is not null").select("error").limit(1).collect()
    except Exception as e:
        raise TokenizerError(Error.LOAD_FAILURE, f"{path}: {e}") from None
    if faults:
        raise TokenizerError(Error(faults[0]["error"]), path)
    vocabulary = parsed_rank_lines(lines).select("token", "id")
    if not check_bijection(vocabulary).isEmpty():
        raise TokenizerError(Error.PARSE_FAILURE, f"{path}: a token or rank occurs twice")
    return vocabulary


def write_rank_file(vocabulary: DataFrame, path: str) -> None:
    ordered = vocabulary.orderBy("id").select(F.concat_ws(" ", F.regexp_replace(F.base64("token"), r"\r?\n", ""), F.col("id").cast("string")))
    ordered.coalesce(1).write.mode("overwrite").text(path)


# --- artifacts held by the driver
@dataclass(frozen=True)
class Artifact:
    """What any format gives: tokens by id, specials, and what its kind of encoding needs."""

    tokens: dict[bytes, int]
    specials: dict[str, int] = field(default_factory=dict)
    merges: list[tuple[str, str]] = field(default_factory=list)
    scores: dict[int, float] = field(default_factory=dict)
    pattern: str | None = None
    normalizer: dict | None = None
    pre_tokenizer: dict | None = None
    decoder: dict | None = None
    bos: int = 0
    eos: int = 0
    version: str | None = None
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    options: dict = field(default_factory=dict)

    @property
    def size(self) -> int:
        return len(self.tokens) + len(self.specials)

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        rows = [(bytearray(t), i, float(self.scores.get(i, 0.0))) for t, i in self.tokens.items()]
        return spark.createDataFrame(rows, "token binary, id long, score float")

    def special_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.specials.items(), key=lambda x: x[1]), "token string, id long")


def load_rank(spark: SparkSession, path: str, *, pattern: str, specials: list[str], bos_index: int, eos_index: int) -> Artifact:
    """A rank file; specials are numbered from the count of its tokens."""
    if not (0 <= bos_index < len(specials) and 0 <= eos_index < len(specials)):
        raise TokenizerError(Error.OUT_OF_RANGE, "the index of a begin or end token")
    tokens = {bytes(r["token"]): r["id"] for r in read_rank_file(spark, path).collect()}  # a vocabulary: bounded
    numbered = {s: len(tokens) + i for i, s in enumerate(specials)}
    return Artifact(tokens, numbered, pattern=pattern, bos=len(tokens) + bos_index, eos=len(tokens) + eos_index)


def _json(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError) as e:
        raise TokenizerError(Error.LOAD_FAILURE, f"{path}: {e}") from None


def resolved_merges(tokens: dict[str, int], merges: list[tuple[str, str]]) -> tuple[dict[tuple[int, int], tuple[int, int]], dict[str, int]]:
    """Rules whose parts and result are all tokens, by their pair of ids (the first of a pair wins), and the least rank of each result."""
    rules: dict[tuple[int, int], tuple[int, int]] = {}
    ranks: dict[str, int] = {}
    for rank, (a, b) in enumerate(merges):
        if a in tokens and b in tokens and a + b in tokens and (key := (tokens[a], tokens[b])) not in rules:
            rules[key] = (rank, tokens[a + b])
    text_of = {i: t for t, i in tokens.items()}
    for (a, b), (rank, _) in rules.items():
        text = text_of[a] + text_of[b]
        ranks[text] = min(rank, ranks.get(text, rank))
    return rules, ranks


def guess_begin_and_end(specials: dict[str, int]) -> tuple[int, int]:
    """Ids by name: the one special that says bos or begin, eos or end; of several, the one that also says text; one side stands for both."""

    def find(*names: str) -> int | None:
        found = [s for s in specials if any(n in s for n in names)]
        if len(found) > 1:
            found = [s for s in found if "text" in s]
        return specials[found[0]] if len(found) == 1 else None

    bos, eos = find("bos", "begin"), find("eos", "end")
    return (bos if bos is not None else eos or 0), (eos if eos is not None else bos or 0)


def load_hf(path: str, *, legacy_merges: bool = False, config_path: str | None = None) -> Artifact:
    """A JSON description, or a folder that holds one with its configuration, which ``config_path`` can also name.

    Merges written as one string are skipped unless ``legacy_merges``.
    """
    config = _json(config_path) if config_path else None
    if os.path.isdir(path):
        if os.path.exists(c := os.path.join(path, "tokenizer_config.json")):
            config = _json(c)
        path = os.path.join(path, "tokenizer.json")
    spec = _json(path)
    try:
        specials = {t["content"]: int(t["id"]) for t in spec["added_tokens"]}
        taken = set(specials.values())
        tokens = {t: int(i) for t, i in spec["model"]["vocab"].items() if int(i) not in taken}
        listed = spec["model"]["merges"]
    except (KeyError, TypeError, ValueError) as e:
        raise TokenizerError(Error.LOAD_FAILURE, f"{path}: {e}") from None
    for name in ("pre_tokenizer", "decoder"):
        if name in spec and spec[name] is None:
            raise TokenizerError(Error.LOAD_FAILURE, f"{path}: {name} is null")
    if len(set(tokens.values())) != len(tokens):
        raise TokenizerError(Error.PARSE_FAILURE, f"{path}: an id occurs twice")
    merges = []
    for m in listed:
        parts = m if isinstance(m, list) else m.split(" ") if legacy_merges else []
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    if config is not None:
        names = [c.get("content") if isinstance(c := config.get(k), dict) else c for k in ("bos_token", "eos_token")]
        if any(n not in specials for n in names):
            raise TokenizerError(Error.LOAD_FAILURE, f"{path}: a begin or end token that is no special")
        bos, eos = (specials[n] for n in names)
    else:
        bos, eos = guess_begin_and_end(specials)
    return Artifact({t.encode("utf-8"): i for t, i in tokens.items()}, specials, merges, normalizer=spec.get("normalizer"), pre_tokenizer=spec.get("pre_tokenizer"), decoder=spec.get("decoder"), bos=bos, eos=eos)


# The special tokens of the cased-pattern format where a file names none, by rank.
DEFAULT_TEKKEN_SPECIALS = ["<unk>", "<s>", "</s>", "[INST]", "[/INST]", "[AVAILABLE_TOOLS]", "[/AVAILABLE_TOOLS]", "[TOOL_RESULTS]", "[/TOOL_RESULTS]", "[TOOL_CALLS]", "[IMG]", "<pad>", "[IMG_BREAK]", "[IMG_END]", "[PREFIX]", "[MIDDLE]", "[SUFFIX]", "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]", "[TOOL_CONTENT]"]
# The named specials of rank files; the rest up to RANK_SPECIALS follow by rule.
DEFAULT_RANK_SPECIALS = ["<|begin_of_text|>", "<|end_of_text|>", "<|reserved_special_token_0|>", "<|reserved_special_token_1|>", "<|finetune_right_pad_id|>", "<|step_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|eom_id|>", "<|eot_id|>", "<|python_tag|>"]
RANK_SPECIALS = 256


def default_rank_specials(n: int = RANK_SPECIALS) -> list[str]:
    return DEFAULT_RANK_SPECIALS + [f"<|reserved_special_token_{k}|>" for k in range(2, 2 + n - len(DEFAULT_RANK_SPECIALS))]


def special_slots(defined: list[tuple[int, str]], n: int) -> list[tuple[int, str]]:
    """Specials in order of rank, filled up to ``n`` with placeholders; ranks must run from 0 without a gap."""
    ordered = sorted(defined)
    if [r for r, _ in ordered] != list(range(len(ordered))) or len(ordered) > n:
        raise TokenizerError(Error.LOAD_FAILURE, "special ranks do not run from 0")
    return ordered + [(i, f"<SPECIAL_{i}>") for i in range(len(ordered), n)]


def load_tekken(path: str) -> Artifact:
    """The JSON format with ranked base64 tokens; token ids follow the special ones."""
    spec = _json(path)
    try:
        config = spec["config"]
        n_special, size = int(config["default_num_special_tokens"]), int(config["default_vocab_size"])
        listed = spec.get("special_tokens")
        defined = [(int(s["rank"]), s["token_str"]) for s in listed] if listed else list(enumerate(DEFAULT_TEKKEN_SPECIALS))
        specials = {t: r for r, t in special_slots(defined, n_special)}
        tokens: dict[bytes, int] = {}
        for i, entry in enumerate(spec["vocab"][: max(0, size - n_special)]):
            if int(entry["rank"]) != i:
                raise TokenizerError(Error.PARSE_FAILURE, f"rank {entry['rank']} at {i}")
            text = entry["token_bytes"]
            if not re.match(STRICT_BASE64.replace(r"\z", r"\Z"), text):
                raise TokenizerError(Error.BASE64_DECODE_FAILURE, text)
            tokens[base64.b64decode(text)] = i + n_special
    except (KeyError, TypeError, ValueError) as e:
        raise TokenizerError(Error.LOAD_FAILURE, f"{path}: {e}") from None
    if "<s>" not in specials or "</s>" not in specials:
        raise TokenizerError(Error.LOAD_FAILURE, f"{path}: no <s> or </s>")
    return Artifact(tokens, specials, pattern=config["pattern"], bos=specials["<s>"], eos=specials["</s>"], version=config.get("version"))


def load_llama2c(path: str) -> Artifact:
    """The scored binary: four int32, then score, length and bytes of each token; a file that ends early is filled up with ``<pad>``.

    Of equal tokens the smallest id is looked up.
    """
    try:
        with open(path, "rb") as f:
            data = f.read()
        n, bos, eos, longest = struct.unpack_from("<4i", data)
    except (OSError, struct.error) as e:
        raise TokenizerError(Error.LOAD_FAILURE, f"{path}: {e}") from None
    pieces: list[tuple[str, float, int]] = []
    at, raw, scores = 16, [], {}
    for i in range(n):
        if at >= len(data):
            raw.append(b"<pad>")
            scores[i] = 0.0
            continue
        try:
            scores[i], size = struct.unpack_from("<fi", data, at)
        except struct.error:
            raise TokenizerError(Error.PARSE_FAILURE, f"{path}: token {i}") from None
        at += 8 + size
        if size < 0 or at > len(data):
            raise TokenizerError(Error.PARSE_FAILURE, f"{path}: token {i}")
        raw.append(data[at - size : at])
    tokens: dict[bytes, int] = {}
    for i, t in enumerate(raw):
        tokens.setdefault(t, i)
    return Artifact(tokens, scores=scores, bos=bos, eos=eos, options={"by_id": raw, "longest": longest, "size": n}, pieces=pieces)


def write_llama2c(pieces: list[tuple[bytes, float]], path: str, *, bos: int, eos: int, padding_first: bool = False) -> None:
    """The scored binary of pieces in order of id; a first padding row is not counted in the header."""
    rows = []
    for i, (piece, score) in enumerate(pieces):
        text = "<s>" if i == bos else "</s>" if i == eos else piece.decode("utf-8", "surrogateescape").replace("▁", " ")
        rows.append((text.encode("utf-8", "surrogateescape"), score))
    with open(path, "wb") as f:
        f.write(struct.pack("<4I", len(rows), bos, eos, max((len(t) for t, _ in rows), default=0)))
        if padding_first:
            rows.insert(0, (b"<pad>", 0.0))
        for text, score in rows:
            f.write(struct.pack("<fI", score, len(text)) + text)


# --- piece models (protocol buffers, by the public schema)
def _fields(data: bytes):
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield number, data[at : at + size]
            at += size
        elif kind == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind}")


# Kinds of pieces in the public schema.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def load_pieces(path: str) -> Artifact:
    """A piece model: pieces with scores and kinds, the algorithm (1 unigram, 2 BPE) and the normalizer's switches."""
    try:
        with open(path, "rb") as f:
            data = f.read()
        pieces, trainer, norm = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode("utf-8"), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
    except (OSError, IndexError, KeyError, ValueError, AttributeError, UnicodeDecodeError, TypeError) as e:
        raise TokenizerError(Error.LOAD_FAILURE, f"{path}: {e}") from None
    if not pieces:
        raise TokenizerError(Error.LOAD_FAILURE, f"{path}: no pieces")
    if norm.get(2):
        raise TokenizerError(Error.LOAD_FAILURE, f"{path}: models with a character map are not read")
    tokens: dict[bytes, int] = {}
    for i, (t, _, _) in enumerate(pieces):
        tokens.setdefault(t.encode("utf-8"), i)
    options = {"algorithm": trainer.get(3, 1), "add_dummy_prefix": bool(norm.get(3, 1)), "remove_extra_spaces": bool(norm.get(4, 1)), "unk": trainer.get(40, 0)}
    return Artifact(tokens, scores={i: s for i, (_, s, _) in enumerate(pieces)}, bos=trainer.get(41, 1), eos=trainer.get(42, 2), pieces=pieces, options=options)
