"""A small vocabulary made by rule, for the queries: all bytes, then every beginning of some frequent letter groups."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..api import hf_from_artifact, HFTokenizer, Llama2c, Tiktoken
from ..functions.patterns import RANK_PATTERN
from ..sources.artifacts import Artifact

GROUPS = [" the", " of", " and", " to", " in", " that", " is", " de", " la", " le", " que", " und", " der", " die", " el", " los", "ing", "tion", "ent", "er", "an", "on", "re", "th", "he", "nd", "ment", "ung", "keit", "ción", "eau", ".\n"]
SPECIALS = ["[INST]", "[/INST]", "<s>", "</s>"]


def rank_tokens() -> dict[bytes, int]:
    out = {bytes([b]): b for b in range(256)}
    for group in GROUPS:
        data = group.encode("utf-8")
        for n in range(2, len(data) + 1):
            out.setdefault(data[:n], len(out))
    return out


def rank_artifact() -> Artifact:
    tokens = rank_tokens()
    return Artifact(tokens, {s: len(tokens) + i for i, s in enumerate(SPECIALS)}, pattern=RANK_PATTERN, bos=len(tokens) + 2, eos=len(tokens) + 3)


def rank_tokenizer(spark: SparkSession) -> Tiktoken:
    t = Tiktoken(spark, specials=SPECIALS, bos_index=2, eos_index=3)
    t.artifact = rank_artifact()
    return t


def character_merges() -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Tokens and merges over the printable byte alphabet; id 0 is left to a special."""
    from ..functions.bytelevel import ALPHABET

    tokens = {c: i + 1 for i, c in enumerate(ALPHABET)}
    merges: list[tuple[str, str]] = []
    for group in GROUPS:
        text = "".join(ALPHABET[b] for b in group.encode("utf-8"))
        for n in range(2, len(text) + 1):
            if text[:n] not in tokens:
                tokens[text[:n]] = len(tokens) + 1
                merges.append((text[: n - 1], text[n - 1]))
    return tokens, merges


def hf_tokenizer(spark: SparkSession) -> HFTokenizer:
    tokens, merges = character_merges()
    spec = Artifact({t.encode("utf-8"): i for t, i in tokens.items()}, {"<s>": 0, "</s>": len(tokens) + 1}, merges, pre_tokenizer={"type": "ByteLevel", "add_prefix_space": False}, decoder={"type": "ByteLevel"}, bos=0, eos=len(tokens) + 1)
    return hf_from_artifact(spark, spec)


def scored_tokenizer(spark: SparkSession) -> Llama2c:
    by_id = [b"<unk>", b"<s>", b"</s>", *[b"<0x%02X>" % b for b in range(256)]]
    scores = [0.0] * len(by_id)
    for token, rank in rank_tokens().items():
        if token.decode("utf-8", "ignore").encode("utf-8") == token and token not in by_id:
            by_id.append(token)
            scores.append(-float(rank))
    tokens: dict[bytes, int] = {}
    for i, t in enumerate(by_id):
        tokens.setdefault(t, i)
    t = Llama2c(spark)
    t.artifact = Artifact(tokens, scores=dict(enumerate(scores)), bos=1, eos=2, options={"by_id": by_id, "longest": max(map(len, by_id)), "size": len(by_id)})
    return t
