"""``python -m tokenloom.tools.tokenize <kind> <model> <text...>``: ids of a text and their pieces."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .. import api

KINDS = {"sentencepiece": api.SentencePiece, "tiktoken": api.Tiktoken, "hf_tokenizer": api.HFTokenizer, "llama2c": api.Llama2c, "tekken": api.Tekken}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if len(args) < 3 or args[0] not in KINDS:
        print(f"{__doc__}\nkinds: {', '.join(KINDS)}")
        return 1
    spark = spark or SparkSession.builder.master("local[1]").getOrCreate()
    t = KINDS[args[0]](spark).load(args[1])
    ids = t.encode_text(" ".join(args[2:]), bos=1)
    print(f"Vocab size: {t.vocab_size}\nBOS: {t.bos_tok}\nEOS: {t.eos_tok}\nIDs: {ids}")
    for before, i in zip([0, *ids], ids, strict=False):
        print(i, t.decode(i, before))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
