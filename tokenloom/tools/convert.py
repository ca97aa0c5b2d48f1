"""``python -m tokenloom.tools.convert -t model -o out.bin [-p]``: a piece model as a scored binary."""

from __future__ import annotations

import argparse
import sys

from ..sources.artifacts import load_pieces, write_llama2c


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-t", "--tokenizer-model", required=True)
    p.add_argument("-o", "--output-path")
    p.add_argument("-p", "--prepend-padding", action="store_true")
    o = p.parse_args(args)
    a = load_pieces(o.tokenizer_model)
    out = o.output_path or o.tokenizer_model.removesuffix(".model") + ".bin"
    write_llama2c([(t.encode("utf-8"), s) for t, s, _ in a.pieces], out, bos=a.bos, eos=a.eos, padding_first=o.prepend_padding)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
