"""The classes of ``api`` with the options of single-language wrappers: boolean begin and end, no specials unless allowed, long texts in parts.

Columns in, columns out.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import api
from .errors import log
from .functions.splitters import MOST_CHARS, MOST_RUN, long_input_parts, quoted
from .operators.segments import allowed_specials
from .sources import artifacts


class _Wrapper:
    def __init__(self, tokenizer: api.Tokenizer):
        self.model = tokenizer
        self.n_words, self.bos_id, self.eos_id = tokenizer.vocab_size, tokenizer.bos_tok, tokenizer.eos_tok
        log.info("words: %s, begin: %s, end: %s", self.n_words, self.bos_id, self.eos_id)

    def decode(self, ids: Column | str) -> Column:
        """The text of a column of ids; null where an id is unknown."""
        return self.model.decode_ids(ids)["data"].cast("string")

    def decode_token(self, token: int) -> str:
        return self.model.decode(token, 0 if token else 1).decode("utf-8")


class RankWrapper(_Wrapper):
    """Rank files."""

    _instances: dict[str, RankWrapper] = {}

    def __init__(self, spark: SparkSession, path: str, **options):
        super().__init__(api.Tiktoken(spark, lookahead=True, **options).load(path))
        self.stop_tokens = [self.eos_id]

    @classmethod
    def get_instance(cls, spark: SparkSession, path: str) -> RankWrapper:
        """One a path."""
        if path not in cls._instances:
            cls._instances[path] = cls(spark, path)
        return cls._instances[path]

    def encode(self, text: Column | str, *, bos: bool, eos: bool, allowed_special: str | Collection[str] | None = None, disallowed_special: str | Collection[str] = (), most_chars: int = MOST_CHARS, most_run: int = MOST_RUN) -> Column:
        """``struct<ids, error, dropped>``.  Specials are ordinary text unless allowed; a disallowed one in a text ends the query.

        A text beyond the limits is encoded in parts, and its ids are those of the parts in order.
        """
        text = F.col(text) if isinstance(text, str) else text
        known = self.model.artifact.specials
        allowed = allowed_specials(known, set(allowed_special or ()) if allowed_special != "all" else "all")
        refused = [s for s in (known if disallowed_special == "all" else disallowed_special) if s not in allowed]
        if refused:
            text = F.when(text.rlike("|".join(map(quoted, refused))), F.raise_error(F.lit("a disallowed special string")).cast("string")).otherwise(text)
        parts = F.transform(long_input_parts(text, most_chars=most_chars, most_run=most_run), lambda p: self.model.pieces(p, allowed_special=set(allowed)))
        return self.model.encode_pieces(F.when(text.isNotNull(), F.flatten(parts)), bos=bool(bos), eos=bool(eos))


class JsonWrapper(_Wrapper):
    """JSON descriptions; ``bos`` and ``eos`` are taken and ignored."""

    def __init__(self, spark: SparkSession, path: str, config: str | None = None):
        super().__init__(api.HFTokenizer(spark, config=config).load(path))
        self.stop_tokens = [self.eos_id]

    def encode(self, text: Column | str, *, bos: bool, eos: bool) -> Column:
        return self.model.encode(text)


class PieceWrapper(_Wrapper):
    """Piece models."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(api.SentencePiece(spark).load(path))

    def encode(self, text: Column | str, bos: bool, eos: bool) -> Column:
        return self.model.encode(text, bos=int(bool(bos)), eos=int(bool(eos)))

    def export(self, path: str, *, prepend_padding: bool = False) -> None:
        """As a scored binary."""
        a = self.model.artifact
        artifacts.write_llama2c([(t.encode("utf-8"), s) for t, s, _ in a.pieces], path, bos=a.bos, eos=a.eos, padding_first=prepend_padding)
