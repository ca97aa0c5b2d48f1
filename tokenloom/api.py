"""Load an artifact, encode and decode columns, register SQL functions.

    t = get_tokenizer(spark, "tokenizer.json")
    df.select(t.encode("text", bos=1)["ids"])
    t.decode_df(df, "doc_id", "ids")
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Error, TokenizerError, log
from .functions.decoders import compile_decoder
from .functions.normalizers import compile_normalizer
from .functions.patterns import RANK_PATTERN, RANK_PATTERN_LOOKAHEAD, find_all
from .functions.splitters import compile_pretokenizer
from .operators import decoding, merging
from .operators.encoding import check_loaded, failfast, kernel_function, pieces_of, repeats, text_function
from .operators.segments import allowed_specials
from .sources import artifacts


class Tokenizer:
    """The common surface.  Subclasses load an artifact and name their kernel."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.artifact: artifacts.Artifact | None = None

    # --- state
    @property
    def is_loaded(self) -> bool:
        return self.artifact is not None

    @property
    def vocab_size(self) -> int:
        check_loaded(self.artifact)
        return self.artifact.size

    @property
    def bos_tok(self) -> int:
        check_loaded(self.artifact)
        return self.artifact.bos

    @property
    def eos_tok(self) -> int:
        check_loaded(self.artifact)
        return self.artifact.eos

    def load(self, path: str) -> Tokenizer:
        raise NotImplementedError

    # --- encode
    def kernel(self) -> merging.Kernel:
        raise NotImplementedError

    def normalize(self, segments: Column) -> Column:
        return segments

    def cut(self, text: Column) -> Column:
        raise NotImplementedError

    def encode(self, text: Column | str, *, bos: int = 0, eos: int = 0, allowed_special: str | set[str] = "all") -> Column:
        """``struct<ids, error, dropped>`` of a text column; a null text gives null ids."""
        check_loaded(self.artifact)
        return self.encode_pieces(self.pieces(text, allowed_special=allowed_special), bos=bos, eos=eos)

    def encode_pieces(self, pieces: Column, *, bos: int = 0, eos: int = 0) -> Column:
        """The same of what ``pieces`` gives."""
        return kernel_function(self.kernel(), repeats(self.artifact.bos, bos), repeats(self.artifact.eos, eos))(pieces)

    def elements(self) -> DataFrame:
        """(index, id, token) of the regular tokens, in ascending order of id."""
        check_loaded(self.artifact)
        rows = sorted((i, t) for t, i in self.artifact.tokens.items())
        return self.spark.createDataFrame([(n, i, bytearray(t)) for n, (i, t) in enumerate(rows)], "index long, id long, token binary")

    def encode_df(self, df: DataFrame, text: str = "text", *, output: str = "ids", permissive: bool = True, **options) -> DataFrame:
        """``df`` with ``output`` and, in permissive mode, ``error``; otherwise an error ends the query."""
        rows = df.withColumn("encoded_", self.encode(text, **options))
        if permissive:
            return rows.withColumns({output: F.col("encoded_")["ids"], "error": F.col("encoded_")["error"], "dropped_pieces": F.col("encoded_")["dropped"]}).drop("encoded_")
        return rows.withColumn(output, failfast(F.col("encoded_"))).drop("encoded_")

    # --- decode
    def piece_of(self, piece: Column, prev: Column) -> Column:
        return piece

    def piece_rows(self) -> DataFrame:
        """(id, piece): the bytes of every id, a regular token before a special one."""
        regular, special = self.artifact.vocabulary(self.spark).select("id", "token"), self.artifact.special_table(self.spark).select("id", F.encode("token", "UTF-8").alias("token"))
        both = regular.withColumn("n", F.lit(0)).unionByName(special.withColumn("n", F.lit(1)))
        return both.groupBy("id").agg(F.min(F.struct("n", "token"))["token"].alias("piece"))

    #: The error of an id beyond the vocabulary.
    beyond = Error.DECODE_FAILURE

    @property
    def piece_table(self) -> decoding.PieceTable:
        """What each id stands for, worked out once from the vocabulary."""
        check_loaded(self.artifact)
        known = getattr(self, "_pieces", None)
        if known is None or known[0] is not self.artifact:
            a, piece = self.artifact, F.col("piece")
            rows = self.piece_rows().select("id", self.piece_of(piece, F.lit(a.bos + 1)).alias("plain"), self.piece_of(piece, F.lit(a.bos)).alias("first")).collect()  # a vocabulary
            known = self._pieces = (a, decoding.PieceTable({r["id"]: (r["plain"], r["first"]) for r in rows}, a.bos, self.beyond))
        return known[1]

    def decode_ids(self, ids: Column | str) -> Column:
        """``struct<data, error>`` of a column of ids: their bytes, or the error's name; null ids give null."""
        return decoding.decode_function(self.piece_table)(F.col(ids) if isinstance(ids, str) else ids)

    def decode_df(self, df: DataFrame, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
        """doc, data, n_tokens, error, text of each row, one by one; no ids give no bytes."""
        rows = df.select(F.col(doc).alias("doc"), F.size(ids).cast("long").alias("n_tokens"), self.decode_ids(ids).alias("d"))
        return rows.select("doc", "d.data", "n_tokens", "d.error", F.col("d.data").cast("string").alias("text"))

    def decode_batch(self, ids: list[int]) -> bytes:
        """The bytes of one sequence."""
        row = self.piece_table.decoded(pa.array([[int(i) for i in ids]], pa.list_(pa.int64())))[0].as_py()
        if row["error"]:
            raise TokenizerError(Error(row["error"]), str(ids))
        return row["data"]

    def encode_text(self, text: str, *, bos: int = 0, eos: int = 0, **options) -> list[int]:
        """One text, through the same expression."""
        row = self.spark.createDataFrame([(text,)], "text string").select(self.encode("text", bos=bos, eos=eos, **options).alias("r")).first()["r"]
        if row["error"]:
            raise TokenizerError(Error(row["error"]), text[:50])
        return list(row["ids"])

    def decode(self, token: int, prev: int | None = None) -> bytes:
        """One token; ``prev`` defaults to the token itself."""
        piece = self.piece_table.piece(int(token), int(token if prev is None else prev))
        if piece is None:
            raise TokenizerError(self.piece_table.error(int(token)), str(token))
        return piece

    def register(self, name: str, *, bos: int = 0, eos: int = 0) -> None:
        """A SQL function ``name(array<struct<piece, special>>)`` for pieces built in SQL; see ``pieces``."""
        self.spark.udf.register(name, kernel_function(self.kernel(), repeats(self.bos_tok, bos), repeats(self.eos_tok, eos)))

    def pieces(self, text: Column | str, *, allowed_special: str | set[str] = "all") -> Column:
        """``array<struct<piece, special>>`` of a text column: everything before the merge kernel."""
        check_loaded(self.artifact)
        text = F.col(text) if isinstance(text, str) else text
        return pieces_of(text, allowed_specials(self.artifact.specials, allowed_special), self.normalize, self.cut)


class Tiktoken(Tokenizer):
    """Rank files.  With ``lookahead`` the pattern is the one that keeps ``\\s+(?!\\S)``."""

    def __init__(self, spark: SparkSession, *, pattern: str | None = None, specials: list[str] | None = None, bos_index: int = 0, eos_index: int = 1, lookahead: bool = False):
        super().__init__(spark)
        self.pattern = pattern or (RANK_PATTERN_LOOKAHEAD if lookahead else RANK_PATTERN)
        self.specials = specials if specials is not None else artifacts.default_rank_specials()
        self.at = (bos_index, eos_index)
        if not all(0 <= i < len(self.specials) for i in self.at):
            raise TokenizerError(Error.OUT_OF_RANGE, "the index of a begin or end token")

    def load(self, path: str) -> Tiktoken:
        self.artifact = artifacts.load_rank(self.spark, path, pattern=self.pattern, specials=self.specials, bos_index=self.at[0], eos_index=self.at[1])
        return self

    def kernel(self):
        return merging.RankMerge(tokens=self.artifact.tokens)

    def cut(self, text: Column) -> Column:
        return find_all(text, self.artifact.pattern)


class Tekken(Tiktoken):
    """The JSON format of ranked base64 tokens; the pattern comes from the file."""

    def __init__(self, spark: SparkSession):
        Tokenizer.__init__(self, spark)

    def load(self, path: str) -> Tekken:
        self.artifact = artifacts.load_tekken(path)
        return self

    def load_with_special_tokens(self, path: str, special_tokens: list[str] | None = None) -> Tekken:
        """The list is ignored: specials are those of the file."""
        return self.load(path)

    @property
    def version(self) -> str | None:
        check_loaded(self.artifact)
        return self.artifact.version


class HFTokenizer(Tokenizer):
    """JSON descriptions with normalizer, pre-tokenizer, merges and decoder."""

    def __init__(self, spark: SparkSession, *, legacy_merges: bool = False, config: str | None = None):
        super().__init__(spark)
        self.legacy_merges, self.config = legacy_merges, config

    def load(self, path: str) -> HFTokenizer:
        return self.use(artifacts.load_hf(path, legacy_merges=self.legacy_merges, config_path=self.config))

    def use(self, a: artifacts.Artifact) -> HFTokenizer:
        self._normalize, self._cut = compile_normalizer(a.normalizer), compile_pretokenizer(a.pre_tokenizer)
        self._decode = compile_decoder(a.decoder) if a.decoder is not None else None
        _, self.ranks = artifacts.resolved_merges({t.decode("utf-8"): i for t, i in a.tokens.items()}, a.merges)
        self.artifact = a
        return self

    def kernel(self):
        return merging.CharacterMerge(tokens=self.artifact.tokens, ranks=self.ranks)

    def normalize(self, segments: Column) -> Column:
        return self._normalize(segments)

    def cut(self, text: Column) -> Column:
        return self._cut(text)

    def piece_of(self, piece: Column, prev: Column) -> Column:
        return piece if self._decode is None else self._decode(F.decode(piece, "UTF-8"))


def hf_from_artifact(spark: SparkSession, artifact: artifacts.Artifact) -> HFTokenizer:
    """A tokenizer of an artifact made in memory."""
    return HFTokenizer(spark).use(artifact)


class Llama2c(Tokenizer):
    """The scored binary; begin takes part in merging, end is added after."""

    def load(self, path: str) -> Llama2c:
        self.artifact = artifacts.load_llama2c(path)
        return self

    @property
    def vocab_size(self) -> int:
        check_loaded(self.artifact)
        return self.artifact.options["size"]

    def encode(self, text: Column | str, *, bos: int = 0, eos: int = 0, **_) -> Column:
        check_loaded(self.artifact)
        if bos < 0 or eos < 0:
            raise TokenizerError(Error.ENCODE_FAILURE, "a negative number of begin or end tokens")
        a = self.artifact
        kernel, begin = merging.ScoreMerge(by_id=a.options["by_id"], tokens=a.tokens, scores=a.scores), repeats(a.bos, bos)
        run = text_function(kernel, lambda own, t: own.text(t, begin), repeats(a.eos, eos))
        return run(F.col(text) if isinstance(text, str) else text)

    def piece_of(self, piece: Column, prev: Column) -> Column:
        return decoding.scored_piece(piece, prev, self.artifact.bos)

    beyond = Error.OUT_OF_RANGE

    def piece_rows(self) -> DataFrame:
        """By id, so that equal tokens all decode."""
        return self.spark.createDataFrame(list(enumerate(map(bytearray, self.artifact.options["by_id"]))), "id long, piece binary")


class SentencePiece(Tokenizer):
    """Piece models (unigram or BPE) by the published algorithms.

    As in the reference of the byte pieces only ``<0x0A>`` decodes to its byte, a NUL ends a text and the space mark reads as a space.
    With ``exact`` all byte pieces decode to bytes and those characters are encoded as such, so texts come back whole.
    """

    def __init__(self, spark: SparkSession, *, exact: bool = False):
        super().__init__(spark)
        self.exact = exact

    def load(self, path: str) -> SentencePiece:
        self.artifact = artifacts.load_pieces(path)
        return self

    @property
    def vocab_size(self) -> int:
        check_loaded(self.artifact)
        return len(self.artifact.pieces)

    def encode(self, text: Column | str, *, bos: int = 0, eos: int = 0, **_) -> Column:
        check_loaded(self.artifact)
        a = self.artifact
        kernel, begin = merging.PieceMerge(pieces=a.pieces, options=a.options | {"exact": self.exact}), repeats(a.bos, bos)
        run = text_function(kernel, lambda own, t: begin + own.encode(t), repeats(a.eos, eos))
        return run(F.col(text) if isinstance(text, str) else text)

    def piece_rows(self) -> DataFrame:
        rows = [(i, t, kind == artifacts.CONTROL, self.exact and kind == artifacts.BYTE) for i, (t, _, kind) in enumerate(self.artifact.pieces)]
        return self.spark.createDataFrame(rows, "id long, text string, control boolean, byte boolean").select("id", F.struct("text", "control", "byte").alias("piece"))

    def piece_of(self, piece: Column, prev: Column) -> Column:
        return decoding.model_piece(piece["text"], prev, self.artifact.bos, piece["control"], piece["byte"])


def get_tokenizer(spark: SparkSession, path: str, config: str | None = None) -> Tokenizer:
    """By the path: JSON descriptions, else a piece model, else a rank file."""
    if path.endswith(".json"):
        return HFTokenizer(spark, config=config).load(path)
    try:
        return SentencePiece(spark).load(path)
    except TokenizerError as e:
        log.info("%s is no piece model (%s): read as a rank file", path, e)
        return Tiktoken(spark, lookahead=True).load(path)
