"""A Spark-first tokenization engine: text columns to token ids and back, as DataFrame operators."""

from .api import HFTokenizer, Llama2c, SentencePiece, Tekken, Tiktoken, Tokenizer, get_tokenizer
from .errors import Error, TokenizerError
from .wrappers import JsonWrapper, PieceWrapper, RankWrapper

__all__ = ["Error", "HFTokenizer", "JsonWrapper", "Llama2c", "PieceWrapper", "SentencePiece", "Tekken", "Tiktoken", "RankWrapper", "Tokenizer", "TokenizerError", "get_tokenizer"]
