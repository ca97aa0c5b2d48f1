"""Error codes of the engine and the exception that carries one."""

from __future__ import annotations

import logging
from enum import Enum

log = logging.getLogger("tokenloom")


class Error(Enum):
    OK = "Ok"
    INTERNAL = "Internal"
    UNINITIALIZED = "Uninitialized"
    OUT_OF_RANGE = "OutOfRange"
    LOAD_FAILURE = "LoadFailure"
    ENCODE_FAILURE = "EncodeFailure"
    BASE64_DECODE_FAILURE = "Base64DecodeFailure"
    PARSE_FAILURE = "ParseFailure"
    DECODE_FAILURE = "DecodeFailure"
    REGEX_FAILURE = "RegexFailure"


class TokenizerError(Exception):
    """Raised in failfast mode; in permissive mode the code's name stands in an ``error`` column."""

    def __init__(self, code: Error, what: str = ""):
        super().__init__(f"{code.value}: {what}" if what else code.value)
        self.code = code
