"""Content-addressed identity: texts, chunks, entities and documents named by SHA-256."""

from __future__ import annotations

import re
import secrets
import time
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters without width, which never tell two texts apart.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
UNIT_SEPARATOR = "\x1f"
_SPACE = re.compile(r"\s+")
_DROP = str.maketrans("", "", ZERO_WIDTH)


def normal_form(text: str, form: str = "NFKC", casefold: bool = True, strip_zero_width: bool = True) -> str:
    """The form of a text that is hashed; never shown."""
    if strip_zero_width:
        text = text.translate(_DROP)
    text = _SPACE.sub(" ", unicodedata.normalize(form, text)).strip()
    return text.casefold() if casefold else text


@F.pandas_udf(StringType())
def _normal_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normal_form(t))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def normalize_for_hash(text: Column) -> Column:
    """``normal_form`` of a column: in the JVM for ASCII texts, by Arrow for the rest (which alone are sent)."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f]+", " ")))
    return F.when(is_ascii(text), plain).otherwise(_normal_form(F.when(~is_ascii(text), text)))


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_for_hash(text), 256)


def uuid_of(digest: Column) -> Column:
    """A hexadecimal digest's first 16 bytes as a UUID with version 5 and the RFC variant."""
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def chunk_id(text: Column) -> Column:
    return uuid_of(content_hash(text))


def entity_id(name: Column, kind: Column) -> Column:
    return uuid_of(F.sha2(F.concat(normalize_for_hash(name), F.lit(UNIT_SEPARATOR), kind), 256))


def document_id(content: Column) -> Column:
    """Over the raw bytes, not over any normalised text."""
    return uuid_of(F.sha2(content, 256))


def document_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def new_correlation_id(at_ms: int | None = None, entropy: bytes | None = None) -> str:
    """A 26-character ULID: 48 bits of milliseconds, 80 of randomness, in Crockford's base 32."""
    value = ((at_ms if at_ms is not None else time.time_ns() // 1_000_000) << 80) | int.from_bytes(entropy or secrets.token_bytes(10), "big")
    out = ""
    for _ in range(26):
        value, digit = divmod(value, 32)
        out = CROCKFORD[digit] + out
    return out
