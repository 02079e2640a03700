"""Tokenizers and normalizers as column expressions.

A tokenizer gives an array of raw tokens and, only where somebody asks for it, where each token stands in the UTF-8
bytes of the text. Terms stay in the JVM; the byte ranges come from one vectorised Arrow step over the lengths of tokens
and gaps, so that no token has to be shuffled to add up the lengths before it. Arrow steps take a batch by slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches

LETTERS = r"\p{L}+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(text: Column) -> Column:
    """Maximal runs of letters; no token for an empty or null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), F.array().cast("array<string>"))


def letter_gaps(text: Column) -> Column:
    """What stands before each run of letters, and after the last one."""
    return F.coalesce(F.split(text, LETTERS, -1), F.array(F.lit("")))


_RANGES = T.StructType([T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType()))])


@F.arrow_udf(_RANGES)
def _byte_ranges(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for tokens, gaps in columns:
        for begin, end in batches.slices(batches.offsets(tokens)):
            yield batches.byte_ranges(tokens[begin:end], gaps[begin:end])


def letter_ranges(text: Column) -> Column:
    """Byte offset and byte length of each run of letters: struct of two arrays."""
    return _byte_ranges(F.transform(letter_runs(text), F.octet_length), F.transform(letter_gaps(text), F.octet_length))


def lowercase(token: Column) -> Column:
    return F.lower(token)


def ascii_lowercase(token: Column) -> Column:
    """Only the letters A to Z."""
    return F.translate(token, _UPPER, _LOWER)


def identity(token: Column) -> Column:
    return token


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms.

    ``tokens(text)`` gives an array of strings; ``ranges(text)`` a struct of two arrays of the same size, ``starts`` and
    ``lengths``; ``normalize(token)`` a term. ``normalize_word`` does to a word of a query, on the driver, what
    ``normalize`` does to a token.
    """

    tokens: Callable[[Column], Column] = letter_runs
    ranges: Callable[[Column], Column] = letter_ranges
    normalize: Callable[[Column], Column] = lowercase
    normalize_word: Callable[[str], str] = str.lower

    def terms(self, text: Column) -> Column:
        return self.tokens(text) if self.normalize is identity else F.transform(self.tokens(text), self.normalize)


LOWERCASE = Analyzer()
ASCII_LOWERCASE = Analyzer(normalize=ascii_lowercase, normalize_word=lambda w: w.translate(str.maketrans(_UPPER, _LOWER)))
RAW = Analyzer(normalize=identity, normalize_word=lambda w: w)


def code_points(text: Column) -> Column:
    return F.char_length(text)


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def valid_utf8(data: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD, one for each longest part that could have begun a character."""
    return F.make_valid_utf8(data.cast("string"))


def utf16(text: Column) -> Column:
    """The text's UTF-16 units, little end first, without a mark."""
    return F.encode(text, "UTF-16LE")


def from_utf16(data: Column) -> Column:
    return F.decode(data, "UTF-16LE")


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the first 65,536 count twice."""
    return (F.octet_length(utf16(text)) / 2).cast("long")


_GROUPED = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


@F.arrow_udf(_GROUPED)
def by_term(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each row's different terms with their ascending positions."""
    for terms in columns:
        for begin, end in batches.slices(batches.offsets(terms)):
            yield batches.by_term(terms[begin:end])
