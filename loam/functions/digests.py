"""Digests that the engine hasn't got built in, by Arrow batches: for results that must equal those made elsewhere with the same digests.

Plans that needn't agree with others use ``text.portable_hash``, the same as ``md5_shingles`` here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

try:  # Python's own takes half the time of OpenSSL's on strings as short as these
    from _md5 import md5
except ImportError:
    from hashlib import md5


def _digest(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big", signed=True)


@F.arrow_udf(ArrayType(LongType()))
def _of_lists(x: pa.Array) -> pa.Array:
    rows = [None if r is None else [None if v is None else _digest(v) for v in r] for r in x.to_pylist()]
    return pa.array(rows, pa.list_(pa.int64()))


def blake2b_64(strings: Column) -> Column:
    """Of an array of strings, each one's 8-byte BLAKE2b of its UTF-8, big-endian, as the long of the same bits; null stays null.

    As with all functions in Python, ``strings`` must not be made by functions with lambdas in the same step: settle it first.
    """
    return _of_lists(strings)


def _grams(words: list[bytes], n: int) -> list[bytes]:
    """Runs of ``n`` words, joined by spaces; of fewer words, one of all of them; of none, none."""
    flat, at = b" ".join(words), [0, *accumulate(len(w) + 1 for w in words)]
    return [flat[i : j - 1] for i, j in zip(at, at[n:] or at[-1:], strict=False)] if words else []


def once(h: np.ndarray) -> np.ndarray:
    """Each number once, in their order."""
    return h[np.sort(np.unique(h, return_index=True)[1])]


def _distinct(rows: list, numbers: Callable[[str], np.ndarray]) -> pa.Array:
    """A list for each row, null for null: its numbers, each once, in their order."""
    found = [once(numbers(r)) if r else np.zeros(0, np.int64) for r in rows]
    offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
    flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
    return pa.ListArray.from_arrays(offsets, flat, mask=pa.array([r is None for r in rows], pa.bool_()))


def md5_of(said: str, n: int) -> np.ndarray:
    """Of lower-cased words joined by spaces, the hash of each n-gram, as ``text.portable_hash`` has it."""
    h = b"".join([md5(g, usedforsecurity=False).digest() for g in _grams(said.encode().split(b" "), n)])
    return (np.frombuffer(h, ">u8")[::2] >> np.uint64(4)).astype(np.int64)


def blake2b_of(words: list | str, n: int) -> np.ndarray:
    """Of words, or words joined by spaces, the 8-byte BLAKE2b of each lower-cased n-gram."""
    lowered = words.lower().encode().split(b" ") if isinstance(words, str) else [x.lower().encode() for x in words]
    h = b"".join([hashlib.blake2b(g, digest_size=8).digest() for g in _grams(lowered, n)])
    return np.frombuffer(h, ">i8").astype(np.int64)


def _by(of: Callable, n: int):
    @F.arrow_udf(ArrayType(LongType()))
    def hashed(x: pa.Array) -> pa.Array:
        return _distinct(x.to_pylist(), lambda r: of(r, n))

    return hashed


def md5_shingles(words: Column, n: int) -> Column:
    """What ``text.shingles`` gives, by Arrow batches: several times as fast on whole corpora."""
    return _by(md5_of, n)(F.lower(F.array_join(words, " ")))


def shingles(words: Column, n: int) -> Column:
    """Distinct hashes of lower-cased word n-grams as ``text.shingles`` has them, by BLAKE2b; ``words`` as said there."""
    return _by(blake2b_of, n)(words)


#: Of words joined by spaces, for texts without spaces in words: what is hashed of it, and how.
SAID = {md5_shingles: (F.lower, md5_of), shingles: (lambda said: said, blake2b_of)}


def said_shingles(said: Column, n: int, shingles: Callable[[Column, int], Column]) -> Column:
    """What ``shingles`` gives, of words joined by spaces: a row is one string on its way to Python."""
    ready, of = SAID[shingles]
    return _by(of, n)(ready(said))
