"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import mix64

_P = np.uint64(0x9E3779B97F4A7C15)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, A-Z lower-cased; the number of each word of all texts in a row; each text's bounds in that.

    Words lie between ASCII white space; null texts have none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    index = coded.indices.to_numpy()
    real = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)[index] if len(index) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(real)])
    return coded.dictionary, index[real], before[bounds - bounds[0]]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row (see :func:`words`), and each text's bounds in it."""
    names, index, bounds = words(texts)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names.to_pylist()), np.uint64, len(names))
    return own[index], bounds


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of ``width`` words in a row.

    A text of fewer words is one shingle; one without words has none.
    """
    words, bounds = word_hashes(texts)
    n = len(words) - width + 1
    rolled = np.zeros(0, np.uint64)
    if n > 0:
        rolled = words[:n].copy()
        for i in range(1, width):
            rolled *= _P
            rolled += words[i : i + n]
        rolled = mix64(rolled)
    out = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low >= width:
            own = np.sort(rolled[low : high - width + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif high > low:
            h = np.full(1, high - low, np.uint64)
            for i in range(low, high):
                h = mix64(h * _P + words[i : i + 1])
            out.append(h)
        else:
            out.append(rolled[:0])
    return out
