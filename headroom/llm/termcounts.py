"""Terms of texts: maximal runs of bytes of a set, A-Z lower-cased, counted by text.

Equal terms are found by comparing their bytes, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from headroom.llm import words

#: Letters only, and letters and digits; every character beyond ASCII belongs to both.
LETTERS = words.byte_set((0x61, 0x7A), (0x80, 0xFF))
ALPHANUMERIC = words.ALPHANUMERIC


def term_counts(texts: pa.LargeStringArray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms; text number, term number and occurrences of each pair that occurs; all terms of each text."""
    found = words.find_words(texts, inside, lower=True)
    ends = np.zeros(len(found) + 1, dtype=np.int64)
    np.cumsum(found.ends - found.starts, out=ends[1:])
    flat = found.data[inside[found.data]]
    listed = pa.LargeStringArray.from_buffers(len(found), pa.py_buffer(ends), pa.py_buffer(flat)).dictionary_encode()
    size = max(len(listed.dictionary), 1)
    pairs, occurrences = np.unique(found.text_of() * size + listed.indices.to_numpy(), return_counts=True)
    return listed.dictionary, pairs // size, pairs % size, occurrences, found.counts()


def rows_of(batches: Iterator[pa.RecordBatch], weight, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their weight reaches ``limit``."""
    waiting, total = [], 0
    for batch in batches:
        waiting.append(batch)
        total += weight(batch)
        if total >= limit:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, total = [], 0
    if waiting and sum(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
