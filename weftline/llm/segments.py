"""Segments of documents: runs of a task's rows whose words are numbered by a dictionary of their own.

A segment is a piece of one Arrow batch, of a bounded number of bytes (a longer document is a segment by itself),
so numpy handles its words together, and what is said once a distinct word is said once a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

SEGMENT_BYTES = 1 << 23
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = SEGMENT_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(segment, rows): batches cut where their texts (no nulls) pass another ``most`` bytes. A segment's number is the task's and a count, so a task that runs again gives the same."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), batch.num_rows)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield number, batch.slice(lo, hi - lo)
            number += 1


def words(texts: pa.StringArray, inside: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(distinct words, the word of each token, the text of each token): maximal runs of bytes of the kind ``inside``, A-Z in lower case.

    ``inside`` is a table of 256; it has to take all bytes of a code point alike.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    solid = inside[data]
    before = np.append(False, solid[:-1])[: len(solid)]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    begin = np.flatnonzero(solid & ~before)
    letters = _LOWER[data[solid]]
    starts = (np.cumsum(solid, dtype=np.int32)[begin] - 1).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(starts, np.int32(len(letters)))), pa.py_buffer(letters))
    coded = tokens.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(offsets[1:], begin, "right")


def binaries(values: np.ndarray, first: np.ndarray) -> pa.BinaryArray:
    """The bytes of values[first[k] : first[k + 1]] for each k."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((np.asarray(first) * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
