"""Blocks of texts as a dictionary of distinct chunks and, for each text, the places of its chunks in that dictionary.

A tokenizer whose tokens never cross a cut needs each distinct chunk once. Blocks hold whole texts up to a number of bytes, so
a task keeps one block at a time; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from .common import bytes_of, chunks

SPACE = 0x20


class Block(NamedTuple):
    first: int  # row of the batch that the block begins with
    end: int
    data: np.ndarray
    offsets: np.ndarray
    words: pa.LargeBinaryArray  # distinct chunks, the most frequent ones first
    places: np.ndarray  # index into words, for every chunk of the texts in order
    bounds: np.ndarray  # n + 1 offsets of the texts in places


def spaced(texts: pa.Array) -> pa.Array:
    """A space before every text; null and empty texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    prefix = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string())
    return pc.binary_join_element_wise(prefix, texts, pa.scalar("", pa.large_string()))


def space_runs(data: np.ndarray) -> np.ndarray:
    """Where a run of spaces begins."""
    space = data == SPACE
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    return begins


def blocks(texts: pa.Array, begins_at, most: int) -> Iterator[Block]:
    """Cut texts that ``spaced`` made where ``begins_at(bytes)`` says so, and at their beginnings."""
    for first, end, data, offsets in chunks(*bytes_of(texts), most):
        begins = begins_at(data)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        edges = np.append(starts, len(data)).astype(np.int64)
        coded = binaries(data, edges).dictionary_encode()
        places = np.asarray(coded.indices)
        order = np.argsort(-np.bincount(places, minlength=len(coded.dictionary)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        yield Block(first, end, data, offsets, coded.dictionary.take(pa.array(order)), rank[places], np.searchsorted(starts, offsets))


def binaries(data: np.ndarray, edges: np.ndarray) -> pa.LargeBinaryArray:
    """Byte strings that follow each other in ``data``, from their n + 1 edges."""
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def flattened(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, … of every range, one range after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def packed(values: np.ndarray) -> bytes:
    """Numbers as zstd of their byte planes: high bytes, mostly equal, cost next to nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T if len(values) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)
