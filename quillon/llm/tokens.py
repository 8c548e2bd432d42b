"""Encoding of texts with a public byte-level BPE vocabulary.

Forced-boundary splitting: a pair of bytes that is inside no vocabulary token can't be merged over, so a
text may be cut there, if the splitting pattern can't tell either. It can't between two characters of which
the first is neither white space nor an apostrophe and the second no apostrophe: of two characters of
different kinds the pattern ends a match between them, within a run of one kind a match goes on to the
end of the run from wherever it starts, and white space only ever begins a match. A script without blanks
is so cut as well. All cuts of a batch are found at once in its bytes; the fragments are encoded on their
own, each distinct one once, and their ids are concatenated.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCAB_DIR = "/opt/tokenizers"
VOCAB = "byte_bpe_50k.tiktoken"
# fixed value: the splitting pattern that belongs to the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMORY = 400_000  # fragments remembered by a worker; more only means encoding one again
MEMORABLE = 64  # characters up to which a fragment is worth remembering
PART_BYTES = 8 << 20  # text encoded at once


def vocabulary_path(name: str = VOCAB, directory: str | None = None) -> str:
    """``directory`` or the variable QUILLON_TOKENIZERS or the usual place."""
    return os.path.join(directory or os.environ.get("QUILLON_TOKENIZERS", VOCAB_DIR), name)


def forced_pairs(tokens: list[bytes]) -> np.ndarray:
    """A table of 256 × 256: True where the two bytes are never neighbours inside a token."""
    forced = np.ones((256, 256), dtype=bool)
    for token in tokens:
        codes = np.frombuffer(token, dtype=np.uint8)
        forced[codes[:-1], codes[1:]] = False
    return forced


#: white space beyond ASCII by its last bytes
_WIDE_SPACES = np.array([int.from_bytes(chr(x).encode()) for x in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
APOSTROPHE = 39


class ForcedBoundaryEncoder:
    """Ids of texts by the vocabulary at ``path``, without special tokens."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = tiktoken.Encoding("forced", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        forced = forced_pairs(list(ranks))
        forced[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, APOSTROPHE], :] = False
        forced[:, APOSTROPHE] = False
        for contraction in (b"re", b"ve", b"ll"):  # the pattern's own pairs after an apostrophe
            forced[contraction[0], contraction[1]] = False
        # never inside a character: the second byte begins one
        forced[:, 0x80:0xC0] = False
        self.forced = forced.ravel()
        self.known: dict[str, np.ndarray] = {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """The places between two bytes of UTF-8 ``data`` where a cut is certain, as a mask over all bytes:
        True at the byte that begins the next fragment."""
        out = np.zeros(len(data), dtype=bool)
        if len(data) < 2:
            return out
        pairs = data[:-1].astype(np.uint16) << 8
        pairs |= data[1:]
        out[1:] = self.forced[pairs]
        # not after white space of several bytes
        wide = np.flatnonzero(out[3:] & (data[2:-1] >= 0x80)) + 3
        last = data[wide - 3].astype(np.int64) << 16 | data[wide - 2].astype(np.int64) << 8 | data[wide - 1]
        out[wide[np.isin(last, _WIDE_SPACES) | np.isin(last & 0xFFFF, _WIDE_SPACES[:2])]] = False
        out[2:3] &= data[1:2] < 0x80
        return out

    def fragment_ids(self, part: str) -> np.ndarray:
        found = self.known.get(part)
        if found is None:
            found = np.array(self.whole(part), dtype=np.int32)
            if len(part) <= MEMORABLE:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[part] = found
        return found

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The fragments of all texts one after the other, and how many belong to the texts before each."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        first = self.cuts(data)
        first[ends[:-1][ends[:-1] < len(data)]] = True
        starts = np.flatnonzero(first)
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        return parts, np.searchsorted(starts, ends)

    def fragments(self, text: str) -> list[str]:
        return self.split(pa.array([text], pa.large_string()))[0].to_pylist()

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.large_string()))[0].tolist()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids begin; one more for the end); null as empty."""
        parts, at = self.split(texts.fill_null(""))
        coded = parts.dictionary_encode()
        each = [self.fragment_ids(x) for x in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        which = coded.indices.to_numpy()
        lengths = size[which]
        begin = np.append(0, np.cumsum(lengths))
        flat = np.concatenate(each) if each else np.zeros(0, np.int32)
        home = (np.cumsum(size) - size)[which] - begin[:-1]
        return flat[np.repeat(home, lengths) + np.arange(begin[-1])], begin[at]


_ENCODERS: dict[str, ForcedBoundaryEncoder] = {}


def encoder(path: str) -> ForcedBoundaryEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ForcedBoundaryEncoder(path)
    return _ENCODERS[path]


def _mapped(df: DataFrame, text_col: str, keep: list[str], out_col: str, kind: T.DataType, column, path: str) -> DataFrame:
    if out_col in keep:
        raise ValueError(f"{out_col} is a column of the result")
    rows = df.select(*keep, F.col(text_col).alias(out_col))
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField(out_col, kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = batch.column(len(keep))
            size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
            start = 0
            while start < batch.num_rows:  # parts of bounded bytes, of one text at least
                stop = max(start + 1, int(np.searchsorted(size, size[start] + PART_BYTES, side="right")) - 1)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], column(*coder.encode_all(part.column(len(keep))))], names=[*keep, out_col])
                start = stop

    return rows.mapInArrow(work, schema)


def encode_texts(df: DataFrame, text_col: str, keep: list[str], out_col: str = "ids", path: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``out_col``, the ids of ``text_col`` as a list of integers.

    A null text and an empty text have the empty list. The strings of special tokens are ordinary text.
    Repeated rows are kept. Decoding the ids gives the text back. Nothing is shuffled.
    """
    return _mapped(df, text_col, keep, out_col, T.ArrayType(T.IntegerType(), True), lambda ids, begin: pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids)), path or vocabulary_path())


def count_tokens(df: DataFrame, text_col: str, keep: list[str], out_col: str = "n_tokens", path: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``out_col``, the number of ids that :func:`encode_texts` gives."""
    return _mapped(df, text_col, keep, out_col, T.LongType(), lambda ids, begin: pa.array(np.diff(begin).astype(np.int64)), path or vocabulary_path())
