"""Cutting oversized texts at natural boundaries, with an overlap between the pieces.

For each text the boundaries are a table and each is joined with its farthest legal successor; squaring
the table of successors (pointer doubling) gives all cuts that the greedy walk from the start would make
in about log2(pieces) steps. The tables are arrays beside their text, so nothing is shuffled. Positions
count code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 12_000, 200
#: White space of Unicode, as code points
SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


def boundary_ranks(codes: np.ndarray) -> np.ndarray:
    """For each position 0..n the kind of cut before it: 3 subheading (a line of three or four #),
    2 blank line, 1 white space, 0 none of them. A cut never parts a carriage return from its line feed.
    """
    n = len(codes)
    rank = np.zeros(n + 1, dtype=np.int8)
    if not n:
        return rank
    space = np.isin(codes, SPACES)
    rank[1:n][space[: n - 1]] = 1  # after a white space
    line_end = (codes == 10) | ((codes == 13) & np.append(codes[1:] != 10, True))
    starts = np.flatnonzero(line_end) + 1  # of lines
    starts = starts[starts < n]
    if len(starts):
        firsts = np.append(0, starts)
        # a line is blank if it has nothing but white space before its end
        solid = np.append(0, np.cumsum(~space))
        ends = np.append(starts, n)
        blank = solid[ends] == solid[firsts]
        after_blank = firsts[1:][blank[:-1]]
        rank[after_blank] = 2
        padded = np.append(codes, np.zeros(5, dtype=codes.dtype))
        hashes = (padded[starts] == 35) & (padded[starts + 1] == 35) & (padded[starts + 2] == 35)
        third = padded[starts + 3]
        heading = hashes & (((third == 32) | (third == 9)) | ((third == 35) & ((padded[starts + 4] == 32) | (padded[starts + 4] == 9))))
        rank[starts[heading]] = 3
    torn = np.flatnonzero((codes[:-1] == 13) & (codes[1:] == 10)) + 1
    rank[torn] = 0
    return rank


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """The positions 0 = c0 < c1 < … < ck = len(text) between which the new parts of the pieces lie.

    Each part but the first is preceded by ``overlap`` characters in its piece, so parts have at most
    ``limit`` (the first) or ``limit - overlap`` characters. Each cut is the farthest subheading in
    reach, else the farthest blank line, else the farthest white space; a kind is passed over if its
    farthest place would leave the part less than half full, and if all are, the farthest place of any
    kind is taken. Without any the text is cut at the full length.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    if n <= limit:
        return [0, n]
    rank = boundary_ranks(codes)
    room = limit - overlap
    places = np.flatnonzero(rank)
    of_kind = {kind: np.append(0, places[rank[places] >= kind]) for kind in (3, 2, 1)}
    torn = lambda at: (at > 0) & (at < n) & (codes[np.maximum(at, 1) - 1] == 13) & (codes[np.minimum(at, n - 1)] == 10)

    def successors(start: np.ndarray, reach: int, least: int) -> np.ndarray:
        """Joins each start with the farthest legal cut in its reach."""
        far = np.minimum(start + reach, n)
        best, found = far.copy(), far == n
        last = {kind: at[np.searchsorted(at, far, side="right") - 1] for kind, at in of_kind.items()}
        for kind in (3, 2, 1):
            half = ~found & (last[kind] >= start + max(least, (reach + 1) // 2))
            best[half], found[half] = last[kind][half], True
        short = ~found & (last[1] >= start + least)
        best[short], found[short] = last[1][short], True
        # cut anywhere, but not between a carriage return and its line feed
        back = ~found & torn(far) & (far - 1 >= start + least)
        best[back] -= 1
        return best

    # every boundary is a row of the table; a cut elsewhere lies in a stretch of a piece's length without any, so
    # of such stretches, if there are any, every place is a row
    ends = np.concatenate([[0], places, [n]])
    bare = np.flatnonzero(np.diff(ends) >= room)
    at = np.unique(np.concatenate([ends, *(np.arange(ends[i], ends[i + 1]) for i in bare)]))
    # the first piece is long enough to lend the whole overlap
    first = int(successors(at[:1], limit, max(1, overlap))[0])
    jump = np.searchsorted(at, successors(at, room, 1))
    # squaring: after each step ``hit`` holds all rows that the walk from the first cut reaches
    hit = np.zeros(len(at), dtype=bool)
    hit[np.searchsorted(at, first)] = True
    while True:
        grown = hit.copy()
        grown[jump[hit]] = True
        if (grown == hit).all():
            break
        hit, jump = grown, jump[jump]
    return [0, *at[hit].tolist()]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    cuts = cut_points(text, limit, overlap)
    return [text[max(0, a - overlap) if k else 0 : b] for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def split_oversized(df: DataFrame, text_col: str, keep: list[str], limit: int = LIMIT, overlap: int = OVERLAP, only_oversized: bool = False) -> DataFrame:
    """The ``keep`` columns with piece_idx (from 0), total_pieces, piece, overlap_chars: one row a piece.

    A text of up to ``limit`` characters, the empty one too, is one piece as it is; a null text is one
    piece that is null. With ``only_oversized`` rows of longer texts alone are taken, which is decided
    in the scan. Repeated rows give repeated pieces. Any length is cut; a text is never dropped. The new columns' names
    are refused in ``keep``.
    """
    added = ["piece_idx", "total_pieces", "piece", "overlap_chars"]
    if clash := set(keep) & set(added):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    rows = df.select(*keep, F.col(text_col).alias("piece"))
    if only_oversized:
        rows = rows.where(F.char_length("piece") > limit)
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("piece_idx", T.IntegerType()), T.StructField("total_pieces", T.IntegerType()), T.StructField("piece", T.StringType()), T.StructField("overlap_chars", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # few long texts at once
                part = batch.slice(start, 256)
                source, idx, total, pieces, lap = [], [], [], [], []
                for row, text in enumerate(part.column(len(keep)).to_pylist()):
                    cuts = [0, 0] if text is None else cut_points(text, limit, overlap)
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        back = min(overlap, a) if k else 0
                        source.append(row), idx.append(k), total.append(len(cuts) - 1), lap.append(back)
                        pieces.append(None if text is None else text[a - back : b])
                take = pa.array(source, pa.int64())
                columns = [part.column(i).take(take) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(idx, pa.int32()), pa.array(total, pa.int32()), pa.array(pieces, pa.string()), pa.array(lap, pa.int32())], names=[*keep, "piece_idx", "total_pieces", "piece", "overlap_chars"])

    return rows.mapInArrow(work, schema)
