"""Distinct pairs of numbered variables, packed and counted by tile.

Numbers from 1 are cut into blocks of ``side``; a tile is a pair of blocks. A pair is a code: its tile, its place in the first block and
its place in the second. Rows of a tile: tile, codes (the sorted codes within it, as bytes of their differences: all low bytes, then all next
ones, compressed), size and width (how many, of how many bytes); or lists x and y of places, each of which is paired with each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.plans.checkpoint import cut

MOST_SIDE = 1 << 13  # a tile has up to 64 MB of cells
PAIRS_HELD, PAIRS_MADE = 8_000_000, 1_000_000  # before they are merged; at once
CODES_A_ROW = 1 << 16
SPARSE = 1_000_000  # codes of a tile that are sorted; more are marked in its cells
SCHEMA = "tile long, codes binary, size int, width int, x array<smallint>, y array<smallint>"


def side_of(n: int, parts: int) -> int:
    """A power of two, so that there are at least twice as many tiles as parts."""
    return 1 << min(MOST_SIDE, max(1, n // math.ceil(2 * math.sqrt(parts)))).bit_length() - 1


def _merged(codes: list[np.ndarray]) -> np.ndarray:
    c = np.concatenate(codes)
    c.sort()
    return c[np.append(True, c[1:] != c[:-1])] if len(c) else c


def _squeezed(codes: np.ndarray) -> tuple[bytes, int]:
    gap = np.diff(codes, prepend=0).astype("<u4")
    width = max(1, -(-int(gap.max()).bit_length() // 8))
    return pa.compress(np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 4)[:, :width].T), codec="zstd", asbytes=True), width


def _unsqueezed(raw: bytes, size: int, width: int) -> np.ndarray:
    gap = np.zeros((size, 4), np.uint8)
    gap[:, :width] = np.frombuffer(pa.decompress(raw, decompressed_size=size * width, codec="zstd"), np.uint8).reshape(width, size).T
    return np.cumsum(gap.reshape(-1).view("<u4"), dtype=np.int64)


def _blocks(codes: np.ndarray, cells: int) -> pa.RecordBatch:
    tile = codes // cells
    begins = np.append(0, np.flatnonzero(np.diff(tile)) + 1)
    ends = np.append(begins[1:], len(codes))
    cuts = [(a, min(a + CODES_A_ROW, e)) for b, e in zip(begins.tolist(), ends.tolist(), strict=True) for a in range(b, e, CODES_A_ROW)]
    rows = [_squeezed(codes[a:b] - tile[a] * cells) for a, b in cuts]
    none = pa.nulls(len(cuts), pa.list_(pa.int16()))
    columns = [pa.array(tile[[a for a, _ in cuts]]), pa.array([r[0] for r in rows], pa.binary()), pa.array([b - a for a, b in cuts], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), none, none]
    return pa.RecordBatch.from_arrays(columns, ["tile", "codes", "size", "width", "x", "y"])


def _codes(flat: np.ndarray, offsets: np.ndarray, side: int, across: int):
    """Codes of the pairs of each set, of about ``PAIRS_MADE`` at once. Sets are sorted, so the first of a pair is the smaller one."""
    block, place = flat // side, flat % side
    first, second = block * across * side * side + place * side, block * side * side + place
    sizes = np.diff(offsets)
    for k in np.unique(sizes[sizes > 1]).tolist():
        i, j = (x.astype(np.int32) for x in np.triu_indices(k, 1))
        starts, step = offsets[:-1][sizes == k], max(1, PAIRS_MADE // len(i))
        for a in range(0, len(starts), step):
            at = starts[a : a + step, None] + np.arange(k)
            yield (first[at][:, i] + second[at][:, j]).reshape(-1)


def packed(sets: DataFrame, n: int, side: int) -> DataFrame:
    """Rows of codes of all pairs of ``sets`` (a sorted array of numbers up to ``n``); those that a task merges are there once."""
    across, cells = -(-n // side), side * side

    def run(batches):
        held, made = [], 0
        for batch in batches:
            lists = batch.column(0)
            flat = lists.values.to_numpy().astype(np.int64) - 1
            for codes in _codes(flat, lists.offsets.to_numpy().astype(np.int64), side, across):
                held.append(codes)
                made += len(codes)
                if made >= PAIRS_HELD:
                    merged = _merged(held)
                    held, made = [merged], len(merged)
                    if made > PAIRS_HELD // 2:
                        yield _blocks(merged, cells)
                        held, made = [], 0
        if made:
            yield _blocks(_merged(held), cells)

    return sets.mapInArrow(run, SCHEMA)


def listed(links: DataFrame, n: int, side: int) -> DataFrame:
    """Rows of lists for the tiles of large factors. ``links``: factor_id, no."""
    block, place = F.floor((F.col("no") - 1) / side), ((F.col("no") - 1) % side).cast("smallint")
    of = cut(links.groupBy("factor_id", block.alias("i")).agg(F.collect_set(place).alias("x")), "pieces")
    pairs = of.join(of.toDF("factor_id", "j", "y").hint("merge"), "factor_id").where("i <= j")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("codes", "binary"), ("size", "int"), ("width", "int"))]
    return pairs.select((F.col("i") * -(-n // side) + F.col("j")).alias("tile"), *none, "x", "y")


class _Tile:
    """The pairs of a tile: sorted while there are few of them, else marked in all of its cells."""

    def __init__(self, side: int):
        self.side, self.codes, self.held, self.cells = side, [], 0, None

    def _mark(self) -> np.ndarray:
        if self.cells is None:
            self.cells = np.zeros(self.side * self.side, np.bool_)
        for c in self.codes:
            self.cells[c] = True
        self.codes, self.held = [], 0
        return self.cells

    def add(self, codes: np.ndarray) -> None:
        self.codes.append(codes)
        self.held += len(codes)
        if self.held > min(SPARSE, self.side * self.side // 8) or self.cells is not None:
            self._mark()

    def pair(self, x: np.ndarray, y: np.ndarray, same: bool) -> None:
        if len(x) * len(y) <= SPARSE:
            codes = (x[:, None] * self.side + y).reshape(-1)
            self.add(codes[codes // self.side < codes % self.side] if same else codes)
            return
        y_cells = np.zeros(self.side, np.bool_)
        y_cells[y] = True
        grid = self._mark().reshape(self.side, self.side)
        for a in x.tolist():
            grid[a, a + 1 if same else 0 :] |= y_cells[a + 1 if same else 0 :]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each place in the first block and in the second: how many pairs it is in."""
        if self.cells is None:
            c = _merged(self.codes)
            return np.bincount(c // self.side, minlength=self.side), np.bincount(c % self.side, minlength=self.side)
        grid = self.cells.reshape(self.side, self.side)
        return np.count_nonzero(grid, axis=1), np.count_nonzero(grid, axis=0)


def counted(rows: DataFrame, n: int, side: int, parts: int) -> DataFrame:
    """(no, n) of each number and tile: in how many distinct pairs of the tile it is. Tiles are taken one after another."""
    across = -(-n // side)

    def told(tile: int, of: _Tile):
        for block, k in zip(divmod(tile, across), of.counts(), strict=True):
            at = np.flatnonzero(k)
            yield pa.RecordBatch.from_arrays([pa.array(block * side + at + 1), pa.array(k[at].astype(np.int64))], ["no", "n"])

    def run(batches):
        now, of = None, None
        for batch in batches:
            for r, tile in enumerate(batch.column(0).to_pylist()):
                if tile != now:
                    if now is not None:
                        yield from told(now, of)
                    now, of = tile, _Tile(side)
                codes, size, width, x, y = (batch.column(k)[r] for k in range(1, 6))
                if codes.is_valid:
                    of.add(_unsqueezed(codes.as_py(), size.as_py(), width.as_py()))
                else:
                    of.pair(*(v.values.to_numpy().astype(np.int64) for v in (x, y)), tile // across == tile % across)
        if now is not None:
            yield from told(now, of)

    return rows.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(run, "no long, n long")
