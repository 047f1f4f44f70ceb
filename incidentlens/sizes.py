"""Sizes at which an operator changes its way of working; none of them changes a result."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Sizes:
    # A cell with more rows than this is split over several tasks.
    split_rows: int = 1_000_000
    # When no key group holds more undecided rows than this, each is settled by one ordered fold.
    fold_rows: int = 1_000
    # Larger groups, up to ``fold_most``, are folded while rows times group size stay below this.
    fold_work: int = 200_000_000
    fold_most: int = 10_000
    # Sweeps take the widest tiles that hold no more rows than this each; any tile can be swept.
    tile_rows: int = 2_000_000
    # Larger tiles are swept in ranges of that size, one pass each, but in no more passes than this: ranges
    # get longer instead, which costs no memory, as a pass streams its rows.
    sweep_passes: int = 8
    # A plain round that leaves more than this share of its rows undecided is followed by a sweep.
    slow_share: float = 0.5
    # A sweep that leaves more than this share undecided is followed by a plain round.
    stuck_share: float = 0.9
    # Suppressors are broadcast, listed by cell, when they take no more bytes than this (counted first).
    broadcast_bytes: int = 64 << 20
    # A sample cut-off shared by at most this many rows is found by sorting them.
    sort_rows: int = 10_000

    def foldable(self, rows: int, largest: int) -> bool:
        """Whether groups of these sizes (all rows, largest group) may be folded."""
        if largest <= self.fold_rows:
            return True
        return largest <= self.fold_most and rows * largest <= self.fold_work
