"""Sizes at which a plan changes; every side of each limit gives the same rows."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    group_rows: int = 5_000_000  # a key with more rows than this is sorted in blocks, not in one task
    block_rows: int = 1_000_000  # rows per block of such a key
    broadcast_rows: int = 200_000  # a dimension with more rows than this is shuffled, not broadcast
    match_rows: int = 5_000_000  # a key matching more facts than this is spread over several tasks


DEFAULT = Limits()
