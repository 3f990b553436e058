"""Exponentially weighted means: how weights decay, and how many rows one scale can hold."""

import math

_RANGE = 1e100  # weights within a block differ by no more than this
_LONGEST = 4096


def decay_of(span: float) -> float:
    """Factor from one row's weight to that of the row before it."""
    if span < 1:
        raise ValueError("span must be at least 1")
    return 1 - 2 / (span + 1)


def block_length(decay: float) -> int:
    """Rows whose weights fit one scale without overflow; sums within a block then lose nothing."""
    if decay <= 0:
        return _LONGEST
    return max(1, min(_LONGEST, int(math.log(_RANGE) / -math.log(decay))))
