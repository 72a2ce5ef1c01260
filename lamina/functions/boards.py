"""A small mask as one integer: bit ``y * width + x`` is pixel (y, x).

Shifts move a whole mask at once, so closing, filling and regions of a window of some hundred
pixels take microseconds. ``width`` holds at least one spare column, and as many as the
farthest step sideways, so that nothing wraps into the next row.
"""

from __future__ import annotations

from functools import lru_cache

LARGEST = 1 << 14  # bits; a mask beyond that is better drawn as an array
SLICE = 1 << 16  # bits; a whole slice beyond that is better held as spans


@lru_cache(4096)
def frame(shape: tuple[int, int], width: int) -> tuple[int, int]:
    """(all pixels of the window, those at its border)."""
    h, w = shape
    row = (1 << w) - 1
    full = sum(row << y * width for y in range(h))
    inner = sum((row >> 2 << 1) << y * width for y in range(1, h - 1)) if w > 2 else 0
    return full, full & ~inner


def draw(y: list[int], a: list[int], b: list[int], width: int) -> int:
    out = 0
    for i, s, e in zip(y, a, b, strict=True):
        out |= ((1 << e - s) - 1) << i * width + s
    return out


def flood(seed: int, inside: int, width: int) -> int:
    """What of ``inside`` edges connect with the seed."""
    seed &= inside
    while True:
        seed |= inside & ~(inside + seed)  # a carry runs to the end of each run
        more = (seed | seed >> 1 | seed << width | seed >> width) & inside
        if more == seed:
            return seed
        seed = more


def regions(mask: int, width: int) -> list[int]:
    """Regions by edges, in raster order."""
    out = []
    while mask:
        out.append(flood(mask & -mask, mask, width))
        mask ^= out[-1]
    return out


def drop_small(mask: int, least: int, width: int) -> int:
    return sum(r for r in regions(mask, width) if r.bit_count() >= least)


def largest(mask: int, width: int) -> int:
    """The largest region, the first of equal ones; 0 if there is none."""
    return max(regions(mask, width), key=int.bit_count, default=0)


def dilate(mask: int, offsets: list[tuple[int, int]], full: int, width: int) -> int:
    out = 0
    for dy, dx in offsets:
        step = dy * width + dx
        out |= mask << step if step >= 0 else mask >> -step
    return out & full


def close(mask: int, offsets: list[tuple[int, int]], full: int, width: int) -> int:
    """A dilation, then an erosion that takes pixels outside the window as set."""
    grown = dilate(mask, offsets, full, width)
    return full & ~dilate(full & ~grown, [(-dy, -dx) for dy, dx in offsets], full, width)


def fill_holes(mask: int, full: int, border: int, width: int) -> int:
    """Fill background that steps by edges can't reach from outside."""
    free = full & ~mask
    return full & ~flood(free & border, free, width)


def runs(mask: int, width: int) -> list[tuple[int, int, int]]:
    """(y, x0, x1) in raster order."""
    out = []
    at = 0
    while mask:
        skip = (mask & -mask).bit_length() - 1
        at, mask = at + skip, mask >> skip
        n = (~mask & mask + 1).bit_length() - 1
        y, x = divmod(at, width)
        out.append((y, x, x + n))
        at, mask = at + n, mask >> n
    return out
