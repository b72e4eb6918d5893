"""Planning of levels, tiles and jumps: small decisions on the driver."""

from __future__ import annotations

import re


def nearest_level(target: int, levels: list[int]) -> int:
    """The nearest level; of two as near the coarser."""
    return min(levels, key=lambda r: (abs(r - target), -r))


def level_at_least(target: int, levels: list[int]) -> int:
    """The finest level that isn't finer than the target; the coarsest if all are."""
    return min((r for r in levels if r >= target), default=max(levels))


def overview_resolution(span: int, base: int, bins: int = 320) -> int:
    """The least multiple of the base by which a span has at most ``bins`` bins."""
    return max(1, -(-span // (bins * base))) * base


def render_resolution(width: int, height: int, base: int, cells: int = 1_048_576) -> int:
    """The least multiple of the base by which a view has at most ``cells`` cells."""
    k = 1
    while -(-width // (k * base)) * -(-height // (k * base)) > cells:
        k += 1
    return k * base


def viewport_tiles(viewport: tuple[int, int, int, int], resolution: int, tile_bins: int) -> list[tuple[int, int]]:
    """Tiles of the upper triangle that a viewport x0, x1, y0, y1 touches, sorted."""
    x0, x1, y0, y1 = viewport
    step = resolution * tile_bins
    return sorted({(min(x, y), max(x, y)) for x in range(x0 // step, (x1 - 1) // step + 1) for y in range(y0 // step, (y1 - 1) // step + 1)})


def parse_jump(text: str) -> tuple[str, int | None, int | None]:
    """A contig, or contig:start-end with 1-based closed ends and commas allowed, as a half-open interval."""
    found = re.fullmatch(r"\s*(.+?):([0-9,]+)-([0-9,]+)\s*", text)
    if not found:
        return text.strip(), None, None
    start, end = (int(x.replace(",", "")) for x in found.groups()[1:])
    if start < 1 or end < start:
        raise ValueError("an interval starts at 1 or later and ends no earlier")
    return found[1], start - 1, end
