"""Colours of drawings: tables, gradients and mixtures, as (red, green, blue) from 0 to 1."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from synteny_spark.functions.numbers import by_coordinate, cubic, linear

Colour = tuple[float, float, float]


def table(lines: Iterable[str]) -> dict[str, Colour]:
    """Names of a table with lines of three numbers up to 255 and a name; lines that begin with an exclamation mark are comments."""
    out = {}
    for line in lines:
        words = line.split(None, 3)
        if len(words) == 4 and not line.startswith("!"):
            out[words[3].strip()] = tuple(int(v) / 255 for v in words[:3])
    return out


def gradient(colours: Sequence[Colour], smooth: bool = False) -> Callable[[float], Colour]:
    """From 0 to 1 through the colours at even distances."""
    at = by_coordinate([(i / max(len(colours) - 1, 1), c) for i, c in enumerate(colours)], cubic if smooth else linear)
    return lambda x: tuple(min(1.0, max(0.0, v)) for v in at(x))


def mixed(front: Colour, back: Colour, alpha: float) -> Colour:
    """front at that opacity over back."""
    return tuple(alpha * f + (1 - alpha) * b for f, b in zip(front, back))


def from_yuv(y: float, u: float, v: float) -> Colour:
    """By the luma weights of standard-definition video: 0.299, 0.587 and 0.114 of red, green and blue."""
    red, blue = y + v * (1 - 0.299) / 0.615, y + u * (1 - 0.114) / 0.436
    green = (y - 0.299 * red - 0.114 * blue) / 0.587
    return tuple(min(1.0, max(0.0, c)) for c in (red, green, blue))
