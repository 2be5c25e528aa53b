"""Whole-number arrays as small byte strings, for rows that carry many numbers at once."""

from __future__ import annotations

import numpy as np


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, without the planes that are zero throughout.

    Planes of high bytes are nearly constant and vanish under block compression.
    """
    raw = np.ascontiguousarray(values, dtype="<u8")
    if not len(raw):
        return b""
    width = (int(raw.max()).bit_length() + 7) // 8
    return bytes([width]) + raw.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def numbers(data: bytes, n: int) -> np.ndarray:
    """Inverse of ``planes`` for ``n`` numbers."""
    raw = np.zeros((n, 8), np.uint8)
    if n:
        width = data[0]
        raw[:, :width] = np.frombuffer(data, np.uint8, n * width, 1).reshape(width, n).T
    return raw.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def ascending(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers by their steps."""
    return planes(np.diff(values, prepend=np.zeros(1, np.uint64)))


def from_ascending(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(numbers(data, n), dtype=np.uint64)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each 64-bit hash when their range is cut into equal parts."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
