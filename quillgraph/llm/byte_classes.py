"""Counts of kinds of characters in pieces of text, for the models of quality.

All pieces of a batch are counted at once: their UTF-8 bytes are mapped to kinds, and
``bincount`` adds up kinds and pairs of neighbours per piece.
"""

from __future__ import annotations

import numpy as np

#: Kinds of bytes: lower, upper, digit, space, other space, stop, comma, exclamation, bar, sign, other ASCII, lead byte, later byte.
N_KINDS = 13


def _kinds() -> np.ndarray:
    kind = np.full(256, 10, np.uint8)
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[ord(" ")] = 3
    kind[9:14] = 4
    kind[ord(".")] = 5
    kind[ord(",")] = 6
    kind[[ord("!"), ord("?")]] = 7
    kind[ord("|")] = 8
    kind[[ord(c) for c in "#$%&*<>@=+~^"]] = 9
    kind[0xC0:] = 11
    kind[0x80:0xC0] = 12
    return kind


KIND = _kinds()


def kind_shares(pieces: list[bytes], pairs: bool = True) -> np.ndarray:
    """Per piece the share of each kind, and of each pair of kinds; zeros for empty pieces."""
    n = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, n)
    kinds = KIND[np.frombuffer(b"".join(pieces), np.uint8)]
    at = np.repeat(np.arange(n, dtype=np.int32), size)
    one = np.bincount(at * N_KINDS + kinds, minlength=n * N_KINDS).reshape(n, N_KINDS)
    out = [one / np.maximum(size, 1)[:, None]]
    if pairs:
        same = at[1:] == at[:-1]
        k = N_KINDS * N_KINDS
        two = np.bincount((at[:-1].astype(np.int64) * k + kinds[:-1].astype(np.int64) * N_KINDS + kinds[1:])[same], minlength=n * k).reshape(n, k)
        out.append(two / np.maximum(size - 1, 1)[:, None])
    return np.concatenate(out, 1).astype(np.float32)
