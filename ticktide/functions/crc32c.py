"""CRC-32C (Castagnoli) over many equal-length rows at once, and the CRC of a concatenation."""

from __future__ import annotations

import numpy as np

_POLYNOMIAL = 0x82F63B78


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), t >> np.uint32(1))
    return t


TABLE = _byte_table()


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC of ``data``, carried on from ``crc``. Long inputs are cut into equal rows that are done together."""
    n = len(data)
    if n < 4096:
        c = crc ^ 0xFFFFFFFF
        table = TABLE.tolist()
        for b in data:
            c = table[(c ^ b) & 255] ^ (c >> 8)
        return c ^ 0xFFFFFFFF
    width = 1 << max(6, (n.bit_length() - 1) // 2)
    whole = n // width * width
    rows = crc_rows(np.frombuffer(data, np.uint8, whole).reshape(-1, width))
    out = fold(rows, width)
    out = combine(crc, out, whole)
    return crc32c(data[whole:], out)


def crc_rows(rows: np.ndarray) -> np.ndarray:
    """CRCs of the rows of a 2-d byte array."""
    c = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for k in range(rows.shape[1]):
        c = TABLE[(c ^ rows[:, k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    return c ^ np.uint32(0xFFFFFFFF)


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


def _squared(m: list[int]) -> list[int]:
    return [_times(m, x) for x in m]


def shift_matrix(n_bytes: int) -> list[int]:
    """The linear map, on CRC registers, of appending ``n_bytes`` zero bytes."""
    step = [_POLYNOMIAL, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        step = _squared(step)
    out = [1 << k for k in range(32)]
    while n_bytes:
        if n_bytes & 1:
            out = [_times(step, x) for x in out]
        step = _squared(step)
        n_bytes >>= 1
    return out


def combine(a: int, b: int, b_len: int) -> int:
    """CRC of a concatenation, from the CRCs of its parts and the second's length."""
    return _times(shift_matrix(b_len), a) ^ b


def _apply(matrix: list[int], values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for k, m in enumerate(matrix):
        out ^= np.where((values >> np.uint32(k)) & np.uint32(1), np.uint32(m), np.uint32(0))
    return out


def fold(crcs: np.ndarray, width: int) -> int:
    """CRC of the concatenation of rows of equal ``width``, pairwise from the left."""
    crcs = crcs.astype(np.uint32)
    head, length = 0, width
    tail: list[tuple[int, int]] = []  # odd rows set aside from the end: (crc, length)
    while len(crcs) > 1:
        if len(crcs) % 2:
            tail.append((int(crcs[-1]), length))
            crcs = crcs[:-1]
        crcs = _apply(shift_matrix(length), crcs[0::2]) ^ crcs[1::2]
        length *= 2
    head = int(crcs[0]) if len(crcs) else 0
    for crc, n in reversed(tail):
        head = combine(head, crc, n)
    return head
