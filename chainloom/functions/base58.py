"""Base58 of whole batches: digits and bytes as columns of limbs, so that the work is done by arrays and not by row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# The alphabet.
ALPHABET = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_DIGIT = np.full(256, 255, np.uint8)
_DIGIT[np.frombuffer(ALPHABET, np.uint8)] = np.arange(58)
_LETTER = np.frombuffer(ALPHABET, np.uint8)
#: Digits that are taken into the 32-bit limbs at once: 58^5 is below 2^30.
_STEP = 5
_WORD = np.uint64(0xFFFFFFFF)
_BITS = np.uint64(32)


def _by_length(values: Sequence[bytes | None]) -> dict[int, np.ndarray]:
    sizes = np.array([-1 if v is None else len(v) for v in values])
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes) if n >= 0}


def decode(texts: Sequence[bytes | None]) -> list[bytes | None]:
    """The bytes of base58 texts; None for what has other letters."""
    out: list[bytes | None] = [None] * len(texts)
    for size, rows in _by_length(texts).items():
        digits = _DIGIT[np.frombuffer(b"".join(texts[k] for k in rows), np.uint8).reshape(len(rows), size)]
        fine = (digits < 58).all(axis=1)
        rows, digits = rows[fine], digits[fine].astype(np.uint64)
        zeros = np.cumprod(digits == 0, axis=1).sum(axis=1) if size else np.zeros(len(rows), int)
        limbs = np.zeros((size * 733 // 4000 + 2, len(rows)), np.uint64)  # the lowest first; a digit is under 5.87 bits
        for start in range(0, size, _STEP):
            part = digits[:, start : start + _STEP]
            carry, factor = np.zeros(len(rows), np.uint64), np.uint64(58 ** part.shape[1])
            for k in range(part.shape[1]):
                carry = carry * np.uint64(58) + part[:, k]
            for limb in limbs:
                found = limb * factor + carry
                limb[:] = found & _WORD
                carry = found >> _BITS
        raw = limbs[::-1].T.astype(">u4").tobytes()
        width = 4 * len(limbs)
        for n, (k, z) in enumerate(zip(rows.tolist(), zeros.tolist(), strict=True)):
            out[k] = b"\0" * z + raw[n * width : (n + 1) * width].lstrip(b"\0")
    return out


def encode(values: Sequence[bytes | None]) -> list[str | None]:
    """Base58 texts of bytes."""
    out: list[str | None] = [None] * len(values)
    for size, rows in _by_length(values).items():
        data = np.frombuffer(b"".join(values[k] for k in rows), np.uint8).reshape(len(rows), size)
        zeros = np.cumprod(data == 0, axis=1).sum(axis=1) if size else np.zeros(len(rows), int)
        padded = np.pad(data, ((0, 0), (-size % 4, 0)))
        limbs = np.ascontiguousarray(padded).view(">u4").astype(np.uint64).T.copy()  # the highest first
        chunks = size * 1366 // 1000 // _STEP + 1
        letters = np.zeros((len(rows), chunks * _STEP), np.uint8)
        base = np.uint64(58**_STEP)
        for chunk in range(chunks - 1, -1, -1):
            rest = np.zeros(len(rows), np.uint64)
            for limb in limbs:
                found = (rest << _BITS) | limb
                limb[:] = found // base
                rest = found % base
            for k in range(_STEP - 1, -1, -1):
                letters[:, chunk * _STEP + k] = rest % np.uint64(58)
                rest //= np.uint64(58)
        first = np.cumprod(letters == 0, axis=1).sum(axis=1)
        texts = _LETTER[letters].tobytes().decode()
        width = letters.shape[1]
        for n, (k, z, f) in enumerate(zip(rows.tolist(), zeros.tolist(), first.tolist(), strict=True)):
            out[k] = "1" * z + texts[n * width + f : (n + 1) * width]
    return out
