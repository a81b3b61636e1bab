"""64-bit hashes of the words of a text, computed over the whole text at once with NumPy."""

import numpy as np

SPACES = " \t\n\x0b\x0c\r"
_BASE = 0x5851F42D4C957F2D
_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
#: A fixed pseudo-random 64-bit number for each byte.
_BYTE = np.array([((i + 1) * 0x9E3779B97F4A7C15 ^ ((i + 7) * 0xC2B2AE3D27D4EB4F >> 13)) & (2**64 - 1) for i in range(256)], np.uint64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as a text has needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each run of bytes other than ASCII white space, in order.

    The sum of byte numbers times powers of the base over a word is a difference of running sums; times
    the inverse power at its start, it does not depend on where the word stands.
    """
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], ~_SPACE[a], [False]))))
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS.to(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])
