"""What the operators share: durable checkpoints, word buffers and rolling n-gram hashes.

Word buffers hold the words of many documents, one space between neighbours, as one byte array. A prefix sum of
``table[byte] * base**i`` (mod 2**64) gives the hash of any run of words in constant time, all in numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from gleanery.session import durable

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder that the cluster names in spark.checkpoint.dir; a local one only where none is named, on one machine."""
    return durable(df)


# Word buffers -----------------------------------------------------------------------------------------------------


class Words:
    """The words of some documents: ``buf`` bytes, word ``start``/``end`` offsets, ``count`` per document, ``limit`` of each word's document."""

    def __init__(self, joined: list[bytes]):
        kept = [j for j in joined if j]
        self.count = np.array([j.count(b" ") + 1 if j else 0 for j in joined], dtype=np.int64)
        self.buf = np.frombuffer(b" ".join(kept), dtype=np.uint8)
        if len(self.buf):
            gaps = np.flatnonzero(self.buf == 32)
            self.start = np.concatenate(([0], gaps + 1))
            self.end = np.concatenate((gaps, [len(self.buf)]))
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.count)))
        self.doc = np.repeat(np.arange(len(joined)), self.count)
        self.limit = self.offset[1:][self.doc] if len(self.doc) else np.zeros(0, dtype=np.int64)

    def fits(self, n: int) -> np.ndarray:
        """Whether n words from each position on lie in one document."""
        return np.arange(len(self.start)) + n <= self.limit


_POWERS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _powers(which: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random byte table, base**i and base**-i; kept per Python worker and grown by doubling."""
    have = _POWERS.get(which)
    if have is None or len(have[1]) < length:
        size = max(length, 1 << 16, 2 * len(have[1]) if have and 2 * len(have[1]) < (1 << 24) else 0)
        draw = np.random.default_rng(1000 + which)
        table = draw.integers(0, 2**64, 256, dtype=np.uint64)
        base = int(draw.integers(0, 2**64, dtype=np.uint64)) | 5
        base -= 0 if base % 8 in (3, 5) else base % 8 - 5
        up, down = np.full(size, base % 2**64, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[which] = (table, np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Constant-time hashes of word runs of a Words buffer."""

    def __init__(self, words: Words, which: int = 0):
        table, up, self.down = _powers(which, len(words.buf) + 1)
        self.words = words
        self.sums = np.zeros(len(words.buf) + 1, np.uint64)
        np.cumsum(table[words.buf] * up[: len(words.buf)], out=self.sums[1:])

    def at(self, first: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from each position in ``first`` on; every run must lie in the buffer."""
        s, e = self.words.start[first], self.words.end[first + n - 1]
        return mix((self.sums[e] - self.sums[s]) * self.down[s])


def sliding(values: np.ndarray, width: int, op, fill) -> np.ndarray:
    """op over values[i : i + width], the end padded with fill; a logarithmic number of passes."""
    out, have = values, 1
    padded = lambda x, k: np.concatenate((x[k:], np.full(min(k, len(x)), fill, x.dtype)))
    while have * 2 <= width:
        out, have = op(out, padded(out, have)), have * 2
    return op(out, padded(out, width - have)) if width > have else out


def pieces(sizes: list[int], limit: int):
    """Ranges of consecutive items of at most ``limit`` bytes together; a larger item is alone."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same components as the links a-b: (node, smallest node reachable), for other nodes than the smallest."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            next_ = label[label]
            if np.array_equal(next_, label):
                break
            label = next_
        if np.array_equal(before, label):
            break
        live = label[x] != label[y]
        x, y = x[live], y[live]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
