"""Substring dedup by level-wise doubling.

Windows repeated at one length alone are extended to about twice that length, up to the window asked for. On the
shortest level only content-chosen runs are looked at: of the runs within each window, the one with the smallest hash,
so that equal windows choose equal runs; a window whose run is repeated nowhere is out. Each later level looks at the
first and the last run of its length in every window that is left. Rolling hashes tell runs apart up to there, where a
collision only leaves more windows to look at; whole windows are told apart by a cryptographic digest of their bytes.

Documents are dealt into bounded batches once. On each level a batch sends each of its distinct hashes once, sorted, with
a mark where it holds it twice; groups of the hash range answer with one bit for each; the batch then goes on with what
is repeated. So a passage that most documents hold is one hash a batch, no group grows with it, and no positions travel.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import TOP, Grams, Words, mix, sliding

#: UTF-8 bytes of text in a batch, about.
BATCH_BYTES = 2 << 20
#: Hashes in one group of the hash range, about.
GROUP_HASHES = 1 << 18
#: Rows alike in id and text that may go to batches one by one; where some row has more copies, copies are counted first.
COPIES = 64

ANSWER = "batch long, level int, part long, bits binary"


def levels_of(window: int) -> list[int]:
    """Lengths from the shortest on; each but the last is at least half of the next."""
    out = [window]
    while out[0] > 9:
        out.insert(0, -(-out[0] // 2))
    return out


class Batch:
    """The windows of one batch of texts, and what is left of them level by level."""

    def __init__(self, texts: list[str | None], window: int):
        self.tokens = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        self.words = Words([b" ".join(t) for t in self.tokens])
        self.window, self.lengths = window, levels_of(window)
        self.grams = Grams(self.words)
        self.fits = self.words.fits(window)
        self.left = np.flatnonzero(self.fits)

    def keys(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of a level (a hash, on the last level both halves of a digest), whether this batch holds each twice."""
        n = self.lengths[level]
        if level == len(self.lengths) - 1:
            self.at = self.left
            first, second = self.digests(self.at, n)
            order = np.lexsort((second, first))
            a, b = first[order], second[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            self.slot = np.empty(len(a), np.int64)
            self.slot[order] = np.cumsum(new) - 1
            count = np.bincount(self.slot) if len(a) else np.zeros(0, np.int64)
            return a[new], b[new], count > 1
        if level == 0:
            size, width = len(self.words.start), self.window - n + 1
            self.values = np.full(size, TOP)
            at = np.flatnonzero(self.words.fits(n))
            self.values[at] = self.grams.at(at, n)
            self.least = sliding(self.values, width, np.minimum, TOP)
            inside = np.where(self.fits, self.least, np.uint64(0))
            highest = sliding(inside[::-1], width, np.maximum, np.uint64(0))[::-1]
            self.at = np.flatnonzero((highest == self.values) & (highest > 0))
            hashes = mix(self.values[self.at])  # chosen hashes are small ones; spread again over the range
        else:
            mark = np.zeros(len(self.words.start), bool)
            mark[self.left] = True
            mark[self.left + self.window - n] = True
            self.at = np.flatnonzero(mark)
            hashes = self.grams.at(self.at, n)
        keys, self.slot, count = np.unique(hashes, return_inverse=True, return_counts=True)
        return keys, np.zeros(len(keys), np.uint64), count > 1

    def digests(self, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the 128-bit digests of the n words from each position on."""
        data = self.words.buf.tobytes()
        spans = zip(self.words.start[first].tolist(), self.words.end[first + n - 1].tolist(), strict=True)
        halves = np.frombuffer(b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in spans]), np.uint64).reshape(-1, 2)
        return halves[:, 0], halves[:, 1]

    def narrow(self, level: int, repeated: np.ndarray) -> None:
        """Keeps the windows that a level's answer leaves."""
        hit = np.zeros(len(self.words.start), bool)
        hit[self.at] = repeated[self.slot] if len(self.at) else False
        n = self.lengths[level]
        if level == 0 and n < self.window:
            found = sliding(np.where(hit, self.values, TOP), self.window - n + 1, np.minimum, TOP)
            self.left = np.flatnonzero(self.fits & (found == self.least) & (found != TOP))
        else:
            self.left = self.left[hit[self.left] & hit[self.left + self.window - n]]

    def kept(self) -> tuple[list[int], list[int], list[bytes]]:
        """Words, removed words and kept text of each document."""
        change = np.zeros(len(self.words.start) + 1, np.int64)
        np.add.at(change, self.left, 1)
        np.add.at(change, self.left + self.window, -1)
        gone = np.cumsum(change[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        removed, texts = [], []
        for d, tokens in enumerate(self.tokens):
            lo, hi = self.words.offset[d], self.words.offset[d + 1]
            removed.append(int(total[hi] - total[lo]))
            texts.append(b" ".join(tokens if not removed[-1] else [t for t, g in zip(tokens, gone[lo:hi].tolist(), strict=True) if not g]))
        return self.words.count.tolist(), removed, texts


def _texts(table: pa.Table) -> tuple[list[str | None], list[int]]:
    """The texts of a batch, twice where a row stands for copies, and the place of each row's own."""
    times = np.minimum(np.asarray(table["times"].combine_chunks()), 2)
    texts = [t for t, n in zip(table["text"].to_pylist(), times.tolist(), strict=True) for _ in range(n)]
    return texts, (np.cumsum(times) - times).tolist()


def _narrowed(texts: list[str | None], answers: pa.Table, window: int, level: int, shift: int) -> Batch:
    """A batch after the answers to all levels before ``level``."""
    batch = Batch(texts, window)
    levels, parts, bits = (answers[c].to_pylist() for c in ("level", "part", "bits"))
    said = {(at, p): b for at, p, b in zip(levels, parts, bits, strict=True)}
    for at in range(level):
        keys, _, _ = batch.keys(at)
        repeated = np.zeros(len(keys), bool)
        for part, lo, hi in _parts(keys, shift):
            if (at, part) in said:
                repeated[lo:hi] = np.unpackbits(np.frombuffer(said[at, part], np.uint8), count=hi - lo).astype(bool)
        batch.narrow(at, repeated)
    return batch


def _parts(keys: np.ndarray, shift: int):
    part = (keys >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts.tolist()] if len(part) else [], [*cuts.tolist(), len(part)], strict=False):
        yield int(part[lo]), lo, hi


def _asked(batch_id: int, batch: Batch, level: int, shift: int) -> pa.Table:
    keys, second, twice = batch.keys(level)
    parts = list(_parts(keys, shift))
    last = level == len(batch.lengths) - 1
    return pa.table(
        {
            "batch": pa.array([batch_id] * len(parts), pa.int64()), "level": pa.array([level] * len(parts), pa.int32()), "part": pa.array([p for p, _, _ in parts], pa.int64()),
            "keys": pa.array([keys[lo:hi].tobytes() for _, lo, hi in parts], pa.binary()), "second": pa.array([second[lo:hi].tobytes() if last else b"" for _, lo, hi in parts], pa.binary()),
            "twice": pa.array([np.packbits(twice[lo:hi]).tobytes() for _, lo, hi in parts], pa.binary()),
        }
    )


ASKED = "batch long, level int, part long, keys binary, second binary, twice binary"


def _answer(table: pa.Table) -> pa.Table:
    """One bit for each key of each batch: held elsewhere too, or twice there."""
    keys = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
    second = [np.frombuffer(k, np.uint64) for k in table["second"].to_pylist()]
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)) for t, k in zip(table["twice"].to_pylist(), keys, strict=True)]).astype(bool)
    a = np.concatenate(keys)
    b = np.concatenate(second)
    order = np.lexsort((b, a)) if len(b) else np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    if len(b):
        same &= b[order][1:] == b[order][:-1]
    repeated = np.zeros(len(a), bool)
    repeated[order[1:]] |= same
    repeated[order[:-1]] |= same
    repeated |= twice
    cuts = np.cumsum([len(k) for k in keys])
    bits = [np.packbits(x).tobytes() for x in np.split(repeated, cuts[:-1])]
    return pa.table({"batch": table["batch"], "level": table["level"], "part": table["part"], "bits": pa.array(bits, pa.binary())})


def drop_repeated_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of docs.

    Words are runs of other characters than ASCII white space, unchanged. Every word that lies in a window of ``window`` words
    which also starts anywhere else, in the same document too, is removed, all judged on the input; of a window that
    occurs n times, all n go. kept_text joins the words left by one space. Null texts have no words; texts shorter
    than a window lose nothing; rows with one id and text are two documents, copies of each other, null ids included. A text
    is worked on whole, in one batch, however long. Other columns of docs are left out, whatever their names; an empty table
    gives no rows. Whole windows are compared by 128 bits of BLAKE2b.
    """
    if window < 1:
        raise ValueError("window must be positive")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    alike = rows.groupBy(F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size"))
    most, size = alike.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # Copies that would fill a batch are counted before they travel; two of them stand for all.
    rows = rows.groupBy("doc_id", "text").agg(F.count("*").alias("times")) if most > COPIES else rows.withColumn("times", F.lit(1).cast("long"))
    batches = max(8, -(-size // batch_bytes))
    # Some seven bytes a word at most, and about half of the words' hashes on the fullest level.
    shift = 64 - max(8, int(np.ceil(np.log2(max(1, size / 12 / GROUP_HASHES)))))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))
    last = len(levels_of(window)) - 1
    id_type = dict(rows.dtypes)["doc_id"]

    def ask(level: int):
        def first(key: tuple, table: pa.Table) -> pa.Table:
            return _asked(key[0].as_py(), Batch(_texts(table)[0], window), 0, shift)

        def later(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
            return _asked(key[0].as_py(), _narrowed(_texts(table)[0], answers, window, level, shift), level, shift)

        if level == 0:
            return dealt.groupBy("batch").applyInArrow(first, ASKED)
        return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(later, ASKED)

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, own = _texts(table)
        count, removed, kept = _narrowed(texts, answers, window, last + 1, shift).kept()
        count, removed, kept = ([x[i] for i in own] for x in (count, removed, kept))
        return pa.table({"doc_id": table["doc_id"], "times": table["times"], "n_words": pa.array(count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    answers = None
    for level in range(last + 1):
        answer = ask(level).groupBy("level", "part").applyInArrow(_answer, ANSWER)
        answers = answer if answers is None else answers.union(answer)
    out = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, f"doc_id {id_type}, times long, n_words long, n_removed long, kept_text string")
    if most > COPIES:
        out = out.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return out.drop("times")
