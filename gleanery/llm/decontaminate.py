"""Benchmark decontamination by winnowing.

The smallest k-gram hash of every sliding window of k-grams is kept as a fingerprint, in test items and training
documents alike; a shared span of ``window`` words holds ``window - k + 1`` k-grams, so it always shares a fingerprint.
Fingerprint hits are extended: the document's windows around a hit are compared with the item windows, by hash and
then byte by byte. Items shorter than a window are one window, found through the hashes of all runs of their length.

A small benchmark is one broadcast index, and fingerprints meet where the documents are read. A larger one is joined: a document's
fingerprints that pass a filter of bounded size go, with the words around them, to the items' fingerprints, and the windows
of those that meet to the items' windows. Either way the documents are scanned once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import TOP, Grams, Words, checkpoint, mix, pieces, sliding

#: A-Z become a-z; every other ASCII character that is no letter or digit parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The same words in a text as it is.
FOLDED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of item text up to which the benchmark is a broadcast index.
BLOCK_BYTES = 8 << 20
#: 64-bit words of the filter that a larger benchmark's fingerprints make, at most; beyond that more fingerprints pass for nothing.
FILTER_WORDS = 1 << 22
PIECE = 1 << 20


def folded(text: str | None) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(FOLD).split()) if text else b""


class ItemIndex:
    """Windows of some benchmark items: by length, sorted hashes with the window's bytes and its items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int, k: int):
        self.window, self.k = window, k
        spans: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            words = folded(text).split()
            n = min(window, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                spans.setdefault(n, {}).setdefault(b" ".join(words[i : i + n]), set()).update(() if item is None else (str(item),))
        self.by_length: dict[int, tuple[np.ndarray, list[list[tuple[bytes, tuple[str, ...]]]]]] = {}
        prints = []
        for n, found in spans.items():
            texts = list(found)
            held = Words(texts)
            hashes = Grams(held).at(held.offset[:-1], n)
            keys = np.unique(hashes)
            slots: list[list[tuple[bytes, tuple[str, ...]]]] = [[] for _ in keys]
            for at, text in zip(np.searchsorted(keys, hashes).tolist(), texts, strict=True):
                slots[at].append((text, tuple(sorted(found[text]))))
            self.by_length[n] = (keys, slots)
            if n == window:
                grams, whole = kept_grams(held, Grams(held), window, k)
                prints.append(grams[whole])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)


def kept_grams(words: Words, grams: Grams, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hash at each position, and which of them winnowing keeps: the smallest of some window of k-grams, ties all kept."""
    n, width = len(words.start), window - k + 1
    values = np.full(n, TOP)
    at = np.flatnonzero(words.fits(k))
    values[at] = grams.at(at, k)
    least = sliding(values, width, np.minimum, TOP)
    least[~words.fits(window)] = 0
    backwards = sliding(least[::-1], width, np.maximum, np.uint64(0))[::-1]
    return values, (backwards == values) & (backwards > 0)


def _member(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, values), max(0, len(sorted_keys) - 1))
    return (sorted_keys[at] == values if len(sorted_keys) else np.zeros(len(values), bool)), at


def hits_in(texts: list[str | None], index: ItemIndex) -> tuple[Words, np.ndarray, list[set[str]]]:
    """The words of the texts, whether each is hit, and the items with a window in each text."""
    words = Words([folded(t) for t in texts])
    items: list[set[str]] = [set() for _ in texts]
    change = np.zeros(len(words.start) + 1, np.int64)
    if len(words.start):
        grams = Grams(words)
        for n, (keys, slots) in index.by_length.items():
            if n == index.window:
                values, kept = kept_grams(words, grams, n, index.k)
                at = np.flatnonzero(kept)
                at = at[_member(index.prints, values[at])[0]]
                near = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(near, np.maximum(at - (n - index.k), 0), 1)
                np.add.at(near, at + 1, -1)
                first = np.flatnonzero((np.cumsum(near[:-1]) > 0) & words.fits(n))
            else:
                first = np.flatnonzero(words.fits(n))
            found, slot = _member(keys, grams.at(first, n))
            for i, s in zip(first[found].tolist(), slot[found].tolist(), strict=True):
                span = words.buf[words.start[i] : words.end[i + n - 1]].tobytes()
                for text, names in slots[s]:
                    if text == span:
                        change[i] += 1
                        change[i + n] -= 1
                        items[words.doc[i]].update(names)
    return words, np.cumsum(change[:-1]) > 0, items


class PrintFilter:
    """A blocked Bloom filter: each fingerprint of a length is three bits of one word."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(fps: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, bits) of fingerprints in a filter of ``size`` words, a power of two."""
        h = mix(fps ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
        bits = np.zeros(len(h), np.uint64)
        for shift in (0, 6, 12):
            bits |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
        return ((h >> np.uint64(18)) & np.uint64(size - 1)).astype(np.int64), bits

    def passes(self, fps: np.ndarray, n: int) -> np.ndarray:
        at, bits = self.places(fps, n, len(self.words))
        return (self.words[at] & bits) == bits


def item_prints(text: bytes, window: int, k: int) -> tuple[int, np.ndarray]:
    """The length of a folded item's windows and its fingerprints: those that winnowing keeps, or the hash of a short item."""
    words = Words([text])
    n = min(window, len(words.start))
    if n < window:
        return n, Grams(words).at(np.zeros(1, np.int64), n) if n else np.zeros(0, np.uint64)
    grams, kept = kept_grams(words, Grams(words), window, k)
    return n, np.unique(grams[kept])


def doc_prints(words: Words, n: int, window: int, k: int, known: PrintFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first word, end) of the fingerprints for items of window length n that pass the filter, with all words of windows around them."""
    if n == window:
        values, kept = kept_grams(words, Grams(words), n, k)
        at = np.flatnonzero(kept)
        at = at[known.passes(values[at], n)]
        begin = words.offset[:-1][words.doc[at]]
        return values[at], np.maximum(at - (n - k), begin), np.minimum(at + n, words.limit[at])
    at = np.flatnonzero(words.fits(n))
    values = Grams(words).at(at, n)
    found = known.passes(values, n)
    return values[found], at[found], at[found] + n


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 6, share: int = 20, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, nameless: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) and the columns in ``keep``, prefixed ``kept_``, a row for each row of docs.

    A word is hit inside any occurrence of an item window of ``window`` words, or of a whole shorter item. items: the
    items with an occurring window, sorted as strings. contaminated: n_hit > 0 and share * n_hit >= n_words. Null and blank texts have no
    words; texts of any length are scanned whole; null items, null item texts and items without words hit nothing; repeated items
    count once, repeated rows are rows of their own; an empty table of either kind gives no rows or no hits. With ``nameless``,
    null items with a text hit words too; items leaves them out. A benchmark of at most ``block_bytes`` of text is one broadcast
    index, without a shuffle; a larger one is joined by fingerprints, and only hits meet the documents' rows, by hashes of id and text.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).dropna(subset=["text"] if nameless else None).distinct()
    total = items.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    keep = keep or []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"kept_{c}") for c in keep])
    if total <= block_bytes:
        out = _scan(rows, spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.collect()]), window, k)
    else:
        rows = rows.withColumn("k0", F.xxhash64("doc_id", "text")).withColumn("k1", F.xxhash64(F.lit(1), "doc_id", "text"))
        found = _joined(rows.select("k0", "k1", "text"), items, window, k)
        out = rows.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(FOLDED_WORD)), F.lit(0)).cast("long")).join(found, ["k0", "k1"], "left")
        out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn("n_items", F.size("items").cast("long"))
    flag = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return out.withColumn("contaminated", flag).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated", *[f"kept_{c}" for c in keep])


def _joined(rows: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """(k0, k1, n_hit, items) of the rows that some item hits, by joins of fingerprints and then of windows."""
    spark = rows.sparkSession

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n, fps = item_prints(folded(text), window, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), n, np.int32)), pa.array(fps.view(np.int64))], names=["n", "fp"])

    def placed(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths, fps = np.asarray(batch.column("n")), np.asarray(batch.column("fp")).view(np.uint64)
                for n in np.unique(lengths).tolist():
                    at, bits = PrintFilter.places(fps[lengths == n], n, size)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], names=["at", "bits"])

        return run

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = folded(text).split()
                n = min(window, len(words))
                found = sorted({b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else ())
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], names=["item_id", "window"])

    prints = checkpoint(items.select("text").mapInArrow(printed, "n int, fp long").distinct())
    size = 1 << min(FILTER_WORDS.bit_length() - 1, max(4, (prints.count() // 4).bit_length()))  # some 16 bits a fingerprint
    held = prints.mapInArrow(placed(size), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # a row for each word at most
    bits = np.zeros(size, np.uint64)
    bits[np.asarray(held["at"])] = np.asarray(held["bits"]).view(np.uint64)
    known = spark.sparkContext.broadcast((bits, sorted(r["n"] for r in prints.select("n").distinct().collect())))  # window lengths

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing, lengths = PrintFilter(known.value[0]), known.value[1]
        for batch in batches:
            texts, k0, k1 = (batch.column(c).to_pylist() for c in ("text", "k0", "k1"))
            for i, j in pieces([len(t or "") for t in texts], PIECE):
                words = Words([folded(t) for t in texts[i:j]])
                data = words.buf.tobytes()
                for n in lengths if len(words.start) else ():
                    fps, first, end = doc_prints(words, n, window, k, passing)
                    doc = words.doc[first]
                    spans = [data[a:b] for a, b in zip(words.start[first].tolist(), words.end[end - 1].tolist(), strict=True)]
                    own = (doc + i).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k0[d] for d in own], pa.int64()), pa.array([k1[d] for d in own], pa.int64()), pa.array(np.full(len(doc), n, np.int32)), pa.array(fps.view(np.int64)), pa.array((first - words.offset[:-1][doc]).astype(np.int32)), pa.array(spans, pa.binary())],
                        names=["k0", "k1", "n", "fp", "first", "span"],
                    )

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of each span."""
        for batch in batches:
            at, spans = [], []
            for row, (n, span) in enumerate(zip(batch.column("n").to_pylist(), batch.column("span").to_pylist(), strict=True)):
                words = span.split(b" ")
                for i in range(len(words) - n + 1):
                    at.append((row, i))
                    spans.append(b" ".join(words[i : i + n]))
            row, shift = np.array(at, np.int64).reshape(-1, 2).T
            kept = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([kept.column("k0"), kept.column("k1"), kept.column("n"), pa.array((np.asarray(kept.column("first")) + shift).astype(np.int32)), pa.array(spans, pa.binary())], names=["k0", "k1", "n", "first", "window"])

    windows = items.mapInArrow(windows_of, "item_id string, window binary")
    met = rows.mapInArrow(scanned, "k0 long, k1 long, n int, fp long, first int, span binary").join(prints, ["n", "fp"], "left_semi").drop("fp")
    spots = met.mapInArrow(extended, "k0 long, k1 long, n int, first int, window binary").join(windows.select("window").distinct(), "window", "left_semi")
    spots = checkpoint(spots.distinct())  # hits alone
    places = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))))
    hits = spots.groupBy("k0", "k1").agg(F.size(places).alias("n_hit"))
    named = spots.select("k0", "k1", "window").distinct().join(windows.where("item_id is not null"), "window").select("k0", "k1", "item_id").distinct()
    return hits.join(named.groupBy("k0", "k1").agg(F.array_sort(F.collect_list("item_id")).alias("items")), ["k0", "k1"], "left")


def _scan(rows: DataFrame, items, window: int, k: int) -> DataFrame:
    """The rows without text, with what the items hit in them."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name != "text"}
    schema = ", ".join([f"`{n}` {t}" for n, t in fields.items()] + ["n_words long, n_hit long, n_items long, items array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or ItemIndex(items.value, window, k)
            texts = batch.column("text").to_pylist()
            counts, hits, names = [], [], []
            for i, j in pieces([len(t or "") for t in texts], PIECE):
                words, marks, found = hits_in(texts[i:j], index)
                total = np.concatenate(([0], np.cumsum(marks)))
                counts.append(words.count)
                hits.append(total[words.offset[1:]] - total[words.offset[:-1]])
                names += [sorted(x) for x in found]
            long = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            columns = [batch.column(n) for n in fields] + [long(counts), long(hits), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*fields, "n_words", "n_hit", "n_items", "items"])

    return rows.mapInArrow(run, schema)
