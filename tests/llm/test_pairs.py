"""Embedding and SimHash near-duplicates, components and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import simhash
from gleanery.llm.components import connected_components
from gleanery.llm.embedding_dedup import embedding_groups
from gleanery.llm.substring_dedup import drop_repeated_windows, levels_of


def closure(ids, links):
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    return {i: top(i) for i in ids}


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 90)] + [(200, 200 + i) for i in range(1, 60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, links[0], (5, 5), (None, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(df).collect()}
    want = {i: t for i, t in closure({x for e in links for x in e}, links).items() if i != t}
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


def _vectors(rng, n, dims):
    base = [rng.standard_normal(dims) for _ in range(n // 4)]
    return [(base[i % len(base)] + rng.standard_normal(dims) * rng.choice([0.1, 0.3, 0.45])).astype(np.float32).tolist() for i in range(n)]


@pytest.mark.parametrize("dims,tile", [(64, 32768), (64, 16), (5, 40), (1, 32768)])
def test_embeddings_link_as_in_brute_force(spark, dims, tile):
    rng = np.random.default_rng(dims)
    rows = list(enumerate(_vectors(rng, 160, dims)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, [2 * x for x in rows[3][1]]), (300, None), (301, [0.0] * dims), (302, [float("nan")] * dims), (303, [math.inf] + [1.0] * (dims - 1)), (304, [None] + [1.0] * (dims - 1)), (305, []), (306, [1.0] * (dims + 1))]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<float>, node long, vector string")
    got = {r["vec_id"]: r for r in embedding_groups(df, tile_rows=tile).collect()}
    unit = {i: np.array(v, np.float64) / np.linalg.norm(v) for i, v in rows if v and len(v) == dims and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.9]
    top = closure([i for i, _ in rows], links)
    assert len(got) == len(rows) and len(links) > 20
    for i, _ in rows:
        assert got[i]["n_links"] == sum(i in e for e in links), i
        assert got[i]["component_id"] == top[i] and got[i]["kept"] == (top[i] == i)
    assert embedding_groups(df.limit(0)).count() == 0


def test_embeddings_at_the_threshold(spark):
    """Very many pairs within rounding of the threshold, more than a tile leaves to others; and pairs on both sides of it."""
    rng = np.random.default_rng(4)
    base = np.zeros((1200, 64))
    base[:, 0] = np.sqrt(0.9)
    base[np.arange(1200), 1 + np.arange(1200) % 63] = np.sqrt(0.1)
    base += rng.standard_normal(base.shape) * rng.choice([1e-6, 1e-5, 1e-4], (1200, 1))
    other = rng.standard_normal((60, 64))
    vectors = np.concatenate([base, other]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    x = vectors.astype(np.float64)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    linked = np.einsum("ik,jk->ij", x, x) >= 0.9
    np.fill_diagonal(linked, False)
    near = np.abs(np.einsum("ik,jk->ij", x, x) - 0.9) < 1e-13
    got = {r["vec_id"]: r["n_links"] for r in embedding_groups(df).collect()}
    assert linked.sum() > 100_000
    assert all(abs(got[i] - linked[i].sum()) <= near[i].sum() for i in got)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [None, "", " \t\x0b ", "A b", "a B c d e f\u00a0g h", "x " * 500, "É é " * 40 + "\x1c z", "w1 w2 w3 w4"]
    assert simhash.fingerprints(texts).tolist() == [plain_fingerprint(t) for t in texts]
    assert [f"{x & (2**64 - 1):016x}" for x in [r[0] for r in spark.createDataFrame([("w1 w2 w3 w4",)], "t string").select(F.xxhash64("t")).collect()]] == [f"{xxhash.xxh64_intdigest(b'w1 w2 w3 w4', 42):016x}"]


def test_every_pair_within_a_bit_of_a_part_meets_at_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for part, (shift, width) in enumerate(simhash.PARTS):
        home, _, _ = simhash.anchors(x, part)
        for bit in [None, *range(width)]:
            y = x if bit is None else x ^ np.uint64(1 << (shift + bit))
            _, index, anchor = simhash.anchors(y, part)
            near = set(zip(index.tolist(), anchor.tolist(), strict=True))
            assert all((i, int(h)) in near for i, h in enumerate(home)), (part, bit)


@pytest.mark.parametrize("home_rows", [simhash.HOME_ROWS, 3])
def test_near_links_as_in_brute_force(spark, monkeypatch, home_rows):
    monkeypatch.setattr(simhash, "HOME_ROWS", home_rows)
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for k in (1, 2, 3, 4, 5, 6):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), k)))
    fps += [fps[0] ^ (1 << b) for b in range(64)] + [0, 2**64 - 1]
    fps = sorted(set(fps))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4]
    found = [(r["a"], r["b"]) for r in simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    assert closure(signed, found) == closure(signed, links)


def test_simhash_groups_with_nulls_copies_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text), (3, text), (3, text), (9, text + " end"), (7, None), (8, ""), (None, "zz yy"), (11, " ".join(f"v{i}" for i in range(50)))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, component_id int")
    got = simhash.simhash_groups(df).collect()
    assert len(got) == len(rows)
    top = {}
    prints = [plain_fingerprint(t) for _, t in rows]
    label = closure(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4])
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in label if label[j] == label[k] and rows[j][0] is not None]
        top.setdefault((i, f"{prints[k]:016x}"), min(ids) if ids else None)
    assert {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got} == top
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def plain_windows(texts, window):
    tokens = [(t or "").encode().split() for t in texts]
    seen = {}
    for d, w in enumerate(tokens):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = {(d, i + k) for at in seen.values() if len(at) > 1 for d, i in at for k in range(window)}
    return [(len(w), sum((d, i) in gone for i in range(len(w))), b" ".join(x for i, x in enumerate(w) if (d, i) not in gone)) for d, w in enumerate(tokens)]


@pytest.mark.parametrize("window,size", [(35, 2 << 20), (35, 500), (10, 300), (3, 100), (1, 4000)])
def test_repeated_windows_as_in_brute_force(spark, window, size):
    rng = random.Random(window)
    words = [f"w{i}" for i in range(40)] + ["É", "\u00a0x"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [None, "", "a", passage, "  ".join(["same"] * 90), passage.replace(" ", "\n") + " tail", "lead " + passage[5:]]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(25)]
    texts += [texts[-1], texts[-1] + " more", texts[9] + " " + texts[10]]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, batch int")
    got = sorted(drop_repeated_windows(df, window, batch_bytes=size).collect(), key=lambda r: r["doc_id"])
    want = plain_windows(texts, window)
    assert [(r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in got] == want
    assert drop_repeated_windows(df.limit(0), window).count() == 0


def test_crafted_words_are_no_copies(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever the base."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    words = [f"w{i}" for i in range(34)]
    texts = [" ".join([*words[:17], x, *words[17:]]) for x in (morse, morse.translate(str.maketrans("ab", "ba")))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_removed"] for r in drop_repeated_windows(df, 35).collect()] == [0, 0]
    assert sorted(r["n_removed"] for r in drop_repeated_windows(df.union(df.limit(1)), 35).collect()) == [0, 35, 35]


@pytest.mark.parametrize("times", [1, 1000])
def test_rows_that_repeat_very_often(spark, times):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (80, 50, 34, 60)]
    rows = [(0, texts[0]), (None, texts[1]), (2, texts[2]), (3, None)] * times + [(4, texts[3]), (5, "x " * 20 + texts[0]), (6, texts[3] + " " + texts[1])]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, times int, batch string")
    want = sorted((str(i), *x) for (i, _), x in zip(rows, plain_windows([t for _, t in rows], 35), strict=True))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in drop_repeated_windows(df, 35).collect()) == want


def test_windows_of_a_very_long_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    df = spark.createDataFrame([(1, long), (2, "w1 " * 3 + long[:400])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in drop_repeated_windows(df, 35).collect()}
    assert got[1] == (300_000, 300_000) and got[2][1] > 60


def test_levels_double():
    assert levels_of(35) == [9, 18, 35] and levels_of(9) == [9] and levels_of(1) == [1]
    assert all(2 * a >= b for n in range(1, 200) for a, b in zip(levels_of(n)[:-1], levels_of(n)[1:], strict=True))


def test_digest_of_kept_text(spark):
    got = drop_repeated_windows(spark.createDataFrame([(1, " b  a\t")], "doc_id long, text string"), 35).select(F.sha2(F.col("kept_text").cast("binary"), 256)).first()[0]
    assert got == hashlib.sha256(b"b a").hexdigest()
