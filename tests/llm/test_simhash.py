import random

import numpy as np
import pytest
import xxhash

from loomlog.llm import simhash
from loomlog.llm.gray_index import GrayIndex, gray_rank

SCHEMA = "doc_id bigint, text string, fp string"


def brute(rows, distance=3):
    prints = {}
    out = []
    for key, text in rows:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        out.append((key, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    label = list(range(len(out)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(out)):
        for j in range(i):
            if (out[i][1] ^ out[j][1]).bit_count() <= distance:
                label[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(out):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted((str(k), f"{fp:016x}", str(least.get(find(i)))) for i, (k, fp) in enumerate(out))


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["É", "ÉÀ", "x y"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 40, 200])))
        rows.append((i, text))
        if rng.random() < 0.5:
            cut = text.split(" ")
            cut[rng.randrange(len(cut))] = "edit"
            rows.append((1000 + i, " ".join(cut)))
            rows.append((2000 + i, text.upper() if text.isascii() else text))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (None, None), (None, "only nulls here at all"), (7, rows[7][1]), (6000, "long word " * 30000)]
    return rows


@pytest.mark.parametrize("split", [20_000, 3])
def test_matches_brute_force(spark, split):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], SCHEMA)
    got = simhash.near_duplicates(docs, split=split).collect()
    found = sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", str(r.component_id)) for r in got)
    assert found == brute(rows)


@pytest.mark.parametrize("split", [2, 40, 400])
def test_crowded_groups_lose_no_link(spark, split):
    """Fingerprints that share most of their bits, so that groups stay large at every level."""
    rng = np.random.default_rng(split)
    base = int(rng.integers(0, 1 << 63))
    low = rng.choice(1 << 22, size=700, replace=False).astype(np.uint64)
    fps = np.unique(np.concatenate([np.uint64(base >> 22 << 22) | low, rng.integers(0, 1 << 63, size=100, dtype=np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = np.array([tuple(r) for r in simhash.links(frame, split=split).collect()], dtype=np.int64).reshape(-1, 2).view(np.uint64)
    assert all((int(u) ^ int(v)).bit_count() <= 3 for u, v in edges)

    def classes(pairs):
        label = {int(x): int(x) for x in fps}

        def find(x):
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for u, v in pairs:
            label[max(find(int(u)), find(int(v)))] = min(find(int(u)), find(int(v)))
        return [find(int(x)) for x in fps]

    close = [(u, v) for i, u in enumerate(fps) for v in fps[:i][np.bitwise_count(fps[:i] ^ u) <= 3]]
    assert classes(edges) == classes(close) and len(set(classes(close))) < len(fps)


def test_levels_bound_a_group():
    masks = {0}
    for _ in range(simhash.LEVELS):
        masks = {m for mask in masks for m in simhash._finer(mask, 4)}
    assert all(64 - m.bit_count() <= 21 for m in masks) and len(masks) <= 4**simhash.LEVELS


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_gray_rank_orders_the_reflected_sequence():
    codes = np.array([i ^ i >> 1 for i in range(256)], dtype=np.uint64)
    assert gray_rank(codes).tolist() == list(range(256))


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_the_closure_of_all_links(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, size=40, dtype=np.uint64)
    fps = []
    for c in centres:
        for _ in range(rng.integers(1, 60)):
            flips = rng.choice(64, size=rng.integers(0, 7), replace=False)
            fps.append(int(c) ^ sum(1 << int(b) for b in flips))
    fps = np.unique(np.array(fps, dtype=np.uint64))
    rng.shuffle(fps)
    edges = GrayIndex(fps).link(3)
    assert (np.bitwise_count(fps[edges[:, 0]] ^ fps[edges[:, 1]]) <= 3).all()

    def classes(pairs):
        label = list(range(len(fps)))
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                m = min(label[a], label[b])
                if label[a] != m or label[b] != m:
                    label[a] = label[b] = m
                    changed = True
        return label

    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    assert classes(edges.tolist()) == classes(near.tolist())
    assert len(edges) < len(fps)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text, "a"), (2, text, "b"), (2, text, "b"), (9, "something else is here", "c"), (None, text, "d")], SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "9", "None"]


@pytest.mark.parametrize("size", [1, 5, 40, 1 << 20])
def test_blocks_of_a_text_give_the_same_hashes(size):
    for text in ("", " ", "one", "one two", " one  two three ", "a b c d e f g " * 9, "long" * 30 + " x\ty\nz"):
        whole = [h for part in simhash.text_hashes(text) for h in part.tolist()]
        assert [h for part in simhash.text_hashes(text, size=size) for h in part.tolist()] == whole
        assert len(whole) == max(min(1, len(text.split())), len(text.split()) - 2)


# --- near copies: five-word shingles, a similarity of 0.8 or more -------------------------------------------------


def shingles(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def copies_of(rows, least=0.8):
    """Smallest id among the rows that a chain of similar texts reaches, by comparing all with all."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both) and both:
                label[find(i)] = find(j)
    first = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            first[find(i)] = min(key, first.get(find(i), key))
    return sorted((str(k), str(first.get(find(i)))) for i, (k, _) in enumerate(rows))


def edited(rng, text, n):
    words = text.split(" ")
    for i in range(n):
        words[(i * 2 + 1) * len(words) // (2 * n)] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def copied(seed):
    """Texts with copies that share 0.87 and more of their shingles, or no more than 0.55."""
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        n = rng.choice([3, 8, 90, 150, 400])
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
        rows.append((i, text))
        for k in range(rng.choice([0, 1, 3])):
            if n >= 90:
                rows.append((1000 + 10 * i + k, edited(rng, text, max(1, n // 150))))
                rows.append((3000 + 10 * i + k, edited(rng, text, n // 15)))
        if i % 4 == 0:
            rows.append((2000 + i, text.upper()))
    for i in range(4):  # what is repeated counts once
        rows.append((4000 + i, "again " * 900 + " ".join(f"v{rng.randrange(3000)}" for _ in range(40))))
    return rows + [(5000, None), (5001, ""), (5002, " \t"), (None, rows[2][1]), (None, "only nulls have this text of seven words"), (7, rows[7][1])]


def test_wide_fold_counts_bits():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 255, 256, 700):
        hashes = rng.integers(0, 1 << 64, size=n, dtype=np.uint64)
        got = simhash.fold_wide([hashes[: n // 3], hashes[n // 3 :]], 3, size=300)
        mixed = simhash._mixed(hashes, 3)
        assert got == [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in mixed[:, w]) > n) for w in range(3)]
        assert not n or got[0] == simhash.fold([hashes])


@pytest.mark.parametrize("options", [{}, {"split": 3}])
def test_near_copies_match_brute_force(spark, options):
    rows = copied(4)
    got = simhash.near_copies(spark.createDataFrame([(k, t, "clash") for k, t in rows], SCHEMA).repartition(3), **options).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == copies_of(rows)


def test_recall_of_near_copies(spark):
    """Of pairs at 0.8 to 0.85, more than nine in ten are found; of pairs at 0.5 to 0.6, fewer than three in a hundred."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(400))
        rows += [(i, text), (1000 + i, edited(rng, text, 8)), (2000 + i, edited(rng, text, 24))]
    near = [len(shingles(rows[3 * i][1]) & shingles(rows[3 * i + 1][1])) / len(shingles(rows[3 * i][1]) | shingles(rows[3 * i + 1][1])) for i in range(300)]
    assert all(0.8 <= x < 0.85 for x in near)
    out = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(out[1000 + i] == i for i in range(300)) >= 0.92 * 300
    assert sum(out[2000 + i] != 2000 + i for i in range(300)) <= 9 and all(out[i] == i for i in range(300))


def test_keep_one(spark):
    rows = copied(4)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], SCHEMA)
    kept = sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect())
    want = {k for k, c in copies_of(rows) if k == c and k != "None"}
    assert kept == sorted([*want, "None", "None"])
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_copies(empty).count() == 0 and simhash.keep_one(empty).count() == 0
