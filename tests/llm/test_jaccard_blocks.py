"""The exact comparison of blocks and the dealing of groups, against brute force."""

import numpy as np
import pytest

from gridloom.llm import chosen_path


def brute(sets, weight, block, cross, threshold):
    partners, links = [0] * len(sets), []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if cross and block[i] == block[j]:
                continue
            both = len(sets[i] & sets[j])
            if both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                partners[i] += weight[j]
                partners[j] += weight[i]
                links.append((i, j))
    root = list(range(len(sets)))
    for _ in sets:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return root, partners


@pytest.mark.parametrize("kind", ["chain", "copies", "mixed"])
def test_exact_links_against_brute_force(kind):
    rng = np.random.default_rng(1)
    if kind == "chain":  # each shares most with the next, all of them nothing
        sets = [set(range(3 * i, 3 * i + 40)) for i in range(150)]
    elif kind == "copies":
        sets = [set(range(100)) - set(rng.choice(100, 5).tolist()) for _ in range(120)]
    else:
        sets = [set(rng.choice(60, rng.integers(1, 50), replace=False).tolist()) | set(range(1000 * (i % 7), 1000 * (i % 7) + 90)) for i in range(120)]
    for cross in (False, True):
        weight, block = rng.integers(1, 5, len(sets)), rng.integers(0, 2, len(sets))
        hashes = [np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets]
        root, partners = chosen_path.exact_links([np.sort(h) for h in hashes], weight, block, cross, 0.8)
        want = brute(sets, weight.tolist(), block.tolist(), cross, 0.8)
        assert (root.tolist(), partners.tolist()) == want


@pytest.mark.parametrize(("block", "grams"), [(8, 300), (8, 1 << 20), (2048, 300)])
def test_large_buckets_and_groups_give_the_same(spark, block, grams):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(60):
        words = list(base)
        words[int(rng.integers(60))] = f"x{k % 20}"
        texts.append(" ".join(words))
    texts += [" ".join(f"a{rng.integers(1000)}" for _ in range(50)) for _ in range(40)] + texts[:5] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams_of = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(max(len(w) - 4, 1))} if t else set()
    sets = [grams_of(t) for t in texts]
    root, partners = brute([s or {i} for i, s in enumerate(sets)], [1] * len(sets), [0] * len(sets), False, 0.8)
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.jaccard_classes(docs, leaf=4, block=block, grams=grams, recall=0.9999).collect()}
    assert got == {i: (root[i], partners[i]) for i in range(len(texts))}
