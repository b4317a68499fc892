"""Problem 5: near-duplicate pairs against brute force."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docloom.llm.nearcopies import near_groups, near_pairs, prob_minhash


def similarity(a, b):
    p, q = (Counter(re.findall(r"[^\W_]+", (t or "").lower())) for t in (a, b))
    union = sum((p | q).values())
    return sum((p & q).values()) / union if union else 0.0


def rows():
    rng = random.Random(2)
    vocab = [f"term{i}" for i in range(300)]
    out = []
    for base in range(40):
        words = rng.choices(vocab, k=rng.randint(20, 60))
        for copy in range(3):
            edited = list(words)
            for _ in range(copy * rng.randint(0, 6)):
                edited[rng.randrange(len(edited))] = rng.choice(vocab)
            rng.shuffle(edited)
            out.append((base * 10 + copy, " ".join(edited)))
    return out + [(9000, None), (9001, ""), (9002, "!!"), (0, out[0][1]), (None, "a b c"), (9003, out[0][1].upper()), (9004, "solo"), (9005, "x " * 50_000)]


def test_pairs_and_groups(spark):
    data = rows()
    df = spark.createDataFrame(data, "record_id long, text string").selectExpr("*", "1 AS id", "'k' AS keys", "'t' AS version")
    pairs, members = near_pairs(df, "record_id", F.col("text"))
    rep = {r.id: r.rep for r in members.collect()}
    texts = {i: t for i, t in data if i is not None and re.search(r"\w", t or "")}
    assert set(rep) == set(texts)
    assert rep[9003] == rep[0] == 0
    reps = sorted(set(rep.values()))
    expected = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if similarity(texts[a], texts[b]) >= 0.75}
    got = [(r.rep_a, r.rep_b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected
    groups = {r.id: r.group_id for r in near_groups(pairs, members).collect()}
    parent = {i: i for i in reps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in expected:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert groups == {i: find(rep[i]) for i in rep}


def test_empty(spark):
    pairs, members = near_pairs(spark.createDataFrame([], "record_id long, text string"), "record_id", F.col("text"))
    assert pairs.count() == 0 and members.count() == 0
    assert near_groups(pairs, members).count() == 0


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 2**63, 60).astype(np.uint64)
    a = (np.sort(hashes[:45]), rng.integers(1, 5, 45))
    b = (np.sort(hashes[10:]), rng.integers(1, 5, 50))
    wa, wb = ({int(h): w for h, w in zip(*x)} for x in (a, b))
    both = wa.keys() & wb.keys()
    exact = sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in wa.keys() | wb.keys()) for i in both)
    signature = prob_minhash([a, b], 4096)
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.03
    assert not prob_minhash([(np.array([], dtype=np.uint64), np.array([]))], 8).any()


def test_pairs_at_the_threshold_that_a_narrower_search_loses(spark):
    # 48 of 64 words shared: exactly 0.75; 48 bands with 99 of 128 bits lose each of these
    expected, data = set(), []
    for seed in (55, 67, 650, 690, 854, 1091):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(10**6)}" for _ in range(56)]
        other = words[:48] + [f"w{rng.randrange(10**6)}" for _ in range(8)]
        assert similarity(" ".join(words), " ".join(other)) == 0.75
        data += [(2 * seed, " ".join(words)), (2 * seed + 1, " ".join(other))]
        expected.add((2 * seed, 2 * seed + 1))
    pairs, _ = near_pairs(spark.createDataFrame(data, "record_id long, text string"), "record_id", F.col("text"))
    assert {(r.rep_a, r.rep_b) for r in pairs.collect()} == expected
