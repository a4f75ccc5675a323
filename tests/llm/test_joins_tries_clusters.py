"""Small cases of the exact set join, the prefix trie and the clustering: 11, 12 and 13."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from codeloom.llm import centroids, ngram_join, prefix_trie

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 11 --------------------------------------------------------------------------------------------------


def shingles(text):
    ws = SPACED.findall((text or "").translate(LOWER))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def join_by_hand(docs, percent=80):
    sets = [(i, shingles(t)) for i, t in docs]
    up = {i: i for i, _ in docs if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                i_, j_ = root(i), root(j)
                up[max(i_, j_)] = min(i_, j_)
    return sorted((str(i), len(s), None if i is None else root(i)) for i, s in sets)


def near_corpus(seed):
    """Groups of near copies and copies, a passage that most share, short, blank and null texts."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 400))
    passage = [word() for _ in range(40)]
    docs, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(5, 60))]
        for _ in range(rnd.randint(1, 14)):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = word()
            docs.append((i, rnd.choice([" ", "\t", "  "]).join(text).upper() if rnd.random() < 0.2 else " ".join(text)))
            i += 1
    for _ in range(40):
        own = [word() for _ in range(rnd.randint(0, 12))]
        at = rnd.randint(0, len(own))
        docs.append((i, " ".join(own[:at] + passage + own[at:])))
        i += 1
    docs += [(i + k, t) for k, t in enumerate(["", None, " \n\t", "one", "ONE", "a b c d", "a b c d", "a b c", "x" * 5000])]
    docs += [(3, docs[40][1]), (None, docs[0][1]), (None, None), (docs[5][0], docs[5][1])]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "small", "narrow", "block", "percent"), [(1, 8, 4096, 256, 80), (2, 2, 7, 3, 80), (3, 3, 16, 5, 60), (4, 2, 9, 4, 95)])
def test_ngram_join(spark, seed, small, narrow, block, percent, monkeypatch):
    """Against all pairs; also with tiny buckets and blocks, so that every path is taken."""
    for name, value in (("SMALL_BUCKET", small), ("NARROW_BLOCK", narrow), ("BLOCK", block), ("COUNTED_FROM", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    docs = near_corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df, percent=percent).collect())
    assert got == join_by_hand(docs, percent)


def test_members_of_one_block_are_dealt_once(spark):
    """op11, round 3: only buckets of several blocks are copied, and every member outside the main component still meets all."""
    rows = [("one", i, i % 4, 0, 1, 1) for i in range(12)] + [("two", i, i % 4, 0, 2, 3) for i in range(24)]
    dealt = ngram_join._dealt(spark.createDataFrame(rows, "bucket string, id long, c long, main long, rest_blocks int, all_blocks int"), ["id", "c"])
    assert dealt.filter("bucket = 'one'").count() == 12 and dealt.filter("bucket = 'two'").count() == 18 * 3 + 24 * 2
    met = {(bucket, a[0], b[0]) for bucket, rest, every in ngram_join._blocks(iter(dealt.coalesce(1).sortWithinPartitions("bucket", "x", "y", "side").toArrow().to_batches()), ["id", "c"]) for a in rest for b in every}
    assert met == {(r[0], r[1], q[1]) for r in rows for q in rows if r[0] == q[0] and r[2] != 0}


def test_features_travel_for_wanted_ends_only(spark):
    rows = spark.createDataFrame([(i, i * 2) for i in range(2000)], "id long, n long")
    got = {r["id"] for r in ngram_join._those_of(rows, spark.createDataFrame([(k,) for k in range(0, 2000, 400)], "id long")).collect()}
    assert {0, 400, 800, 1200, 1600} <= got and len(got) < 500


def test_ngram_join_empty(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="percent"):
        ngram_join.ngram_join(spark.createDataFrame([], "doc_id long, text string"), percent=100)


def test_filters_lose_no_link():
    """Linked sets pass the sizes, the places of the first common token, the parity and every order's prefix."""
    rnd = np.random.default_rng(5)
    known = ngram_join.Frequent(np.arange(0, 40, dtype=np.uint64), np.arange(1, 41))
    for _ in range(400):
        common = rnd.integers(0, 1 << 62, rnd.integers(4, 120 if rnd.random() < 0.9 else 9000), dtype=np.uint64)
        common[: rnd.integers(0, 10)] = rnd.integers(0, 40, 1, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rnd.integers(0, 1 << 62, rnd.integers(0, len(common) // 6 + 1), dtype=np.uint64)])) for _ in "ab")
        both = np.intersect1d(a, b)
        linked = 100 * len(both) >= 80 * (len(a) + len(b) - len(both))
        if not linked:
            continue
        x, y = (np.sort(ngram_join.first_order(s, known)) for s in (a, b))
        first = np.intersect1d(x, y)[0]
        i, j = np.flatnonzero(x == first)[0], np.flatnonzero(y == first)[0]
        assert i < ngram_join.prefix(len(a), 80) and j < ngram_join.prefix(len(b), 80)
        assert ngram_join.possible(np.int64(len(a)), i, np.int64(len(b)), j, 80)
        bits = [np.frombuffer(ngram_join.parity(s), dtype=np.uint64) for s in (a, b)]
        assert ngram_join.differing(*bits) <= len(a) + len(b) - 2 * ngram_join.overlap(np.int64(len(a)), np.int64(len(b)), 80)
        for p, q in zip(*(ngram_join.other_prefixes(s, ngram_join.prefix(len(s), 80), known) for s in (a, b)), strict=True):
            assert ngram_join.meets(p, q)


# --- 12 --------------------------------------------------------------------------------------------------


def trie_by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    seqs = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, s in seqs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = seqs.get(base, [])[:h] + s[h:]
    nodes = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []

    def below(p):
        leaves, saved = (1 if p not in children else 0), (len(nodes[p]) - 1) * len(SPACED.findall(p[-1][1]) if p else [])
        for q in children.get(p, []):
            a, b = below(q)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(made[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if nodes:
        below(())
    return sorted(out, key=str)


def talks(seed, n=90):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        first = rnd.choice(["hello there", "hello", None, "a  b\tc", "xé"])
        for t in range(rnd.choice([1, 2, 3, 3, 4, 9])):
            rows.append((c - 20, t if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", None, ""]) if t else "user", first if t == 0 else rnd.choice(["yes", "no", "long text here"])))
    rows += [(1000 + 20 * k + j, t, "user", f"same {t}") for k in range(3) for j in (0, 1, 2) for t in range(3)]
    rows += [(2001, 0, "user", "alone"), (2002, 0, "user", None), (None, 0, "user", "nobody"), (rows[0])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("ranges", "run_rows", "block", "piece"), [(1_000_000, 20_000, 512, 50_000), (5, 7, 2, 2), (20, 3, 1, 1)])
def test_prefix_trie(spark, ranges, run_rows, block, piece, monkeypatch):
    """Against a walk over all prefixes; also with tiny runs, blocks and pieces, over many ranges."""
    for name, value in (("RUN_ROWS", run_rows), ("BLOCK", block), ("PIECE", piece)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = talks(ranges)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    got = prefix_trie.prefix_trie(df, range_turns=ranges)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie_by_hand(rows)


def test_prefix_trie_copies_over_ranges(spark):
    """One long group of equal conversations spans many ranges; its ends are one list in order."""
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(400) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(df, range_turns=20).collect()), key=str)
    assert got == trie_by_hand(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []


def test_merge_compares_little():
    """Runs merge into one sorted stream with right common prefixes, and shared turns are not compared again."""
    rnd = random.Random(2)
    rows = [([rnd.choice([b"a" * 16, b"b" * 16]) for _ in range(rnd.randint(0, 12))], np.zeros(0, dtype=np.int32), i) for i in range(500)]
    rows = [(t, np.arange(len(t), dtype=np.int32), i) for t, _, i in rows]
    merge = prefix_trie.Merge([prefix_trie.sorted_run(rows[k::7]) for k in range(7)])
    out = list(merge)
    assert [(t, i) for _, t, _, i in out] == sorted((t, i) for t, _, i in rows)
    before = []
    for lcp, turns, words, _ in out:
        assert lcp == prefix_trie.common(before, turns) and words.tolist() == list(range(len(turns)))
        before = turns
    assert merge.compared < sum(len(t) for t, _, _ in rows)


# --- 13 --------------------------------------------------------------------------------------------------


def clusters_by_hand(rows, k, rounds, dims, scale, seed=1):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dims and all(c is not None and np.isfinite(c) for c in x):
            kept.append((i, [max(-(1 << 27), min(1 << 27, int(np.floor(max(-1e18, min(1e18, float(np.float32(c)) * scale)))))) for c in x]))
    start = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "~"), n) for n, (i, _) in enumerate(kept))[:k]
    cs = [kept[n][1] for _, n in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cs = [[sum(col) // len(ms) for col in zip(*ms, strict=True)] if (ms := [v for (_, v), o in zip(kept, own, strict=True) if o == j]) else c for j, c in enumerate(cs)]
    last = [near(v) for _, v in kept]
    total = {j: sum(d for d, o in last if o == j) for j in range(len(cs))}
    return sorted(((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str)


@pytest.mark.parametrize(("seed", "n", "k"), [(1, 300, 16), (2, 40, 5), (3, 9, 16), (4, 3, 1)])
def test_centroids(spark, seed, n, k):
    """Against all distances: few distinct values make ties and equal centroids."""
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([0.0, 0.5, 1.0, -0.25, -0.26]) for _ in range(4)]) for i in range(n)]
    rows += [(500, None), (501, [1.0]), (502, [1.0, None, 0.0, 0.0]), (503, [float("nan"), 0.0, 0.0, 0.0]), (504, [float("inf"), 0.0, 0.0, 0.0]), (505, [])]
    rows += [(506, [1e7, -3e5, 1e30, 0.0]), (507, [200.0, 1.0, -200.0, 0.0])] if seed == 2 else []
    df = spark.createDataFrame([(i, x, 7) for i, x in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    got = centroids.centroid_clusters(df, clusters=k, rounds=3, dims=4, scale=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == clusters_by_hand(rows, k, 3, 4, 8)


def test_centroids_odd(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.centroid_clusters(empty).collect() == []
    odd = spark.createDataFrame([(None, [1.0, 1.0]), (1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.9])], "vec_id long, embedding array<double>")
    got = centroids.centroid_clusters(odd, clusters=2, rounds=2, dims=2).collect()
    assert len(got) == 4 and {r["vec_id"] for r in got} == {None, 1, 2}


def test_bounds_skip_and_keep_ties():
    """Bounds save distances over rounds, and every round's nearest centroids are those of all distances."""
    rnd = np.random.default_rng(3)
    v = (rnd.integers(0, 8, (600, 1)) * 40 + rnd.integers(-3, 4, (600, 6))).astype(np.int64)
    cs, before = v[:8].copy(), None
    own, upper, lower, taken = np.zeros(600, dtype=np.int64), np.full(600, np.inf), np.zeros((600, 8)), 0
    for _ in range(6):
        own, upper, lower, n = centroids.assign(v, own, upper, lower, centroids.Round(cs, before))
        lower = centroids._lower32(lower)
        d = ((v[:, None] - cs[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all()
        assert (upper >= np.sqrt(d[np.arange(600), own])).all() and (lower <= np.sqrt(d)).all()
        taken += n
        cs, before = np.array([v[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else cs[j] for j in range(8)]), cs
    assert taken < 0.6 * 6 * 600 * 8
