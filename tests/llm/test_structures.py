"""Centroids, packing and the prefix trie against brute force, odd cases and hot groups included."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import kdtree, mixing, packing, quality, queries, trie

WORDS = queries.tokenizer_file("word_bpe_49k.json")


# -- centroids -----------------------------------------------------------------


def clustered(vectors, k, size, rounds, seed, scale):
    kept = []
    for i, e in vectors:
        if e is not None and len(e) == size and all(x is not None and np.isfinite(x) for x in e):
            kept.append((i, [int(np.floor(scale * x)) for x in e]))
    if not kept:
        return Counter()
    by_hash = sorted((hashlib.sha256(f"{seed}{'' if i is None else i}".encode()).hexdigest(), p) for i, p in kept)
    centroids = [p for _, p in by_hash[:k]]
    apart = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
    for last in range(rounds + 1):
        near = [min(range(len(centroids)), key=lambda z: (apart(p, centroids[z]), z)) for _, p in kept]
        if last == rounds:
            break
        for z in range(len(centroids)):
            own = [p for n, (_, p) in zip(near, kept) if n == z]
            if own:
                centroids[z] = [sum(c) // len(own) for c in zip(*own)]
    far = [apart(p, centroids[n]) for n, (_, p) in zip(near, kept)]
    of = [sum(d for d, n in zip(far, near) if n == z) for z in range(len(centroids))]
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, n, d, of[n], sum(far), told[n]) for (i, _), n, d in zip(kept, near, far))


def test_centroids(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "BLOCK", 150)
    rnd = random.Random(8)
    rows = [(k, [rnd.gauss(0, 1) + (k % 5) for _ in range(6)]) for k in range(500)]
    rows += [(1000 + k, [0.5] * 6) for k in range(300)]  # one vector very often, and ties
    rows += [(7, [1.0] * 6), (7, [2.0] * 6), (None, [1.0] * 6), (None, [1.0] * 6)]
    odd = [(2000, None), (2001, [1.0] * 5), (2002, [None] + [1.0] * 5), (2003, [float("nan")] * 6), (2004, [float("inf")] + [0.0] * 5), (2005, []), (2006, [-0.001] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "2 AS n", "3 AS ids").repartition(3)
    plain = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = clustered(plain, 8, 6, 3, "1:", 4.0)
    for parts in (1, 5):
        assert Counter(map(tuple, kdtree.cluster(df.repartition(parts), 8, 6, 3, "1:", 4.0).collect())) == want
    few = df.where("vec_id < 3")
    assert Counter(map(tuple, kdtree.cluster(few, 8, 6, 3, "1:", 4.0).collect())) == clustered([r for r in plain if r[0] is not None and r[0] < 3], 8, 6, 3, "1:", 4.0)
    assert kdtree.cluster(df.limit(0), 8, 6, 3).collect() == []
    beyond = spark.createDataFrame([(1, [1e30] * 6), (2, [0.0] * 6)], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["distance"]) for r in kdtree.cluster(beyond, 8, 6, 1).collect()] == [(2, 0)]


def test_pruning_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 3, (600, 4)) for c in ((0, 0, 0, 0), (90, 0, 0, 9), (0, 90, 9, 0))]).astype(np.int32)
    order, t = kdtree.build(points)
    row = {"ids": np.arange(len(points))[order].tobytes(), "known": np.ones(len(points), bool).tobytes(), "points": points[order].tobytes(), **{k: v.tobytes() for k, v in t.items()}}
    tree = kdtree.Tree(row, 4)
    assert sorted(order.tolist()) == list(range(len(points)))
    centroids = np.array([[0, 0, 0, 0], [90, 0, 0, 9], [0, 90, 9, 0], [0, 90, 9, 0]], np.int64)
    near, far = tree.assigned(centroids)
    d = ((points[order].astype(np.int64)[:, None] - centroids[None]) ** 2).sum(-1)
    assert (near == d.argmin(1)).all() and (far == d.min(1)).all()
    n, total, inertia = tree.sums(centroids)
    assert n.tolist() == np.bincount(near, minlength=4).tolist() and inertia.sum() == far.sum()
    assert all((total[z] == points[order][near == z].sum(0)).all() for z in range(4))
    whole, leaves = tree.filter(centroids[:3])
    # groups far apart are assigned as nodes; halves by number leave a few leaves at the groups' edges
    assert tree.count[whole[:, 0]].sum() > 0.9 * len(points) and tree.count[leaves[:, 0]].sum() + tree.count[whole[:, 0]].sum() == len(points)


# -- packing -----------------------------------------------------------------------


def checked_pieces(rows, texts):
    """Every id lies in one piece, sequences have no gap and no padding."""
    from tokenizers import Tokenizer

    told = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, x in texts:
        ids = told.encode(x or "", add_special_tokens=False).ids + [1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    inside = defaultdict(list)
    for r in rows:
        inside[r["sequence_id"]].append(r)
    for own in inside.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0
    assert sorted(inside) == list(range(len(inside)))
    return want


def test_packing(spark, docs, corpus):
    pieces = packing.pack(docs, WORDS).persist()
    rows = pieces.collect()
    assert [f for f in pieces.columns] == [x.split()[0] for x in packing.PIECES.split(", ")]
    want = checked_pieces(rows, corpus)
    # documents of one id are told apart by their pieces' totals only, so whole documents are compared where ids are single
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    single = Counter(i for i, _, _ in want.elements())
    for (i, n, crc), times in want.items():
        own = sorted(by[i], key=lambda r: r["start"])
        if single[i] == 1:
            assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
            assert zlib.crc32(b"".join(bytes(r["ids"]) for r in own)) == crc and all(r["doc_tokens"] == n for r in own)
    assert sum(r["length"] for r in rows) == sum(n * t for (_, n, _), t in want.items())
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    for r in rows:
        assert bytes(whole[r["sequence_id"]]["ids"])[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    crc = {(r["sequence_id"], r["offset"]): r["ids_crc32"] for r in packing.digests(pieces).collect()}
    assert all(crc[r["sequence_id"], r["offset"]] == zlib.crc32(bytes(r["ids"])) for r in rows)
    pieces.unpersist()


def test_packing_of_equal_lengths(spark, monkeypatch):
    """One length holds most documents; ranks are joined by a shuffle."""
    monkeypatch.setattr(packing, "MOST_BROADCAST", 0)
    texts = [(k, "the " * (682 if k % 3 else 1 + k % 50)) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    pieces = packing.pack(docs, WORDS)
    rows = pieces.collect()
    checked_pieces(rows, texts)
    assert packing.pack(docs.limit(0), WORDS).collect() == []


def test_words_apart_give_the_ids_of_the_text(corpus):
    words = packing.word_ids(WORDS)
    texts = [t or "" for _, t in corpus] + ["don't. a.'s H\u0331.x Don'T! re's'd x1y ...a'LL É.a e\u0301.b A\u0300", "It's\tDON'T  we'll\x1cx\x85y z İstanbul ΣΑΣ é ́x <|endoftext|>a <|ENDOFTEXT|> 12345 ,;--"]
    for t, ids in zip(texts, words.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, words.kind).tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_patterns():
    """The knapsack's totals are exact; the program leaves little and never uses more documents than there are."""
    lengths, values = np.array([3, 5, 7]), np.array([1.0, 2.5, 3.0])
    best, take = packing.knapsack(lengths, values, 16)
    for t in range(17):
        sums = [a * 1.0 + b * 2.5 + c * 3.0 for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c == t]
        assert best[t] == (max(sums) if sums else -np.inf)
        if sums and t:
            assert sum(int(lengths[j]) * a for j, a in packing._trace(t, lengths, take).items()) == t
    counts = np.zeros(packing.SIZE, np.int64)
    counts[[700, 648, 1024, 1000, 1048, 5]] = [500, 250, 400, 90, 90, 3]
    made = packing.plan(counts)
    assert (made.taken <= counts).all() and made.about["cut"] <= 6  # 2 x 700 + 648, 2 x 1024, 1000 + 1048
    assert made.total == ((counts - made.taken) * np.arange(packing.SIZE)).sum()
    seen = Counter()
    for length in np.flatnonzero(counts).tolist():
        for rank in range(counts[length]):
            for start, n, sequence, offset in packing.place(made, length, rank, made.sequences):
                seen.update((sequence, at) for at in range(offset, offset + n))
    assert max(seen.values()) == 1 and sum(seen.values()) == (counts * np.arange(packing.SIZE)).sum()


# -- trie ---------------------------------------------------------------------------


def nodes_by_hand(seqs):
    """``seqs``: id to a list of turns (told, bytes)."""
    members = defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, own in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(own) - 1) * k[-1][1] if k else 0
    least = {k: min(c for c, _ in own) for k, own in members.items()}
    ends = {k: ",".join(str(c) for c, n in sorted(own) if n == len(k)) for k, own in members.items()}
    return Counter((least[k], len(k), least[k[:-1]] if k else None, len(own), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, own in members.items())


def keys_of(seqs):
    told = lambda t: hashlib.sha256(str(t[0]).encode()).digest()[: trie.DIGEST] + t[1].to_bytes(trie.UNIT - trie.DIGEST, "big")
    return [(c, bytearray(b"".join(map(told, turns)))) for c, turns in seqs.items()]


@pytest.mark.parametrize("case", ["bushy", "hot", "deep", "equal", "turnless", "one", "no common turn"])
def test_trie_against_brute_force(spark, case):
    rnd = random.Random(case)
    turn = lambda k: (k, 3 + 7 * k)
    if case == "bushy":
        seqs = {k: [turn(rnd.randrange(3)) for _ in range(rnd.randrange(7))] for k in range(400)}
    elif case == "hot":  # a third equal, another third one first turn
        seqs = {k: [turn(1), turn(2), turn(3)] if k % 3 == 0 else [turn(1)] + [turn(rnd.randrange(9)) for _ in range(rnd.randrange(5))] if k % 3 == 1 else [turn(rnd.randrange(50))] for k in range(450)}
    elif case == "deep":
        seqs = {k: [turn(0)] * rnd.randrange(60) + [turn(1)] * rnd.randrange(3) for k in range(300)}
    elif case == "equal":
        seqs = {-k: [turn(4), turn(5)] for k in range(300)}
    elif case == "turnless":
        seqs = {k: [] for k in range(50)}
    elif case == "one":
        seqs = {5: [turn(1), turn(2)]}
    else:
        seqs = {k: [turn(k), turn(1)] for k in range(100)}
    df = spark.createDataFrame(keys_of(seqs), "conv_id long, key binary")
    want = nodes_by_hand(seqs)
    for parts in (2, 40) if case in ("bushy", "hot", "deep") else (7,):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            assert Counter(map(tuple, trie.prefix_trie(df).collect())) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_of_odd_turns(spark):
    rows = [(1, 2, "user", "b"), (1, None, "user", "first"), (1, 1, None, None), (2, None, "user", "first"), (2, 0, "", ""), (2, 0, "", ""), (None, 1, "user", "lost"), (3, 1, "user", "x" * 100_000), (4, 1, "z", "b"), (4, 1, "a", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS rows", "3 AS unit")
    seqs = {1: [("user", "first"), ("", ""), ("user", "b")], 2: [("user", "first"), ("", ""), ("", "")], 3: [("user", "x" * 100_000)], 4: [("a", "c"), ("z", "b")]}
    want = nodes_by_hand({c: [(t, len(t[1].encode())) for t in turns] for c, turns in seqs.items()})
    assert Counter(map(tuple, trie.prefix_trie(trie.sequences(df)).collect())) == want
    assert trie.prefix_trie(trie.sequences(df.limit(0))).collect() == []


def test_prefixes_of_other_conversations(spark):
    rows = [(c, k, "user", f"{c}.{k}") for c, n in ((0, 5), (1, 2), (2, 6), (7, 4), (10, 1), (11, 0)) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seqs = trie.sequences(df)
    got = {r["conv_id"]: bytes(r["key"]) for r in trie.joined_prefixes(seqs, F.col("conv_id") - F.col("conv_id") % 5, F.lit(3)).collect()}
    key = {r["conv_id"]: bytes(r["key"]) for r in seqs.collect()}
    u = trie.UNIT
    assert got == {0: key[0], 1: key[0][: 3 * u], 2: key[0][: 3 * u] + key[2][3 * u :], 7: key[7][3 * u :], 10: key[10]}


def test_registered_trie(spark, small):
    import duckdb

    convs = defaultdict(list)
    for c, t, r, x in duckdb.sql(f"select * from '{small}/conversations.parquet'").fetchall():
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    own = {c: [((r, x), len(x.encode())) for _, r, x in sorted(v)] for c, v in convs.items()}
    cut = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    rebuilt = {c: own.get(c - c % 5, [])[: cut[c]] + own[c][cut[c] :] for c in own}
    assert Counter(map(tuple, queries.queries()["op13_prefix_trie"](spark, small).collect())) == nodes_by_hand(rebuilt)


def test_registered_centroids_and_packing(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert Counter(map(tuple, queries.queries()["op11_centroids"](spark, small).collect())) == clustered(rows, 16, 64, 3, "1:", 64.0)
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    checked_pieces(queries.queries()["op12_packing"](spark, small).collect(), texts)


# -- the quality discriminant and wide counts -----------------------------------------


def test_discriminant_against_plain_densities(spark):
    """Scores of rows of statistics are those of two normal densities with shrunk covariances, put through the fitted curve."""
    rng = np.random.default_rng(12)
    d = len(quality.FEATURES)
    mixers = [rng.normal(size=(d, d)) / 3, rng.normal(size=(d, d)) / 2]
    x = [rng.normal(size=(n, d)) @ m + shift for n, m, shift in ((160, mixers[0], 0.0), (110, mixers[1], 0.4))]
    rows = [(k, v.tolist(), z) for z in (0, 1) for k, v in enumerate(x[z], 1000 * z)]
    df = spark.createDataFrame(rows, "doc_id long, stats array<double>, label int").repartition(5)
    model = quality.fit(df)
    n = [len(v) for v in x]
    cov = [np.cov(v.T, bias=True) for v in x]
    pooled = np.diag(np.maximum((n[0] * np.diag(cov[0]) + n[1] * np.diag(cov[1])) / sum(n), 1e-4))
    every, densities = np.concatenate(x), []
    for z in (0, 1):
        w = min(1.0, quality.SHRINKAGE + d / (n[z] + d))
        c = (1 - w) * cov[z] + w * pooled
        away = every - x[z].mean(axis=0)
        densities.append(np.log(n[z] / sum(n)) - 0.5 * (np.einsum("nd,nd->n", away, np.linalg.solve(c, away.T).T) + np.linalg.slogdet(c)[1]))
    gap = np.clip(densities[1] - densities[0], -quality.SPAN, quality.SPAN)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    want = 1 / (1 + np.exp(-(model.slope * gap + model.offset)))
    assert np.allclose([got[k] for k, _, _ in rows], want, atol=1e-9)
    # the curve is where the likelihood of the binned gaps, pulled weakly to slope 1, is flat
    edges = np.linspace(-quality.SPAN, quality.SPAN, quality.BINS + 1)
    mid = (edges[1:] + edges[:-1]) / 2
    ones, zeros = (np.histogram(gap[[r[2] == z for r in rows]], edges)[0] for z in (1, 0))
    loss = lambda a, b: -(ones * -np.log1p(np.exp(-(a * mid + b))) + zeros * -np.log1p(np.exp(a * mid + b))).sum() + (a - 1) ** 2 / 2 + 0.005 * b * b
    assert all(loss(model.slope, model.offset) <= loss(model.slope + i, model.offset + j) + 1e-12 for i in (-1e-3, 0, 1e-3) for j in (-1e-3, 0, 1e-3))


def test_counts_beyond_32_bits():
    block = {"runs": [mixing.pack(np.array([2]))], "context": [np.array([7], np.uint64).tobytes()], "classes": [mixing.pack(np.array([1]))], "codes": [mixing.pack(np.array([5, 9]))], "hot": [mixing.pack(np.array([0]))], "counts": [mixing.pack(np.array([3 << 30, 3 << 30]))], "chunk": [0]}
    made = mixing.PairBlock(block)
    assert made.count.tolist() == [3 << 30, 3 << 30] and made.nodes(0).tolist() == [6 << 30, 6 << 30]
