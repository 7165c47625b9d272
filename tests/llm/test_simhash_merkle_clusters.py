"""SimHash near-dedup, Merkle manifest and centroid clustering against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from streetloom.llm import clusters, merkle, simhash

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, DIGEST string, tree string, fp string"


def plain_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    votes = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(runs))


def least_reachable(nodes, linked):
    """nodes: {name: id}; the least id of all that the links reach."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    names = list(nodes)
    for i, a in enumerate(names):
        for b in names[:i]:
            if linked(a, b):
                up[top(a)] = top(b)
    least = {}
    for n, k in nodes.items():
        least[top(n)] = min(k, least.get(top(n), k))
    return {n: least[top(n)] for n in nodes}


def near(a, b):
    return (a ^ b).bit_count() <= 3


def check_simhash(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string") if isinstance(rows, list) else rows
    texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    fps = {}
    for k, t in texts:
        if k is not None:
            f = plain_fingerprint(t)
            fps[f] = min(k, fps.get(f, k))
    least = least_reachable(fps, near)
    want = sorted((str(k), f"{plain_fingerprint(t):016x}", str(None if k is None else least[plain_fingerprint(t)])) for k, t in texts)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df, **how).collect()) == want
    return least


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_simhash(spark, docs)
    # Each with a word more: near copies of the longer ones.
    more = docs.select((simhash.F.col("doc_id") + 1000).alias("doc_id"), simhash.F.concat("text", simhash.F.lit(" more")).alias("text"))
    least = check_simhash(spark, docs.select("doc_id", "text").union(more), shard=40)
    assert len(set(least.values())) < len(least) - 20


def test_simhash_edges(spark):
    rows = [(None, "no id"), (None, None), (3, None), (1, ""), (9, " \n"), (4, "One  word"), (4, "one word"), (5, "a b c d"), (5, "other words for one id"), (6, "A B\tC d"), (7, "long " * 70_000 + "end"), (8, "x" * 50_000), (2, "é 漢字 ÀB")]
    check_simhash(spark, rows)
    extra = spark.createDataFrame([(1, "a", "b", "c", 1, "d", "t", "f")], DOCS)
    assert simhash.near_duplicates(extra).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(extra.limit(0)).count() == 0


def family(rng, n, spread):
    """Fingerprints in families: a few bits from a centre, or from a member before."""
    out = set()
    while len(out) < n:
        centre = rng.getrandbits(64)
        out.add(centre)
        for _ in range(rng.randint(0, 40)):
            centre = rng.choice([centre, centre ^ 1 << rng.randrange(64)])
            f = centre
            for b in rng.sample(range(64), rng.randint(0, spread)):
                f ^= 1 << b
            out.add(f)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("shard", [64, 500, 10_000])
def test_simhash_links_over_many_shards(spark, shard):
    """Links of small shards, with visitors in several blocks, span the same components as all pairs."""
    fps = family(random.Random(shard), 1500, 5)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").repartition(3)
    got = simhash.links(df, shard=shard).collect()
    pairs = {tuple(sorted((r.u, r.v))) for r in got}
    assert all(near(u & (1 << 64) - 1, v & (1 << 64) - 1) for u, v in pairs)
    nodes = {int(f): int(f) for f in fps}
    mask = (1 << 64) - 1
    linked = {(u & mask, v & mask) for u, v in pairs}
    linked |= {(v, u) for u, v in linked}
    want = least_reachable(nodes, near)
    assert least_reachable(nodes, lambda a, b: (a, b) in linked) == want and len(set(want.values())) < len(want)


def test_simhash_router_overlaps_boundaries():
    fps = family(random.Random(1), 3000, 3)
    upper = simhash.Upper(fps[::5], 30)
    row, shard, home = upper.route(fps)
    assert upper.shards > 10 and sorted(row[home].tolist()) == list(range(len(fps)))
    at = {int(r): int(s) for r, s in zip(row[home], shard[home], strict=True)}
    visits = set(zip(row.tolist(), shard.tolist(), strict=True))
    near_ = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    for i, j in np.argwhere(near_):
        low, high = sorted((at[int(i)], at[int(j)]))
        first = i if at[int(i)] == low else j
        assert (int(first), high) in visits


def test_simhash_family_of_one_ball_gives_a_forest():
    """All fingerprints within two bits of each other: pairs grow with the square, links do not."""
    centre = 0x123456789ABCDEF
    fps = np.array([centre] + [centre ^ 1 << b for b in range(64)] + [centre ^ 1 << b ^ 1 << (b + 1) % 64 for b in range(64)], np.uint64)
    assert len(simhash.forest_links(fps, fps[:0], True)) == len(fps) - 1


def test_simhash_dense_family():
    """Thousands of fingerprints within a few bits of one: trees stay flat, and components are those of all pairs."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)} | {rng.getrandbits(64) for _ in range(300)}
    fps |= {f ^ 7 << 20 for f in list(fps)[::40]} | {centre ^ rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) for _ in range(300)}
    fps = np.array(sorted(fps), np.uint64)
    assert simhash.Upper(fps, 300).shards >= 1
    near_ = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    forest = simhash.Forest(len(fps))
    forest.link(*np.nonzero(np.triu(near_, 1)))
    want = forest.roots()
    for cut in (0, 700):
        got = simhash.Forest(len(fps))
        for members, visitors, base in ((fps[cut:], fps[:0], cut), (fps[:cut], fps[cut:], 0), (fps[:cut], fps[:0], 0)):
            found = np.array(simhash.forest_links(members, visitors, not len(visitors)), int).reshape(-1, 2)
            assert len(found) < len(members) + len(visitors) + 1 and near_[found[:, 0] + base, found[:, 1] + base].all()
            got.link(found[:, 0] + base, found[:, 1] + base)
        assert (got.roots() == want).all() and len(np.unique(want)) < len(fps) - 2000


def plain_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) to what the query returns."""

    def H(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def up(row):
        levels = [row]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, at):
        for row in levels[:-1]:
            low = at // 8 * 8
            yield row[low:at], row[at + 1 : low + 8]
            at //= 8

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in langs}
    levels = {k: up([leaf(r) for r in t]) for k, t in trees.items()}
    over = up([levels[k][-1][0] for k in langs])
    root = over[-1][0]
    for i, k in enumerate(langs):
        for at, r in enumerate(trees[k]):
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            h = leaf((*r[:4], r[4].translate(LOW) if r[4] is not None else None)) if tampered else leaf(r)
            proof = ""
            for before, after in [*way(levels[k], at), *way(over, i)]:
                proof += "".join(before + after)
                h = H(*before, h, *after)
            yield r[0], leaf(r), levels[k][-1][0], root, H(proof), h, h == root


def check_manifest(df):
    rows = [tuple(r[c] for c in merkle.COLUMNS) for r in df.collect()]
    got = merkle.verified(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    out = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, out)) == sorted(map(repr, plain_manifest(rows)))
    return out


def test_manifest_edges(spark):
    rows = [(None, "No Id", "en"), (1, None, None), (2, "", ""), (3, "A", "en"), (3, "A", "en"), (3, "B", "en"), (4, "Same", "fr"), (5, "Long " * 50_000, "zz"), (6, "é 漢字", "É"), *[(k, f"Text {k}", "de") for k in range(20, 93)], *[(7, "Copy", "cc")] * 70]
    out = check_manifest(spark.createDataFrame([(k, t, g, None if k == 4 else "s", k and len(t or ""), "x", "y", "z") for k, t, g in rows], DOCS))
    assert len({r[6] for r in out}) == 2
    one = spark.createDataFrame([(5, "lone", "en", "s", 4, "x", "y", "z")], DOCS)
    assert check_manifest(one)[0][4] == hashlib.sha256(b"").hexdigest()
    assert merkle.verified(one.limit(0)).count() == 0


def test_manifest_of_many_trees_and_runs(spark, monkeypatch):
    """Runs far shorter than a tree, trees of one leaf, and places met by a shuffle rather than a broadcast."""
    rows = [(k, f"t{k}", f"only{k}" if k % 9 == 0 else ["en", None][k % 2], "s", k, "", "", "") for k in range(1200)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    monkeypatch.setattr(merkle, "RUN_ROWS", 37)
    check_manifest(df)
    monkeypatch.setattr(merkle, "FEW_RUNS", 0)
    check_manifest(df)


def plain_clusters(rows, k=8, rounds=10):
    q = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in q)
    centres = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in q]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            own = [v for (_, c), (_, v) in zip(found, q, strict=True) if c == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    for (i, _), (d, c) in zip(q, found, strict=True):
        yield i, c, d, sum(x for x, y in found if y == c), sum(x for x, _ in found), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()


def check_clusters(spark, rows, monkeypatch, tmp_path):
    path = str(tmp_path / str(len(rows)))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("Q", simhash.F.lit(1)).write.parquet(f"{path}/embeddings.parquet")
    got = [tuple(r) for r in clusters.query(spark, path).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_clusters(rows)))
    return got


def test_clusters_edges(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    some = [(k, (rng.standard_normal(64).astype(np.float32) * 0.2).tolist()) for k in range(60)]
    bad = [(100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 65), (104, [None] + [0.0] * 63), (105, [float("nan")] + [0.0] * 63), (106, [float("inf")] * 64)]
    hot = [(k, some[3][1]) for k in range(200, 240)] + [(3, some[3][1])] * 3 + [(None, [0.5] * 64), (None, [-0.5] * 64)]
    assert len(check_clusters(spark, some + bad + hot, monkeypatch, tmp_path)) == 60 + 45
    check_clusters(spark, some[:3] + bad, monkeypatch, tmp_path)
    assert check_clusters(spark, bad, monkeypatch, tmp_path) == []
    assert clusters.query(spark, str(tmp_path / str(len(bad)))).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    # Every vector the same: equal centroids, all but the first stay empty.
    assert {r[1] for r in check_clusters(spark, [(k, [0.25] * 64) for k in range(30)], monkeypatch, tmp_path)} == {0}


def test_clusters_sum_with_weights():
    """Weights beyond 32 bits and negative sums: floors of exact means."""
    sums = {0: (3, [-1, -3, 7]), 2: (1 << 40, [-(1 << 60), (1 << 60) + 1, -1])}
    now = clusters.moved(np.zeros((3, 3), np.int64), sums)
    assert now.tolist() == [[-1, -1, 2], [0, 0, 0], [-(1 << 20), 1 << 20, -1]]
