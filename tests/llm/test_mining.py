"""Decontamination, collocations and centroid clustering against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgrain.llm import annulus, collocations, decontaminate

RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdé東9"), RNG.integers(1, 5))) for _ in range(300)]
ASCII = {i: i + 32 for i in range(65, 91)}


def prose(n, words=WORDS):
    return " ".join(RNG.choice(words, n))


# ---- decontamination

LONG, SHORT, PAIR = prose(24), prose(7), prose(2)
ITEMS = [(1, LONG), (2, SHORT), (2, prose(12)), (3, None), (4, ""), (5, "--!"), (6, PAIR.upper()), (10, LONG), (None, prose(11)), (7, " ".join(LONG.split()[5:18])), (8, "x")]
TEXTS = [
    None,
    "",
    "...",
    prose(50),
    f"{prose(9)} {LONG.title()} {prose(5)}",
    f"{prose(9)}, {'; '.join(LONG.split()[:10])}. {prose(5)}",
    " ".join(LONG.split()[:9]) + " q " + " ".join(LONG.split()[9:18]),
    f"{SHORT} {SHORT}",
    f"a {PAIR}b {PAIR} c",
    f"{ITEMS[8][1]} {ITEMS[2][1]}",
    "x",
    "x " * 50,
    prose(4000) + " " + LONG + " " + prose(3000) + " " + LONG,
    f"{LONG}{LONG}",
]
TEXTS += [TEXTS[4]] * 3


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def hits(text, items, length=10):
    words, at, ids = item_words(text), set(), set()
    for item, body in items:
        w = item_words(body)
        m = min(len(w), length)
        grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1) if m else ():
            if tuple(words[i : i + m]) in grams:
                at.update(range(i, i + m))
                ids |= {str(item)} if item is not None else set()
    return len(words), at, sorted(ids)


@pytest.mark.parametrize("most", [100_000, 0])
@pytest.mark.parametrize("length, gram", [(10, 5), (6, 8), (3, 1)])
def test_contamination(spark, monkeypatch, length, gram, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_TEXTS", most)
    rows = [(i if i % 4 else None, t, "f", 1, "h", "s", 5) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _a string, first int, hash string, spans string, n_words int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit("w"))
    got = decontaminate.contamination(docs, items, length, gram)
    assert sorted(got.columns) == sorted(["doc_id", "text", "_a", "first", "hash", "spans", "n_words", "items", "contaminated"])
    got = got.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    for r in got:
        n, at, ids = hits(r.text, ITEMS, length)
        spans = [range(x["first"], x["after"]) for x in r.spans]
        assert (r.n_words, {i for s in spans for i in s}, r["items"], r.contaminated) == (n, at, ids, bool(at)), r.text
        assert sum(map(len, spans)) == len(at) and (r._a, r["first"], r.hash) == ("f", 1, "h")


def test_contamination_without_items_or_texts(spark):
    docs = spark.createDataFrame([(1, LONG), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r["items"], r.spans, r.contaminated) for r in decontaminate.contamination(docs, none).collect()] == [([], [], False)] * 2
    assert decontaminate.contamination(docs.filter("false"), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_winnowing_query(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in decontaminate.op11_winnowing(spark, str(tmp_path)).collect():
        n, at, ids = hits(TEXTS[r.doc_id], ITEMS)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(at), len(ids), bool(at))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


# ---- collocations

SMALL = [*WORDS[:12], "a", "b\x00", "ß"]


def mixed():
    ends = [" ", "  ", "\t", " ", ", ", ".", "\n", "; ", "!", " - "]
    return "".join(w + e for w, e in zip(RNG.choice(SMALL, 60), RNG.choice(ends, 60), strict=True))


PHRASED = [(None if i % 7 == 0 else ["en", "de", "und"][i % 3], mixed() if i % 5 else "New York City, new york") for i in range(120)]
PHRASED += [("en", None), ("en", ""), (None, "..,;"), ("fr", "one two three"), ("xx", "to " * 900), ("en", prose(4000)), ("en", PHRASED[1][1]), ("en", PHRASED[1][1])]


def mined(rows, least, share, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if not inside[p] or 100 * inside[p] < share * a:
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(scored), 1):
            out[lang, p.decode()] = (i, -a, left, right, n[lang], -score)
    return out


@pytest.mark.parametrize("least, share, bits, flush", [(4, 100, (16, 24), 1_000_000), (3, 70, (16, 24), 40), (300, 100, (16, 24), 1000), (1, 100, (16, 16), 200)])
def test_collocations(spark, monkeypatch, least, share, bits, flush):
    monkeypatch.setattr(collocations, "SKETCH_BITS", bits)
    monkeypatch.setattr(collocations, "FLUSH", flush)
    monkeypatch.setattr(collocations, "MERGE", 2)
    docs = spark.createDataFrame([(*r, "p", "b", 1) for r in PHRASED], "lang string, text string, part string, block string, n int").repartition(5)
    scored = collocations.collocations(*collocations.phrase_counts(docs, least), share=share)
    got = {(r.lang, r.phrase): (r["rank"], r.a, r.l, r.r, r.n, r.score) for r in collocations.best(scored, 10**9).collect()}
    assert got == mined(PHRASED, least, share)
    assert len(got) > (0 if least == 300 else 50)


def test_loose_bounds_change_no_count(spark, monkeypatch):
    monkeypatch.setattr(collocations.Sketch, "passes", lambda self, h: np.ones(len(h), bool))
    docs = spark.createDataFrame(PHRASED, "lang string, text string")
    counts, words = collocations.phrase_counts(docs, 4)
    got = {(r.lang, r.phrase): r.a for r in collocations.collocations(counts, words).collect()}
    assert got == {k: v[1] for k, v in mined(PHRASED, 4, 100).items()}


@pytest.mark.parametrize("most", [50_000, 40])
def test_rounds_keep_the_best(spark, monkeypatch, most):
    monkeypatch.setattr(collocations, "ROUND", most)
    rows = [(["en", "en", "de", "fr"][i % 4], f"p {i}", int(RNG.integers(1, 4)), int(RNG.integers(0, 9))) for i in range(900)]
    got = {(r.lang, r.phrase): r["rank"] for r in collocations.best(spark.createDataFrame(rows, "lang string, phrase string, a long, score long"), 15).collect()}
    wanted = {}
    for lang in ("en", "de", "fr"):
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[3], -r[2], r[1].encode()))
        wanted |= {(r[0], r[1]): i for i, r in enumerate(mine[:15], 1)}
    assert got == wanted


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a b", 3 * 10**12), ("en", "a", 4 * 10**12), ("en", "b", 10**13)], "lang string, phrase string, f long")
    words = spark.createDataFrame([("en", 9 * 10**13)], "lang string, n long")
    assert collocations.collocations(counts, words).first().score == 1000 * 3 * 10**12 * 9 * 10**13 // (4 * 10**12 * 10**13)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(*collocations.phrase_counts(empty)).count() == 0


def test_sketch_never_falls_short():
    h = RNG.integers(0, 2**63, 5000).astype(np.uint64)
    sketch = collocations.Sketch(10, 3)
    for _ in range(3):
        sketch.add(h)
    sketch.stop()
    assert sketch.passes(h).all() and sketch.rows.max() == 3


# ---- clustering


def clusters(rows, k, rounds, dims):
    kept = [(i, [floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        found = defaultdict(list)
        for _, v in kept:
            found[near(v)[1]].append(v)
        centroids = [[sum(x) // len(found[j]) for x in zip(*found[j], strict=True)] if found[j] else c for j, c in enumerate(centroids)]
    return centroids, Counter((i, near(v)[1], near(v)[0]) for i, v in kept)


def vectors(n, dims):
    rows = [(i, (RNG.normal(size=dims) * RNG.choice([0.1, 1, 9])).astype(np.float32).tolist()) for i in range(n)]
    rows += [(3, rows[5][1]), (3, rows[6][1]), (None, rows[7][1]), (90, None), (91, []), (92, [1.0] * (dims + 1)), (93, [float("nan")] * dims), (94, [None] * dims), (95, [float("-inf")] * dims)]
    return [*rows, *[(100 + i, [0.0] * dims) for i in range(4)], *[(200 + i, [float(i % 2)] * dims) for i in range(6)]]


@pytest.mark.parametrize("n, k, rounds, dims", [(60, 8, 10, 6), (40, 5, 1, 3), (8, 30, 10, 2), (30, 12, 4, 1)])
def test_clusters(spark, n, k, rounds, dims):
    rows = vectors(n, dims)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, cluster int, place string").repartition(3)
    found = annulus.fit(df, k, rounds, dims)
    centroids, wanted = clusters(rows, k, rounds, dims)
    got = annulus.assign(df, found).collect()
    assert found.centroids.tolist() == centroids
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == wanted
    assert found.inertia == [sum(r.distance for r in got if r.cluster == j) for j in range(len(centroids))]
    assert found.sizes == [sum(r.cluster == j for r in got) for j in range(len(centroids))]


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")
    found = annulus.fit(df, dims=1)
    assert found.centroids.tolist() == [] and annulus.assign(df, found).count() == 0


def test_large_components_raise(spark):
    df = spark.createDataFrame([(1, [2.0**18])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="2\\*\\*27"):
        annulus.fit(df, dims=1)


def test_annulus_is_exact_and_spares_pairs(monkeypatch):
    monkeypatch.setattr(annulus, "PAIRS", 50)
    centroids = RNG.integers(-5000, 5000, (40, 4)) * RNG.integers(1, 50, (40, 1))
    centroids = np.vstack([centroids, centroids[:5], -centroids[:5], np.zeros((2, 4), np.int64)])
    x = np.vstack([RNG.integers(-90_000, 90_000, (500, 4)), centroids, (centroids[:20] + centroids[20:40]) // 2])
    seen = Counter()
    number, distance = annulus.Annulus(centroids).nearest(x, seen)
    d = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert seen["compared"] < 0.7 * seen["all"]


def test_clusters_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    centroids, wanted = clusters(rows, 8, 10, 64)
    got = annulus.op13_annulus_clusters(spark, sf).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == wanted
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert all(r.centroid_sha256 == digest[r.cluster] and r.inertia == sum(x.distance for x in got) for r in got)
