"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftgrain.llm import backoff_lm, chunk_dedup, common, kd_sharding, knn_quality, maxscore, mixing, ngram_jaccard, piece_transducer, quality_rules, suffix_dedup

RNG = np.random.default_rng(7)
WORDS = ["".join(RNG.choice(list("abcdeéß"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


PASSAGE = prose(60)
TEXTS = [prose(80), None, "", prose(5), f"{prose(40)} {PASSAGE} {prose(40)}", f"{prose(30)}\n{PASSAGE} {prose(50)}", "x", "to " * 200, prose(3000), "|** !!\n\n"]
TEXTS += [TEXTS[0], TEXTS[0] + " more", TEXTS[8], *[prose(60) for _ in range(8)]]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, node int, key string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s1", "s2"][i % 4], len(t or ""), "b", 1, "k", "s") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]


def test_empty_tables(spark, empty):
    assert quality_rules.clean_lines(empty).count() == 0
    assert kd_sharding.kd_shards(empty).count() == 0
    assert backoff_lm.score(empty, empty).count() == 0
    assert suffix_dedup.dedup_substrings(empty).count() == 0
    assert chunk_dedup.dedup_chunks(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert piece_transducer.encode(empty).count() == 0
    assert ngram_jaccard.jaccard_components(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert knn_quality.knn_scores(empty, labels).count() == 0
    vectors = maxscore.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert maxscore.top_k(vectors, vectors).count() == 0


def test_knn_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r.score for r in knn_quality.knn_scores(docs, labels).collect()} == {0.5}


def test_knn_learns(spark, docs):
    labels = spark.createDataFrame([(0, 1), (3, 1), (8, 1), (13, 1), (7, 0), (9, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in knn_quality.knn_scores(docs, labels).collect()}
    assert len(got) == len(TEXTS) and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2]


def test_knn_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = knn_quality.op1_knn_quality(spark, sf).filter("held_out")
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("quality is not null").select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 20 and len(bad) > 20
    ahead = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    hits = np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows])
    assert ahead > 0.85 and hits > 0.75


def test_maxscore(spark):
    v = [[float(x) for x in RNG.normal(size=8)] for _ in range(120)]
    v[5] = v[6] = v[7]
    rows = [(i, x) for i, x in enumerate(v)] + [(200, None), (300, [float("nan")] * 8), (400, [None] * 8), (7, v[7])]
    q = maxscore.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in maxscore.top_k(q, q.filter("vec_id % 10 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = [(i, np.floor(1024 * np.array(x)).astype(int)) for i, x in rows if x and x[0] is not None and x[0] == x[0]]
    for i, a in ints:
        if i % 10 == 0:
            best = sorted((-int(a @ b), j) for j, b in ints if j != i)[:10]
            assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


def test_maxscore_skips(spark):
    """At sf0.1: non-essential terms, rows and shards are passed over, and the result is brute force's."""
    rows = maxscore.quantised(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).toPandas()
    vectors, seen = np.stack(rows["terms"].to_numpy()), Counter()
    queries = rows[rows["vec_id"] % 100 == 0].assign(row=0)
    queries["least"] = [maxscore.kth_best(int(i), np.array(t), rows["vec_id"].to_numpy()[:500], vectors[:500], 10) for i, t in zip(queries["vec_id"], queries["terms"], strict=True)]
    got = maxscore.search(rows, queries, 10, seen)
    for i, part in got.groupby("query_id"):
        scores = vectors @ vectors[rows["vec_id"] == i][0]
        best = sorted((-int(s), int(j)) for s, j in zip(scores, rows["vec_id"], strict=True) if j != i)[:10]
        assert sorted(zip(-part["score"], part["vec_id"], strict=True)) == best
    assert seen["terms"] > 0 and seen["non-essential terms"] > 0.2 * seen["terms"] and seen["rows summed up"] < 0.7 * seen["rows"]


def test_quality_rules(docs):
    for r in quality_rules.clean_lines(docs).collect():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", r.text or "") if x]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(w), len(hit), sum(map(len, w)))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.kept and r.base_failed) and r.node == 1


def test_kd_sharding(docs):
    got = kd_sharding.kd_shards(docs, 4).collect()
    assert len(got) == len(TEXTS)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    for r in got:
        raw = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, crc32(raw))


def test_kd_sharding_balances(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") % 300).cast("int")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    sums = [r["b"] for r in kd_sharding.kd_shards(rows, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) < 1.05 * min(sums)


def test_backoff_lm(docs):
    train = docs.filter("doc_id <> 3")
    got = {r.doc_id: r for r in backoff_lm.score(docs, train).collect()}
    tokens = {i: [*words(t), None] for i, t in enumerate(TEXTS)}
    c = Counter(w for i, t in tokens.items() if i != 3 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        assert got[i].base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)


@pytest.mark.parametrize("share", [1 << 20, 64, 1])
def test_backoff_lm_keeps_every_bigram(docs, monkeypatch, share):
    monkeypatch.setattr(backoff_lm, "ROOT_ARCS", share)
    monkeypatch.setattr(backoff_lm, "STATE_ARCS", share)
    got = {r.doc_id: r for r in backoff_lm.score(docs, docs.filter("doc_id <> 3")).collect()}
    tokens = {i: [None, *words(t), None] for i, t in enumerate(TEXTS)}
    pairs = Counter(p for i, t in tokens.items() if i != 3 for p in zip(t, t[1:], strict=False))
    c, arcs = Counter(), {}
    for (_, w), n in pairs.items():
        c[w] += n
    n, v = sum(c.values()), len(c)
    for (a, w), k in pairs.items():
        if k >= 2:
            arcs.setdefault(a, {})[w] = (k - 0.5) / c[a]
    root = lambda w: (c[w] + 1) / (n + v + 1)
    fail = {a: (1 - sum(x.values())) / (1 - sum(map(root, x))) for a, x in arcs.items()}
    for i, t in tokens.items():
        wanted = sum(np.log10(arcs[a][w] if w in arcs.get(a, {}) else fail.get(a, 1) * root(w)) for a, w in zip(t, t[1:], strict=False))
        assert got[i].score == pytest.approx(wanted)


def test_backoff_lm_sums_to_one():
    rng = np.random.default_rng(1)
    counts, pairs = np.zeros(6, np.int64), Counter()
    runs = [rng.integers(1, 6, rng.integers(1, 9)).tolist() + [0] for _ in range(60)]
    for run in runs:
        for a, b in zip([0, *run], run, strict=False):
            pairs[a, b] += 1
            counts[b] += 1
    m = backoff_lm.Automaton(np.arange(6), counts, int(counts.sum()), 6)
    kept = sorted((a * 6 + b, k) for (a, b), k in pairs.items() if k >= 2)
    m.with_arcs(np.array([k for k, _ in kept]), np.array([n for _, n in kept]))
    arcs = dict(zip(m.arcs.tolist(), m.arc_logs, strict=True))
    for s in range(6):
        seen = sum(10 ** arcs[s * 6 + w] for w in range(6) if s * 6 + w in arcs)
        rest = sum(10 ** m.root[w] for w in range(6) if s * 6 + w not in arcs) + 10**-m.log_all
        assert seen + 10 ** m.fail[s] * rest == pytest.approx(1)


def test_suffix_dedup(docs):
    seen, wanted = set(), {}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        wanted[i] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_substrings(docs).collect()} == wanted


def test_chunk_dedup(docs):
    got = {r.doc_id: r for r in chunk_dedup.dedup_chunks(docs).collect()}
    assert got[4].n_removed == 0 and got[5].n_removed > 0.5 * len(PASSAGE.encode()) and PASSAGE not in got[5].text
    assert got[12].text == "" and got[0].text == TEXTS[0] and got[1].n_bytes == got[2].n_bytes == 0 and got[5].node == 1


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_rows_keep_their_first(spark, parts):
    text, other = prose(80), prose(80)
    rows = [(1, text), (1, text), (1, text), (None, other), (None, other), (2, text)]
    both = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    for got in (suffix_dedup.dedup_substrings(both).collect(), chunk_dedup.dedup_chunks(both).collect()):
        assert len(got) == 6 and all((r.n_removed == r.n_bytes) if r.doc_id == 2 else (r.n_removed == 0) for r in got)


def test_chunks_resist_shifts():
    a, b = PASSAGE.encode(), b"some words more " + PASSAGE.encode()
    ends = lambda x: set(chunk_dedup.chunk_ends(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0].tolist())
    assert len({e + 16 for e in ends(a)} & ends(b)) >= len(ends(a)) - 2


def test_unspaced_chunks_resist_shifts(spark):
    passage, other = ("".join(chr(x) for x in RNG.integers(0x4E00, 0x9FA5, n)) for n in (2000, 200))
    texts = [other[:40] + passage, other[45:90] + passage + other[90:], "a" * 5000, None, "b" * 5000]
    got = {r.doc_id: r for r in chunk_dedup.dedup_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and got[1].n_removed > 0.95 * 6000 and got[1].text.startswith(other[45:90]) and got[1].text.endswith(other[90:])
    assert got[2].n_chunks >= 5 and got[2].n_bytes == 5000
    # A text's chunks don't depend on its neighbours.
    raw = [(t or "").encode() for t in [*texts, *TEXTS]]
    cut = lambda x: chunk_dedup.chunk_ends(np.frombuffer(b"".join(x), np.uint8), np.cumsum([0, *map(len, x)]))[0].tolist()
    assert cut(raw) == [sum(map(len, raw[:i])) + e for i, t in enumerate(raw) for e in cut([t])]


def test_mixing(docs):
    rows, slots, members = mixing.mix_plan(docs, block=8)
    taken = {r.row: r.taken for r in mixing.taken_blocks(slots, members).groupBy("row").agg(F.sum("n_words").alias("taken")).collect()}
    by_source = Counter()
    for r in rows.collect():
        assert taken.get(r.row, 0) <= 3 * r["size"]
        by_source[r.target] += taken.get(r.row, 0)
    assert all(abs(n - t) <= 24 for t, n in by_source.items())
    assert mixing.targets([10, 100, 0], [5, 2, 1], 110) == [30, 80, 0]
    again = [sorted(map(tuple, mixing.mix(docs, block=8).collect())) for _ in range(2)]
    assert again[0] == again[1] and sum(len(words(r[1])) for r in again[0]) == sum(by_source.values())


def test_mixing_repeated_rows(spark, tmp_path):
    twice, none = prose(300), prose(150)
    rows = [(1, twice, "a"), (1, twice, "a"), (None, none, "b"), (None, none, "b"), (None, none, "b"), (4, prose(900), "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op8_source_mixing(spark, str(tmp_path)).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r["size"] for r in got)
    for size in {r.source_size for r in got}:
        part = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 3 * 64


def test_slots_do_not_depend_on_runs(docs, monkeypatch):
    whole = sorted(map(tuple, mixing.mix_plan(docs, block=2)[1].collect()))
    monkeypatch.setattr(mixing, "RUN_SLOTS", 4)
    monkeypatch.setattr(mixing, "TASK_SLOTS", 50)
    assert len(whole) > 500 and sorted(map(tuple, mixing.mix_plan(docs, block=2)[1].collect())) == whole


def test_permutation():
    for n in (1, 2, 7, 100):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9))) == list(range(n))


def test_piece_transducer(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.MODEL)
    m = piece_transducer.Transducer(open(piece_transducer.MODEL, "rb").read())
    odd = ["".join(RNG.choice(list("aabcehnorst. ,\n\t▁é😀x0"), 30)) for _ in range(300)]
    for t in [*[t or "" for t in TEXTS], *odd]:
        assert np.frombuffer(m.encode(t), np.int32).tolist() == lib.encode(t)
    back = piece_transducer.decode(piece_transducer.encode(docs))
    assert all(r.decoded == (r.text or "") and r.round_trip for r in back.collect())


def unigram_model(pieces, with_bytes):
    """A model file by hand: unknown piece, byte pieces, pieces with scores; blanks are kept."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def field(number, value):
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        return varint(number << 3 | 2) + varint(len(value)) + value

    rows = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if with_bytes] + [(p, x, 1) for p, x in pieces]
    body = b"".join(field(1, field(1, p.encode()) + field(2, float(x)) + field(3, k)) for p, x, k in rows)
    return body + field(2, field(3, 1) + field(35, int(with_bytes))) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0))


@pytest.mark.parametrize("with_bytes", [True, False])
def test_unigram_pieces(with_bytes):
    import sentencepiece

    rng = np.random.default_rng(4)
    pieces = sorted({"".join(rng.choice(list("abcdé"), n)) for n in rng.integers(1, 5, 60)} - {"d"}) + ["▁", "▁a", "▁bc"]
    model = unigram_model([(p, -float(x)) for p, x in zip(pieces, rng.uniform(1, 9, len(pieces)), strict=True)], with_bytes)
    lib, m = sentencepiece.SentencePieceProcessor(model_proto=model), piece_transducer.Transducer(model)
    for _ in range(300):
        t = "".join(rng.choice(list("aabbccdé xß"), rng.integers(1, 25)))
        got, wanted = np.frombuffer(m.encode(t), np.int32).tolist(), lib.encode(t)
        if not with_bytes:  # the library joins neighbouring unknown pieces
            got, wanted = ([x for i, x in enumerate(ids) if x or not i or ids[i - 1]] for ids in (got, wanted))
        # Pieces in another order weigh the same, and the library sums in single precision: paths are equal in weight.
        assert sum(m.scores[i] for i in got) == pytest.approx(sum(m.scores[i] for i in wanted), abs=1e-4)
        assert sorted(got) == sorted(wanted) or abs(len(got) - len(wanted)) <= 2
        if with_bytes:
            assert m.decode(got) == t and [i for i in got if m.kinds[i] == 6] == [i for i in wanted if m.kinds[i] == 6]


def test_round_trip_decodes():
    m = piece_transducer.Transducer(open(piece_transducer.MODEL, "rb").read())
    texts = ["some words", None, "", TEXTS[0]]
    assert piece_transducer.packed_ids(m, texts)[2] == [True] * 4
    m.decode = lambda ids: "other words"
    assert piece_transducer.packed_ids(m, texts)[2] == [False] * 4


def test_ngram_jaccard(docs):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs).collect()} == {i: (len(s), label[i]) for i, s in sets.items()}


def linked_rows(texts, width, percent):
    """Brute force: of each row the set of rows that links reach; and the sets."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return label, sets


def changed(text, n, seed):
    """The text with its last n words replaced."""
    w = text.split(" ")
    return " ".join(w[: len(w) - n] + [f"z{seed}x{i}" for i in range(n)])


LONG = prose(300)
SHARED = [
    (1, LONG), (None, changed(LONG, 20, 1)), (2, " ".join(["q1 q2"] * 9 + changed(LONG, 20, 1).split(" ")[18:])), (3, prose(50)), (5, changed(LONG, 10, 2)), (5, prose(70)), (5, None),
    (9, LONG), (9, LONG), (None, ""), (None, None), (None, "one two"), (7, "one two"), (8, "ONE  two"), (None, prose(90)), (4, " \n"),
]


@pytest.mark.parametrize(("share", "most"), [(4096, 512), (2, 512), (4096, 2)])
def test_ngram_jaccard_shared_and_null_ids(spark, monkeypatch, share, most):
    monkeypatch.setattr(ngram_jaccard, "SHARE", share)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SETS", most)
    label, sets = linked_rows([t for _, t in SHARED], 4, 85)
    ids = [i for i, _ in SHARED]
    least = [min((ids[j] for j in range(len(ids)) if label[j] == x and ids[j] is not None), default=None) for x in label]
    wanted = sorted(((i, len(s), c) for i, s, c in zip(ids, sets, least, strict=True)), key=str)
    df = spark.createDataFrame(SHARED, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("node", F.lit(0))
    assert sorted(map(tuple, ngram_jaccard.jaccard_components(df).collect()), key=str) == wanted


def test_large_blocks_are_dealt(spark, monkeypatch):
    """A group of near copies and two chains, in chunks of five, against brute force."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SETS", 5)
    base = prose(120)
    texts = [changed(base, i % 9, i) for i in range(40)]
    for k in range(2):
        chain = prose(100).split(" ")
        for i in range(12):
            chain[i * 6 : i * 6 + 6] = [f"c{k}x{i}x{j}" for j in range(6)]
            texts.append(" ".join(chain))
    label, _ = linked_rows(texts, 4, 85)
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))


def test_line_rules(spark):
    lines = ["to " * 8 + "and so on with many other words that follow here to the end of it", "B U Y N O W T O D A Y", "The U.S. and A. B. Smith met there on Monday.", "no no no no", "Tous droits réservés 2020", "Il a dit bonjour à tous."]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert quality_rules.clean_lines(df).first().clean_text.split("\n") == [lines[2], lines[5]]


def test_one_of_each(spark):
    label, sets = linked_rows([t for _, t in SHARED], 5, 80)
    df = spark.createDataFrame([(i, t, n, "k") for n, (i, t) in enumerate(SHARED)], "doc_id long, text string, n int, key string")
    got = ngram_jaccard.one_of_each(df, 5, 80).collect()
    assert all(r.key == "k" and (r.doc_id, r.text) == SHARED[r.n] for r in got)
    kept = {r.n for r in got}
    assert len(kept) == len(got) and {n for n, s in enumerate(sets) if not s} <= kept
    for x in {x for n, x in enumerate(label) if sets[n]}:
        group = [n for n, y in enumerate(label) if y == x]
        first = min(group, key=lambda n: (SHARED[n][0] is None, SHARED[n][0] or 0))
        assert len(kept & set(group)) == 1 and SHARED[min(kept & set(group))][0] == SHARED[first][0]


def test_pairs_of_frequent_tokens_are_indexed(docs):
    rng = np.random.default_rng(2)
    often = np.arange(1, 40, dtype=np.uint64)
    sets = [np.unique(rng.choice(often, 30)) for _ in range(60)] + [np.unique(np.r_[rng.choice(often, 30), rng.integers(100, 9000, 300, dtype=np.uint64)]) for _ in range(20)]
    sizes = np.array([len(x) for x in sets])
    sigs, rows, pairs = ngram_jaccard.signatures(np.concatenate(sets), sizes, 85, often)
    assert pairs > 0
    held = [set(sigs[rows == r].tolist()) for r in range(len(sets))]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert held[i] & held[j]


def test_pair_signatures_occur(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    heavy = ngram_jaccard.frequent_tokens(table, 4)
    arrow = table.select("text").toArrow().column("text")
    from siftgrain.llm.vec import slices, utf8

    assert len(heavy) > 1000 and sum(ngram_jaccard.signatures(*ngram_jaccard.shingle_sets(part, ends), heavy=heavy)[2] for _, part, ends in slices(*utf8(arrow))) > 10_000


def test_kd_sharding_repeated_rows(spark):
    rows = [(1, "abc " * 10, "en", "s", 1)] * 2000 + [(None, "x" * (i % 97), None, f"s{i % 5}", 1) for i in range(2000)]
    got = kd_sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tie int")).collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    assert len(got) == 4000 and len(sums) == 40 and max(sums.values()) < 1.1 * min(sums.values())
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in sums)


def test_kd_sharding_medians(spark):
    """Against brute force: every cut lies at the weighted median of its node along its widest dimension."""
    rows = [(i, "a" * int(x), f"l{i % 3}", f"s{i % 11}") for i, x in enumerate(RNG.integers(0, 400, 1500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    at = {r.doc_id: (r["size"], r.k_size, r.k_lang, r.k_source) for r in kd_sharding.coordinates(df).collect()}
    got = {r.doc_id: r.shard for r in kd_sharding.kd_shards(df, 8).collect()}
    whole = [max(x[i] for x in at.values()) - min(x[i] for x in at.values()) for i in (1, 2, 3)]

    def cut(ids, shards):
        if len(shards) == 1:
            assert {got[i] for i in ids} == set(shards)
            return
        dim = max((1, 2, 3), key=lambda d: ((max(at[i][d] for i in ids) - min(at[i][d] for i in ids)) / whole[d - 1], -d))
        ids = sorted(ids, key=lambda i: at[i][dim])
        total, below, n = sum(at[i][0] for i in ids), 0, 0
        while below + at[ids[n]][0] / 2 < total / 2:
            below += at[ids[n]][0]
            n += 1
        low = {i for i in ids if got[i] in shards[: len(shards) // 2]}
        assert len(low ^ set(ids[:n])) <= 1
        cut(low, shards[: len(shards) // 2])
        cut(set(ids) - low, shards[len(shards) // 2 :])

    cut(set(at), list(range(8)))


def test_backoff_lm_repeated_rows(spark):
    rows = [(1, TEXTS[0])] * 3 + [(1, TEXTS[4]), (None, TEXTS[5]), (None, TEXTS[5]), (None, None), (2, ""), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = backoff_lm.score(df, df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    tokens = [[*words(t), None] for _, t in rows]
    c = Counter(w for t in tokens for w in t)
    n, v = sum(c.values()), len(c)
    base = sorted(round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), 6) for t in tokens)
    assert sorted(round(r.base_score, 6) for r in got) == base and sorted(r.n_tokens for r in got) == sorted(map(len, tokens)) == sorted(r.n_known for r in got)


def test_suffix_dedup_when_hashes_collide(monkeypatch):
    import pandas as pd

    from siftgrain.llm.common import delta, pack

    assert suffix_dedup.first_equals(np.array([3, 3, 5, 3], np.uint64)).tolist() == [0, 0, 2, 0]
    data = np.frombuffer(b"abcabdabc", np.uint8)
    assert suffix_dedup.equal_strings(data, np.array([0, 6]), np.array([0, 0]), 3) and not suffix_dedup.equal_strings(data, np.array([0, 3]), np.array([0, 0]), 3)
    monkeypatch.setattr(suffix_dedup, "grams", lambda d, w: np.zeros(max(0, len(d) - w + 1), np.uint64))
    text = (prose(40) + " " + TEXTS[0]).encode()
    raw = np.frombuffer(text[:150] + text[:150] + text[100:250], np.uint8)
    keys, starts, runs = np.array([1, 2, 3], np.int64), np.zeros(3, np.int32), np.full(3, 51, np.int32)
    blobs = pd.DataFrame({"bucket": [0], "settled": [False], "n": [3], "blob": [pack(delta(keys), delta(keys), starts, runs)], "bytes": [pack(raw)]})
    assert suffix_dedup.repeated_spans(blobs, 100)["key"].tolist() == [2]


def test_columns_called_like_internal_ones(spark):
    rows = [(i, t, f"v{i}") for i, t in enumerate(TEXTS)]
    for names, run in (
        (("_w", "_l", "_h1", "_left", "_phrases"), quality_rules.clean_lines),
        (("key", "ns", "blobs", "Key_"), suffix_dedup.dedup_substrings),
        (("_key", "_n", "_blob"), chunk_dedup.dedup_chunks),
        (("run", "_row", "_words"), lambda d: mixing.mix(d, block=8)),
        (("key", "_key", "node"), ngram_jaccard.one_of_each),
    ):
        df = spark.createDataFrame(rows, "doc_id long, text string, x string")
        df = df.select("doc_id", "text", F.lit("s").alias("source"), *[F.col("x").alias(n) for n in names])
        got = run(df).select("doc_id", *names).collect()
        assert got and all(r[n] == f"v{r.doc_id}" for r in got for n in names)


def test_knn_sample_is_bounded(spark):
    df = spark.createDataFrame([(1, "same words here")] * 50 + [(1, f"word{i} again") for i in range(40)] + [(2, "x y"), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    x, y = knn_quality.sampled(df, labels, 10)
    assert len(x) == len(y) == 10
    x, y = knn_quality.sampled(df, labels, 1000)
    assert len(x) == 42 and sorted(y)[:1] == [0]


@pytest.mark.parametrize("rows", [[], [(1, "x"), (1, "x"), (None, None), (None, ""), (2, "a b " * 50)]])
def test_pipeline_on_little(spark, tmp_path, rows):
    import corpus_pipeline

    full = [(i, t, None, None, None) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_chunks(raw):
    """Chunks of a text by the rule as it is stated, byte by byte."""
    blank = [chunk_dedup.SPACE[b] for b in raw]
    reach, near = chunk_dedup.REACH, lambda i: any(blank[max(0, i - chunk_dedup.REACH) : i + chunk_dedup.REACH + 1])
    spots = {}
    for i in range(31, len(raw) - 1):
        if blank[i] or (raw[i + 1] & 0xC0 != 0x80 and not near(i)):
            h = sum(int(chunk_dedup.GEAR[raw[i - k]]) << k for k in range(32)) & 0xFFFFFFFF
            spots[i] = int(chunk_dedup.mix(np.array([h], np.uint64))[0]) >> 8
    ends = [i + 1 for i, v in spots.items() if all((spots[j], j) > (v, i) for j in range(i - reach, i + reach + 1) if j in spots and j != i)]
    ends, out, at = [*ends, *([len(raw)] if raw else [])], [], 0
    for e in ends:
        while e - at > chunk_dedup.MOST:
            cut = at + chunk_dedup.MOST
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(raw[at:cut])
            at = cut
        out.append(raw[at:e])
        at = e
    return out


def test_chunk_dedup_by_the_rule(spark):
    unspaced = "".join(chr(x) for x in RNG.integers(0x4E00, 0x9FA5, 500))
    texts = [*TEXTS, unspaced + " end", prose(4) + unspaced, f"{prose(20)} {PASSAGE}"]
    seen, wanted = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        parts = plain_chunks(raw)
        again = [x in seen or x in parts[:n] for n, x in enumerate(parts)]
        seen |= set(parts)
        kept, run = [], []
        for x, a in [*zip(parts, again, strict=True), (b"", False)]:
            if a:
                run.append(x)
                continue
            kept += [x] if sum(map(len, run)) >= chunk_dedup.LEAST else [*run, x]
            run = []
        wanted[i] = (len(parts), b"".join(kept).decode())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_chunks, r.text) for r in chunk_dedup.dedup_chunks(df).collect()} == wanted


def test_votes_by_the_rule():
    rng = np.random.default_rng(8)
    x = np.abs(rng.normal(size=(60, knn_quality.WIDTH)) * (rng.random((60, knn_quality.WIDTH)) < 0.02)).astype(np.float32)
    y = (rng.random(60) < 0.5).astype(np.float32)
    v = knn_quality.Voter(x, y, rank=8)
    got = v.score(x[:20], 5)
    for i in range(20):
        latent = (x[i] * v.idf) @ v.project
        cosines = [float(latent @ v.vectors[:, j] / np.linalg.norm(latent)) for j in range(60)]
        near = sorted(range(60), key=lambda j: -cosines[j])[:5]
        weights = [np.exp(20 * (cosines[j] - 1)) for j in near]
        assert got[i] == pytest.approx(sum(w * y[j] for w, j in zip(weights, near, strict=True)) / sum(weights), abs=1e-4)


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage on what the one before kept, against a plainer version."""
    import sentencepiece

    import corpus_pipeline

    first = prose(70)
    more = [(100, first, "en", "s1", 1), (101, first + " end", "en", "s2", 1), (101, prose(40), None, None, None), (None, first, None, "s1", 1), (None, prose(30), None, "s9", 1)]
    table = docs.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.col("n_chars").cast("int")))
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    kept = stage["quality"](spark, table, "").cache()
    wanted = [(r.doc_id, r.clean_text) for r in quality_rules.clean_lines(table).collect() if r.kept]
    assert sorted(rows(kept), key=str) == sorted(wanted, key=str) and wanted
    left = stage["near_duplicates"](spark, kept, "").cache()
    before = rows(kept)
    label, sets = linked_rows([t for _, t in before], 5, 80)
    first_of = {min((n for n in range(len(before)) if label[n] == x), key=lambda n: (before[n][0] is None, before[n][0] or 0)) for x in label}
    assert sorted(rows(left), key=str) == sorted((before[n] for n in first_of), key=str)
    single = stage["repeated_passages"](spark, left, "").cache()
    assert single.count() == left.count() and all(r.n_chars == len(r.text) for r in single.collect())
    mix = stage["mixed"](spark, single, "").cache()
    whole = Counter(w for _, t in rows(single) for w in words(t))
    taken = Counter(w for _, t in rows(mix) for w in words(t))
    assert taken and all(n <= 3 * whole[w] for w, n in taken.items())
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.MODEL)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in stage["pieces"](spark, mix, "").collect())
    assert found == sorted((i if i is not None else -1, lib.encode(t)) for i, t in rows(mix))


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.round_trip for r in out) and not {7, 9, 10} & {r.doc_id for r in out}
    assert len(corpus_pipeline.STAGES) == 5


def test_map_texts_bounds_batches_but_keeps_sizes_that_the_session_names(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    try:
        for named, most in (("10000", 1000), ("300", 300)):
            spark.conf.set(name, named)
            found = [r["n"] for r in common.map_texts(spark.range(0, 2500, 1, 1), sizes, "n long").collect()]
            assert sum(found) == 2500 and max(found) == most
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("flush, parts", [(24 << 20, 1), (24 << 20, 4), (900, 1), (900, 4)])
def test_suffix_dedup_of_shared_ids(spark, monkeypatch, flush, parts):
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", flush)
    p, q = prose(100), prose(60)
    rows = [(5, f"{prose(60)} {p}"), (5, f"{prose(3)} {p}"), (5, f"{prose(20)} {p} {prose(10)} {q}"), (7, p), (None, f"{prose(9)} {q}"), (None, f"{q} {prose(2)}"), (3, f"{prose(4)} {p[40:400]}"), (7, f"x{p}"), (5, f"{q}{q}")]
    strings = sorted(((-1 if i is None else i), at, common_key, n, t[at : at + 100]) for n, (i, t) in enumerate((i, t.encode()) for i, t in rows) for at in range(len(t) - 99) for common_key in [0])
    first = {}
    for i, at, _, _, x in strings:
        first.setdefault(x, (i, at))
    got = {(r.doc_id, r.text): r.n_removed for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for at in range(len(b) - 99):
            if first[b[at : at + 100]] != ((-1 if i is None else i), at):
                gone[at : at + 100] = b"\1" * 100
        assert got[i, t] == sum(gone), (i, t[:20])


def test_mixing_keeps_what_equal_texts_hold(spark):
    t, u = prose(640), prose(640)
    schema = "doc_id long, text string, lang string, source string, extra map<string,int>"
    docs = spark.createDataFrame([(1, t, None, "a", {"x": 1}), (1, t, "a", None, {"x": 2}), (1, t, "a", "b", None), (2, u, None, "c", None)], schema)
    got = mixing.mix(docs, block=8).collect()
    taken = Counter()
    for r in got:
        taken[r.lang, r.source, (r.extra or {}).get("x")] += len(r.text.split())
    rows, slots, members = mixing.mix_plan(docs, block=8, row=mixing.whole_row(docs))
    wanted = {r.source_key: r.n for r in mixing.taken_blocks(slots, members).groupBy("source_key").agg(F.sum("n_words").alias("n")).collect()}
    assert taken == {(None, "a", 1): wanted["sa"], ("a", "b", None): wanted["sb"], (None, "c", None): wanted["sc"], ("a", None, 2): wanted["t"]}
    assert len(set(wanted.values())) > 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_sized_join_beyond_its_bound_sorts_nothing_and_shuffles_what_can_match(spark, how):
    large = spark.range(20_000).select(F.when(F.col("id") % 50 > 0, F.xxhash64("id")).alias("key"), F.lit("text").alias("text"))
    small = spark.range(0, 40_000, 20).select(F.xxhash64("id").alias("key"))
    got = common.sized_join(large, small, "key", how, most=10)
    assert sorted(map(str, got.collect())) == sorted(map(str, large.join(small, "key", how).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    passed = large.filter(common.may_hold(small, ["key"], small.count())).count()
    assert 980 <= passed <= 4000


def test_one_of_each_beyond_the_bound_of_broadcasts(spark, monkeypatch):
    base = [prose(60) for _ in range(6)]
    rows = [(i, t + " end" * (i % 3 == 1)) for i, t in enumerate(base * 3)] + [(5, base[5]), (30, None), (31, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted(map(str, ngram_jaccard.one_of_each(docs).collect()))
    whole = common.sized_join
    monkeypatch.setattr(ngram_jaccard, "sized_join", lambda *a, **k: whole(*a, **k | {"most": 0}))
    assert sorted(map(str, ngram_jaccard.one_of_each(docs).collect())) == wanted


def test_substrings_and_chunks_sort_no_texts(docs):
    for out in (suffix_dedup.dedup_substrings(docs), chunk_dedup.dedup_chunks(docs)):
        plan = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_backoff_lm_buckets_hold_little(docs, monkeypatch):
    asked = []
    monkeypatch.setattr(backoff_lm, "buckets_for", lambda *a: asked.append(a) or 32)
    backoff_lm.score(docs.select("doc_id", "text"), docs.select("doc_id", "text"))
    assert asked[0][2] <= 32 << 20


def test_signatures_are_shuffled_but_not_written(spark, monkeypatch):
    written, real = [], ngram_jaccard.cut
    monkeypatch.setattr(ngram_jaccard, "cut", lambda df: written.append(df.columns) or real(df))
    text, big = prose(60), (1 << 60) + 1
    rows = [(big, text), (None, f"{text} more"), (7, prose(50)), (8, None), (big, text)]
    got = ngram_jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text) == sorted([(big, text), rows[2][:2]]) and (8, None) in [(r.doc_id, r.text) for r in got]
    assert written and not [c for c in written if {"blob", "bitmaps"} & set(c)]


def test_suffix_dedup_buckets_grow_with_the_input(docs, monkeypatch):
    asked, real = [], suffix_dedup.buckets_for
    monkeypatch.setattr(suffix_dedup, "buckets_for", lambda df, least, each=common.BUCKET_BYTES: asked.append(each) or real(df, least, each))
    suffix_dedup.dedup_substrings(docs)
    assert len(asked) == 1 and asked[0] <= 16 << 20


def test_suffix_dedup_looks_at_a_class_of_strings_at_a_time(monkeypatch):
    import pandas as pd

    from siftgrain.llm.common import delta, pack, unpack

    text = np.frombuffer((prose(200) + TEXTS[0]).encode()[:900], np.uint8)
    at, keys = np.array([0, 60, 0, 10]), np.array([1, 1, 2, 3], np.int64)
    starts, runs = np.array([0, 60, 5, 0], np.int32), np.array([60, 60, 60, 50], np.int32)
    raw = np.concatenate([text[a : a + r + 99] for a, r in zip(at, runs, strict=True)])
    blobs = pd.DataFrame({"bucket": [0], "settled": [False], "n": [4], "blob": [pack(delta(keys), delta(keys), starts, runs)], "bytes": [pack(raw)]})
    for strings in (1 << 20, 7):
        monkeypatch.setattr(suffix_dedup, "STRINGS", strings)
        got = {r.key: [x.tolist() for x in unpack(r.blob, r.n, "int32", "int32")] for r in suffix_dedup.repeated_spans(blobs, 100).itertuples()}
        assert got == {2: [[5], [164]], 3: [[0], [149]]}
    names = np.arange(4000, dtype=np.uint64) % np.uint64(1000)
    assert (suffix_dedup.origins(names, None) == np.arange(4000) % 1000).all()
