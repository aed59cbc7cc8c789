"""Hand-made cases for the scoring, dataset, ranking and grading operators."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgrain.functions import text as tx
from siftgrain.operators import dataset as ds
from siftgrain.operators import percentile as pc
from siftgrain.operators import pooling as pl
from siftgrain.operators import predictors as pr
from siftgrain.operators import qa, ranking, split, stats, vectors
from siftgrain.operators.cache import ScoreCache, fingerprint


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "flags", "wanted"),
    [
        ("a.B  c\n d", {}, "a. B c d"),
        ("x (y) [z] w", {"brackets": True}, "x w"),
        ("see arXiv:1234.5678v2 now", {"arxiv": True}, "see now"),
        ("A\nFig. 3: plot of x\nB", {"figures": True}, "A B"),
        ("go a b c on", {"pdf_noise": True}, "go on"),
        ("go é a ü on a_b c d", {"pdf_noise": True}, "go é a ü on a_b c d"),
        ("go 1 b  3 on", {"pdf_noise": True}, "go on"),
        ('x <LaTeXit sha1="q">a\nb</ l a t e x i t > y', {"latex": True}, "x y"),
        ("x <latexit.a>a</latexit> y", {"latex": True}, "x <latexit. a>a</latexit> y"),
    ],
)
def test_clean(spark, text, flags, wanted):
    assert one(spark, tx.clean(F.lit(text), **flags)) == wanted


@pytest.mark.parametrize("text", ["Ción y y de", "go é a ü b c d on", "a b\u00a0c d e_f g", "x a b c", "a b cé", "1 2 3\n4 \x0b 5 6 7", "_a b c d", "a b c_ d e f g"])
def test_clean_flags_of_letters_beyond_ascii_equal_their_sql(spark, tmp_path, text):
    import duckdb

    from siftgrain.plans import catalogue, single  # noqa: F401

    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(catalogue.ORACLE_SQL["clean_flags"]).fetchall()
    assert [tuple(r) for r in catalogue.QUERIES["clean_flags"](spark, str(tmp_path)).collect()] == wanted


def test_sections_lists_and_names(spark):
    assert one(spark, tx.section(F.lit("Introduction\n\nabc\n\n\nRelated"), "Introduction")) == "abc"
    assert one(spark, tx.section(F.lit("none"), "Introduction")) is None
    assert one(spark, tx.semicolon_list(F.lit("a; b;;c "))) == ["a", "b", "c"]
    assert one(spark, tx.word_count(F.lit("  a  b "))) == 2
    assert one(spark, ds.first_seen(F.array(F.lit(" A"), F.lit("a"), F.lit("B ")))) == ["A", "B"]
    name = "scope_sentence_spooling_lower_quantile_mean_pooling_mean_stailq_0.8"
    assert one(spark, tx.short_name(F.lit(name))) == "sent-lqm-0.8-pool-mean"
    assert one(spark, tx.short_name(F.lit("scope_sentence_spooling_weighted_mean_pooling_sum"))) == "sent-weighted-mean-pool-sum"
    assert one(spark, tx.short_name(F.lit("scope_document_spooling_mean_pooling_lower_quantile_mean_tailq_0.5"))) == "doc-pool-lqm-0.5"


def test_units(spark):
    assert one(spark, split.units(F.lit("The red car of Smith et al met 3 dogs, and cats."))) == ["red car", "Smithetal met 3 dogs", "cats"]
    assert one(spark, split.sentences(F.lit(""))) == [""]
    with pytest.raises(ValueError):
        split.scopes(F.lit("a"), "page")


def test_percentiles(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "score double")
    got = pc.percentile_rank(spark.createDataFrame([(2.0,), (2.5,), (None,)], "score double"), ref)
    assert {r.score: r.percentile for r in got.collect()} == {2.0: 62.5, 2.5: 75.0, None: None}
    cuts = [one(spark, pc.bucket(F.lit(x))) for x in (33.32, 33.33, 66.65, 66.66, math.nan)]
    assert cuts == ["low", "medium", "medium", "high", "high"]


def test_pools(spark):
    low = lambda v, q: one(spark, pl.lower_mean(F.array(*[F.lit(float(x)) for x in v]), q))
    assert low([5, 1, 3, 2, 4], 0.5) == 2.0 and low([7], 0.1) == 7.0 and low([1, 2, 3], 1.0) == 2.0
    assert len(pl.sweep_names()) == 63
    with pytest.raises(ValueError):
        pl.validate("weighted_mean", "mean", 0.5, 0.5)
    with pytest.raises(ValueError):
        pl.validate("mean", "median", 0.5, 0.5)


def test_whole_pipeline_and_stream_agree(spark, tmp_path):
    from siftgrain.streaming.scoring import score_stream, scored

    docs = spark.createDataFrame([(1, "Red car. Big dog runs."), (2, ""), (3, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    stream = {r.doc_id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.doc_id: r.score for r in scored(docs).collect()}
    table = {r.doc_id: r.score for r in pl.score_texts(docs, pr.length).collect()}
    assert stream == batch == table and batch[2] == pl.NO_FACT


def test_likert_and_rows(spark):
    y = lambda n: [one(spark, ds.likert(F.lit(i), F.lit(n))) for i in range(n)]
    assert [y(1), y(2), y(3), y(4)] == [[1], [1, 4], [1, 2.5, 4], [1, 2, 3, 4]]
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, ds.has_duplicates(a("x", "x", ""))) and one(spark, ds.has_gap(a("x", "", "z", "")))
    runs = ds.runs(spark.createDataFrame([(1, i, k) for i, k in enumerate("aaba")], "g int, i int, k string"), ["g", "i"], "k")
    assert [r["size"] for r in runs.orderBy("run").collect()] == [2, 1, 1]
    edges = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c")], "id int, answer string")
    split_ = ds.leakage_free_split(edges)
    assert {r.id: r.component for r in split_.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert ds.disjoint(edges.join(split_, "id"))


def test_split_takes_every_line(spark, tmp_path):
    from siftgrain.plans import catalogue

    lines = [(1, 1, 10, 5), (1, 2, 11, 5), (2, 1, 12, 5), (2, 2, 11, 5), (3, 2, 13, 5), (4, 1, 11, 6)]
    spark.createDataFrame(lines, "l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {r.id: r.component for r in catalogue.split_no_leakage(spark, str(tmp_path)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("pool", ["mean", "sum", "min", "max", "lower_quantile_mean"])
@pytest.mark.parametrize("scope_pool", ["weighted_mean", "lower_quantile_mean", "sum"])
def test_scores_by_expression_equal_scores_by_rows_and_shuffle_nothing(spark, pool, scope_pool):
    texts = [(1, "Red cats sleep. The dogs of big towns bark! And"), (1, "the of."), (2, ""), (3, None), (4, "cats and cats and grey dogs. " * 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    how = {"pool": pool, "scope_pool": scope_pool, "details": True}
    got = pl.score_texts(docs, pr.length, **how)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()

    def rows(df):
        return sorted((r.doc_id, round(r.score, 9), sorted((s.scope_index, s.scope_text, round(s.scope_score, 9), tuple(sorted(s.unit_scores.items()))) for s in r.scopes)) for r in df.collect())

    assert rows(got) == rows(pl.score_texts(docs, lambda u: pr.length(u), **how))


def test_lines_round_by_the_exact_value(spark):
    # 24.91875 and 0.00005 are not doubles: the nearest ones lie below and above; 0.03125 is one, and ties go to the even digit.
    values = [("a", 24.91875), ("b", 0.00005), ("c", 0.03125), ("d", 0.09375), ("e", -24.91875), ("f", None)]
    df = spark.createDataFrame(values, "k string, v double")
    got = {r.k: r.line.split(": ")[1] if r.line else None for r in ranking.ranking_table(df, "k", "v").collect()}
    assert got == {"a": "24.9187", "b": "0.0001", "c": "0.0312", "d": "0.0938", "e": "-24.9187", "f": None}
    rows = df.filter("k = 'a'").select(F.col("v").alias("answer_granularity"), F.lit(None).cast("double").alias("question_granularity"))
    assert qa.overview_line(rows, "x").first().line == "x: Answer 24.9187 - Question N/A"


def test_ranking(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i // 4), int(i), float(rng.integers(1, 5)), float(rng.integers(0, 9))) for i in range(80)]
    df = spark.createDataFrame(rows, "g int, o int, y double, p double")
    got = ranking.global_accuracy(df, "y", "p").first()
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    i, j = np.triu_indices(len(y), 1)
    assert got.accuracy == pytest.approx(((p[i] - p[j]) * (y[i] - y[j]) > 0)[y[i] != y[j]].mean())
    assert ranking.group_accuracy(spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 2, 2.0, 1.0)], df.schema), "g", "o", "y", "p").first().accuracy == 0.0
    assert ranking.evaluation(df, "g", "o", "y", "p").count() == 1


@pytest.mark.parametrize(("levels", "values"), [(4, 9), (1, 5), (60, 3), (500, 400), (3, 1)])
def test_global_accuracy_forms_no_pairs_of_levels(spark, levels, values):
    rng = np.random.default_rng(levels)
    y, p, w = rng.integers(0, levels, 600).astype(float), rng.integers(-2, values, 600) / 4, rng.integers(1, 5, 600)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist(), w.tolist(), strict=True)), "y double, p double, w long")
    df = df.unionByName(spark.createDataFrame([(None, 1.0, 1), (1.0, None, 1), (1.0, float("nan"), 1)], df.schema))
    i, j = np.triu_indices(len(y), 1)
    for weight, n in (("w", w), (None, np.ones(600, np.int64))):
        both = (n[i] * n[j])[y[i] != y[j]]
        got = ranking.global_accuracy(df, "y", "p", weight).first()
        if not len(both):
            assert got.accuracy is None and got.n_pairs is None
            continue
        assert got.n_pairs == both.sum()
        assert got.accuracy == pytest.approx((both * ((p[i] - p[j]) * (y[i] - y[j]) > 0)[y[i] != y[j]]).sum() / both.sum(), abs=1e-12)


def test_a_fragment_is_met_in_blocks_with_ties_by_id(monkeypatch):
    monkeypatch.setattr(vectors, "CELLS", 64)
    rng = np.random.default_rng(2)
    sims = rng.integers(0, 4, (40, 30)) / 4
    for k in (1, 7, 30):
        assert (vectors.best_places(sims, k) == np.argsort(-sims, axis=1, kind="stable")[:, :k]).all()
    holed = np.where(sims == 0.25, np.nan, sims)
    assert (vectors.best_places(holed, 28) == np.argsort(-holed, axis=1, kind="stable")[:, :28]).all()


def test_tau_and_level_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i // 5), int(i), float(i % 5), float(rng.integers(0, 6) + i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, o int, y double, p double")
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    i, j = np.triu_indices(len(rows), 1)
    s = np.sign(y[i] - y[j]) * np.sign(p[i] - p[j])
    wanted = s.sum() / np.sqrt((y[i] != y[j]).sum() * float((p[i] != p[j]).sum()))
    assert ranking.kendall_tau_global(df, "y", "p").first().tau == pytest.approx(wanted)
    got = ranking.level_pairs(df, "g", "o", "y", "p").collect()
    assert len(got) == 10 and all(r.n == 40 and 0 <= r.p <= 1 and r.significant == (r.p < 0.01) for r in got)
    assert next(r for r in got if (r.i, r.j) == (0.0, 4.0)).significant


def test_running_sums_and_numbers(spark):
    from siftgrain.operators.ordered import numbered, running

    rows = [(g, float(x), x % 7 + 1) for g in (None, "a") for x in np.random.default_rng(1).permutation(300).tolist()]
    df = spark.createDataFrame(rows, "g string, x double, n long")
    for r in running(df, "x", "n", "below", ["g"]).collect():
        assert r.below == sum(n for g, x, n in rows if g == r.g and x < r.x)
    for r in running(df.filter("g = 'a'"), "x", "n", "below").collect():
        assert r.below == sum(n for g, x, n in rows if g == "a" and x < r.x)
    got = numbered(df, [F.md5(F.col("x").cast("string")), F.col("x")], ("g",)).collect()
    assert len(got) == 600 and all(sorted(r.number for r in got if r.g == g) == list(range(1, 301)) for g in (None, "a"))
    assert running(df.limit(0), "x", "n", "below").count() == 0


def test_calls_without_splitting(spark):
    from siftgrain.api import granularity

    ref = spark.createDataFrame([(float(x),) for x in range(1, 11)], "score double")
    assert granularity(spark, ["ab", "ab", "abcdefghij"], ref, split=False) == [20.0, 20.0, 100.0]
    assert granularity(spark, "abcde", ref, split=False, buckets=True) == "medium"
    assert granularity(spark, "abcde", split=False) == 5.0
    same = spark.createDataFrame([(1, "Red car."), (1, "Red car."), (None, "Dog."), (None, "Blue house here.")], "doc_id long, text string")
    assert sorted(r.score for r in pl.score_texts(same, pr.length).collect()) == [3.0, 7.0, 7.0, 15.0]


def test_gaps_keep_every_question(spark):
    s = "id int, score double"
    got = qa.joined_gap(spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1, 5.0), (2, 4.0)], s), spark.createDataFrame([(1, 3.0), (3, 1.0)], s))
    assert {r.id: r.gap for r in got.collect()} == {1: 2.0, 2: None, 3: None}


def test_hierarchy_and_ranker(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("c", "a")], "node string, parent string")
    assert {r.node: r.depth for r in pr.hypernym_depths(edges).collect()} == {"a": 0.0, "b": 1.0, "c": 1.5}
    with pytest.raises(RuntimeError):
        pr.hypernym_depths(edges.unionByName(spark.createDataFrame([("b", "c")], edges.schema)), most=5)
    rows = spark.createDataFrame([(i, [float(i * k % 7), float(k)], k) for i in range(12) for k in range(4)], "id int, features array<double>, y int")
    scored = pr.fit_pairwise(rows)(rows)
    assert ranking.group_accuracy(scored.withColumn("o", F.col("y")), "id", "o", "y", "score").agg(F.avg("accuracy")).first()[0] == 1.0


def test_numbers_follow_the_file(spark, tmp_path):
    from siftgrain.sources import files

    (tmp_path / "n.txt").write_text("\n".join(f"line {i}" for i in range(5000)))
    got = files.numbered(spark.read.option("maxPartitionBytes", "4k").text(str(tmp_path / "n.txt"))).collect()
    assert all(r["value"] == f"line {r['id']}" for r in got) and len(got) == 5000
    (tmp_path / "model").write_bytes(b"x")
    with pytest.raises(ValueError):
        files.verified(str(tmp_path / "model"), "0" * 64)
    assert (tmp_path / "model").exists()


def test_statistics(spark):
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803)


def test_grades(spark):
    letter = lambda t, **k: one(spark, qa.grade_letter(F.lit(t), **k))
    assert [letter(t) for t in ("A: CORRECT", "B", "none", "CORRECT", "INCORRECT", "NOT_ATTEMPTED")] == ["A", "B", "C", "C", "C", "A"]
    assert letter("NOT_ATTEMPTED", strict=True) == "C"
    r = qa.grade_summary(qa.graded(spark.createDataFrame([("A",), ("A",), ("B",), ("C",)], "reply string"))).first()
    assert (r.correct, r.attempted, r.accuracy_given_attempted, r.f1) == (0.5, 0.75, 0.6667, 0.5714)
    line = '{"body":{"output":[{"content":[{"text":"x"}]},{"content":[{"text":"A"}]}]}}'
    assert qa.batch_replies(spark.createDataFrame([("task-12", line)], "custom_id string, response string")).first() == ("12", "A")
    assert [one(spark, pr.likert_reply(F.lit(t))) for t in ("Granularity: 3", "15")] == [3, None]


def test_cache(spark, tmp_path):
    cache = ScoreCache(spark, str(tmp_path / "cache"), fingerprint(model="length"))
    units = spark.createDataFrame([("ab",), ("ab",), ("c",)], "unit string")
    assert sorted(r.score for r in cache.score(units, pr.length).collect()) == [1.0, 2.0, 2.0]
    assert cache.misses(units).count() == 0


def test_files(spark, tmp_path):
    from siftgrain.sources import files

    (tmp_path / "a.jsonl").write_text('{"a":1}\n{bad\n{"a":2}\n')
    assert sorted(r.a for r in files.read(spark, str(tmp_path / "a.jsonl"), schema="a int").collect()) == [1, 2]
    assert files.read(spark, str(tmp_path / "none.jsonl")) is None
    (tmp_path / "t.txt").write_text("x\ny\n")
    (tmp_path / "v.txt").write_text("1\n2\n")
    assert [tuple(r) for r in files.paired_lines(spark, str(tmp_path / "t.txt"), str(tmp_path / "v.txt")).orderBy("line").collect()] == [(0, "x", 1.0), (1, "y", 2.0)]


def plain_lexical(rows, rare=3.0):
    words, total = {}, {}
    for key, text in rows:
        found = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
        if found:
            words.setdefault(key, []).extend(found)
        for w in found:
            total[w] = total.get(w, 0) + 1
    zipf = {w: math.log10(n / sum(total.values())) + 9 for w, n in total.items()}
    return {k: (len(x), len(set(x)) / len(x), sum(zipf[w] for w in x) / len(x), sum(zipf[w] < rare for w in x) / len(x)) for k, x in words.items()}


@pytest.mark.parametrize("sent", [0, 3, 40, 200_000])
def test_lexical_with_words_sent_and_joined(spark, monkeypatch, sent):
    monkeypatch.setattr(qa, "BROADCAST_WORDS", sent)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{z}" for z in rng.zipf(1.5, i % 40) % 300)) for i in range(120)]
    # Repeated keys, keys that are null, texts without words.
    rows += [(3, "w1 w2, W1! é_x 漢字"), (3, "w2"), (None, "w1 w7"), (None, "w7 w9"), (500, None), (501, " .. "), (502, "")]
    got = {r.id: (r.n_words, r.ttr, r.mean_zipf, r.rare_share) for r in qa.lexical(spark.createDataFrame(rows, "id int, text string").repartition(3), "id", "text", 8.0).collect()}
    wanted = plain_lexical(rows, 8.0)
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(wanted[k]) for k in wanted)
    assert qa.lexical(spark.createDataFrame([(1, None), (2, "")], "id int, text string"), "id", "text").count() == 0


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_lexical_leaves_words_where_they_are(spark):
    df = spark.range(2000).select("id", F.expr("concat_ws(' ', transform(sequence(0, 59), i -> concat('w', (id + i * i) % 500)))").alias("text")).repartition(4).cache()
    pairs = df.select("id", F.explode(F.array_distinct(F.split("text", " ")))).count()
    before = shuffled_rows(spark)
    assert len(qa.lexical(df, "id", "text").collect()) == 2000
    assert sum(n for i, n in shuffled_rows(spark).items() if i not in before) < pairs / 4


def test_every_vector_asks_for_its_nearest(spark, tmp_path):
    from siftgrain.plans import catalogue

    x = np.random.default_rng(5).normal(size=(230, 8))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.cosine_topk(spark, str(tmp_path)).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = -np.sort(-(unit @ unit.T), axis=1)[:, :10]
    assert len(got) == 2300 and {(r.query_id, r.rank) for r in got} == {(i, k) for i in range(230) for k in range(1, 11)}
    assert max(abs(r.similarity - best[r.query_id, r.rank - 1]) for r in got) < 1e-5
