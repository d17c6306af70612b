"""Hot keys, very long texts, empty tables and plain versions of learned scores."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from tidemark.llm import boosting, common, components, decontaminate, line_dedup, neardup, quality_classifier, quality_rules, secrets, token_rollup
from tidemark.llm.docstats import FEATURES

SF_DIR = "/root/testdata/sf0.001"


def largest_parts(joined, on):
    """Rows of each part of the exchange below the join that the rows were dealt to."""
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes), float(np.median(sizes))


@pytest.mark.parametrize("same", ["id", "null id"])
def test_equal_rows_of_a_hot_key_are_dealt_apart(spark, tmp_path, monkeypatch, same):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        spark.range(10_000).select(F.lit(1).alias("k"), F.lit(7 if same == "id" else None).cast("long").alias("doc_id"), F.lit("same text").alias("text")).write.parquet(str(tmp_path / "rows"))
        rows = spark.read.parquet(str(tmp_path / "rows"))
        other = spark.createDataFrame([(1, "a")], "k int, v string")
        out = common.spread_join(rows, other, ["k"])
        assert out.count() == 10_000
        most, middle = largest_parts(out, "k")
        assert most < 2 * middle
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_operators_on_many_copies_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1)
    line = "the same long line of boilerplate everywhere"
    passage = "one two three four five six seven eight nine ten eleven"
    text = F.concat(F.lit(f"{line}\n{passage}\n"), F.when(F.col("id") % 2 == 0, "").otherwise(F.format_string("own line number %d of this text", F.col("id"))))
    docs = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), text.alias("text"), F.format_string("s%d", F.col("id") % 7).alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"))
    docs = common.settle(docs)
    cut = line_dedup.remove_boilerplate(docs)
    assert cut.count() == 600 and cut.filter(F.col("text").contains(line)).count() == 0
    items = spark.createDataFrame([(1, passage), (2, "nothing of this kind")], "item_id long, text string")
    found = decontaminate.report(docs, items)
    assert found.count() == 600 and {(r["n_hit"], r["n_items"]) for r in found.collect()} == {(11, 1)}
    assert decontaminate.remove_documents(docs, items).count() == 0
    linked = neardup.link(docs, neardup.plan(shingle=5, num=4, den=5))
    assert linked.count() == 600
    stay = neardup.deduplicate(docs, neardup.plan(shingle=5, num=4, den=5))
    assert stay.filter("doc_id is null").count() == 200


def test_components_of_a_star_and_a_chain_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1)
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(300)} | {1000 + k: 1000 for k in range(61)}


def test_rows_of_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long), (1, long), (2, long), (3, "alone"), (3, "alone"), (4, "one text"), (4, "another text"), (4, "another text"), (5, None), (5, None)]
    left = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), neardup.plan())
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, long), (3, "alone"), (4, "one text"), (4, "another text"), (5, None)], key=str)


# op5


def test_tokens_of_long_runs_are_counted(spark):
    import tiktoken

    names = ("byte_bpe_50k", "byte_bpe_multi_50k")
    paths = {name: public_tokenizers.path(f"{name}.tiktoken") for name in names}
    texts = [" " * 1_000_000 + "a", "a" * 100_000, " \n" * 50_000 + "word", "x" * 499 + " " + "y" * 501, "Straße 123 don't", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in token_rollup.count_tokens(docs, paths, public_tokenizers.PATTERN).collect()}
    for k, name in enumerate(names):
        from tidemark.llm import bpe

        with open(paths[name], "rb") as f:
            raw = f.read()
        replay = bpe.MergeReplay(raw, public_tokenizers.PATTERN)
        for i, text in enumerate(texts):
            assert got[i][k] == len(replay.encode_long(text or "")) // 4
        coder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: r for r, t in enumerate(bpe.tokens(raw)) if t}, special_tokens={})
        for i in (3, 4):
            assert got[i][k] == len(coder.encode_ordinary(texts[i]))


# op10


@pytest.mark.parametrize("piece", ["eyJ", "eyJabcdefgh.", "-----BEGIN ", "-----BEGIN PRIVATE KEY-----", "password", "password=", "secret: ", "AKIA", "ghp_", "xoxb-", "AIza", "sk_live_", "A1", "A=", "token := '", "a.", "\n", " "])
def test_patterns_take_time_in_proportion(piece):
    def seconds(size):
        text = piece * (size // len(piece))
        best = min(timed(text) for _ in range(2))
        return best

    def timed(text):
        began = time.perf_counter()
        secrets.candidates(text)
        return time.perf_counter() - began

    small, large = seconds(50_000), seconds(400_000)
    assert large < 40 * max(small, 0.002)


def test_vote_equals_a_plain_walk():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 6)), 1)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(0, 0.3, 400) > 0.7).astype(float)
    for trees in (boosting.fit(x, y, {0: 1}), boosting.forest(x, y, trees=12)):
        want = []
        for row in x:
            total = trees.base
            for node in trees.roots:
                while trees.feature[node] >= 0:
                    node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
                total += trees.value[node]
            want.append(total)
        assert np.allclose(trees.vote(x), want)


def test_verdicts_equal_plain_trees(spark):
    some = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees, cut = quality_rules.fit(documents, some)
    for r in quality_rules.judge(documents, some, ["doc_id"]).collect():
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["tree_score"] >= cut)


# op8


def test_margin_equals_plain_log_densities():
    rng = np.random.default_rng(9)
    x = np.abs(rng.normal(size=(500, len(FEATURES)))) * rng.integers(1, 50, len(FEATURES))
    y = (rng.random(500) < 0.4).astype(float)
    x[y > 0] *= 1.4
    model = quality_classifier.discriminant(x, y)
    own = np.arange(500) % 5 != 4
    z = (quality_classifier.transform(x) - model.centre) / model.scale
    groups = [z[own & (y == k)] for k in (0, 1)]
    pooled = np.diag(sum(((g - g.mean(axis=0)) ** 2).sum(axis=0) for g in groups) / own.sum()) + 1e-3 * np.eye(z.shape[1])
    shrunk = [(1 - quality_classifier.SHRINKAGE) * np.cov(g, rowvar=False, bias=True) + quality_classifier.SHRINKAGE * pooled for g in groups]
    for row in range(0, 500, 25):
        density = []
        for g, cov in zip(groups, shrunk):
            d = z[row] - g.mean(axis=0)
            density.append(np.log(len(g) / own.sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.inv(cov) @ d)
        assert model.margin(x[row : row + 1])[0] == pytest.approx(density[1] - density[0], rel=1e-6, abs=1e-6)


# empty tables and the pipeline's stages


def test_editing_operators_of_an_empty_table(none, labels, benchmark):
    same = [neardup.deduplicate(none, neardup.plan()), line_dedup.remove_boilerplate(none), decontaminate.remove_documents(none, benchmark), decontaminate.remove_spans(none, benchmark), quality_rules.keep_good(none, labels), secrets.redact(none)]
    for out in same:
        assert out.columns == none.columns and out.count() == 0


@pytest.mark.parametrize("name", ["odd", "none"])
def test_stages_on_odd_and_empty_tables(request, spark, name):
    docs = request.getfixturevalue(name)
    rows = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.settle(stage(spark, docs, SF_DIR))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert out.count() <= rows
        docs, rows = out, out.count()
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


# op1


def test_shards_prune_files(spark, none):
    from tidemark.llm import shards

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    curve = {r["by"]: r["shards"] for r in shards.pruning(docs, shards.place(docs)).collect()}
    dealt = {r["by"]: r["shards"] for r in shards.pruning(docs, docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("shard"))).collect()}
    assert set(curve) == {"lang", "source", "size", "lang+source", "lang+size", "source+size"}
    assert all(curve[by] < dealt[by] for by in ("lang", "source", "lang+source", "lang+size")) and curve["lang+source"] < 0.5 * dealt["lang+source"]
    assert shards.pruning(none, shards.place(none)).count() == 0
