"""Operators over whole tables: shards, line dedup, rollups, near-duplicates, decontamination, pipeline."""

import glob
import os
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tidemark.llm import common, components, decontaminate, line_dedup, neardup, quality_rules, shards, token_rollup

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_hilbert_index_visits_neighbours(spark):
    cells = spark.range(512).selectExpr("cast(id div 64 as int) x", "cast(id div 8 % 8 as int) y", "cast(id % 8 as int) z")
    path = cells.select("x", "y", "z", shards.hilbert_index([cells["x"], cells["y"], cells["z"]], 3).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in path] == list(range(512))
    assert all(sum(abs(a[k] - b[k]) for k in range(3)) == 1 for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_shards(request, name):
    docs = request.getfixturevalue(name)
    rows = shards.place(docs).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), len(t) + 1, zlib.crc32(t)) for i, t in texts)
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    most = max(r["size"] for r in rows)
    assert all(abs(size[k] - sum(size.values()) / 16) <= most for k in range(16))


def test_names_that_differ_late_have_cells_of_their_own(spark):
    # names share all but their last characters; a filter on one reads few shards
    rows = [(k, f"text {k} " + "x" * (k % 50), f"https://host.example.org/a/long/path/site{k % 32:02d}", ("de", "en")[k // 32 % 2]) for k in range(3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    placed = {r["doc_id"]: r["shard"] for r in shards.place(docs).collect()}
    def read(column):
        by = defaultdict(set)
        for r in rows:
            by[r[column]].add(placed[r[0]])
        return sum(map(len, by.values())) / len(by)
    assert len(set(placed.values())) == 16 and read(2) <= 8 and read(3) <= 12


def test_shards_equal_a_plain_walk_along_the_curve(spark):
    rows = [(k, "y" * (k * 37 % 61), f"s{k % 9}", ("de", "en", "fr", None)[k % 4]) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sorted(shards.place(docs, 4).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in got] == sorted(r["curve"] for r in got)
    begin, whole = 0, sum(r["size"] for r in got)
    for r in got:
        assert r["shard"] == min(begin * 4 // whole, 3)
        begin += r["size"]
    cells = defaultdict(set)
    for r in got:
        cells[r["curve"]].add((rows[r["doc_id"]][2], rows[r["doc_id"]][3]))
    assert all(len(c) == 1 for c in cells.values())


def test_shards_of_nothing(none):
    assert shards.place(none).count() == 0


def test_line_dedup_odd(odd, none):
    done = line_dedup.remove_boilerplate(odd)
    assert done.count() == odd.count() and done.columns == odd.columns
    assert line_dedup.report(none).count() == 0


def test_line_dedup_cuts_every_spread_line(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    notice, short = "All of these rights are reserved here.", "版权所有"
    rows = [(k, f"own words of page {k} are standing here\n{notice}\n{short}\nand more of page {k} again", f"s{k % 6}") for k in range(12)]
    rows += [(200, notice, None), (200, f"{notice}\n\n{notice}", None), (None, notice, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most_bytes in (common.BROADCAST_BYTES, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", most_bytes)
        done = sorted((r["doc_id"] or -1, r["text"]) for r in line_dedup.remove_boilerplate(docs).collect())
        assert done == sorted([(i or -1, "\n".join(x for x in t.split("\n") if x != notice)) for i, t, _ in rows])


def test_removers_leave_clashing_columns_alone(spark, labels):
    # the names that the operators use inside, and names that differ from them in case alone
    names = ["id", "KEY", "key_at", "places", "lines", "n_lines", "n_cut", "h", "at", "match", "doc_id_match", "key_match", "hit_words", "hit_words_match", "lead_match", "pieces_match", "run", "text_counted", "quality_kept", "base_failed", "kept", "label", "__text", "__key"]
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"{text} {k}\na line that is on each of the sites", f"s{k}", *(f"{c}{k}" for c in names)) for k in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    items = spark.createDataFrame([(1, "of nothing that is here")], "item_id long, text string")
    want = {r[0]: dict(zip(docs.columns, r)) for r in rows}
    for done, changed in ((line_dedup.remove_boilerplate(docs), True), (decontaminate.remove_documents(docs, items), False), (decontaminate.remove_spans(docs, items), False), (quality_rules.keep_good(docs, labels), False)):
        got = {r["doc_id"]: r.asDict() for r in done.collect()}
        assert done.columns == docs.columns and got.keys() == want.keys()
        for i, r in got.items():
            assert r == want[i] | ({"text": want[i]["text"].split("\n")[0]} if changed else {})


def test_pipeline_cuts_boilerplate_of_any_share_and_leaves_copies(spark):
    notice = "This whole passage is printed by each of the sites that take part in it " * 4
    rows = [(k, f"here are {k} a few own words{k} of page{k}\n{notice}", f"s{k % 6}") for k in range(12)]
    page = "\n".join(f"line{n} of the copied{n} page that has many{n} words{n} in it{n}" for n in range(30))
    rows += [(100 + k, f"{page}\nseen{k}", f"s{k}") for k in range(6)]
    rows += [(200, notice, "s9")]
    rows += [(300 + k, " ".join(f"w{k}x{n}" for n in range(60)) + f"\n{notice}", f"s{k}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    done = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, SF_DIR).collect()}
    assert done.keys() == {r[0] for r in rows} and not [i for i, t in done.items() if notice in t]
    assert all(done[i] == t for i, t, _ in rows if 100 <= i < 200)


def test_pipeline_cuts_lines_without_blanks(spark):
    notice = "本网站的所有内容均受版权保护未经许可不得转载或使用"
    rows = [(k, " ".join(f"w{k}x{n}" for n in range(60)) + f"\n{notice}", f"s{k}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["text"] for r in corpus_pipeline.lines(spark, docs, SF_DIR).collect()} == {t.split("\n")[0] for _, t, _ in rows}


def test_near_threshold_is_exact(spark):
    rows = [(k, f"line number {n} of them all", f"s{s}") for k, (n, s) in enumerate((n, s) for n in range(1, 12) for s in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spread = {r["h"] for r in line_dedup.boilerplate(docs, min_sites=5).collect()}
    by_hash = {r["h"]: r["text"] for r in docs.selectExpr("xxhash64(text) as h", "text").collect()}
    assert sorted(int(by_hash[h].split()[2]) for h in spread) == list(range(5, 12))


def test_rollup_batches(spark, tmp_path, odd):
    root, delta = str(tmp_path / "rollup"), token_rollup.DELTA
    send = lambda name, rows: token_rollup.commit(spark, root, name, spark.createDataFrame(rows, delta))
    now = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in token_rollup.totals(spark, root).collect()}
    assert now() == {}
    assert send("one", [("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, "en", "v1", None, None)])
    assert not send("one", [("insert", "a", "en", "v1", 99, None)])
    assert now() == {("a", "en", "v1"): (2, 15), (None, "en", "v1"): (1, 0)}
    assert send("two", [("delete", "a", "en", "v1", None, 5), ("revise", "a", "en", "v1", 12, 10)]) and send("empty", [])
    assert now()[("a", "en", "v1")] == (1, 12)
    assert send("three", [("delete", "a", "en", "v1", None, 12)]) and ("a", "en", "v1") not in now()
    with pytest.raises(Exception, match="unknown op"):
        send("four", [("drop", "a", "en", "v1", 1, 1)])
    assert not [x for x in os.listdir(root) if x.startswith("batch_id=four")]


@pytest.mark.parametrize("name", ["documents", "odd", "none"])
def test_rollups_equal_plain_counts(request, spark, tmp_path, name):
    import base64

    import public_tokenizers
    import tiktoken

    docs = request.getfixturevalue(name)
    versions = {v: public_tokenizers.path(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    count = {}
    for v, path in versions.items():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        coder = tiktoken.Encoding(v, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        count[v] = lambda t, coder=coder: len(coder.encode_ordinary(t))
    old, new = versions
    rows = [(r["text"] or "", r["doc_id"], r["source"], r["lang"]) for r in docs.collect()]
    firsts = {}
    for r in sorted(rows, key=lambda r: [(x is not None, x) for x in r[1:]]):
        firsts.setdefault(r[0], r)
    want = {}
    for after, own, version, counted in (("load", rows, old, lambda t: -(-len(t.encode()) // 4)), ("count", rows, old, count[old]), ("copies", firsts.values(), old, count[old]), ("upgrade", firsts.values(), new, count[new])):
        for text, _, source, lang in own:
            total = want.setdefault((after, source, lang, version), [0, 0])
            total[0] += 1
            total[1] += counted(text)
    got = token_rollup.maintain(spark, docs.repartition(5), str(tmp_path / "rollup"), versions, public_tokenizers.PATTERN).collect()
    assert {tuple(r)[:4]: list(tuple(r)[4:]) for r in got} == want


def plain_links(rows, size, num, den):
    """doc_id to set sizes and component, comparing every two texts that share a shingle; rows of one doc_id are linked."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()))
    top = {i: i for i, s in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    shared = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            shared[x].append(k)
    for p, q in {(a, b) for ids in shared.values() for k, a in enumerate(ids) for b in ids[:k]}:
        (i, x), (j, y) = sets[p], sets[q]
        if den * len(x & y) >= num * len(x | y):
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return {(i, len(s)): find(i) if s else i for i, s in sets}


def edited_copies():
    """Chains of copies that drift apart word by word, so that most links are not to the first of a group."""
    import random

    rng = random.Random(4)
    rows = []
    for g in range(6):
        words = [f"w{rng.randrange(4000)}" for _ in range(60)]
        for _ in range(25):
            rows.append((len(rows) * 7 % 151, " ".join(words)))
            words[rng.randrange(60)] = f"n{rng.randrange(9999)}"
    return rows


def test_near_duplicates_of_drifting_copies(spark):
    rows = edited_copies()
    got = neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), neardup.plan(3, 85, 100)).collect()
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got} == plain_links(rows, 3, 85, 100)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("hot, most_bytes", [(3, 0)])
def test_near_duplicates_with_hot_keys_and_without_broadcasts(spark, monkeypatch, hot, most_bytes):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "BROADCAST_BYTES", most_bytes)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = edited_copies() + [(900 + k, "one text that stands here in many rows") for k in range(30)] + [(960 + k, "") for k in range(9)]
    got = neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), neardup.plan(3, 85, 100)).collect()
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got} == plain_links(rows, 3, 85, 100)


@pytest.mark.parametrize("turn", range(2))
def test_near_duplicates_of_an_id_with_several_texts(spark, turn):
    import random

    one, two = (" ".join(f"{c}{n}" for n in range(60)) for c in "xy")
    rows = [(5, one), (5, two), (7, one + " more"), (9, "and " + two), (3, one), (2, "what nobody else says"), (5, None)]
    random.Random(turn).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(turn + 1)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in neardup.link(docs, neardup.plan(3, 85, 100)).collect()}
    assert got == plain_links(rows, 3, 85, 100) and {got[i, n] for i, n in got if n > 2 and i != 2} == {3}
    # an id that names several texts names none: its texts are all kept
    left = sorted((r["doc_id"], r["text"] or "") for r in neardup.deduplicate(docs, neardup.plan(3, 85, 100)).collect())
    assert left == sorted([(2, "what nobody else says"), (3, one), (5, ""), (5, one), (5, two), (9, "and " + two)])


def test_deduplicate_leaves_clashing_columns_alone(spark):
    names = ["key", "key_high", "KEY_", "n", "node", "kept", "component_id", "n_shingles", "hot_part"]
    rows = [(k, "a text that is the same in all of these", *(f"{c}{k}" for c in names)) for k in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    (left,) = neardup.deduplicate(docs, neardup.plan()).collect()
    assert left.asDict() == dict(zip(docs.columns, rows[0]))


def test_near_duplicates_odd(odd, none, spark):
    rows = {(r["doc_id"], r["n_shingles"]): r for r in neardup.link(odd, neardup.plan(3, 85, 100)).collect()}
    assert rows[6, 6]["component_id"] == 5 and rows[5, 6]["kept"] and rows[None, 1]["component_id"] == 3
    assert rows[1, 0]["kept"] and rows[2, 0]["component_id"] == 2
    assert neardup.link(none, neardup.plan()).count() == 0
    left = neardup.deduplicate(odd, neardup.plan())
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [1, 2, 3, 5, 7, 8, 9, 10, 11]


def test_signatures_within_the_distance_share_a_key():
    import numpy as np

    how, rng = neardup.plan(), np.random.default_rng(0)
    one = rng.integers(0, 65536, how.size).astype(np.uint16)
    for _ in range(200):
        two = one.copy()
        two[rng.choice(how.size, how.distance, replace=False)] ^= 1
        keys = neardup.chunk_keys(np.stack([one, two]), how.chunks)
        assert set(keys[0]) & set(keys[1])


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in range(100, 140)} == {100} and got[201] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most_bytes", [common.BROADCAST_BYTES, 0])
def test_decontamination_with_short_items(spark, odd, monkeypatch, most_bytes):
    monkeypatch.setattr(common, "BROADCAST_BYTES", most_bytes)
    items = spark.createDataFrame([(1, "Upon a TIME"), (2, "word"), (3, None), (4, "!?"), (None, "a"), (5, "of naïve words 中文 text tags 42 second line of words here"), (6, "time there")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.report(odd, items).collect()}
    assert got[3, 1]["n_hit"] == 1 and got[None, 1]["contaminated"] and got[None, 0]["n_hit"] == 0 and not got[9, 2]["contaminated"]
    assert got[5, 18_000]["n_hit"] == 12_000 and got[5, 18_000]["n_items"] == 2
    assert got[7, 38]["n_items"] == 1 and got[1, 0]["n_items"] == 0
    cut = decontaminate.remove_spans(odd, items)
    assert cut.columns == odd.columns and decontaminate.report(cut, items).filter("doc_id = 5 and contaminated").count() == 0
    assert decontaminate.remove_documents(odd, items).filter("doc_id in (3, 5, 6, 7)").count() == 0


def test_decontamination_of_nothing(odd, none, benchmark):
    assert decontaminate.report(none, benchmark).count() == 0
    assert decontaminate.report(odd, benchmark.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, want = __spark_entry__.queries()[name](spark, SF_DIR), con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [list(want.columns).index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF_DIR)
        rows = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r["text"] for r in rows.collect()}
        if name == "line dedup":
            assert after.keys() == before.keys()
        else:
            assert all(before[i] == t for i, t in after.items())
        if name == "near-duplicates":
            assert after.keys() == {i for (i, _), root in plain_links(before.items(), 5, 4, 5).items() if i == root}
        if name == "benchmark decontamination":
            hit = {r["doc_id"] for r in decontaminate.report(spark.createDataFrame(list(before.items()), "doc_id long, text string"), benchmark).filter("contaminated").collect()}
            assert after.keys() == before.keys() - hit
        docs = rows
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()))
