import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases, runs, weighted_sampling

SF_DIR = "/root/testdata/sf0.001"


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# op11


def phrases_in_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("text", "lang").toPandas())
    return sorted((dict(zip(("lang", "rank", "phrase", "a", "l", "r", "n", "score"), r)) for r in con.sql(phrases.COLLOCATIONS_SQL).fetchall()), key=lambda r: (r["lang"], r["rank"]))


def found_phrases(docs):
    return sorted((r.asDict() for r in phrases.collocations(docs).collect()), key=lambda r: (r["lang"], r["rank"]))


def test_phrases_equal_sql(documents):
    assert found_phrases(documents) == phrases_in_sql(documents)


def test_phrases_in_small_blocks(documents, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)
    assert found_phrases(documents) == phrases_in_sql(documents)


def test_phrases_of_odd_rows(spark, odd, none):
    assert found_phrases(odd) == phrases_in_sql(odd)
    assert found_phrases(none) == []
    few = [("New York, new york. New York!" * 5, None), ("a a a a a a a a a a a a", "en"), ("\x0bnew\tyork\x0c" * 10, None)]
    made = spark.createDataFrame(few, "text string, lang string")
    assert found_phrases(made) == phrases_in_sql(made) != []


def test_entries_of_blocks_are_counted_and_named_in_one_shuffle(documents, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)
    plans, settled = [], phrases.settle
    monkeypatch.setattr(phrases, "settle", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), settled(df))[1])
    phrases.grams(documents)
    raised = [plan for plan in plans if "FlatMapCoGroups" in plan]
    assert len(raised) == phrases.MAX_WORDS - 1 and not any("Join" in plan for plan in raised)
    named = [plan for plan in plans if "monotonically_increasing_id" in plan and "Window" in plan]
    assert len(named) == phrases.MAX_WORDS - 1 and not any("Join" in plan or "Aggregate" in plan for plan in named)


def test_a_frequent_key_has_one_id_and_one_row_with_its_count(documents, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)
    level = phrases.settle(phrases.blocks(documents))
    entries = {(r["block"], r["at"]): ((r["lang"], r["word"]), r["n"]) for r in level.filter("at is not null").collect()}
    count = Counter()
    for key, n in entries.values():
        count[key] += n
    named = phrases.settle(phrases._named(level, ["lang", "word"], 10)).collect()
    assert sorted((r["block"], r["at"]) for r in named) == sorted(at for at, (key, _) in entries.items() if count[key] >= 10) != []
    of_id = {r["id"]: (r["lang"], r["word"]) for r in named if r["f"] is not None}
    assert len(of_id) == len(set(of_id.values())) == sum(r["f"] is not None for r in named)
    assert all(entries[r["block"], r["at"]][0] == of_id[r["id"]] and r["f"] in (None, count[of_id[r["id"]]]) for r in named)


def test_scores_beyond_64_bits(spark):
    count = 10_000_000_000_000
    rows = spark.createDataFrame([(count, [count + 7], [count + 9])], "f long, prefix_f array<long>, suffix_f array<long>")
    assert rows.select(phrases._best_cut(2)["score"]).first()[0] == 1_000_000 * count * count // ((count + 7) * (count + 9))


def test_top_phrases_are_ranked_in_parts(spark):
    rows = spark.range(3000).select(F.lit("en").alias("lang"), F.format_string("%05d", "id").alias("phrase"), (F.col("id") % 7).alias("score"), (F.col("id") % 3).alias("a"))
    got = {r["phrase"]: r["rank"] for r in phrases._top(rows, 50).collect()}
    want = sorted(((-(i % 7), -(i % 3), f"{i:05d}") for i in range(3000)))[:50]
    assert got == {p: k for k, (_, _, p) in enumerate(want, 1)}


# op12


def plain_runs(words):
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_report(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_runs_of_short_sequences():
    rng = np.random.default_rng(5)
    texts = [[bytes([97 + x]) for x in rng.integers(0, rng.integers(1, 4), rng.integers(0, 60))] for _ in range(400)]
    texts += [[b"a"] * 50, [b"a", b"b"] * 20 + [b"c"] + [b"a", b"b"] * 20, ([b"x"] * 7 + [b"y"]) * 9, []]
    for words, (found, left) in zip(texts, runs.inspect(texts)):
        assert found == plain_runs(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        assert left == [w for i, w in enumerate(words) if i not in gone]


def test_runs_in_small_portions(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 16)
    test_runs_of_short_sequences()


def test_runs_of_documents(spark, documents):
    some = documents.filter("length(text) < 4000")
    assert plain(runs.report(some)) == sorted((plain_report(r["doc_id"], r["text"]) for r in some.select("doc_id", "text").collect()), key=str)


def test_runs_of_odd_rows(odd, none):
    short = odd.filter("doc_id is null or doc_id not in (5, 6)")
    assert plain(runs.report(short)) == sorted((plain_report(r["doc_id"], r["text"]) for r in short.collect()), key=str)
    assert runs.report(none).count() == 0 and runs.report(odd).count() == odd.count()


def test_a_long_text_of_one_word_and_a_long_random_one():
    (found, left), (none, _) = runs.inspect([[b"a"] * 200_000, [b"%d" % x for x in np.random.default_rng(1).integers(0, 100_000, 200_000)]])
    assert found == [(0, 200_000, 1)] and left == [b"a"] and none == []


def test_collapse_keeps_texts_without_runs(spark, odd, none):
    done = {(r["doc_id"], r["text"]) for r in runs.collapse(odd).collect()}
    assert (1, None) in done and (2, "") in done and (8, " \n\t ") in done and (5, "once upon a time there was") in done
    assert runs.collapse(odd).schema == odd.schema and runs.collapse(none).count() == 0


# op13


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def plain_edits(rows):
    """rows: (doc_id, text) in their order."""
    out = []
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        out.append((i, len(t), t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]))
    return out


@pytest.mark.parametrize("range_bytes", [1 << 20, 20_000])
def test_fingerprints_of_documents(documents, monkeypatch, range_bytes):
    monkeypatch.setattr(weighted_sampling, "RANGE_BYTES", range_bytes)
    rows = [(r["doc_id"], r["text"] or "") for r in documents.orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in weighted_sampling.report(documents).collect()}
    assert len(got) == len(rows)
    edits = plain_edits(rows)
    apart = []
    for k, (i, n, edited) in enumerate(edits):
        assert got[i]["n_chars"] == n and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        apart += [got[i]["near_edited"] - jaccard(rows[k][1], edited), got[i]["near_next"] - jaccard(rows[k][1], rows[(k + 1) % len(rows)][1])]
    # unbiased, and with the spread of 32 samples
    assert abs(np.mean(apart)) < 0.01 and np.std(apart) < 0.5 / 32**0.5
    prints = {}
    for i, t in rows:
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert len(set(prints.values())) > 0.95 * len(prints)


def test_fingerprints_do_not_depend_on_the_operator(documents):
    got = {r["doc_id"]: r["fingerprint"] for r in weighted_sampling.report(documents).collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in weighted_sampling.fingerprints(documents).collect()} == got


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = weighted_sampling.report(odd).collect()
    assert len(got) == odd.count() and weighted_sampling.report(none).count() == 0
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 8)} == {""}
    one = spark.createDataFrame([(4, "alone in the world")], "doc_id long, text string")
    row = weighted_sampling.report(one).first()
    assert row["edited_sha256"] == hashlib.sha256(b"alone in alone in ").hexdigest() and row["near_next"] == 1.0
    assert weighted_sampling.fingerprints(odd).columns == [*odd.columns, "fingerprint"] and weighted_sampling.fingerprints(none).count() == 0


def test_fingerprints_run_no_python(documents):
    plan = weighted_sampling.report(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_collocations(docs, least, most, top):
    """By counting all phrases of up to ``most`` words."""
    import re

    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    frequent = {key: n for key, n in f.items() if len(key[1]) > 1 and n >= least}
    out = []
    for (lang, words), a in frequent.items():
        longer = (n for (other, more), n in frequent.items() if other == lang and len(more) > len(words) and any(more[i : i + len(words)] == words for i in range(len(more) - len(words) + 1)))
        if any(100 * n >= 50 * a for n in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    ranked = []
    for lang in sorted(total):
        for rank, (_, score, a, phrase, l, r) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            ranked.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return ranked


@pytest.mark.parametrize("most", [2, 3, 5])
def test_phrases_of_more_words_equal_plain_counts(spark, most):
    rng = np.random.default_rng(most)
    texts = [(["en", "de", None][k % 3], " ".join(rng.choice(["a", "b", "c", "d.", "New", "york"], 60, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1]))) for k in range(12)]
    made = spark.createDataFrame(texts, "lang string, text string")
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(made, 4, most, 25).collect())
    assert got == sorted(plain_collocations(texts, 4, most, 25))


def test_outcomes_of_terms_at_the_ends_of_their_range(spark):
    ends = spark.createDataFrame([(2**63 - 1, 9.0), (-(2**63), 0.0)], "term long, log_weight double")
    assert ends.select(*(weighted_sampling._outcome("term", "log_weight", k).alias(f"s{k}") for k in range(8))).count() == 2
