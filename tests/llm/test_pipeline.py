"""The queries and the pipeline on the smallest tables, skipped where there are none, and the pipeline against a plain version."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from test_operators import WORDS, brute_groups, brute_lines, edited, prose, without

import corpus_pipeline
from millrace.llm import mixing, queries

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    got = sorted(tuple(str(r[c]) for c in columns) for r in queries.QUERIES[name](spark, FOLDER).collect())
    assert got == sorted(tuple(map(str, r)) for r in cursor.fetchall())


def rows_of(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(*columns).collect()]


def run(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


@here
def test_op1_names_the_languages_of_held_out_texts(spark):
    import zlib

    truth = dict(rows_of(spark, "documents", "doc_id", "lang"))
    got = {r.doc_id: r for r in run(spark, "op1_language_id")}
    assert set(got) == set(truth) and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out and truth[i] is not None and r.lang_pred != "und"]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.9


@here
def test_op3_equals_brute_force(spark):
    rows = rows_of(spark, "documents", "doc_id", "text")
    gone = brute_lines(rows)
    got = {r.doc_id: r for r in run(spark, "op3_fuzzy_lines")}
    lines = sum(len(gone[r]) for r in rows)
    assert all(got[i].n_removed <= len(gone[i, t]) for i, t in rows) and sum(r.n_removed for r in got.values()) >= 0.98 * lines
    for i, t in rows:
        if got[i].n_removed == len(gone[i, t]):
            assert got[i].text_sha256 == hashlib.sha256(without(t, gone[i, t]).encode()).hexdigest()


@here
def test_op4_equals_the_library(spark):
    import tiktoken

    tokens, pattern = queries.bpe_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    got = {r.doc_id: r for r in run(spark, "op4_byte_bpe")}
    for i, text in rows_of(spark, "documents", "doc_id", "text"):
        ids = library.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_op5_recall(spark, scale):
    folder = f"/root/testdata/sf{scale}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding and any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    found = defaultdict(list)
    for r in queries.QUERIES["op5_collision_neighbours"](spark, folder).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    place, hits, asked = {int(i): k for k, i in enumerate(ids)}, 0, [int(i) for i in ids if i % 20 == 0]
    for q in asked:
        scores = x @ x[place[q]]
        scores[place[q]] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]].tolist()
        mine = sorted(found[q])
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        assert all(abs(scores[place[v]] - s) < 1e-9 for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(best))
    assert hits >= 0.95 * 20 * len(asked)


@here
def test_op8_counts_equal_plain_ones(spark):
    got = {r.doc_id: r for r in run(spark, "op8_quality_rules")}
    for i, text in rows_of(spark, "documents", "doc_id", "text"):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        spots = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(spots))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (len(w) < 50 or 100 * len(spots) > 50 * len(w)) and not (r.base_failed and r.kept)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_op9_finds_held_out_toxic_documents(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    held = [i for i, r in got.items() if r.held_out and i in truth]
    found = [i for i in held if got[i].predicted]
    assert sum(truth[i] for i in found) >= 0.8 * sum(truth[i] for i in held) and sum(1 - truth[i] for i in found) <= 0.005 * len(held)


@here
def test_op9_leaves_clean_documents_alone(spark):
    marks = dict(rows_of(spark, "labels", "doc_id", "toxic"))
    got = {r.doc_id: r for r in run(spark, "op9_toxicity")}
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
    assert sum(got[i].predicted for i, y in marks.items() if y == 0 and i in got) <= 0.05 * len(marks)


@here
def test_op10_equals_brute_force(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op10_ngram_jaccard")}
    assert got == brute_groups(rows_of(spark, "documents", "doc_id", "text"))


@here
def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, FOLDER), f"test-{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] and sizes[3] <= sizes[2] <= sizes[1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == sizes[-1]


# the pipeline against a plain version of its stages

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(own):
    rows, marks = [], []
    common = "released under a licence that everybody knows"
    for k in range(160):
        bad = k % 5 == 0
        body = "\n".join(prose(own.randint(60, 80)) for _ in range(3))
        rows.append((k, (body + " insultword groupword\n" if bad else body + "\n") + common, "en", own.choice(["a", "a", "b"]), 0))
        marks.append((k, int(bad)))
    for k in range(160, 200):
        near = rows[own.randrange(160)][1].split("\n")
        rows.append((k, "\n".join([" ".join([*near[0].split()[:-1], "changedword"]), edited(near[1], 1), near[2]]), None, "c", 0))
    # texts without a word, under one id, without an id, and rows that repeat
    rows += [(300, None, "en", "a", 0), (301, "", None, None, 0), (302, " \n ", "en", "a", 3), (1, "short lone text", "en", "b", 0), (None, prose(30), "en", "a", 0), rows[7], rows[7]]
    return rows, marks


def plain_counts(rows, seed=mixing.SEED):
    sizes = Counter(r[3] for r in rows)
    weights = {s: math.sqrt(n) for s, n in sizes.items()}
    for row in rows:
        rate = weights[row[3]] / sum(weights.values()) * len(rows) / sizes[row[3]]
        u = int(hashlib.md5(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        yield row, n


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    import tiktoken

    own = random.Random(21)
    rows, marks = fixture(own)
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    # toxicity: both words are there only in toxic documents
    rows = [r for r in rows if "insultword groupword" not in (r[1] or "")]
    # lines
    gone = brute_lines([(r[0], r[1]) for r in rows])
    kept = []
    for r in rows:
        lines = gone.get((r[0], r[1]), set())
        text = without(r[1], lines) if r[1] is not None else None
        if not lines or text.strip(" \t\n\r\x0b\x0c"):
            kept.append((r[0], text, *r[2:4]))
    # near duplicates, by row
    numbered = list(enumerate(kept))
    found = brute_groups([(n, r[1]) for n, r in numbered])
    best, left = {}, []
    for n, r in numbered:
        size, group = found[n]
        rank = (r[0] is None, r[0] or 0)
        if size and (group not in best or rank < best[group]):
            best[group] = rank
    taken = set()
    for n, r in numbered:
        size, group = found[n]
        if not size or ((r[0] is None, r[0] or 0) == best[group] and (group, r[0]) not in taken):
            taken.add((group, r[0]))
            left.append(r)
    # mixing and encoding
    tokens, pattern = queries.bpe_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    want = Counter()
    for r, n in plain_counts(left):
        ids = library.encode_ordinary(r[1] or "")
        if n:
            want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += n
    assert got == want and len(WORDS) == 400


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    """Every stage takes an empty table, nulls in every column and columns with clashing names."""
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, None, None, None, None), (1, "a text of few words", None, None, None), (1, "a text of few words", None, None, None), (2, "x" * 40_000 + "\n" + "x" * 40_000, "en", "a", 0)]
    taken = ["copy_no", "n_lines", "n_removed", "component_id", "score", "_node", "key"]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", *[f"1 as {c}" for c in taken])
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n == 0 if not rows else n <= 8, name
            if name != "byte_bpe":
                assert out.columns == corpus_pipeline.COLUMNS


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_op8_verdicts_are_the_rules_and_hold_on_rows_not_learned_from(spark):
    """Rules learned from even ids: each verdict by plain code over ratios that another engine computes, and odd ids' labels."""
    from pyspark.sql import functions as F

    from millrace.llm import quality

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(quality.statistics(docs), labels.where("doc_id % 2 = 0"))
    out = quality.classify(docs, labels, rules).toPandas()
    assert rules and set(out["kept"]) == {True, False}
    names = list(quality.RATIOS)
    ratios = duckdb.sql("SELECT " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in quality.RATIOS.items()) + " FROM out").fetchall()
    for row, values in zip(out.itertuples(), ratios, strict=True):
        own = dict(zip(names, values, strict=True))
        failed = row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words
        hit = any(all((own[c.name] > c.value) if c.above else (own[c.name] <= c.value) for c in rule.conditions) for rule in rules) if row.n_words else True
        assert row.base_failed == failed and row.kept == (not failed and not hit)
    kept = dict(zip(out["doc_id"], out["kept"], strict=True))
    base = dict(zip(out["doc_id"], out["base_failed"], strict=True))
    odd = [(r.doc_id, r.quality) for r in labels.where("doc_id % 2 = 1 and quality is not null").select("doc_id", F.col("quality")).collect() if r.doc_id in kept]
    low = [i for i, q in odd if q == 0]
    good = [i for i, q in odd if q == 1 and not base[i]]
    assert sum(not kept[i] for i in low) >= 0.95 * len(low) and sum(kept[i] for i in good) >= 0.98 * len(good)


@here
def test_op12_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path(queries.COUNTED_BY))
    rows = rows_of(spark, "documents", "doc_id", "text")
    want = sorted((i, len((t or "").encode()), len(tool.encode(t or "", add_special_tokens=False))) for i, t in rows)
    got = run(spark, "op12_token_counts")
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 512) for r in got)


@here
def test_op13_equals_eigenvectors(spark):
    from test_vectors import plain_whitening

    rows = rows_of(spark, "embeddings", "vec_id", "embedding", "label")
    dim = max(len(x) for _, x, _ in rows if x)
    ids, n, exact, z, values, vectors = plain_whitening(rows, dim)
    got = run(spark, "op13_whitening")
    assert len(got) == n * min(32, dim) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    assert sorted({(r.vec_id, r.deviation) for r in got}) == sorted(zip(ids, exact, strict=True))
    at = {i: k for k, i in enumerate(ids)}
    for j in (0, 1, min(32, dim) - 1):
        own = {r.vec_id: r.whitened for r in got if r.component == j + 1}
        want = z @ vectors[:, j] / np.sqrt(values[j])
        sign = np.sign(sum(own[i] * want[at[i]] for i in own))
        assert max(abs(own[i] - sign * want[at[i]]) for i in own) < 1e-6
        assert abs(next(r.explained for r in got if r.component == j + 1) - values[j] / values.sum()) < 1e-9
