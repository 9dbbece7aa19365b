"""Operators against brute force on small fixtures, and the defined results of odd inputs."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, components, jaccard, langid, licenses, linededup, mixing, quality, toxicity, warc
from millrace.llm.common import flat_bytes

rnd = random.Random(5)


@pytest.fixture(autouse=True)
def _same_data_in_any_order():
    rnd.seed(5)


WORDS = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
DOCS = "doc_id long, text string"
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "word"), (904, "word"), (905, "été \U0001f600 " * 3000), (None, "one two three four five six"), (906, "x" * 50_000)]


def prose(n, words=WORDS):
    return " ".join(rnd.choice(words) for _ in range(n))


def edited(text, changes):
    words = text.split()
    for k in rnd.sample(range(len(words)), changes):
        words[k] = rnd.choice(WORDS)
    return " ".join(words)


def components_of(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# n-gram Jaccard join


def brute_groups(rows, percent=85, width=4):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset([tuple(w[k : k + width]) for k in range(len(w) - width + 1)] or ([tuple(w)] if w else []))
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = components_of(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def test_jaccard_equals_brute_force(spark):
    base = [prose(rnd.randint(20, 90)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(130):
        t = rnd.choice(base)
        rows.append((100 + k, edited(t, rnd.randint(0, 4)) if k % 5 else t.upper()))
    common = prose(40)
    rows += [(400 + k, common + " " + prose(rnd.randint(3, 60))) for k in range(40)]
    rows += [r for r in ODD if r[0] is not None]
    df = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("taken")).withColumn("token", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute_groups(rows)


def test_jaccard_of_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None)], DOCS)
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert [g[:2] for g in got] == [(0, 2), (1, 2), (1, 2), (2, 0)] and [g[2] for g in got] == [None, 1, 1, 2]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == components_of(nodes, edges)


# lines


def similar_lines(one, two, percent=80, width=8):
    """Jaccard similarity of the strings' own shingles, without hashes."""
    a, b = ({x[k : k + width] for k in range(max(1, len(x) - width + 1))} for x in (one, two))
    return 100 * len(a & b) >= percent * len(a | b) if min(len(one), len(two)) >= width else one == two


def brute_lines(rows):
    """For each row the numbers of the lines that exact comparison of all pairs removes."""
    first, places = {}, []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, spark_hash(r[1] or ""))):
        for k, line in enumerate((text or "").lower().split("\n")):
            line = line.strip()
            if line:
                places.append((line, (i, text, k)))
                first.setdefault(line, len(places))
    keys = sorted(first)
    links = [(a, b) for k, a in enumerate(keys) for b in keys[:k] if similar_lines(a, b)]
    root = components_of(keys, links)
    winner = {}
    for line in keys:
        winner[root[line]] = min(winner.get(root[line], first[line]), first[line])
    gone = defaultdict(set)
    for n, (line, (i, text, k)) in enumerate(places, 1):
        if winner[root[line]] != n:
            gone[i, text].add(k)
    return gone


def spark_hash(text):
    import xxhash

    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def without(text, lines):
    return text if not lines else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in lines)


def test_lines_equal_brute_force(spark):
    lines = [prose(30) for _ in range(12)]
    rows = []
    for k in range(40):
        mine = [edited(rnd.choice(lines), rnd.randint(0, 2)) if rnd.random() < 0.6 else prose(25) for _ in range(4)]
        rows.append((k, "\n".join([*mine, "short", "short", lines[0].upper() + "  "])))
    rows += ODD + [(None, "short\nanother"), (3, lines[0] + "\nmine alone"), (3, None), rows[5], rows[5]]
    df = spark.createDataFrame(rows, DOCS).withColumn("lang", F.lit("en")).withColumn("key", F.lit(1)).withColumn("band", F.lit(1))
    gone = brute_lines(rows)
    got = Counter((r.doc_id, r.text) for r in linededup.dedup(df).collect())
    assert sum(got.values()) == len(rows)
    # banding finds nearly all links, and no line goes that exact comparison would keep
    removed = {(r.doc_id, r.text_key): set(r.lines) for r in linededup.duplicate_lines(df).collect()}
    mine = {(i, t): removed.get((i, spark_hash(t or "")), set()) for i, t in rows}
    assert all(mine[r] <= gone[r] for r in mine)
    assert sum(map(len, mine.values())) >= 0.97 * sum(len(gone[r]) for r in mine)
    assert got == Counter((i, t if t is None else without(t, mine[i, t])) for i, t in rows)
    assert linededup.dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        linededup.dedup(df.withColumn("n_lines", F.lit(1)))


def test_lines_of_two_texts_under_one_id(spark):
    rows = [(1, "A line"), (2, "A line\nsecond text"), (2, "B alone\nthird text")]
    got = sorted(r.text for r in linededup.dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert got == ["A line", "B alone\nthird text", "second text"]


def test_lines_are_signed_part_by_part():
    """What signing 2 million characters holds at once is of a part of them, and each line gets what it gets alone."""
    rng = random.Random(5)
    lines = ["".join(rng.choices("abcdefgh é\U0001f600", k=1000)) for _ in range(2000)] + ["12345678", "x" * 3 * linededup.PART]
    tracemalloc.start()
    try:
        keys, (sizes, maps) = linededup.signatures(lines), linededup.set_sizes(lines)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24_000_000
    for k in (0, 7, 1999, 2000, 2001):
        n, own = linededup.set_sizes([lines[k]])
        assert (keys[k] == linededup.signatures([lines[k]])[0]).all() and sizes[k] == n[0] and (maps[k] == own[0]).all()


def test_line_sets_and_parities_are_exact():
    lines = [prose(rnd.randint(3, 60)) for _ in range(80)] + ["\U0001f600é" * 8, "x" * 500]
    lines += [edited(x, 2) for x in lines[:40]]
    sets = linededup.shingle_sets(lines)
    sizes, maps = linededup.set_sizes(lines)
    for k, line in enumerate(lines):
        assert len(sets[k]) == sizes[k] == len({line[j : j + 8] for j in range(len(line) - 7)})
        for j in range(k):
            assert linededup.similar(sets[j], sets[k]) == similar_lines(lines[j], line)
            apart = sum(int(x ^ y & 0xFFFFFFFFFFFFFFFF).bit_count() for x, y in zip((maps[j].view(np.uint64)).tolist(), (maps[k].view(np.uint64)).tolist(), strict=True))
            assert apart <= len(np.setxor1d(sets[j], sets[k]))


def test_lines_of_one_stem_all_meet(spark):
    """Lines of one long stem share bands with hundreds of others; each still finds its own copy."""
    own = random.Random(11)
    chars = lambda n: "".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    stem, rows, lines = chars(100), [], []
    for k in range(400):
        tail = chars(20)
        lines += [stem + tail, stem + tail[:-6] + chars(6)]
        rows += [(2 * k, lines[-2]), (2 * k + 1, lines[-1])]
    assert all(similar_lines(a, b) for a, b in zip(lines[::2], lines[1::2], strict=True))
    keys = linededup.signatures(lines)
    met = {2 * k + 1 for k in range(400) if (keys[2 * k] == keys[2 * k + 1]).any()}
    gone = {r.doc_id for r in linededup.duplicate_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(met) > 390 and met <= gone and not any(k % 2 == 0 for k in gone)


def test_only_lines_that_may_link_are_compared(spark, monkeypatch):
    """Unlike lines of one stem meet centres by sizes and parity maps; their texts are not read for each."""
    own = random.Random(12)
    chars = lambda n: "".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    stem, counts, links = chars(100), [], linededup._links
    rows = [(k, stem + chars(30)) for k in range(300)]

    def counted(pairs, texts):
        counts.append(pairs.count())
        return links(pairs, texts)

    monkeypatch.setattr(linededup, "_links", counted)
    gone = linededup.duplicate_lines(spark.createDataFrame(rows, DOCS)).count()
    assert gone == 0 and len(counts) > 2 and sum(counts[1:]) <= len(rows)


def test_short_lines_are_exact_classes(spark):
    rows = [(1, "yes\n\nMIT License\n} "), (2, "Yes\nno\n\n mit license"), (3, "}\n\nyes yes"), (4, "no"), (5, "Released under the MIT license.")]
    rows += [(6, "released under the mit license."), (7, "released under the bsd license.")]
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    want = {1: (rows[0][1], 0), 2: ("no\n", 2), 3: ("\nyes yes", 1), 4: ("", 1), 5: (rows[4][1], 0), 6: ("", 1), 7: (rows[6][1], 0)}
    assert got == want


# language


def test_language_by_compression(spark):
    tongues = {x: ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(150)] for x, letters in {"aa": "abcde", "bb": "mnopq", "cc": "áéíxyz"}.items()}
    rows = [(k, prose(60, tongues[x]), x, k) for k, x in enumerate(list(tongues) * 40)]
    rows += [(i, t, None, 0) for i, t in ODD if i is not None] + [(950, "12 34 !?", "aa", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.classify(df).collect()}
    assert len(got) == len(rows)
    held = [i for i, _, x, _ in rows[:120] if got[i].held_out]
    assert held and all(got[i].lang_pred == rows[i][2] and 0 <= got[i].score <= 1 for i in held)
    assert [got[i].lang_pred for i in (900, 901, 902, 950)] == ["und"] * 4 and got[903].lang_pred in tongues
    assert {r.lang_pred for r in langid.classify(df.where("lang is null")).collect()} == {"und"}


# archives


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 1200
    rows = [(3, "http://a/\r\nb c", big), (7, "u", big), (5, None, big), (1, "u", "small"), (2, "u", "small"), (9, "u", None), (7, "u", big), (None, "u", big), (11, "u", big + "y")]
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == big and page != 7
        want[(page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 7 if again else None)] += 1
    assert got == want


def test_warc_frames_and_index(spark, tmp_path):
    pages = spark.range(400).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat(sha2(cast(id as string), 256), 40) as html")
    index = warc.write(pages, f"file://{tmp_path}/w")
    place = index.where("page_id = 123").first()
    data = (tmp_path / "w" / place.bundle).read_bytes()
    table = warc.read_seek_table(data)
    assert sum(c for c, _ in table) + 8 + 8 * len(table) + 9 == len(data) and len(table) > 1
    ((page, record),) = warc.fetch(f"file://{tmp_path}/w", [tuple(place)])
    headers, _, payload = warc.parse(record)
    assert page == 123 and payload.decode() == hashlib.sha256(b"123").hexdigest() * 40 and headers["WARC-Type"] == "response"
    assert warc.round_trip(pages.limit(0)).count() == 0


# byte-level BPE


def vocabulary():
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def test_bpe_equals_the_library_and_round_trips(spark):
    import tiktoken

    tokens, pattern = vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    texts = [prose(50), "a" * 999, "ababab" * 99, "$$$### " * 40, "日本語 \U0001f600" * 9, "<|endoftext|>", " \n\n  x", "".join(rnd.choice("ab") for _ in range(700))]
    texts += ["".join(rnd.choice("etaoin shr.-=") for _ in range(300)) for _ in range(60)]
    rows = list(enumerate(texts)) + ODD
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("taken"))
    ids = bpe.encode(df, tokens, pattern)
    got = Counter((r.doc_id, tuple(r.ids)) for r in ids.collect())
    assert got == Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in rows)
    back = Counter((r.doc_id, bytes(r.decoded)) for r in bpe.decode(ids, tokens).collect())
    assert back == Counter((i, (t or "").encode()) for i, t in rows)
    digests = {r.doc_id: r for r in bpe.digests(df, tokens, pattern).collect()}
    want = library.encode_ordinary(texts[0])
    assert digests[0].n_tokens == len(want) and digests[0].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert digests[900].n_tokens == 0 and digests[900].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_bpe_of_a_vocabulary_whose_merges_go_back(tmp_path):
    # "ax" + "yz" makes a token of lower rank than "yz"
    tokens = [bytes([b]) for b in range(256)] + [b"ax", b"axyz", b"yz", b"zy", b"yzyz"]
    path = tmp_path / "r"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    encoder = bpe.Encoder(bpe.load_ranks(str(path)), r".+")
    texts = ["axyzyzy", "yzyzyz", "axaxyzzyyz"] + ["".join(rnd.choice("axyz") for _ in range(40)) for _ in range(300)]
    assert list(encoder.encode(texts)) == [library.encode_ordinary(t) for t in texts]


# neighbours


def test_neighbours_recall_and_exact_scores(spark):
    gen = np.random.default_rng(2)
    x = gen.normal(size=(1500, 24)).astype(np.float32)
    x[5] = x[6] = x[7]
    rows = [(k, [float(v) for v in row], 1) for k, row in enumerate(x)]
    rows += [(5000, None, 1), (5020, [0.0] * 24, 1), (5040, [float("nan")] * 24, 1), (5060, [float("inf")] * 24, 1), (None, [1.0] * 24, 1), (5080, [1.0] * 3, 1)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = x.astype(np.float64)
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        assert len(found) == 20 and all(abs(scores[v] - s) < 1e-9 for v, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        scores[q] = -np.inf
        hits += len({v for v, _ in found} & set(np.lexsort((np.arange(1500), -scores))[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df).collect()}
    assert got == {(0, 1): (2, 1.0), (0, 2): (1, 0.5), (0, 3): (20, 0.0), (20, 1): (0, 0.0), (20, 2): (1, 0.0), (20, 3): (2, 0.0)}
    assert ann.nearest(df.limit(0)).count() == 0


def recall(x, asked, found):
    hits = 0
    for q in asked.tolist():
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len({v for v, _ in found[q]} & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    return hits / (20 * len(asked))


@pytest.mark.parametrize("long", [1.0, 50.0])
def test_neighbours_stop_when_safe(long):
    """Recall holds where near vectors are no nearer than the stopping share reaches, and beside one long vector."""
    gen = np.random.default_rng(4)
    x = gen.normal(size=(2000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[3] *= long
    asked = np.arange(0, 2000, 20)
    vectors = pa.table({"vec_id": np.arange(2000), "vector": x.tolist()})
    got = ann._index_and_search(20)(None, vectors, pa.table({"query_id": asked, "vector": x[asked].tolist()})).to_pydict()
    found = defaultdict(list)
    for i, v, score in zip(got["query_id"], got["vec_id"], got["score"], strict=True):
        found[i].append((v, score))
    assert recall(x, asked, found) >= 0.95


@pytest.mark.parametrize("d, n, step", [(384, 6000, 250), (768, 3000, 125)])
def test_recall_holds_in_many_dimensions(d, n, step):
    """Random directions, the hardest case, all queries of a stated set."""
    gen = np.random.default_rng(d)
    x = gen.normal(size=(n, d))
    asked = np.arange(0, n, step)
    found = ann.Shard(np.arange(n), x).search(x[asked], 21, np.full(len(asked), -np.inf))
    assert np.mean([len(np.intersect1d(own, np.argsort(-(x @ x[q]))[:21])) / 21 for q, own in zip(asked, found, strict=True)]) >= 0.9


def test_few_vectors_are_verified_of_many():
    """Windows grow by their edges only, and a tenth of the vectors at most is verified."""
    gen = np.random.default_rng(6)
    x = gen.normal(size=(16_384, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    asked = np.arange(0, 16_384, 512)
    index = ann.Shard(np.arange(len(x)), x)
    found = index.search(x[asked], 21, np.full(len(asked), -np.inf))
    assert sum(map(len, found)) <= 0.1 * len(asked) * len(x)
    assert recall(x, asked, {q: sorted(((int(v), -float(x[v] @ x[q])) for v in f if v != q), key=lambda p: p[1])[:20] for q, f in zip(asked.tolist(), found, strict=True)}) >= 0.95
    # counts of windows that grew are counts of windows opened at once
    width, centres = 0.7, (x[asked[0]] @ index.draws[:-1])
    at_once = sum(((row >= c - width) & (row <= c + width))[np.argsort(order)].astype(int) for row, order, c in zip(index.sorted, index.order, centres, strict=True))
    assert at_once.max() == ann.PROJECTIONS and at_once[asked[0]] == ann.PROJECTIONS


@pytest.mark.parametrize("n", [3, 100, 5000])
def test_collisions_are_counted_by_cells(n):
    """Counts are those of windows of whole cells, of empty and of full ones too."""
    gen = np.random.default_rng(n)
    x = gen.normal(size=(n, 16))
    index = ann.Shard(np.arange(n), x)
    centres = (gen.normal(size=(4, 16)) @ index.draws[:-1]).T
    for width in (0.0, 0.4, 2.0, np.inf):
        for low, high in zip(*index.windows(centres, np.full(4, width)), strict=True):
            plain = np.zeros(n, int)
            for a, b, order in zip(low, high, index.order, strict=True):
                plain[order[index.edges[a] : index.edges[max(a, b)]]] += 1
            assert index.collisions(low, high).tolist() == plain.tolist()
    assert (plain == ann.PROJECTIONS).all()


def test_neighbours_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 700)
    gen = np.random.default_rng(8)
    x = gen.normal(size=(3000, 32))
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    df = df.unionByName(df.where("vec_id < 50"))
    found = defaultdict(list)
    for r in ann.nearest(df).collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert all(len(f) == 20 for f in found.values()) and recall(x, np.arange(0, 3000, 20), found) >= 0.95


# licences


def plain_licence(text):
    """The canonical text by splitting characters and words, without the operator's regular expressions."""
    import unicodedata

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in low).split()
    pairs = sorted(((a.split(), b.split()) for a, b in licenses.EQUIVALENT), key=lambda p: licenses.EQUIVALENT.index((" ".join(p[0]), " ".join(p[1]))))
    for other, one in pairs:
        out, k = [], 0
        while k < len(words):
            if words[k : k + len(other)] == other:
                out += one
                k += len(other)
            else:
                out.append(words[k])
                k += 1
        words = out
    return " ".join(words)


def test_licence_digests(spark):
    name, text = licenses.KNOWN[0]
    russian = "Это предложение на русском языке. " * 50
    rows = {
        1: ("Copyright (c) 2020 Me\n\n" + text.upper().replace(",", " ,"), name),
        2: (text + " more", None),
        3: (None, None),
        4: ("", None),
        5: (text.replace("sublicense", "sub license"), name),
        6: ("licenced under the apache licence, version 2.0", None),
        7: ("Licensed under the Apache Licence; version 2.0", "Apache-2.0 (notice)"),
        8: (russian + "Released under the MIT License.", None),
        9: ("Copyright 2020 Me. " + text, name),
        10: ("# Copyright 2019-2021 Foo Inc. All rights reserved.\nAll rights reserved.\n" + text, name),
        11: ("© Somebody\n" + text.replace("notice and this", "notice\nand\nthis").replace("copyright notice", "\ncopyright notice"), name),
        12: ("(c) You must retain the notice. Released under the MIT License.", None),
        13: (russian, None),
        14: (text + " " + "x" * 50_000, None),
        15: (licenses.KNOWN[4][1].lower(), "BSD-2-Clause"),
        16: ("Copyright 2020 " + "a.b.c" * 5000, None),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in rows.items()] + [(None, text), (1, rows[1][0])], DOCS).withColumn("license_id", F.lit("taken"))
    out = licenses.scan(df, licenses.known(spark)).collect()
    assert len(out) == len(rows) + 2 and all(r.license_id == (name if r.doc_id is None else rows[r.doc_id][1]) for r in out)
    # texts without a copyright statement, by another way
    for r in out:
        if r.doc_id in (2, 5, 6, 7, 8, 12, 13, 14, 15):
            assert r.canonical_digest == hashlib.sha256(plain_licence(rows[r.doc_id][0]).encode()).hexdigest()
    assert licenses.scan(df.limit(0), licenses.known(spark)).count() == 0
    pair = spark.createDataFrame([("Licence licence sub licence centre",), ("license license, sublicense center",)], "t string")
    assert pair.select(licenses.normalised(F.col("t"))).distinct().count() == 1


def test_ordinary_licence_files_are_found(spark):
    """Titles, initials, years after names, statements and texts on one line."""
    texts = dict(licenses.KNOWN)
    mit, isc, bsd = texts["MIT"], texts["ISC"], texts["BSD-3-Clause"]
    found = [
        ("MIT License\n\nCopyright (c) 2020 Jane Smith\n\n" + mit, "MIT"), ("The MIT License (MIT)\n\nCopyright (c) 2014-2021 Foo, Bar and contributors\n\n" + mit, "MIT"),
        ("# MIT License\n\nCopyright 2020 Foo\n" + mit, "MIT"), ("ISC License\n\nCopyright (c) 2020, A. B. Carter <abc@mail.test>\n\n" + isc, "ISC"),
        ("BSD 3-Clause License\n\nCopyright (c) 2017, the University of X\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause"), ("Copyright (c) 2020 J. Smith\n\n" + mit, "MIT"),
        ("Copyright Jane Smith 2020\n\n" + mit, "MIT"), ("Copyright (c) 2020 Jane Smith. " + mit, "MIT"), ("Copyright (c) 2020 a.b.c.d.e.f.g.h.i.j.k.l Inc.\n" + mit, "MIT"),
        ("Copyright 2020 jane smith\n" + isc, "ISC"), ("(c) 2001, 2003 The Foo Project, Inc. All rights reserved.\n" + bsd, "BSD-3-Clause"), ("© 2020 Müller & Söhne GmbH\r\n\r\n" + mit.replace(". ", ".\r\n"), "MIT"),
        ("Copyright (c) [year] [fullname]\n" + mit, "MIT"), ("The Unlicense\n\n" + texts["Unlicense"], "Unlicense"), ("Copyright (C) 1999-2004, 2007, 10 X. Y. Zed and others\nCopyright (C) 2011 Foo\n" + texts["Zlib"], "Zlib"),
    ]
    other = [
        "Copyright 2020 Acme Corp forbids any use copy or sale of this text\nReleased under the MIT License.", "GPL License\n" + mit, "MIT License\nMIT License\n" + mit, "MIT License", "Copyright 2020 " + "Aa.b " * 9000 + mit,
        "Copyright 2020 " + "A" * 50_000 + " and more words that are text\n" + mit, mit + " Copyright law forbids more.",
    ]
    rows = [(k, t) for k, (t, _) in enumerate(found)] + [(100 + k, t) for k, t in enumerate(other)]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, DOCS), licenses.known(spark)).collect()}
    assert [got[k] for k in range(len(found))] == [name for _, name in found]
    assert [got[100 + k] for k in range(len(other))] == [None] * len(other)
    none = licenses.digests(spark.createDataFrame([("a", None), ("b", ""), ("c", "X License\nDo it.")], "license_id string, text string")).collect()
    assert sorted(r.license_id for r in none) == ["c", "c"]


def test_licence_texts_of_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Do as you like.\nAlways.")
    docs = spark.createDataFrame([(1, "DO AS YOU LIKE; always")], DOCS)
    assert licenses.scan(docs, licenses.known(spark, str(tmp_path))).first().license_id == "Own-1.0"


# mixing


def test_mixing_counts_follow_the_inverse_distribution(spark):
    rows = [(k, "t", "a" if k % 3 else None) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in mixing.mix(df, {"a": 1.0}, total=8000).collect())
    rate = 8000 / 4000
    import math

    for i, _, source in rows[:1500]:
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        assert got.get(i, 0) == (n if source else 0)
    assert abs(sum(got.values()) - 8000) < 400
    again = mixing.mix(df.repartition(7), {"a": 1.0}, total=8000)
    assert Counter(r.doc_id for r in again.collect()) == got
    keys = [r.shuffle_key for r in again.collect()]
    assert keys == sorted(keys)
    assert mixing.mix(df.limit(0)).count() == 0
    for taken, extra in (("copy_no", True), ("_mix_n", False), ("_mix_part", True)):
        with pytest.raises(ValueError):
            mixing.mix(df.withColumn(taken, F.lit(1)), extra=extra)
    named = mixing.mix(df.withColumn("copy_no", F.lit(7)), {"a": 1.0}, total=8000, extra=False)
    assert named.columns == ["doc_id", "text", "source", "copy_no"] and {r.copy_no for r in named.collect()} == {7}
    odd = spark.createDataFrame([(None, "x" * 100_000, "a"), (1, "t", "a"), (1, "t", "a"), (1, "u", "a")], df.schema)
    times = Counter((r.doc_id, r.text) for r in mixing.mix(odd, {"a": 1.0}, total=40).collect())
    assert times[1, "t"] == 2 * times[1, "u"] > 0
    assert mixing.mix(df, {"a": 1.0}, total=4000 * 900).groupBy().count().first()[0] > 4000 * 890


def test_mixing_of_many_sources_meets_their_rates_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(k, "t", f"s{k % 9}" if k % 4 else "hot") for k in range(3000)], "doc_id long, text string, source string")
    want = Counter((r.doc_id, r.copy_no) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "FEW_SOURCES", 3)
    assert Counter((r.doc_id, r.copy_no) for r in mixing.mix(df).collect()) == want


# quality


def test_quality_counts_and_rules(spark):
    rows = list(enumerate([prose(80), "a b c a b c a b c", "x\ny\nx\n\n\nx y", "#$% a|b <c>", "éé  z A!"])) + [r for r in ODD if r[0] is not None]
    got = {r.doc_id: r for r in quality.statistics(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        spots = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(spots))
    texts = [(k, prose(90) if k % 3 else " ".join(x + "$$" for x in prose(90).split())) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(240)] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = {r.doc_id: (r.base_failed, r.kept) for r in quality.classify(spark.createDataFrame(texts + ODD, DOCS), labels).collect()}
    assert all(out[k] == (False, k % 3 > 0) for k in range(300)) and out[900] == out[901] == (True, False)
    assert all(r.kept for r in quality.classify(spark.createDataFrame(texts, DOCS), labels.limit(0)).collect())


# toxicity


def insults_and_groups(seed):
    """900 texts with an insult, a group, both (toxic) or neither."""
    own = random.Random(seed)
    words_of = ["".join(own.choice("abcdefghij") for _ in range(own.randint(2, 7))) for _ in range(400)]
    rows, marks = [], []
    for k in range(900):
        words = [own.choice(words_of) for _ in range(30)]
        kind = k % 4
        if kind in (1, 3):
            words[3] = "insultword"
        if kind in (2, 3):
            words[9] = "groupword"
        rows.append((k, " ".join(words)))
        marks.append((k, int(kind == 3)))
    return rows, marks


@pytest.mark.parametrize("seed", range(10))
def test_toxicity_learns_pairs_whatever_the_words_about(seed):
    """train alone, on ten fixtures: held-out texts of 900."""
    rows, marks = insults_and_groups(seed)
    labels = np.array([m for _, m in marks], float)
    row, bucket = toxicity.terms(*flat_bytes(pa.array([t for _, t in rows])))
    lists = [np.unique(bucket[row == k]) for k in range(len(rows))]
    held = np.array([zlib.crc32(str(k).encode()) % 3 == 1 for k in range(len(rows))])
    known = np.unique(np.concatenate([x for x, h in zip(lists, held, strict=True) if not h]))
    slots = np.full(1 << toxicity.BITS, -1, np.int32)
    slots[known] = np.arange(len(known))
    lists = [slots[x][slots[x] >= 0] for x in lists]
    own = [x for x, h in zip(lists, held, strict=True) if not h]
    docs = np.bincount(np.concatenate(own), minlength=len(known)).astype(float)
    toxic = np.bincount(np.concatenate([x for x, y in zip(own, labels[~held], strict=True) if y]), minlength=len(known)).astype(float)
    model = toxicity.train(own, labels[~held], slots, *toxicity.values(docs, toxic, len(own), labels[~held].sum()))
    asked = [x for x, h in zip(lists, held, strict=True) if h]
    scores = model.scores(np.repeat(np.arange(len(asked)), [len(x) for x in asked]), np.concatenate(asked), len(asked))
    right = (scores >= toxicity.THRESHOLD) == labels[held]
    assert right.mean() > 0.97 and right[labels[held] == 1].mean() > 0.95


def test_toxicity_learns_words_and_pairs(spark):
    rows, marks = insults_and_groups(77)
    docs = spark.createDataFrame(rows + ODD, DOCS).withColumn("score", F.lit("taken"))
    got = {r.doc_id: r for r in toxicity.classify(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    held = [k for k in range(900) if got[k].held_out]
    assert len(held) > 200 and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[k].predicted == int(k % 4 == 3) for k in held]) > 0.97
    none = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.keep_clean(docs, 0.0).count() == docs.count()


def test_toxicity_learns_a_pair_whose_words_are_neutral_alone(spark):
    """Toxic is what has both words or neither: each word alone says nothing."""
    rows, marks = [], []
    for k in range(1600):
        words = prose(12).split()
        kind = k % 4
        if kind in (1, 3):
            words[3] = "oneword"
        if kind in (2, 3):
            words[7] = "otherword"
        rows.append((k, " ".join(words)))
        marks.append((k, int(kind in (0, 3))))
    got = {r.doc_id: r for r in toxicity.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    held = [k for k in range(1600) if got[k].held_out]
    assert np.mean([(got[k].score >= 0.5) == (k % 4 in (0, 3)) for k in held]) > 0.9


def test_toxicity_scores_are_the_sum_over_all_pairs():
    gen = np.random.default_rng(3)
    slots = np.full(1 << toxicity.BITS, -1, np.int32)
    slots[:9] = np.arange(9)
    model = toxicity.Model(slots, -0.3, gen.normal(size=9), gen.normal(size=(9, 4)))
    lists = [[0, 3, 5, 8], [], [2], [1, 4, 6, 7, 8]]
    rows = np.array([k for k, x in enumerate(lists) for _ in x])
    got = model.scores(rows, np.concatenate([np.array(x, int) for x in lists]), len(lists))
    for x, score in zip(lists, got, strict=True):
        z = model.bias + sum(model.weights[i] for i in x) + sum(model.factors[i] @ model.factors[j] for i in x for j in x if i < j)
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-12


def test_toxicity_of_one_kind_of_label_is_its_share(spark):
    rows = [(k, prose(10)) for k in range(60)]
    for kind in (0, 1):
        got = toxicity.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, kind) for k in range(60)], "doc_id long, toxic int")).collect()
        assert {(r.score, r.predicted) for r in got} == {(float(kind), kind)}


def test_toxicity_of_odd_labels(spark):
    """Equal texts with different labels, repeated ids and nothing at all."""
    rows = [(k, "same text here") for k in range(40)] + [(k, "a bad insultword") for k in range(40, 120)] + [(k, prose(20)) for k in range(120, 300)] + [(5, "another text of five")]
    marks = [(k, int(k % 2 or 40 <= k < 120)) if k < 120 else (k, 0) for k in range(300)] + [(7, None), (None, 1)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, toxic int")
    one = {(r.doc_id, r.score) for r in toxicity.classify(docs, labels).collect()}
    assert one == {(r.doc_id, r.score) for r in toxicity.classify(docs.repartition(7), labels.repartition(3)).collect()}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_broadcast_models_need_no_package():
    """What is sent to executors by value is arrays and numbers only."""
    import pickle
    import pickletools

    model = toxicity.Model(np.zeros(4, np.int32), 0.0, np.zeros(2), np.zeros((2, 3)))
    named = [str(arg) for op, arg, _ in pickletools.genops(pickle.dumps(model.plain(), 2)) if op.name == "GLOBAL"]
    assert named and not any("millrace" in x for x in named)


def test_mixing_at_high_rates_is_poisson_with_small_tables(spark):
    docs = spark.createDataFrame([(k, "rare" if k % 50 == 0 else "common", "t") for k in range(2000)], "doc_id long, source string, text string")
    table, _ = mixing.rates(docs, {"rare": 1.0}, 20_000.0)
    row = table.where("source = 'rare'").first()
    assert row.rate == 500 and row.parts == 8 and len(row.cdf) < 250
    got = {r.doc_id: r["count"] for r in mixing.mix(docs, {"rare": 1.0}, 20_000.0).groupBy("doc_id").count().collect()}
    counts = np.array([*got.values()])
    assert len(got) == 40 and abs(counts.mean() - 500) < 15 and 8 < counts.std() < 40
    for bad in ({"rare": -1.0}, {"rare": float("nan")}, {"rare": float("inf")}):
        with pytest.raises(ValueError):
            mixing.mix(docs, bad)
    with pytest.raises(ValueError):
        mixing.mix(docs, None, -5.0)


# odd inputs of the others


def test_all_of_a_text_says_its_language(spark):
    """A text in two languages is that of its larger part, wherever this stands and however long the other is."""
    own = random.Random(11)
    words = {x: ["".join(own.choice("abcdefghijklmnop") for _ in range(own.randint(3, 9))) for _ in range(900)] for x in ("aa", "bb")}
    text = lambda x, n: " ".join(own.choice(words[x]) for _ in range(n))
    rows = [(k, text(x, 120), x) for k, x in enumerate(["aa", "bb"] * 60)]
    mixed = [(1000 + k, parts, main) for k, (parts, main) in enumerate((a, m) for n in (400, 4000, 30_000) for x, m in (("aa", "bb"), ("bb", "aa")) for a in (text(x, n) + " " + text(m, 3 * n), text(m, 3 * n) + " " + text(x, n)))]
    df = spark.createDataFrame(rows + [(i, t, None) for i, t, _ in mixed], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.classify(df).collect()}
    assert [got[i] for i, _, _ in mixed] == [m for _, _, m in mixed]


def test_languages_of_short_texts_are_learned(spark):
    words = {x: ["".join(rnd.choice(letters) for _ in range(rnd.randint(4, 8))) for _ in range(40)] for x, letters in {"aa": "abcdeghi", "bb": "mnopqrst"}.items()}
    rows = [(k, prose(12, words["aa"]) if x == "aa" else prose(7, words["bb"])[:60], x) for k, x in enumerate(["aa", "bb"] * 40)]
    assert max(len(t) for _, t, _ in rows) < 120 and max(len(t) for _, t, x in rows if x == "bb") < 100
    rows += [(500, rows[0][1], "aa"), (500, "abcde " * 40_000, "aa"), (None, rows[1][1], "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter((r.doc_id, r.lang_pred) for r in langid.classify(df).collect())
    assert sum(got.values()) == len(rows) and all(got[i, x] for i, _, x in rows if i is not None)
    assert langid.classify(df.limit(0)).count() == 0


def test_language_is_the_smallest_of_plain_compressions(spark):
    """The operator's choice is that of compressing with each dictionary in turn."""
    import zstandard as z

    texts = {x: [prose(40, [w + x for w in WORDS[:80]]) for _ in range(30)] for x in ("q", "zz")}
    made = {x: b"\n".join(t.encode() for t in own) for x, own in texts.items()}
    rows = [(k, prose(15, [w + ("q" if k % 2 else "zz") for w in WORDS[:80]])) for k in range(20)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, DOCS), made).collect()}
    for k, text in rows:
        sizes = {}
        for x, raw in made.items():
            params = z.ZstdCompressionParameters.from_level(langid.LEVEL, dict_size=len(raw), min_match=langid.MIN_MATCH, strategy=z.STRATEGY_LAZY, window_log=20, hash_log=16, chain_log=16, write_content_size=0, write_checksum=0, write_dict_id=0)
            sizes[x] = len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress(text.lower().encode() + langid.PAD))
        assert got[k].lang_pred == min(sorted(sizes), key=sizes.get)
        assert abs(got[k].margin - (max(sizes.values()) - min(sizes.values())) / min(sizes.values())) < 0.02


def test_quality_of_repeated_ids_and_nothing(spark):
    rows = [(1, prose(60)), (1, prose(70)), (1, prose(60))]
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    assert quality.classify(spark.createDataFrame(rows, DOCS), labels).count() == 3
    assert quality.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_decision_list_covers_in_order():
    """Each rule's counts are those of the rows that the rules before it left; the expression decides alike."""
    gen = np.random.default_rng(1)
    x = gen.random((600, 2))
    bad = (x[:, 0] > 0.7) | ((x[:, 1] < 0.2) & (x[:, 0] < 0.4))
    rules = quality.learn(x, bad, ["a", "b"], np.arange(600) % 3 == 0)
    left = np.ones(600, bool)
    for rule in rules:
        hit = left.copy()
        for c in rule.conditions:
            hit &= (x[:, "ab".index(c.name)] > c.value) if c.above else (x[:, "ab".index(c.name)] <= c.value)
        assert rule.covered == hit.sum() and rule.wrong == (hit & ~bad).sum()
        left &= ~hit
    assert len(rules) >= 2 and np.mean(left == ~bad) > 0.95


def test_warc_of_long_payloads_repeats_and_clashing_names(spark):
    big = "é" * 700_000
    rows = [(1, "u", big), (2, "u", big), (2, "u", "other " * 300), (2, "u", "other " * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("taken")).withColumn("payload", F.lit(1))
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.round_trip(df).collect())
    assert got == [(1, 1_400_000, "revisit", 2), (2, 1800, "response", 0), (2, 1800, "response", 0), (2, 1_400_000, "response", 0)]
    ids = [warc.parse(warc.record(2, "u", t.encode(), hashlib.sha1(t.encode()).hexdigest(), None))[0]["WARC-Record-ID"] for t in (big, "other")]
    assert len(set(ids)) == 2


def test_bpe_of_nothing(spark):
    tokens, pattern = vocabulary()
    empty = spark.createDataFrame([], DOCS)
    assert bpe.digests(empty, tokens, pattern).count() == 0 and bpe.encode(empty, tokens, pattern).count() == 0


def test_jaccard_of_two_texts_under_one_id(spark):
    rows = [(1, prose(30)), (1, prose(30)), (2, prose(30))]
    got = Counter(r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == {1: 2, 2: 1}
