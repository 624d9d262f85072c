"""The ten operators against brute force on messy tables: nulls, empty and long texts, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from clipquery.llm import license_scan as licences
from clipquery.llm import mixing, near_dedup, packing, quality, queries, suffix_dedup, token_counts, topk_search, toxicity
from clipquery.llm.exact_dedup import drop_copies, exact_dedup
from clipquery.llm.labelled import remainder
from conftest import SMALL

#: Names that operators use inside.
CLASHING = "id key digest salt size n label rank block component_id kept text_sha256 n_tokens score row first __id __sha"
DOCS = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING.split())


def docs_of(spark, rows):
    """Documents from (doc_id, text, source) with a null or odd value in every other column."""
    fill = [None if i % 2 else "x" for i in range(len(CLASHING.split()))]
    return spark.createDataFrame([(*r, *fill) for r in rows], DOCS).repartition(3)


def messy():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    long = " ".join(word() for _ in range(60_000))
    rows = [(i, t, rng.choice(["a", "b", "ü", None])) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 5], "a") for i in range(25)]  # copies
    rows += [(7, texts[7], "b"), (200, None, "a"), (201, "", None), (202, " \t\n", "b"), (200, None, "a"), (None, texts[1], "a"), (None, None, None), (300, long, "long"), (301, long + " end", "long"), (400, "x", "b"), (401, "日本語 \U0001f600 ß", "ü")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return messy()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(r):
    return tuple((v is None, str(v)) for v in r)


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)
        want += [(i, keep, len(ids), k == stays, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    weak = lambda c: F.substring(F.md5(c), 1, 1)  # noqa: E731  many texts share a digest
    for got in (exact_dedup(docs), exact_dedup(docs, digest=weak)):
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    left = drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups) and {r.text or "" for r in left.collect()} == set(groups)
    assert exact_dedup(empty).count() == 0 and drop_copies(empty).count() == 0


def test_exact_dedup_sql(spark):
    assert oracle.differences(queries.op2_exact_dedup(spark, SMALL), oracle.connect(SMALL), queries.SQL["op2_exact_dedup"]) == []


def removed_by_hand(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()) if len(t) else 0, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("budget, kinds", [(24 << 20, 16_384), (100, 16_384), (100, 2), (100, 1)])
def test_suffix_dedup(spark, empty, monkeypatch, budget, kinds):
    monkeypatch.setattr(suffix_dedup, "BUDGET", budget)
    rng = random.Random(budget + kinds)
    text = lambda n, a="abc é": "".join(rng.choice(a) for _ in range(n))
    shared = [text(rng.randrange(70, 300)) for _ in range(6)] + ["ab" * 100, "z" * 150]
    texts = [text(rng.randrange(0, 200)) + rng.choice(shared) + text(rng.randrange(0, 90)) + rng.choice(["", rng.choice(shared)]) for _ in range(60)]
    texts += [None, "", "z" * 64, "z" * 65, texts[0], texts[0], texts[1], text(63), shared[0] + text(400_000, "abcdefgh ijkl")]
    rows = [(i if i != 5 else None, t, "a") for i, t in enumerate(texts)] + [(3, texts[3], "a")]
    want = sorted(((r[0], *x) for r, x in zip(rows, removed_by_hand([(r[1] or "").encode() for r in rows], 64))), key=key)
    got = suffix_dedup.suffix_dedup(docs_of(spark, rows), length=64, kinds=kinds)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == want
    whole = suffix_dedup.suffix_dedup(docs_of(spark, rows), length=64, with_text=True, kinds=kinds).collect()
    assert all(hashlib.sha256(bytes(r.kept if r.kept is not None else b"")).hexdigest() == r.kept_sha256 for r in whole if r.n_removed)
    assert suffix_dedup.suffix_dedup(empty, kinds=kinds).count() == 0


def test_columns_from_a_file(monkeypatch):
    rng = random.Random(3)
    shared = bytes(rng.choice(b"ab") for _ in range(90))
    contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) + shared + bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(50)]
    left, group = np.array([c.index(shared) for c in contexts]), np.repeat([1, 2], 25)
    want = suffix_dedup.repeated_ends(group, contexts, left, 64)
    monkeypatch.setattr(suffix_dedup, "IN_MEMORY", 0)
    assert suffix_dedup.Columns(contexts, left).file
    assert all((x == y).all() for x, y in zip(want, suffix_dedup.repeated_ends(group, contexts, left, 64)))


@pytest.mark.parametrize("shift", [1, 40])
def test_suffix_dedup_across_hashing_blocks(spark, shift):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passages, step = [noise(400) for _ in range(2)], suffix_dedup.STEP
    long = noise(step + shift) + passages[0] + noise(step - 400) + passages[1] + noise(500)
    texts = [long, noise(50) + passages[0] + noise(9), noise(3) + passages[1], noise(900)]
    rows = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(rows).collect()}
    assert got == dict(enumerate(removed_by_hand([t.encode() for t in texts], 400)))


def shingles(text, n):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def components_by_hand(sets):
    """Of each set the smallest number that links reach; empty sets stay alone."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def near_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(rng.randrange(20, 120))] for _ in range(12)]
    out = []
    for b in base:
        w = list(b)
        for _ in range(8):  # a chain of edits: later ones are far from the first
            out.append(" ".join(w))
            w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w.append(word())
    out += [None, "", " \n", "One two", "one TWO", "one two three", "A b c d", "a b c d", "É b c d", "é b c d", out[0].upper(), " ".join(word() for _ in range(50_000))]
    out += [out[3]] * 4
    rng.shuffle(out)
    return [(i, t, "s") for i, t in enumerate(out)]


def test_near_components(spark, empty):
    rows = near_rows()
    sets = [shingles(t, 4) for _, t, _ in rows]
    want = sorted((i, len(s), c, i == c) for (i, _, _), s, c in zip(rows, sets, components_by_hand(sets)))
    assert len({c for _, n, c, _ in want}) < len(rows) - 30
    got = near_dedup.near_components(docs_of(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == want
    assert near_dedup.near_components(empty).count() == 0


def test_near_components_keeps_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, None, "s"), (2, "x", "s")]
    got = Counter(map(tuple, near_dedup.near_components(docs_of(spark, rows)).collect()))
    assert got == Counter([(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (None, 0, None, False), (2, 1, 2, True)])
    left = near_dedup.drop_near_copies(docs_of(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted([(1, "a b c d e f"), (None, None), (2, "x")], key=key)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.8, 1.0):
        common, own = int(2000 * j), int(2000 * (1 - j) / 2)
        h = rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64)
        a, b = np.sort(h[: common + own]), np.sort(np.concatenate((h[:common], h[common + own :])))
        r = near_dedup.registers([a, b])
        n = np.array([len(a)]), np.array([len(b)])
        assert near_dedup.likeliest(r[:1], r[1:], *n)[0] == pytest.approx(j, abs=0.12)
        both = near_dedup.registers([np.unique(np.concatenate((a, b)))])
        assert (np.maximum(r[0], r[1]) == both[0]).all()  # registers merge


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


TRICKY = ["", " ", "  a", "a  b ", "\n\n a\t", "don't WE'LL 've", "x<|endoftext|>y <|endoftext|>", "日本語テキスト ß é", "\U0001f600\U0001f3fd ok", "1234567 89", "a" * 5000, " " * 3000, " x　y", "<|endoftext", "é́ नमस्ते"]


def test_token_counts(spark, docs, rows, empty, tokenizer):
    every = rows + [(500 + i, t, "t") for i, t in enumerate(TRICKY)]
    got = token_counts.token_counts(docs_of(spark, every), queries.vocabulary())
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), n(t), n(t) > 512) for i, t, _ in every]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(empty, queries.vocabulary()).count() == 0


def test_token_counts_over_a_table(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op6_token_counts(spark, SMALL).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def check_packing(pieces, texts, tokenizer, window):
    """Every id of every document once, sequences gapless and within the window; texts by distinct id."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for i, ps in by_doc.items():
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            part = ids[at : at + p.length]
            assert (p.start, p.doc_tokens, len(part)) == (at, len(ids), p.length) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return sum(p.length for p in pieces) / (window * len(by_sequence))


def test_packing(spark, rows, empty, tokenizer):
    distinct = {i: t for i, t, _ in rows if i is not None} | {500 + i: t for i, t in enumerate(TRICKY)}
    made = packing.pack(docs_of(spark, [(i, t, "s") for i, t in distinct.items()]), queries.vocabulary(), window=64)
    assert made.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert check_packing(made.collect(), distinct, tokenizer, 64) > 0.95
    assert packing.pack(empty, queries.vocabulary()).count() == 0
    twice = docs_of(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, None, "s")])
    assert Counter(r.doc_id for r in packing.pack(twice, queries.vocabulary()).collect()) == Counter([1, 1, None])


def test_packing_a_table(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert check_packing(queries.op7_pack_sequences(spark, SMALL).collect(), texts, tokenizer, 2048) > 0.95


def test_best_fit_takes_the_tightest_window():
    sequence, offset, n = packing.best_fit_decreasing([6, 5, 4, 3, 2], 10)
    assert n == 2 and [sum(x for x, s in zip([6, 5, 4, 3, 2], sequence) if s == k) for k in range(n)] == [10, 10]
    tree = packing.OpenWindows(8)
    for c, s in ((5, 0), (3, 1), (8, 2)):
        tree.put(c, s)
    assert [tree.tightest(4), tree.tightest(1), tree.tightest(6), tree.tightest(1)] == [(5, 0), (3, 1), (8, 2), None]


def test_top_k(spark):
    rng = random.Random(9)
    vec = lambda: [rng.choice([0.0, 0.25, -0.5, 1.0, rng.uniform(-1, 1)]) for _ in range(6)]
    rows = [(i, vec(), "x") for i in range(150)] + [(500, None, "x"), (501, [1.0, None], "x"), (502, [float("nan")] * 6, "x"), (503, [float("inf")] * 6, "x"), (520, [], "x"), (540, [1.0], "x"), (160, [0.1, 0.2], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    good = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float))) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))
    want = []
    for q, a in good:
        if q % 20 == 0:
            order = sorted(((-dot(a, b), i) for i, b in good if i != q))[:20]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(order, 1)]
    for size in ({}, {"query_block": 3, "block": 17}):
        got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, **size)
        assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert topk_search.top_k(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    huge = spark.createDataFrame([(20, [3.0e8] * 3, ""), (21, [3.0e8, 1.0, 1.0], ""), (22, [3.0e8, 1.0, 2.0], "")], "vec_id long, embedding array<double>, id string")
    assert [r.vec_id for r in topk_search.top_k(huge, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [21, 22]


def test_top_k_sql(spark):
    assert oracle.differences(queries.op8_topk_search(spark, SMALL), oracle.connect(SMALL), queries.SQL["op8_topk_search"]) == []


def base_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(spark, rows, empty):
    said = ["The MIT License; gnu general\npublic-license. CC-BY 4.0 and cc by", "mit mit license license", "GNU General Public Licenses", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only WITH Classpath-exception-2.0\nx", "émit license", "mit license" * 3, "mit license", "mit license " * 3000]
    every = rows + [(600 + i, t, "t") for i, t in enumerate(said)]
    got = licences.license_scan(docs_of(spark, every)).collect()
    have = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key)
    assert have == sorted(((i, *base_by_hand(t)) for i, t, _ in every), key=key)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got)
    assert {r.doc_id: r.labels for r in got}[603] == "apache,gpl,mit"
    assert licences.license_scan(empty).count() == 0


def test_license_expressions():
    assert licences.evaluate("MIT OR GPL-2.0 AND Apache-2.0") == ({"mit", "gpl", "apache"}, 1.0)
    assert licences.evaluate("(MIT OR GPL-2.0) AND Apache-2.0") == ({"mit", "gpl", "apache"}, 1.0)
    assert licences.evaluate("GPL-2.0 WITH Classpath-exception-2.0 AND MIT") == ({"gpl", "mit"}, 0.5)
    assert [licences.evaluate(f"GPL-2.0 {x}") for x in ("or any later version", "or later", "or (at your option) any later version.")] == [({"gpl"}, 0.3)] * 3
    assert licences.evaluate("GPL-2.0 or later or MIT") == ({"gpl", "mit"}, 1.0) and licences.evaluate("MIT or later-1.0") == ({"mit", "other"}, 1.0)
    assert licences.evaluate("GPL-2.0+ AND MIT") == ({"gpl", "mit"}, 0.3)
    assert [licences.evaluate(x) for x in ("MIT OR", "(MIT", "AND MIT", "()")] == [None] * 4


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    fixed, left = {}, dict(sizes)
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        w = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] > 3 * sizes[s] * w]
        if not over:
            return fixed | {s: rest * weight[s] / w if w else 0.0 for s in left}
        for s in over:
            fixed[s] = 3 * sizes[s]
            del left[s]


def check_mix(got, rows, near):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = targets_by_hand(sizes)
    of = defaultdict(set)
    for i, t, s in rows:
        of[i, words(t)].add(s)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), words(t)) for i, t, _ in rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = next(s for s in of[r.doc_id, r.size] if sizes[s] == r.source_size and abs(want[s] - r.target) < 1e-6 * max(1, want[s]))
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near(want[s]), (s, taken[s], want[s])


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs, block=4)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    check_mix(got.collect(), rows, lambda t: 12)
    again = mixing.mix(docs.repartition(7, "source"), block=4)
    assert sorted(map(tuple, again.collect()), key=key) == sorted(map(tuple, got.collect()), key=key)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mix(docs.filter("doc_id in (200, 201, 202)")).agg(F.sum("taken")).first()[0] == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {i for i, *_ in rows}


@pytest.mark.parametrize("words", [60, 20, 35, 100])
def test_mixing_keeps_targets_over_many_shards(spark, words):
    # Cells of one document or few; sources weigh 1, 2 and 3.
    rows = [(i, " ".join(["w"] * words), "abc"[i % 3]) for i in range(60)]
    docs = docs_of(spark, rows)
    for shard_words in (50, 400, 4_000_000):
        check_mix(mixing.mix(docs, shard_words=shard_words).collect(), rows, lambda t: 64)


def test_mixing_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    check_mix(queries.op10_mix_sources(spark, SMALL).collect(), rows, lambda t: 64 + 0.01 * t)


def test_mixing_sql(spark, docs, rows):
    assert oracle.differences(queries.op10_mix_sources(spark, SMALL), oracle.connect(SMALL), queries.SQL["op10_mix_sources"]) == []
    con = oracle.duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert oracle.differences(mixing.mix(docs), con, queries.SQL["op10_mix_sources"]) == []


def test_sainte_lague(spark):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0}
    df = spark.createDataFrame([("g", k, w, 7) for k, w in weights.items()], "g string, k string, w double, seats long")
    have = {r.k: r.quota for r in mixing.sainte_lague(df, ["g"], "w", "seats", "k").collect()}
    won = Counter()
    for _ in range(7):
        won[max(weights, key=lambda k: (weights[k] / (2 * won[k] + 1), -ord(k)))] += 1
    assert have == {k: won[k] for k in weights}


def auc(rows):
    ones, zeros = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


# Some labels are wrong on purpose: at this size two of the six held-out toxic texts hold no term.
@pytest.mark.parametrize(("op", "label", "least"), [("op1_toxicity", "toxic", 0.8), ("op5_quality", "quality", 0.8)])
def test_held_out_scores(spark, op, label, least):
    folder = SMALL.replace("0.001", "0.01")
    got = queries.QUERIES[op](spark, folder).cache()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.filter("score < 0 or score > 1").count() == 0
    n, k = (5, 0) if op.startswith("op1") else (4, 2)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) for r in got.collect())
    marked = got.filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = [(r[label], r.score) for r in marked.collect()]
    assert len({y for y, _ in rows}) == 2 and auc(rows) >= least


def test_classifiers_on_messy_tables(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0, "x") for i in range(30)] + [(None, 1, True, "x"), (3, None, None, "x")], "doc_id long, quality int, t boolean, text string").withColumn("toxic", F.col("t").cast("int"))
    for fit, score in ((toxicity.fit, toxicity.score), (quality.fit, quality.score)):
        for some in (labels, labels.filter("false"), labels.filter("quality = 1")):
            model = fit(docs, some, remainder("doc_id", 5) != 0)
            out = score(docs, model)
            assert out.columns == ["doc_id", "score"] and out.count() == docs.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
            assert score(empty, model).count() == 0


def test_misspellings_and_quotation():
    near = toxicity.Nearby(["idiot", "blockheadish"])
    found = {w: near.best(w) for w in ("idiot", "idoit", "id1ot", "idiots", "blockhedish", "blokhedish", "house", "idea")}
    assert found["id1ot"] == (1, "idiot") and found["idiots"] == (1, "idiot") and found["blockhedish"] == (1, "blockheadish") and found["blokhedish"] == (2, "blockheadish")
    assert found["house"] is None and found["idea"] is None
    lex = toxicity.Lexicon(words={"idiot": 3.0})
    match = lex.matcher()
    plain, quoted, aimed = (lex.feature(t, match) for t in ("what an idiot there", 'he quoted the word "idiot" there', "you idiot there"))
    assert quoted < plain < aimed


def labelled_table(spark, toxic, clean):
    """Documents and labels of toxic and clean texts in turn of ids, with words of their own around them."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfghklm") + rng.choice("aeiou") for _ in range(4))
    every = [(y, f"{t} {' '.join(word() for _ in range(9))}") for y, ts in ((1, toxic), (0, clean)) for t in ts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(every)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, (y, _) in enumerate(every)], "doc_id long, toxic int")


def test_misspelled_heads_of_stemmed_short_and_rare_terms(spark):
    # zorg* is in one text more than zorgon; zib and wemp are short; quonkers is under a stem and in one text.
    forms = ["zorgon"] * 30 + ["zorgn"] + ["zib"] * 30 + ["wemp"] * 30 + ["quonk"] * 15 + ["quonked"] * 15 + ["quonkers"]
    docs, labels = labelled_table(spark, forms, [""] * 400)
    lexicon = toxicity.fit(docs, labels, F.lit(True))
    assert "zorg" in lexicon.stems and "zorgon" not in lexicon.words
    match = lexicon.matcher()
    for w in ("zrgon", "xorgon", "zobgon", "zab", "zibb", "wep", "wemmp", "qonk", "qonkers", "xuonkers"):
        assert match[w] and match[w][0] > 0 and match[w][1] == 1, w
    assert not match["house"] and not match["zrgn" * 3]


def test_a_wide_vocabulary_of_rare_terms_is_learnt(spark):
    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("pqrstvwxz") + rng.choice("aeiou") for _ in range(3)) for _ in range(110)})[:100]
    docs, labels = labelled_table(spark, [terms[i % 100] for i in range(1000)], [""] * 1000)  # each in 1 % of toxic texts
    lexicon = toxicity.fit(docs, labels, F.lit(True))
    match = lexicon.matcher()
    assert all(match[t] and match[t][0] > 1.5 for t in terms)
    ordinary = {w for r in docs.filter("doc_id >= 1000").collect() for w in r.text.split()}
    assert sum(bool(match[w]) for w in ordinary) < 0.02 * len(ordinary)


def test_trie_distances_are_exact():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
    terms = sorted({word() for _ in range(25)})
    trie = toxicity.Trie(terms)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(200):
        w = word()
        best = min((edits(w, t), k) for k, t in enumerate(terms))
        for most in (1, 2):
            assert trie.near(w, most) == (best if best[0] <= most else None)


def test_suffix_dedup_of_a_table(spark):
    """400 bytes, every row of the smallest table, against sets of all its strings."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    raw = {r.doc_id: (r.text or "").encode() for r in rows}
    count = Counter(hash(t[i : i + 400]) for t in raw.values() for i in range(len(t) - 399))
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.lower()) for i, t in raw.items()}
    runs = lambda n: Counter(x for w in words.values() for x in {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    long, short = runs(51), runs(20)
    for r in queries.op3_suffix_dedup(spark, SMALL).collect():
        t, gone = raw[r.doc_id], np.zeros(len(raw[r.doc_id]), dtype=bool)
        for i in range(len(t) - 399):
            if count[hash(t[i : i + 400])] > 1:
                gone[i : i + 400] = True
        left = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        starts = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if t else 0
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), starts, hashlib.sha256(left).hexdigest())
        w = words[r.doc_id]
        if any(long[tuple(w[k : k + 51])] > 1 for k in range(len(w) - 50)):
            assert r.repeats_passage
        elif not any(short[tuple(w[k : k + 20])] > 1 for k in range(len(w) - 19)):
            assert not r.repeats_passage


def test_suffix_dedup_of_a_periodic_text(spark):
    rows = docs_of(spark, [(1, "a" * 300_000, "a"), (2, "ab" * 500, "a"), (3, "b" * 399, "a")])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(rows).collect()}
    assert got == {1: (300_000, 300_000, 1), 2: (1000, 1000, 1), 3: (399, 0, 0)}


def test_passages_of_messy_rows(spark, docs, rows, empty):
    got = suffix_dedup.suffix_dedup(docs, passages=True).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.repeats_passage} >= {300, 301}
    assert not any(r.repeats_passage for r in got if r.doc_id in (200, 201, 202, 400, 401))
    assert suffix_dedup.suffix_dedup(empty, passages=True).count() == 0


def test_near_components_of_a_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    root = components_by_hand([shingles(t, 4) for _, t in rows])
    got = {r.doc_id: r.component_id for r in queries.op4_near_components(spark, SMALL).collect()}
    assert got == {i: rows[root[k]][0] for k, (i, _) in enumerate(rows)}


def test_numbered(spark):
    rows = spark.createDataFrame([(v, v // 7, v % 3 if v > 40 else 9) for v in range(200)], "v long, label long, cluster long")
    got = near_dedup.numbered(rows, 16).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.cluster, r.label, r.v)):
        by[r.cluster].append(r.block)
    assert len(got) == 200 and all(b == [k // 16 for k in range(len(b))] for b in by.values())


@pytest.mark.parametrize("folder", ["{}", "file://{}", "file:{}/"])
def test_discard(spark, tmp_path, folder, monkeypatch):
    from clipquery.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda _: folder.format(tmp_path).rstrip("/"))
    keep, drop = (common.materialize(spark.range(5).toDF("id"), x) for x in ("keep", "drop"))
    spark.range(3).write.parquet(f"{tmp_path}/other")
    common.discard(drop, spark.read.parquet(f"{tmp_path}/other"))
    assert [p.name.split("-")[0] for p in (tmp_path / "clipquery").iterdir()] == ["keep"] and keep.count() == 5
    assert (tmp_path / "other").exists()
