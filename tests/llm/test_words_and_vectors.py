"""Operators 11 to 13 against brute force, on odd rows, and on hot groups."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from assayer.llm import exact_dedup, spelling, whitening


# --- exact duplicates


def _ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _plain_duplicates(rows):
    groups = {}
    for r in rows:
        groups.setdefault(_ascii_lower(r[1]), []).append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = [i == keep for i in ids]
        first = kept.index(True)
        out += [(i, keep, len(ids), j == first, sha) for j, i in enumerate(ids)]
    return Counter(out)


@pytest.mark.parametrize("share", [0.001, 0.2, 0.9])
def test_duplicates_equal_a_plain_pass(spark, odd_rows, share):
    rng = random.Random(11)
    rows = [(i, rng.choice(["Hot Text", "hot text", "HOT text"]) if i % 3 == 0 else rng.choice("abcÀà") * rng.randint(0, 6)) for i in range(600)]
    rows += [r[:2] for r in odd_rows] + [(None, "hot text")] * 3 + [(900, "Hot text"), (900, "hot text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.mark_duplicates(docs, share=share)
    assert Counter(map(tuple, got.collect())) == _plain_duplicates(rows)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_duplicates_of_nothing(spark, none):
    assert exact_dedup.mark_duplicates(none).count() == 0
    assert exact_dedup.drop_duplicates(none).columns == none.columns
    assert exact_dedup.drop_duplicates(none).count() == 0


def test_dropped_rows_leave_whole_rows_of_any_column_name(spark):
    rows = [(1, "A b", "x", 1), (2, "a B", "y", 2), (2, "a B", "z", 3), (None, "a b", "w", 4), (None, None, "n", 5), (None, "", "m", 6), (3, "c", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, whole int").repartition(3)
    out = exact_dedup.drop_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, ""), (2, "a B"), (3, "c")] and len(out) == 3
    again = exact_dedup.drop_duplicates(docs.repartition(1)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert {r.digest for r in out} <= {"y", "z", "n", "m", None}


def test_summaries_name_every_heavy_hitter():
    rng = random.Random(1)
    stream = [b"hot"] * 300 + [b"warm"] * 120 + [b"%d" % rng.randint(0, 10_000) for _ in range(580)]
    rng.shuffle(stream)
    for counters in (10, 20, 50):
        total = Counter()
        for part in range(0, 1000, 137):  # summaries of parts add up
            summary = {}
            for at in range(part, min(part + 137, 1000), 20):
                summary = exact_dedup.fold(summary, Counter(stream[at : min(at + 20, part + 137)]), counters)
                assert len(summary) <= counters
            total.update(summary)
        for d, n in Counter(stream).items():
            assert n - 1000 / (counters + 1) <= total[d] <= n


def test_heavy_hitters_are_answered_without_an_exchange(spark):
    rows = [(i, "hot" if i % 2 else f"text {i}") for i in range(400)]
    digests = spark.createDataFrame(rows, "id long, text string").select("id", exact_dedup.digest_of().alias("digest"), (exact_dedup.F.col("id") * 2).alias("row"))
    assert [(r.group_size, r.stays.id) for r in exact_dedup.winners(digests, 400, 0.1).collect()] == [(200, 399)]
    assert exact_dedup.candidates(digests, 400, 0.1).count() <= 20


# --- whitening


def _plain_whitening(rows):
    good = [(i, v) for i, v in rows if v and all(e is not None and np.isfinite(e) for e in v)]
    lengths = Counter(len(v) for _, v in good)
    size = max(lengths, key=lambda d: (lengths[d], d))
    good = [(i, [int(np.floor(256 * float(np.float32(e)))) for e in v]) for i, v in good if len(v) == size]
    fit = np.array(sorted({tuple(v) for _, v in good}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centre = fit - sums / n
    values, vectors = np.linalg.eigh(centre.T @ centre / n)
    return good, n, sums, values[::-1], vectors[:, ::-1]


def test_whitening_equals_a_covariance(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a hot vector counts once
    rows += [(None, rows[1][1]), (5, rows[5][1]), (2000, None), (2001, []), (2002, [None] * 6), (2003, [float("nan")] * 6), (2004, [float("inf")] + [0.0] * 5), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    got = whitening.whiten(df).collect()
    good, n, sums, values, vectors = _plain_whitening(rows)
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c) for i, _ in good for c in (1, 2, 3, 4))
    assert {r.n for r in got} == {n}
    by = {i: v for i, v in good}
    for c in range(4):
        mine = {r.vec_id: r.whitened for r in got if r.component == c + 1}
        plain = {i: float((np.array(v) - sums / n) @ vectors[:, c] / np.sqrt(values[c])) for i, v in by.items()}
        sign = np.sign(mine[7] * plain[7])
        assert max(abs(mine[i] - sign * plain[i]) for i in by) < 1e-9
    for r in got:
        assert r.deviation == sum((n * int(x) - int(s)) ** 2 for x, s in zip(by[r.vec_id], sums))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_many_parts_and_few_dimensions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 8)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(3)
    x = rng.integers(-1000, 1000, size=(200, 3))
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(9)
    n, sums = whitening.exact_sums(fit, 3)
    assert (n, sums) == (200, x.sum(axis=0).tolist())
    r = whitening.tsqr(fit, n, sums)
    centre = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, centre.T @ centre, rtol=1e-12) and r.shape == (3, 3)


def test_whitening_of_odd_tables(spark):
    schema = "component int, vec array<double>, x string"
    assert whitening.whiten(spark.createDataFrame([], schema), "vec").count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "a")], schema), "vec").count() == 0
    # equal vectors have no component; two have one; names that clash are replaced or kept
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "a")] * 3, schema), "vec").count() == 0
    out = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "a"), (1, [2.0, 4.0], None)], schema), "vec")
    assert out.columns == ["x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted((r.x or "", r.component, round(abs(r.whitened), 9)) for r in out.collect()) == [("", 1, 1.0), ("a", 1, 1.0)]
    # numbers beyond 64 bits: sums stay exact, deviation is null
    far = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0], "a"), (1, [-1e30, 0.0], "b"), (1, [0.0, 0.0], "c")], schema), "vec").collect()
    assert {(r.x, r.deviation is None) for r in far if r.component == 1} == {("a", True), ("b", True), ("c", False)}


# --- spelling variants


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _ascii_lower(run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def _texts(rng, words, docs):
    return [(i, " ".join(rng.choices(words, weights=[len(words) / (1 + j) for j in range(len(words))], k=rng.randint(0, 200)))) for i in range(docs)]


@pytest.fixture(scope="module")
def spelt_rows(odd_rows):
    rng = random.Random(13)
    base = ["".join(rng.choices("abÀé", k=rng.randint(7, 11))) for _ in range(30)] + ["international", "Aaaaaaaa", "ababababab", "vieilleÿ"]
    words = list(base)
    for w in base:
        for _ in range(6):
            at = rng.randrange(len(w))
            words.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "É" + w[at + 1 :]]))
    rows = _texts(rng, words, 300) + [r[:2] for r in odd_rows] + [(None, "international " * 40 + "internationel internationel"), (4, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001), (5, "x" * 5001)]
    chain = ["chainedaa"] * 4000 + ["chainedab"] * 300 + ["chainedbb"] * 25 + ["chaineebb"] * 2
    return [*rows, (77, " ".join(chain))]


@pytest.mark.parametrize("block", [100_000, 10])
def test_variants_equal_brute_force(spark, spelt_rows, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    docs = spark.createDataFrame(spelt_rows, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in spelling.variants(docs).collect()}
    assert got == _plain_variants(spelt_rows)
    assert any(form and root != form for _, form, root, *_ in got)


def test_variants_of_odd_rows(spark, odd, odd_rows, none):
    got = [tuple(r) for r in spelling.variants(odd.withColumnRenamed("source", "word").withColumnRenamed("lang", "key")).collect()]
    assert set(got) == _plain_variants([r[:2] for r in odd_rows]) and len(set(got)) == len(got)
    assert spelling.variants(none).count() == 0


def test_automaton_numbers_words_in_order_and_is_minimal():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(200)})
    made = spelling.Automaton(words)
    assert [made.number(made.root, w, 0) for w in words] == list(range(len(words)))
    assert all(made.number(made.root, w, 0) == -1 for w in map("".join, itertools.product("abc", repeat=4)) if w not in words)
    # one node for each set of endings
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(made.edges) == len(endings)
    for w in words[::7]:
        assert set(made.near(w, 0).values()) == {v for v in words if _near(w, v)}
        assert all(words[k] == v for k, v in made.near(w, 0).items())


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    n = {}
    got = {r.word: r for r in spelling.variants(docs).collect()}
    for doc_id, text in rows:
        for w, c in spelling.word_counts(doc_id, text).items():
            n[w] = n.get(w, 0) + c
    assert {w: r.n for w, r in got.items()} == {w: c for w, c in n.items() if c >= 2}
    holes = {}
    for w in got:
        for i in range(len(w)):
            holes.setdefault((w[:i] + "\0" + w[i + 1 :]), set()).add(w)
            if w[:i] + w[i + 1 :] in got:
                holes.setdefault((w, i), set()).update({w, w[:i] + w[i + 1 :]})
    near = {}
    for some in holes.values():
        for w in some:
            near.setdefault(w, set()).update(some - {w})
    assert {w: r.n_near for w, r in got.items()} == {w: len({v for v in near.get(w, ()) if _near(w, v)}) for w in got}
