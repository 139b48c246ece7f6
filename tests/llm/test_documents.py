"""Operators over all documents, against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from assayer.llm import decontamination, jaccard, sharding, simhash, suffix_dedup

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """prints: list of (doc_id, fingerprint) -> {index: least doc_id}."""
    n = len(prints)
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                label[root(i)] = root(j)
    least = {}
    for i in range(n):
        if prints[i][0] is not None:
            r = root(i)
            least[r] = min(least.get(r, prints[i][0]), prints[i][0])
    return [least.get(root(i)) for i in range(n)]


def test_simhash_on_odd_rows(spark, odd, none, odd_rows):
    got = sorted(((r.doc_id, r.simhash % 2**64, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str)
    prints = [(r[0], plain_fingerprint(r[1])) for r in odd_rows]
    want = sorted(((d, f, c) for (d, f), c in zip(prints, plain_components(prints), strict=True)), key=str)
    assert got == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(odd.withColumn("simhash", F.lit("x")))
    assert kept.columns == [*odd.columns, "simhash"] and kept.count() == len({c for *_, c in want})
    assert simhash.drop_near_duplicates(none).count() == 0


def test_groups_without_or_with_repeated_ids_keep_a_row_each(spark):
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None, body(k)) for k in (0, 1, 2, 2)] + [(7, body(3)), (7, body(4)), (7, body(4)), (8, body(5)), (None, body(5)), (9, None), (None, None)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([*((None, body(k)) for k in (0, 1, 2)), (7, body(3)), (7, body(4)), (8, body(5)), (9, None)], key=str)


@pytest.mark.parametrize(("limit", "at"), [(64, 4), (3, 2)])
def test_near_copies_at_shingle_similarity_leave_one(spark, monkeypatch, limit, at):
    """Edited copies, far apart in bits, around the threshold; with limit 3 most lists are long."""
    monkeypatch.setattr(jaccard, "LIST_MAX", limit)
    monkeypatch.setattr(jaccard, "FREQUENT_AT", at)
    rng, rows = random.Random(limit), []
    opening = [f"intro{j}" for j in range(30)]
    for k in range(12):
        base = opening[: rng.choice([0, 30])] + [f"w{k}x{rng.randrange(40)}" for _ in range(rng.choice([4, 60, 150]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    pairs = {(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert sum((prints[i] ^ prints[j]).bit_count() > 2 for i, j in pairs) > 10
    for i, j in pairs | {(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}:
        a, b = label[i], label[j]
        label = [b if x == a else x for x in label]
    want = {min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label)}
    kept = [r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(kept) == sorted(want)


def test_bitmaps_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 3000))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, int(rng.integers(0, 200))).astype(np.uint64)]))
        apart = sum(int(x ^ y).bit_count() for x, y in zip(jaccard.bitmap(a).view(np.uint64).tolist(), jaccard.bitmap(b).view(np.uint64).tolist()))
        assert apart <= len(np.setxor1d(a, b)) and len(jaccard.bitmap(a)) == jaccard.BITS // 64
    assert not jaccard.bitmap(np.empty(0, dtype=np.uint64)).any()


@pytest.mark.parametrize(("slices", "open_"), [(0.5, 1.0), (0.1, 1.0), (0.5, 0.0)])
def test_pairs_equal_brute_force_in_one_or_many_slices(spark, monkeypatch, slices, open_):
    """With ``open_`` 0 further steps of stars come before the pairs."""
    monkeypatch.setattr(jaccard, "SLICE", slices)
    monkeypatch.setattr(jaccard, "OPEN", open_)
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(40, 140))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            near = list(base)
            near[rng.randrange(len(near))] = f"z{rng.randrange(9)}"
            texts.append(" ".join(near))
    texts = sorted(set(texts))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("_key", F.md5("text"))
    sets = jaccard.distinct_sets(jaccard.signatures(docs, np.empty(0, dtype=np.uint64), 5, 0.8, ["_key"]))
    sid = {r.sid: r._key for r in sets.select("sid", "_key").collect()}
    found = {tuple(sorted((sid[r.u], sid[r.v]))) for r in jaccard.links(sets, docs.select("_key", "text")).collect()}
    key = {t: hashlib.md5(t.encode()).hexdigest() for t in texts}
    similar = {tuple(sorted((key[a], key[b]))) for i, a in enumerate(texts) for b in texts[:i] if jaccard.similar(a, b, 5, 0.8)}

    def parts(pairs):
        root = {k: k for k in key.values()}
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert len(similar) > 20 and found <= similar and parts(found) == parts(similar)


def test_a_large_family_among_others_is_not_put_out_in_pairs(spark, monkeypatch):
    """All members are near each other; shorter and other texts with their passage are in the same lists."""
    rng = random.Random(12)
    base = [f"w{j}" for j in range(120)]
    texts = []
    for i in range(300):
        near = list(base)
        near[rng.randrange(120)] = f"edit{i}"
        texts.append(" ".join(near))
    texts += [" ".join(base[:60] + [f"other{i}x{j}" for j in range(rng.randrange(20, 200))]) for i in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("_key", F.md5("text"))
    asked, write = [], jaccard.materialise

    def counted(df, tag):
        out = write(df, tag)
        if tag == "pairs":
            asked.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    sets = jaccard.distinct_sets(jaccard.signatures(docs, np.empty(0, dtype=np.uint64), 5, 0.8, ["_key"]))
    sid = {r.sid: r._key for r in sets.select("sid", "_key").collect()}
    family = {hashlib.md5(t.encode()).hexdigest() for t in texts[:300]}
    roots = jaccard.components(jaccard.links(sets, docs.select("_key", "text"))).collect()
    assert {sid[r.node] for r in roots} == family and len({r.root for r in roots}) == 1
    assert sum(asked) < 20 * len(texts)


def test_a_family_that_is_alike_but_not_similar_makes_few_pairs(spark, monkeypatch):
    """Two edits in each copy: similarity about 0.72, so that stars leave all apart and the last step decides."""
    rng = random.Random(21)
    base, texts = [f"w{j}" for j in range(120)], []
    for i in range(150):
        near = list(base)
        for j in rng.sample(range(10, 110), 2):
            near[j] = f"edit{i}x{j}"
        texts.append(" ".join(near))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("_key", F.md5("text"))
    asked, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: asked.append(pairs.distinct().count()) or verified(pairs, *a))
    sets = jaccard.distinct_sets(jaccard.signatures(docs, np.empty(0, dtype=np.uint64), 5, 0.8, ["_key"]))
    sid = {r.sid: r._key for r in sets.select("sid", "_key").collect()}
    roots = {sid[r.node]: r.root for r in jaccard.components(jaccard.links(sets, docs.select("_key", "text"))).collect()}
    key = [hashlib.md5(t.encode()).hexdigest() for t in texts]
    similar = [(i, j) for i in range(150) for j in range(i) if jaccard.similar(texts[i], texts[j], 5, 0.8)]
    assert all(roots[key[i]] == roots[key[j]] for i, j in similar)
    assert asked[-1] < 1000  # of 11,175


def test_few_pairs_are_verified_in_one_step(spark, monkeypatch):
    """Lists of three at most hold no more pairs than postings: no step of centres comes before the pairs."""
    texts = []
    for i in range(12):
        base = [f"w{i}x{j}" for j in range(80)]
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join(base[:40] + [f"z{i}x{j}" for j in range(40)])]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("_key", F.md5("text"))
    asked, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda *a: asked.append(1) or verified(*a))
    sets = jaccard.distinct_sets(jaccard.signatures(docs, np.empty(0, dtype=np.uint64), 5, 0.8, ["_key"]))
    sid = {r.sid: r._key for r in sets.select("sid", "_key").collect()}
    found = {frozenset((sid[r.u], sid[r.v])) for r in jaccard.links(sets, docs.select("_key", "text")).collect()}
    key = [hashlib.md5(t.encode()).hexdigest() for t in texts]
    assert found == {frozenset((key[i], key[i + 1])) for i in range(0, 36, 3)}
    assert len(asked) == 1


@pytest.mark.parametrize("limit", [64, 3])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, limit):
    """Random families of near fingerprints; with limit 3 most lists go by the star."""
    monkeypatch.setattr(simhash, "LIST_MAX", limit)
    rng = random.Random(limit)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.append(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    rows = list(enumerate(prints))
    df = spark.createDataFrame([(i, x - 2**64 if x >= 2**63 else x) for i, x in rows], "doc_id long, simhash long")
    groups = {r.simhash % 2**64: r.component_id for r in simhash.groups(df).collect()}
    assert [groups[x] for _, x in rows] == plain_components(rows)


def plain_windows(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items):
    words = plain_windows(text)
    hit, found = set(), set()
    for item, t in items:
        w = plain_windows(t)
        size = min(13, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words)):
            if size and tuple(words[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add("null" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def contaminated_rows():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)] + ["Éa", "the"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 13, 14, 30])))) for i in range(12)] + [(3, "w1, w2; W3"), (None, "w5 w6"), (90, ""), (91, None), (10, "the THE the")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = plain_windows(items[i % 12][1])[: rng.randint(4, 30)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    return items, [*docs, (60, None), (60, None), (None, items[3][1]), (61, "")]


def test_decontamination_equals_brute_force(spark, monkeypatch, none):
    items, docs = contaminated_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    for block, shard in ((decontamination.BLOCK_BYTES, decontamination.SHARD_WORDS), (300, 50)):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
        got = decontamination.with_verdict(decontamination.mark_documents(df, bench, keep=["doc_id", "text"])).collect()
        for r in got:
            n, hit, found = plain_hits(r.text, items)
            assert (r.n_words, r.n_hit, r.items) == (n, hit, found)
            assert r.contaminated == (hit > 0 and 20 * hit >= n)
    clean = decontamination.drop_contaminated(df.withColumn("spans", F.lit(1)), bench)
    assert clean.columns == ["doc_id", "text", "spans"] and clean.count() == sum(not r.contaminated for r in got)
    assert decontamination.drop_contaminated(none, bench).count() == 0
    assert decontamination.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 6, 400), 0)
    index = decontamination.FMIndex(text, 6, every=7)
    phrases = np.array([text[i : i + 3] for i in range(0, 390, 13)] + [[5, 5, 5], [1, 0, 1]])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(398) if (text[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def plain_removed(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(r), sum(gone), hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("bucket_runs", [2048, 2])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, bucket_runs):
    """Shared passages, edited copies, self-repeats, runs of one letter; with 2 large buckets are counted."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_RUNS", bucket_runs)
    rng = random.Random(bucket_runs)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(140)) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 150)))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            at = rng.randint(0, len(p))
            parts += [rng.choice([p, p[:at] + "X" + p[at:], p[at:]]), " ".join(word() for _ in range(rng.randint(0, 60)))]
        rows.append((i, " ".join(parts)))
    rows += [(50, "a" * 1500), (51, "ab" * 600), (52, None), (53, ""), (54, passages[0]), (54, passages[0]), (None, passages[1]), (55, "x" * 399)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    want = Counter((str(d), *w) for (d, _), w in zip(rows, plain_removed(rows, suffix_dedup.LENGTH), strict=True))
    assert Counter((str(r.doc_id), r.n_bytes, sum(s.end - s.first for s in r.removed), r.kept_sha256) for r in got) == want
    whole = [r for r in got if "\ufffd" not in r.kept]
    assert len(whole) > 40 and all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in whole)


def test_suffix_dedup_takes_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    a = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = list(suffix_dedup.runs_of([a]))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    parts = list(suffix_dedup.runs_of([a]))
    starts = lambda found: {(int(p), int(m), int(b)) for _, lo, mid, hi, bu, *_ in found for lo_, m, h, b in zip(lo, mid, hi, bu, strict=True) for p in range(lo_, h + 1)}
    assert starts(whole) == starts(parts) and len(starts(whole)) == 5000 - suffix_dedup.LENGTH + 1


def test_suffix_dedup_of_nothing(spark, none):
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_shards_are_balanced_and_gapless(spark, odd, none, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "copy of one text " * 4 if i % 3 == 0 else "x" * rng.randint(0, 400) + str(i)) for i in range(1500)] + [(None, None), (None, "a"), (7, None)]
    for task in (sharding.TASK_BYTES, 3000):
        monkeypatch.setattr(sharding, "TASK_BYTES", task)
        out = sharding.shard_documents(spark.createDataFrame(rows, DOCS), shards=10).collect()
        assert len(out) == len(rows)
        size = Counter()
        slots = {}
        for r in out:
            assert r.size == len((r.text or "").encode()) + 16
            size[r.shard] += r.size
            slots.setdefault(r.shard, []).append(r.slot)
        mean = sum(size.values()) / 10
        assert set(size) == set(range(10)) and max(abs(s - mean) for s in size.values()) <= 2 * 416
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        split = Counter(t for t, _ in {(r.text, r.shard) for r in out if r.text is not None and not r.text.startswith("copy")})
        assert max(split.values()) == 1
        # against a plain sort: the shards one after the other are the rows in order, cut near the targets
        keyed = spark.createDataFrame([(r.doc_id, r.text, r.shard, r.slot, r.size) for r in out], "doc_id long, text string, shard int, slot long, size long")
        keyed = keyed.select("shard", "slot", "size", sharding.key_of().alias("k"), sharding.id_of().alias("i")).collect()
        unsigned = lambda x: x & (1 << 64) - 1
        placed = sorted(keyed, key=lambda r: (r.shard, r.slot))
        order = [(unsigned(r.k), unsigned(r.i)) for r in placed]
        assert order == sorted(order)
        below = 0
        for a, b in zip(placed, placed[1:]):
            below += a.size
            if a.shard != b.shard:
                assert abs(below - mean * b.shard) <= 416
    assert sharding.shard_documents(odd.withColumn("SLOT", F.lit(1))).count() == odd.count()
    assert sharding.shard_documents(none).count() == 0


def test_suffix_dedup_is_linear_in_equal_rows(spark):
    """10,000 rows without an id and of one text, one row that shares a passage with it, one that does not."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    text, own, lone = word(2000), word(500), word(700)
    some = spark.createDataFrame([(1, own + text[300:900] + own[::-1]), (2, lone)], DOCS)
    docs = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(some)
    out = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "removed", "kept_sha256")
    counts = {(r.doc_id, tuple(tuple(x) for x in r.removed)): r["count"] for r in out.groupBy("doc_id", "removed").count().collect()}
    assert counts == {(None, ((0, 2000),)): 10_000, (1, ((500, 1100),)): 1, (2, ()): 1}


def test_spans_are_united_by_columns_not_by_python_objects():
    """Each repeated start of a sorted run once was a dictionary, which was most of the operator's CPU time."""
    rng = np.random.default_rng(4)
    own = np.sort(rng.integers(0, 30, 400))
    low = rng.integers(0, 20_000, 400)
    high = low + rng.integers(0, 300, 400)
    want = []
    for row in range(30):
        at = np.zeros(30_000, dtype=bool)
        for a, b in zip(low[own == row], high[own == row], strict=True):
            at[a : b + suffix_dedup.LENGTH] = True
        edge = np.diff(np.concatenate([[0], at.astype(int), [0]]))
        want += [(row, a, b) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    assert list(zip(*suffix_dedup._merged(own, low, high), strict=True)) == want
    n = 300_000
    parts = pa.array([None, [{"place": 5 << 20, "again": []}], None], pa.list_(pa.struct([("place", pa.int64()), ("again", pa.list_(pa.int32()))])))
    many = pa.StructArray.from_arrays([pa.array([0]), pa.ListArray.from_arrays([0, n], pa.array(np.arange(n, dtype=np.int32)))], names=["place", "again"])
    parts = pa.concat_arrays([parts, pa.ListArray.from_arrays([0, 1], many).cast(parts.type)])
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, None, 4]), pa.array([3, 1, 0, n + 500]), pa.array(["abc", "é", None, "x" * (n + 500)]), pa.nulls(4, suffix_dedup._PURE), parts],
        names=["doc_id", "n_bytes", "text", "pure", "parts"],
    )
    tracemalloc.start()
    out = pa.Table.from_batches(list(suffix_dedup._end(iter([batch])))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["kept"] for r in out] == ["abc", "é", "", "x" * 101] and out[3]["removed"] == [{"first": 0, "end": n + 399}]
    assert [r["kept_sha256"] for r in out] == [hashlib.sha256(r["kept"].encode()).hexdigest() for r in out]
    assert peak < 120 * n  # bytes a start
