"""Operators that work text by text, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import quality_classifier, quality_rules, sentencepieces, token_shards


def test_rule_measures_match_plain_counts(odd_rows):
    for _, text, *_ in odd_rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = set()
        for i in range(len(words) - 2):
            if wins[tuple(words[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))
        assert quality_rules.measure(text)[:5] == want


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.1), (50, 0.02), (300, 0.004)):
        for x in (0, 1, 5, n):
            want = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
            assert quality_rules.binomial_tail(x, n, p) == pytest.approx(want, rel=1e-9)


def test_cutoff_is_certified_and_stops_at_the_first_failure():
    bins = [(0, 2000, 2000), (300, 0, 40), (500, 0, 60), (100, 30, 90)]
    assert quality_rules.certified_cutoff(bins, 2030, 0.01, 0.01) == 300
    assert quality_rules.certified_cutoff(bins, 20, 0.01, 0.01) is None
    assert quality_rules.certified_cutoff([], 0, 0.01, 0.01) is None


def test_false_rejections_stay_below_alpha():
    rng = np.random.default_rng(1)
    bad = 0
    for _ in range(200):  # the true rate at a cutoff of 1 is 2 %: it may be certified at 1 % in a few runs only
        n = 1500
        x = int(rng.binomial(n, 0.02))
        bad += quality_rules.certified_cutoff([(0, n - x, n - x), (1, x, x)], n, 0.01, 0.05) is not None
    assert bad <= 20


def test_rules_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, None), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    m = quality_rules.measure_documents(odd)
    out = quality_rules.judge(m, quality_rules.fit_cutoffs(m, labels)).collect()
    assert len(out) == odd.count() and all(r.base_failed for r in out if r.n_words < 50)
    assert all(r.kept == (not r.base_failed) for r in out)  # too few labels: no cutoff
    clash = odd.withColumn("N_Words", F.lit("x")).withColumn("kept", F.lit(1))
    assert quality_rules.filter_documents(clash, labels).columns == clash.columns
    assert quality_rules.filter_documents(none, labels).count() == 0
    assert quality_rules.filter_documents(odd, labels.limit(0)).count() == sum(not r.base_failed for r in out)


def test_rules_turn_junk_away(spark):
    good = [(i, f"plain words number {i} here " * 4 + " ".join(f"w{i}x{j}" for j in range(80)), "en") for i in range(0, 3000)]
    junk = [(10_000 + i, " ".join(f"a{i}b{j}%%%###" for j in range(80)), "en") for i in range(300)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string").where("doc_id < 10000 OR doc_id >= 0")
    labels = spark.createDataFrame([(i, int(i < 10_000)) for i, *_ in good + junk if i % 2 == 0 or i < 10_000], "doc_id long, quality int")
    m = quality_rules.measure_documents(docs)
    out = quality_rules.judge(m, quality_rules.fit_cutoffs(m, labels))
    got = {r.doc_id: (r.kept, r.base_failed) for r in out.collect()}
    assert not any(k for i, (k, _) in got.items() if i >= 10_000)
    assert all(k or b for i, (k, b) in got.items() if i < 10_000)


@pytest.fixture(scope="module")
def piece_model():
    return sentencepieces.model_path()


def test_pieces_equal_the_library(spark, odd, none, odd_rows, piece_model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    rows = sentencepieces.encode_documents(odd, piece_model).collect()
    assert rows[0].asDict().keys() >= {"doc_id", "text", "ids", "decoded"}
    for r in rows:
        want = sp.encode(r.text or "")
        assert r.ids == want and r.decoded == (sp.decode(want) if want else "")
    digest = sentencepieces.digest_documents(odd, piece_model, keep=["doc_id"]).collect()
    assert sorted(r.ids_sha256 for r in digest) == sorted(hashlib.sha256(",".join(map(str, sp.encode(t or ""))).encode()).hexdigest() for _, t, *_ in odd_rows)
    assert sentencepieces.encode_documents(none, piece_model).count() == 0
    clash = odd.withColumn("IDS", F.lit(1))
    assert sentencepieces.encode_documents(clash, piece_model).columns.count("ids") == 1


def test_small_chunk_table_changes_nothing(monkeypatch, piece_model, odd_rows):
    texts = [t for _, t, *_ in odd_rows]
    whole = [x.tolist() for x in sentencepieces.ChunkEncoder(piece_model).encode_all(texts)]
    for name, value in (("TABLE_CHUNKS", 3), ("LONGEST_REMEMBERED", 4), ("GROUP_CHARS", 10), ("JOINED_CHARS", 9)):
        monkeypatch.setattr(sentencepieces, name, value)
    assert [x.tolist() for x in sentencepieces.ChunkEncoder(piece_model).encode_all(texts)] == whole


def test_shards_read_back(spark, odd, none, odd_rows, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_shards.tokenizer_path())
    path = f"file://{tmp_path}/shards"
    token_shards.write_shards(odd, path, token_shards.tokenizer_path(), partitions=3)
    got = [tuple(r) for r in token_shards.read_back(spark, path).orderBy("start").collect()]
    start, want = 0, []
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for d, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [token_shards.END_ID]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sorted((str(g[0]), *g[2:]) for g in got) == sorted((str(w[0]), *w[1:]) for w in want)
    for g in got:
        assert g[1] == start
        start += g[2]
    assert len(token_shards.lookup(spark, path, 5)) == 2 and token_shards.lookup(spark, path, 6) == []
    ids = token_shards.lookup(spark, path, 9)[0]
    assert t.decode(ids[:-1].tolist()) == dict((r[0], r[1]) for r in odd_rows)[9]
    empty = f"file://{tmp_path}/empty"
    token_shards.write_shards(none, empty, token_shards.tokenizer_path())
    assert token_shards.read_back(spark, empty).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.unique(np.random.default_rng(3).integers(-(2**62), 2**62, 5000)).view(np.uint64)
    mph = token_shards.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    again, _ = token_shards.PerfectHash.load(memoryview(mph.dump()))
    assert (again.slots(keys) == mph.slots(keys)).all()
    own = np.sort(keys.view(np.int64))
    index = token_shards.Index.load(token_shards.Index.build(own, 0, np.ones(len(own), np.int64)).dump())
    assert index.find(own)[1].all()
    assert not index.find(np.arange(1000))[1].any()
    assert index.bounds[index.find(own)[0]].tolist() == list(range(len(own)))


def test_shard_reads_only_the_bytes_of_its_document(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(500)], "doc_id long, text string")
    token_shards.write_shards(docs, path, token_shards.tokenizer_path(), partitions=1)
    (row,) = token_shards.directory(spark, path).collect()
    shard = token_shards.Shard(row.stem)
    reads, real = [], shard.ids

    class Watched:
        def read_at(self, n, at):
            reads.append(n)
            return real.read_at(n, at)

    shard.ids = Watched()
    (ids,) = shard.get(340)
    assert reads == [2 * len(ids)] and len(ids) > 1  # the vocabulary fits 16 bits
    assert shard.get(10_000) == [] and len(reads) == 1


def test_piecewise_tokens_equal_the_library():
    import random

    from tokenizers import Tokenizer

    e, t = token_shards.ChunkTokenizer(token_shards.tokenizer_path()), Tokenizer.from_file(token_shards.tokenizer_path())
    rng, parts = random.Random(5), [" ", "  ", "\n", "\t", "a", "The", "é", "　", "'s", "<|endoftext|>", "日本", "\r", "🙂", "12", ".", "'", "ll", "²", "Ж", "½x", "<|", "\x1c", "\x85", "​"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(next(e.encode_all([s])), f"<u{e.width}").tolist() == t.encode(s, add_special_tokens=False).ids


def test_classifier_learns_and_handles_odd_rows(spark, odd, none):
    rows = [(i, ("good calm text about rivers " if i % 2 else "BUY!! NOW!! %%% ") * 6 + f"n{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    out = quality_classifier.score_documents(docs, model).withColumn("out", quality_classifier.held_out()).collect()
    held = [r for r in out if r.out]
    assert 40 < len(held) < 120 and all(r.predicted == r.doc_id % 2 for r in held)
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    rest = quality_classifier.score_documents(odd, model).collect()
    assert len(rest) == odd.count() and all(0 <= r.score <= 1 for r in rest)
    flat = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score_documents(odd, flat).collect()} == {0.5}
    assert quality_classifier.score_documents(none, model).count() == 0


def test_training_equals_a_plain_pass():
    """Follow-the-regularised-leader one coordinate at a time, in plain numbers."""
    import math
    import random

    rng = random.Random(2)
    texts = [(i % 2, " ".join(rng.choice(["calm", "river", "good", "buy", "now", "!!"][3 * (i % 2 == 0) :][:4]) for _ in range(12))) for i in range(60)]
    rows = [(y, *quality_classifier.vector(t)) for y, t in texts]
    z, n = {}, {}
    a, b, l1, l2 = quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1, quality_classifier.L2

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((b + math.sqrt(n.get(i, 0.0))) / a + l2)

    for _ in range(quality_classifier.EPOCHS):
        for y, index, value in rows:
            w = {i: weight(i) for i in index.tolist()}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(index.tolist(), value.tolist(), strict=True))))
            for i, v in zip(index.tolist(), value.tolist(), strict=True):
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / a * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = quality_classifier.train(rows).weights
    assert len(z) > 10 and set(np.flatnonzero(got).tolist()) == {i for i in z if weight(i)}
    assert all(abs(got[i] - weight(i)) < 1e-4 for i in z)


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = [(i, f"text {i} of {'good' if i % 3 else 'bad'} kind") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = [(i, int(i % 3 > 0)) for i, _ in rows]
    two = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in one]
    a, b = (quality_classifier.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")).weights for x in (one, two))
    assert (a == b).all()


def test_batches_are_cut_without_loss():
    import pyarrow as pa

    from assayer.llm.common import pieces

    b = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 101)], names=["t"])
    cut = list(pieces([b], 10_000))
    assert len(cut) > 9 and sum(x.num_rows for x in cut) == 101
    assert [x.num_rows for x in pieces([b.slice(0, 0)])] == [0]
