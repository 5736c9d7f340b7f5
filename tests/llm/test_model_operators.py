"""Tokens, classifiers, language model, vector search: round trips, brute force, held-out accuracy."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulselake.llm import ann, bpe, langid, ngramlm, quality, queries, tokenstore, toxicity
from pulselake.llm.sparse import bounded, fitted, training_sample

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n", "a", "ÉÀ ß 日本 😀", "x" * 300, "=" * 2000, "a\x1cb c", "İΣ ΑΣ", "don't <|endoftext|> we're", "<|startoftext|>", "two  spaces \n and\tmore ", "word " * 3000]


def test_word_bpe_equals_the_library(spark):
    path = queries.vocabulary("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.codec(path)
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abeinorst'é! 09\n") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_tables(spark):
    path = queries.vocabulary("word_bpe_49k.json")
    docs = documents(spark, ODD)
    ids = bpe.encode_documents(docs, path)
    text = {r.doc_id: r.text for r in bpe.decode_documents(ids, path).collect()}
    digest = {r.doc_id: r for r in bpe.digest_documents(docs, path, with_ids=True).collect()}
    assert len(text) == len(digest) == len(ODD)
    for r in ids.collect():
        assert digest[r.doc_id].n_tokens == len(r.ids) and digest[r.doc_id].ids == r.ids
        assert hashlib.sha256(text[r.doc_id].encode()).hexdigest() == digest[r.doc_id].decoded_sha256
    assert bpe.digest_documents(documents(spark, []), path).count() == 0


def test_token_store_round_trip(spark, tmp_path):
    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(7 * i % 101, t) for i, t in enumerate(ODD + [prose(i, 50) for i in range(60)])]
    tokenstore.write(documents(spark, rows), f"{tmp_path}/store", path, 2)
    got = {r.doc_id: r for r in tokenstore.read(spark, f"{tmp_path}/store").collect()}
    start = 0
    for i, t in sorted(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    want = library.encode(dict(rows)[7], add_special_tokens=False).ids + [2]
    assert [x.tolist() for x in tokenstore.lookup(spark, f"{tmp_path}/store", 7)] == [want]
    name = {r.dictionary_hash for r in spark.read.parquet(f"{tmp_path}/store/segments").collect()}
    assert name == {spark.read.parquet(f"{tmp_path}/store/dictionary").first().hash}


def test_token_store_odd_tables(spark, tmp_path):
    path = queries.vocabulary("byte_bpe_50k.json")
    tokenstore.write(documents(spark, []), f"{tmp_path}/none", path, 2)
    assert tokenstore.read(spark, f"{tmp_path}/none").count() == 0
    twice = spark.createDataFrame([(3, "same", 1), (3, "other", 2), (None, "x", 3)], "doc_id long, text string, start int")
    tokenstore.write(twice, f"{tmp_path}/twice", path, 2)
    assert sorted((r.doc_id is None, r.start) for r in tokenstore.read(spark, f"{tmp_path}/twice").collect())[-1] == (True, 0)


def _fold(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [_fold(i, 3) == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_odd_rows(spark):
    model = langid.LanguageModel([prose(i, 30) for i in range(10)] + ["öüß " * 30] * 10, ["en"] * 10 + ["de"] * 10)
    lang, score = model.predict(pa.array([None, "", "123 !!", "öüß"], pa.string()))
    assert lang[:3] == ["und"] * 3 and score[:3].tolist() == [0, 0, 0] and lang[3] == "de"
    assert langid.LanguageModel([], []).predict(pa.array(["abc"]))[0] == ["und"]
    assert langid.LanguageModel(["a b"], ["xx"]).predict(pa.array(["abc"]))[0] == ["xx"]
    assert langid.identify(documents(spark, [])).count() == 0


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.grade_documents(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert (got.held_out == [_fold(i, 5) == 0 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.grade_documents(documents(spark, ODD), none).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    one = quality.QualityModel(["a b c"] * 3 + ["!!! ???"] * 3, [1] * 3 + [0] * 3, epochs=40)
    s = one.score(pa.array(["a b c", "!!! ???", "", None], pa.string()))
    assert s[0] > s[1] and s[2] == s[3] == 1 / (1 + np.exp(-one.bias))


def test_toxicity_grades(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.grade_documents(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    clean = got[got.held_out & (got.label == 0)]
    assert len(clean) and got.severity.between(0, 1).all() and clean.toxic.mean() < 0.05


def test_ordered_thresholds_share_weights():
    rng = random.Random(3)
    texts, grades = [], []
    for i in range(600):
        g = rng.randrange(4)
        texts.append(prose(i % 7, 30) + " bad" * (g >= 1) + " worse" * (g >= 2) + " worst" * (g >= 3))
        grades.append(g)
    m = toxicity.SeverityModel(texts, grades)
    assert len(m.cuts) == 3 and (np.diff(m.cuts) > 0).all()
    s = m.severity(pa.array([prose(1, 30), prose(1, 30) + " bad", prose(1, 30) + " bad worse", prose(1, 30) + " bad worse worst", None, ""], pa.string()))
    assert s[0] < s[1] < s[2] < s[3] and abs(s[3] - 3) < 0.5 and s[4] == s[5]
    assert toxicity.SeverityModel(["a"], [0]).severity(pa.array(["b"])).tolist() == [0.0]


def _brute(rows):
    toks = {i: [*(t or "").encode().lower().split(), b"\0"] for i, t in rows}
    c = Counter(w for i, t in toks.items() if _fold(i, 10) for w in t)
    n, v = sum(c.values()), len(c)
    return {i: (len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in toks.items()}


def test_language_model_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngramlm, "BLOCK_BYTES", 2000)
    rows = [(i, prose(i % 9, 40, 60)) for i in range(120)] + [(500 + i, t) for i, t in enumerate(ODD)]
    got = {r.doc_id: r for r in ngramlm.score_documents(documents(spark, rows)).collect()}
    want = _brute(rows)
    assert len(got) == len(rows)
    for i, (k, known, n, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (k, known, n, _fold(i, 10) == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score)
    held = [i for i in got if got[i].held_out and i < 500]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_mixture_weight():
    assert ngramlm.maximise(np.array([8.0, 0.0]), np.array([90, 10])) > 0.8
    assert ngramlm.maximise(np.array([0.5]), np.array([10])) < 0.01


def test_language_model_odd_tables(spark):
    assert ngramlm.score_documents(documents(spark, [])).count() == 0
    got = ngramlm.score_documents(spark.createDataFrame([(None, "a b", 1), (None, None, 2)], "doc_id long, text string, score int")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3] and all(r.train_tokens == 0 and r.base_score == 0 for r in got)


def _vectors(spark, x, ids=None):
    rows = [(int(i), None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def test_search_recall_and_exact_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = e.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    got = ann.search(e).toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        others = ids != q
        best = ids[others][np.lexsort((ids[others], d[others]))[:10]]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own.score, [d[ids == v][0] for v in own.vec_id]) and own.score.is_monotonic_increasing
        hits, total = hits + len(set(best) & set(own.vec_id)), total + 10
    assert hits / total >= 0.9


def test_search_ties_and_bad_vectors(spark):
    same = [[1.0, 2.0, 3.0, 4.0]] * 40
    bad = [None, [0.0] * 4, [1.0, None, 3.0, 4.0], [1.0, float("nan"), 1.0, 1.0], [1.0, 2.0]]
    got = ann.search(_vectors(spark, same + bad)).toPandas()
    assert got.query_id.unique().tolist() == [0] and sorted(got.vec_id) == list(range(1, 11)) and (got.score == 0).all()
    few = ann.search(_vectors(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])).toPandas()
    assert sorted(few.vec_id) == [1, 2]
    assert ann.search(_vectors(spark, [])).count() == 0 and ann.search(_vectors(spark, bad)).count() in (0, 1)


def test_training_sample_is_bounded(spark, monkeypatch):
    docs = documents(spark, [prose(i, 5) for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, 1), (6, None)], "doc_id long, quality int")
    got = training_sample(docs, labels, "quality", F.lit(True), 100).toPandas()
    assert 50 < len(got) <= 100 and got.doc_id.is_unique
    assert fitted(training_sample(docs, labels, "quality", F.lit(True), 100), len) == len(got)
    twice = documents(spark, [(i % 2, prose(i % 7, 5)) for i in range(20_000)])
    got = training_sample(twice, labels, "quality", F.lit(True), 1000).toPandas()
    assert sorted(got.doc_id) == [0, 1]  # repeats go before anything is gathered
    rows = docs.withColumn("draw", F.col("doc_id"))
    few = bounded(rows, 100, max_bytes=200).toPandas()
    assert 0 < len(few) < 20 and few.text.map(len).sum() <= 200
    assert bounded(rows.where("false"), 100).count() == 0 and fitted(rows.where("false"), len) == 0
    nulls = documents(spark, [(None, "the very same text here")] * 2000 + [(None, prose(i, 20)) for i in range(50)])
    assert tokenstore.train_dictionary(nulls, queries.vocabulary("byte_bpe_50k.json"), 2)
    assert tokenstore.train_dictionary(documents(spark, []), queries.vocabulary("byte_bpe_50k.json"), 2) == b"\x02\0\0\0" * 2
