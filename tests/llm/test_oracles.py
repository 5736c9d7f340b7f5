"""The queries' SQL on rows that the given tables lack, and fitted models recomputed naively."""

import math
import random
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from helpers import documents, prose

from pulselake.llm import bpe, decontam, langid, ngramlm, quality, queries, setjoin, toxicity

SF = "/root/testdata/sf0.01"


def sql(name, **tables):
    con = duckdb.connect()
    for table, rows in tables.items():
        con.register(table, pd.DataFrame(rows, columns=["doc_id" if table == "documents" else "item_id", "text"]))
    return con.execute(queries.ORACLE_SQL[name]).fetchall()


def test_decontamination_sql_tries_every_start(spark):
    """Halves swapped, the last words cut, the first words moved to the end, a short item, inside other text and alone."""
    rng = random.Random(3)
    items = [prose(50 + i, n, 5000) for i, n in enumerate((60, 60, 94, 100, 12))] + ["one two three", "word"]
    w = [x.split(" ") for x in items]
    half = lambda x: x[len(x) // 2 :] + x[: len(x) // 2]
    variants = [half(w[0]), w[1][:-2], half(w[2]), w[3][:50] + w[3][51:], w[0][15:] + w[0][:15], w[4][:-1], ["one", "two", "three"], w[1], w[1][:30] + ["new", "words"] + w[1][30:]]
    texts = [" ".join(v) for v in variants]
    texts += [prose(200 + i, 40, 5000) + " " + " ".join(v) + " " + prose(300 + i, 40, 5000) for i, v in enumerate(variants)]
    texts += [prose(400 + i, 80, 5000) for i in range(5)] + ["", " ... ", rng.choice(texts)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 6)) for r in decontam.leaks(documents(spark, texts), bench).collect())
    want = sorted(sql("op1_decontamination", documents=list(enumerate(texts)), benchmark=list(enumerate(items))))
    assert got == want
    assert {(0, 0), (1, 1), (2, 2), (3, 3), (9, 0), (10, 1), (6, 5)} <= {x[:2] for x in got}


def test_jaccard_sql_on_chains_and_odd_texts(spark):
    base = prose(7, 120, 900).split(" ")
    chain = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in (3, 40, 80, 119)] + [" ".join(base)]
    texts = [*chain, "", None, "a b", "A  B", "a b c d", " ".join(base).upper(), prose(8, 60), prose(9, 60), prose(8, 60) + " tail"]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.join_components(documents(spark, texts), width=4, percent=85).collect())
    assert got == sorted(sql("op2_ngram_jaccard_join", documents=list(enumerate(texts))))
    assert len({c for _, _, c in got}) < len(texts)


def _sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_language_model_score_by_hand(spark, monkeypatch):
    """Deleted interpolation from plain counters: estimates, buckets, weights by expectation-maximisation, final sums."""
    monkeypatch.setattr(ngramlm, "BLOCK_BYTES", 3000)
    rows = [(i, prose(i % 13, 60, 40)) for i in range(150)] + [(150 + i, prose(700 + i, 25, 80)) for i in range(60)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    tokens = {i: [*t.split(" "), "\0"] for i, t in rows}

    def counts(keep):
        word, pair, context = Counter(), Counter(), Counter()
        for i, t in tokens.items():
            if keep(fold(i)):
                word.update(t)
                pair.update(zip(["^", *t], t, strict=False))
                context.update(["^", *t[:-1]])
        return word, pair, context, sum(word.values()), len(word)

    def estimates(i, model):
        word, pair, context, n, v = model
        for before, w in zip(["^", *tokens[i]], tokens[i], strict=False):
            seen = context[before]
            yield seen.bit_length(), pair[before, w] / max(seen, 1), (word[w] + 0.1) / (n + 0.1 * (v + 1))

    held: dict[int, list] = {}
    kept = counts(lambda f: f > 1)
    for i in tokens:
        if fold(i) == 1:
            for bucket, own, base in estimates(i, kept):
                held.setdefault(bucket, []).append(own / base)
    weight = [0.0] * 24
    for b in range(1, 24):
        weight[b] = weight[b - 1]
        if b in held:
            x = 0.5
            for _ in range(200):
                x = sum(x * r / (x * r + 1 - x) for r in held[b]) / len(held[b])
            weight[b] = min(x, 1 - 1e-6)
    final = counts(lambda f: f > 0)
    want = {i: sum(math.log10(weight[b] * own + (1 - weight[b]) * base) for b, own, base in estimates(i, final)) for i in tokens}
    got = {r.doc_id: r.score for r in ngramlm.score_documents(documents(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=3e-3) for i in want)


def _labelled():
    docs = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by doc_id").fetchall()
    return docs, dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall()), dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())


TEXTS = ["the house", "Ein schönes Haus über der Straße", "la maison de l'été", "x", "", None, "123 !!!", "word " * 3000]


def test_language_votes_by_hand():
    docs, _, _ = _labelled()
    known = [(t, lang) for _, t, lang in docs if t and lang][:200]
    m = langid.LanguageModel([t for t, _ in known], [lang for _, lang in known])
    column = pa.array(TEXTS, pa.string())
    lang, score = m.predict(column)
    for text, a, s in zip(TEXTS, lang, score, strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (a, s) == ("und", 0.0)
            continue
        found, offsets = langid.grams(pa.array([text], pa.string()))
        margin = {n: sum(float(w[f]) for g in found for f in g.tolist()) / offsets[-1] + b for n, w, b in zip(m.columns, m.weights, m.bias, strict=True)}
        family = max(m.families, key=lambda f: margin["family", f])
        members = m.families[family]
        toward = lambda x, y: margin[family, x, y] if (family, x, y) in margin else -margin[family, y, x]  # noqa: E731,B023
        best = max(members, key=lambda x: sum((toward(x, y) > 0) + 1e-3 * math.tanh(toward(x, y)) for y in members if y != x))  # noqa: B023
        sure = max(_sigmoid(4 * margin["family", f]) for f in m.families)
        assert a == best and s == pytest.approx(sure * min([1.0, *(_sigmoid(4 * toward(best, y)) for y in members if y != best)]), rel=1e-3)


def test_severity_by_hand_and_recall(spark):
    docs, toxic, _ = _labelled()
    known = [(t, toxic[i]) for i, t, _ in docs if t and i in toxic]
    m = toxicity.SeverityModel([t for t, _ in known], [g for _, g in known])
    texts = [*TEXTS, *(t for t, g in known if g)][:20]
    weight = dict(zip(m.keys.tolist(), m.w.tolist(), strict=True))
    for text, got in zip(texts, m.severity(pa.array(texts, pa.string())), strict=True):
        own = set(toxicity._features(toxicity._words(pa.array([text], pa.string())))[1].tolist())
        score = sum(weight.get(h, 0.0) for h in own)
        want = m.grades[0] + sum((b - a) * _sigmoid(score - c) for a, b, c in zip(m.grades, m.grades[1:], m.cuts, strict=False))
        assert got == pytest.approx(want, rel=1e-6, abs=1e-9)
    rows = toxicity.grade_documents(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    bad = [r for r in rows if r.held_out and toxic.get(r.doc_id) == 1]
    assert len(bad) >= 3 and sum(r.toxic for r in bad) >= len(bad) / 2  # a model that never flags fails here


def test_quality_by_hand():
    docs, _, quality_of = _labelled()
    known = [(t, quality_of[i]) for i, t, _ in docs if t and i in quality_of][:150]
    m = quality.QualityModel([t for t, _ in known], [g for _, g in known])
    for text, got in zip(TEXTS, m.score(pa.array(TEXTS, pa.string())), strict=True):
        *found, _, _ = quality.hashed(pa.array([text], pa.string()))
        every = [f for g in found for f in g.tolist()]
        assert got == pytest.approx(_sigmoid(sum(float(m.table[f]) for f in every) / max(len(every), 1) + m.bias), rel=1e-3)
    good = [s for s, (_, g) in zip(m.score(pa.array([t for t, _ in known], pa.string())), known, strict=True) if g == 1]
    assert sum(s >= 0.5 for s in good) > 0.9 * len(good)


@pytest.mark.parametrize("op", ["op5", "op6", "op7", "op8", "op9"])
def test_repeated_rows_clashing_columns_and_long_texts(spark, op):
    """Repeated rows get equal results each; columns named like those inside change nothing; 3 MB of text stay whole."""
    long = ("lorem ipsum dolor sit amet " * 120_000)[:3_000_000]
    rows = [(i, prose(i, 40)) for i in range(40)] + [(3, prose(3, 40)), (None, prose(5, 20)), (50, long)]
    plain = documents(spark, rows)
    names = ["score", "held_out", "lang_pred", "predicted", "severity", "grade", "toxic", "quality", "n_tokens", "ids", "row", "block", "use", "draw", "key", "n", "words"]
    clash = plain.selectExpr("*", *[f"'x' as {c}" for c in names])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    run = {
        "op5": langid.identify, "op6": lambda d: toxicity.grade_documents(d, labels), "op7": lambda d: bpe.digest_documents(d, queries.vocabulary("word_bpe_49k.json")),
        "op8": lambda d: quality.grade_documents(d, labels), "op9": ngramlm.score_documents,
    }[op]
    seen = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    a, b = seen(run(plain)), seen(run(clash))
    assert a == b and len(a) == len(rows) and len(set(a)) == len(rows) - 1
