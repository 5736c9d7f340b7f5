"""The five stages against plain versions of them, on a small corpus with planted cases."""

import hashlib
import random

import pytest
from helpers import components, deduplicated, leaked, prose
from tokenizers import Tokenizer

import corpus_pipeline
from pulselake.llm import quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    items = [prose(900 + i, 25) for i in range(4)]
    shared = [prose(800 + i, 8) for i in range(3)]
    texts = []
    for i in range(120):
        lines = [prose(i, 30), prose(1000 + i, 25)]
        if i % 4 == 0:
            lines.insert(rng.randint(0, 2), rng.choice(shared))
        if i % 17 == 0:
            lines.append(items[i % 4])
        texts.append("\n".join(lines))
    texts += [texts[3], texts[5].replace(" ", "  ", 3), texts[9].rsplit(" ", 1)[0] + " altered"]  # copies and a near copy
    texts += ["### " + " ".join(w + "%%%" for w in prose(i, 40).split(" ")) for i in range(60)]  # junk
    texts += [None, ""]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(not (t or "").startswith("###")), 0) for i, t in enumerate(texts) if t], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, items


def test_pipeline_matches_plain_stages(spark, corpus):
    path, texts, items = corpus
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = [(r.doc_id, texts[r.doc_id]) for r in quality.grade_documents(docs, labels).collect() if r.predicted == 1]
    assert not any((t or "").startswith("###") for _, t in rows) and len(rows) >= 115
    rows = [(i, t) for i, (_, t) in deduplicated(rows).items()]
    same = components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if same[i] == i]
    rows = [(i, t) for i, t in rows if not any(leaked(t, x) >= 0.8 for x in items)]
    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_the_columns(spark, corpus):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_stages_take_empty_tables(spark, corpus):
    path, _, _ = corpus
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0
