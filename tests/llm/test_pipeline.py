"""The pipeline's stages on a small corpus, each against a plain version of what it must do."""

import random

import corpus_pipeline
from tests.llm.test_jaccard import brute as components
from tests.llm.test_repeats import brute as cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(9)
    vocab = [f"wo{i}rd" for i in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = say(60)
    rows = [(i, say(r.randint(60, 200))) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    rows += [(210 + i, rows[10 + i][1].replace("wo1rd", "other", 1)) for i in range(5)]
    rows += [(220 + i, f"{say(80)} {passage} {say(80)}") for i in range(6)]
    junk = [(300, "#$% " * 100), (301, ""), (302, None), (303, "a b c " * 40), (304, " ".join(w + "###" for w in say(120).split()))]
    return rows, junk


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_stages_in_order(spark):
    rows, junk = corpus()
    docs = frame(spark, rows + junk).repartition(4)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows}
    left = stages["n-gram Jaccard join"](spark, kept, "")
    roots = components(rows)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, c in roots.items() if i == c}
    single = [(r.doc_id, r.text) for r in left.collect()]
    clean = stages["suffix-array dedup"](spark, left, "")
    want = {i: x[4].decode("utf-8", "ignore") for i, x in cut(single).items()}
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()} == want
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    packed = stages["packing"](spark, clean, "").collect()
    assert {r.doc_id for r in packed} == set(want)


def test_run_is_the_stages(spark, tmp_path):
    rows, junk = corpus()
    frame(spark, rows + junk).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} <= {i for i, _ in rows} and got.count() > 100


def test_empty_corpus(spark):
    docs = frame(spark, [])
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, "")
        assert docs.count() == 0
