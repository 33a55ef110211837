"""The pipeline's stages against plain Python, and the guard around this folder."""

from collections import Counter

import corpus_pipeline
from tabloom.llm import bpe
from test_dedup import components
from test_mixing_and_sharding import WORD
from test_text_rules import counts


def run_stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], "unused").cache())
    return out


def test_stages(spark, docs, cases):
    steps = run_stages(spark, docs)
    assert [len(name) > 0 for name, _ in corpus_pipeline.STAGES] == [True] * 5
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [[(r["doc_id"], r["text"]) for r in s.collect()] for s in steps]
    want = [(i, t) for i, t, _ in cases if not counts(t)[-1]]
    assert Counter(rows[1]) == Counter(want)
    best = {}
    for i, t in want:
        best[t] = max((x for x in (best.get(t), i) if x is not None), default=None)
    want = [(i, t) for t, i in best.items()]
    assert Counter(rows[2]) == Counter(want)
    stay = {i for i, _, c in components(want) if c in (i, None)}
    assert Counter(rows[3]) == Counter((i, t) for i, t in want if i in stay)
    whole = {i: WORD.findall(t) for i, t in rows[3]}
    taken = Counter()
    for i, t in rows[4]:
        words = WORD.findall(t)
        taken[i] += len(words)
        assert set(words) <= set(whole[i])
    assert all(n <= 3 * len(whole[i]) for i, n in taken.items())
    coder = bpe.Codec()
    for r in steps[5].collect():
        assert coder.decode(r["ids"]) == r["text"].encode()
    assert len(rows[5]) == len(rows[4])


def test_near_copies_by_five_words(spark):
    """0.81 alike by four words and 0.77 by five: both stay."""
    words = [f"w{k}" for k in range(80)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:25], "x", *words[26:55], "y", *words[56:]]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, frame, "unused").collect()} == {1, 2}


def test_run_over_the_table(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert out.columns == [*source.columns, "ids"] and 0 < out.count() < 3 * source.count()


def test_empty_table(spark, nothing):
    assert run_stages(spark, nothing)[-1].count() == 0
