import corpus_pipeline
import pytest

from tessera.llm import toxicity
from tessera.llm.common import materialize, read
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_simhash import brute_groups, brute_print
from tests.llm.test_tokens import WORDS, check_pieces, plain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs, docs := materialize(stage(spark, docs, SF), name)))
    return {name: (before.collect(), after.collect(), before, after) for name, before, after in out}


def test_columns(spark, stages):
    for name, (_, after, frame, result) in stages.items():
        assert after
        assert name == "packing" or result.columns == frame.columns


def test_toxicity(spark, stages):
    before, after, frame, _ = stages["toxicity"]
    model = toxicity.train(frame, read(spark, SF, "labels"))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, model.score([r.text for r in before])) if s < 0.7)


def test_line_dedup(stages):
    before, after, *_ = stages["line_dedup"]
    assert sorted(((r.doc_id, r.text) for r in after), key=str) == lines([(r.doc_id, r.text) for r in before])


def test_near_dedup(stages):
    before, after, *_ = stages["near_dedup"]
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in brute_groups([(r.doc_id, brute_print(r.text)) for r in before])})


def test_decontamination(spark, stages):
    before, after, *_ = stages["decontamination"]
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    hit = {d for d, _, h, _ in windows([(r.doc_id, r.text) for r in before], items, 10) if h}
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if r.doc_id not in hit) and hit


def test_packing(stages):
    before, after, *_ = stages["packing"]
    check_pieces(after, before, 4096, plain(WORDS))
