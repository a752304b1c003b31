"""The pipeline's stages, each against its own input."""

import re

import pytest

import corpus_pipeline as cp
from millrace.llm import mixing, pii, simhash
from millrace.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf001, tmp_path_factory):
    """(input, output) of each stage, written as Parquet and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, sf001, "documents"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf001).write.parquet(str(folder / str(k)))
        after = spark.read.parquet(str(folder / str(k)))
        out[name], docs = (docs, after), after
    return out


def test_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "simhash", "pii", "mixing", "packing"]
    for name, (_, after) in stages.items():
        assert name == "packing" or after.columns == COLUMNS


def test_quality_keeps_clean(spark, sf001, stages):
    before, after = stages["quality"]
    labels = table(spark, sf001, "labels")
    good = before.join(labels.where("quality = 1"), "doc_id").count()
    kept = after.join(labels.where("quality = 1"), "doc_id").count()
    bad = after.join(labels.where("quality = 0"), "doc_id").count()
    assert kept >= 0.95 * good and bad <= 2


def test_one_of_each_group_stays(stages):
    before, after = stages["simhash"]
    groups = {r.component_id for r in simhash.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(groups)


def test_personal_data_goes(stages):
    before, after = stages["pii"]
    texts = {r.doc_id: r.text for r in before.collect()}
    marked = 0
    for r in after.collect():
        assert not pii.base_spans(re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", " ", r.text)) or pii.base_spans(texts[r.doc_id])
        assert r.n_chars == len(r.text)
        marked += r.text != texts[r.doc_id]
        if not pii.base_spans(texts[r.doc_id]) and not re.search("[0-9@]", texts[r.doc_id]):
            assert r.text == texts[r.doc_id]
    assert marked > 0


def test_mixing_and_packing(stages):
    before, mixed = stages["mixing"]
    want = {r.doc_id: r.copies for r in mixing.mix_counts(before).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == want
    packed = stages["packing"][1]
    assert packed.count() == mixed.count()
    assert packed.groupBy("bucket", "batch_id", "slot").count().where("count > 1").count() == 0


def test_run(spark, sf001, stages):
    assert sorted(map(tuple, cp.run(spark, sf001).collect())) == sorted(map(tuple, stages["packing"][1].collect()))


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stage_on_odd_rows(spark, sf001, odd_docs, name):
    stage = dict(cp.STAGES)[name]
    out = stage(spark, odd_docs, sf001)
    rows, before = out.collect(), odd_docs.collect()
    empty = stage(spark, odd_docs.limit(0), sf001)
    assert empty.count() == 0 and empty.columns == out.columns
    if name == "packing":
        assert len(rows) == len(before) and all(r.padding == r.bucket_len - r.n_tokens for r in rows)
        return
    assert out.columns == odd_docs.columns and all(r[c] == "clash" for r in rows for c in ("score", "fp", "held"))
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    if name == "quality":
        assert {tuple(r) for r in rows} <= {tuple(r) for r in before}
        assert sum(r.doc_id == 6 for r in rows) in (0, 2) and len({r.doc_id in {x.doc_id for x in rows} for r in before if r.doc_id in (1, 2, 3)}) == 1
    elif name == "simhash":
        assert ids == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0)]
    elif name == "pii":
        assert len(rows) == len(before) and {r.doc_id: r.text for r in rows}[1] is None
    else:
        assert {tuple(r) for r in rows} <= {tuple(r) for r in before}
        per = {r.doc_id: sum(x.doc_id == r.doc_id for x in rows) for r in before}
        assert per[6] % 2 == 0 and max(per.values()) <= 6


def test_stages_over_nothing(spark, sf001, odd_docs):
    docs = odd_docs.limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf001)
    assert docs.count() == 0
