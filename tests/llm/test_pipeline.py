"""The pipeline's stages, one by one and together."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.test_simhash import slow_components, texts_with_copies
from tests.llm.texts import FOLDER, ODD, SCHEMA, documents, empty, present
from tipoff.limits import Limits
from tipoff.llm.common import table
from tipoff.llm.quality_gam import score_quality
from tipoff.llm.simhash import fingerprint

COLUMNS = SCHEMA.names


@pytest.fixture
def folder(spark, tmp_path):
    """A folder with awkward documents and a few labels."""
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(len(ODD))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_are_those_asked_for():
    assert [f.__name__ for _, f in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "sequences"]


@pytest.mark.parametrize("name,stage", pipeline.STAGES[:-1])
def test_columns_stay_and_nothing_gives_nothing(spark, folder, name, stage):
    docs = documents(spark, extra=True)
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns and out.count() >= 0
    assert stage(spark, empty(spark), folder).count() == 0


@pytest.mark.parametrize("limits", [pipeline.LIMITS, Limits(group_rows=20, block_rows=7, broadcast_rows=0, match_rows=5)])
def test_one_document_of_each_group_stays(spark, monkeypatch, limits):
    monkeypatch.setattr(pipeline, "LIMITS", limits)
    texts = texts_with_copies()
    prints = [fingerprint(t) for t in texts]
    classes = slow_components(set(prints))
    smallest = {}
    for i, p in enumerate(prints):
        smallest.setdefault(classes[p], i)
    kept = pipeline.near_duplicates(spark, documents(spark, texts), None).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted((i, texts[i] or "") for i in smallest.values())


def test_ids_may_be_missing(spark):
    rows = [(None, "some words here", None, "a", None), (None, "other words there now", None, "a", None), (7, "some words here", None, "a", None)]
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), None).collect()
    assert len(kept) == 2


@pytest.mark.skipif(not present, reason="driver tables not present")
def test_whole_run(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    good = {r.doc_id for r in score_quality(docs, labels).where("predicted = 1").collect()}
    stages, frames = dict(zip("quality lines near mix".split(), pipeline.STAGES)), {}
    for name, (_, stage) in stages.items():
        docs = pipeline.materialize(stage(spark, docs, FOLDER))
        assert docs.columns == COLUMNS
        frames[name] = docs.collect()
    assert {r.doc_id for r in frames["quality"]} == good
    assert sorted(r.doc_id for r in frames["lines"]) == sorted(r.doc_id for r in frames["quality"])
    near = {r.doc_id for r in frames["near"]}
    assert len(near) == len(frames["near"]) and near <= good
    prints = [fingerprint(r.text) for r in frames["near"]]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    mixed = Counter(r.doc_id for r in frames["mix"])
    assert set(mixed) <= near and max(mixed.values()) <= 2
    rows = pipeline.run(spark, FOLDER).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in frames["mix"]}
    covered = defaultdict(int)
    for r in rows:
        ids = np.array([*library.encode(text[r.doc_id], add_special_tokens=False).ids, 1], dtype="<u4")
        part = ids[r.start:r.start + r.length]
        assert bytes(r.ids) == part.tobytes() and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        covered[r.doc_id] += r.length
        assert r.doc_tokens == len(ids)
    assert {d: n / len(library.encode(text[d], add_special_tokens=False).ids + [1]) for d, n in covered.items()} == {
        d: float(n) for d, n in mixed.items()
    }


def test_near_duplicate_stage_keeps_extra_columns(spark):
    import corpus_pipeline
    from tests.llm.test_clashes import named, same_extras
    from tests.llm.texts import ODD, documents

    docs = named(documents(spark, ODD))
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    same_extras(found, docs.columns)
    plain = corpus_pipeline.near_duplicates(spark, documents(spark, ODD), "")
    assert sorted(r[0] for r in found.collect()) == sorted(r[0] for r in plain.collect())
