"""The pipeline stage by stage against plain Python, each on its predecessor's rows."""

import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ledgerloom.llm import mixing, pieces, quality  # noqa: E402

from .test_ops import DOC, ROWS, base, counts, jaccard_classes, prose  # noqa: E402


def mask(text):
    out, at = [], 0
    for a, e, k in sorted((a, e, k) for k, a, e in base(text)):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows = ROWS + [(300 + i, prose(90) + f" write to me{i}@mail.example.com or 10.1.2.{i}", "en", "ab"[i % 2], 1) for i in range(30)]
    docs, out = spark.createDataFrame(rows, DOC), []
    folder = tmp_path_factory.mktemp("stages")
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, None).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return out


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_quality_stage(spark, stages):
    before, after = stages[0], stages[1]
    kept = {r["text"] for r in quality.rate(spark.createDataFrame(before, DOC)).where("kept").collect()}
    assert bag(after) == bag(r for r in before if r["text"] in kept)
    assert all(not counts(r["text"])[-1] for r in after)


def test_jaccard_stage(stages):
    before, after = stages[1], stages[2]
    assert not bag(after) - bag(before)
    classes = {c for _, n, c in jaccard_classes([tuple(r) for r in before]) if n}
    assert len(after) == len(classes)
    assert len({c for _, n, c in jaccard_classes([tuple(r) for r in after]) if n}) == len(after)


def test_redacting_stage(stages):
    before, after = stages[2], stages[3]
    want = [(r["doc_id"], mask(r["text"]), r["lang"], r["source"], len(mask(r["text"])) if base(r["text"]) else r["n_chars"]) for r in before]
    assert bag(after) == collections.Counter(want)
    assert any("<EMAIL>" in r["text"] for r in after)


def test_mixing_stage(spark, stages):
    before, after = stages[3], stages[4]
    copies = {tuple(r[:5]): r["copies"] for r in mixing.mix(spark.createDataFrame(before, DOC)).collect()}
    assert bag(after) == collections.Counter({k: n for k, n in copies.items() if n})


def test_encoding_stage(stages):
    own = pieces.lattice(pieces.default_model(), pieces.ALPHA)
    import numpy as np

    assert len(stages[5]) == len(stages[4])
    assert all(own.decode(np.array(r["pieces"])).decode() == r["text"] for r in stages[5])


def test_whole_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "pieces", "n_pieces"] and out.count() > 0
