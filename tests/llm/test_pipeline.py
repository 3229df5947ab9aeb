"""Every stage of the corpus pipeline against a brute-force version, on a small corpus with nulls, repeats and shared ids."""

import os
import random

import corpus_pipeline
import pytest
import test_llm as plain
from cairnflow.llm import mixing, shared, toxicity
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, folder = random.Random(12), tmp_path_factory.mktemp("corpus")
    line, item = "a notice that stands at the end of many documents", plain.prose(77, 25)
    rows = [(i, plain.prose(i, 40) + (" nastyword" if i % 5 == 0 else "") + (f"\n{line}" if i % 3 == 0 else ""), f"s{i % 4}" if i % 7 else None) for i in range(150)]
    rows += [(200 + i, rows[i + 1][1], "s1") for i in range(0, 30, 2)] + [(300, rows[7][1].replace("alpha", "omega", 1), "s2"), (301, plain.prose(5, 9) + " " + item, "s0"), (302, item, "s3"), (11, "another text that shares an id", "s1"), rows[13], (None, "text without any id at all", None), (None, None, None), (303, "", "s0"), (304, None, "s1"), (None, item, "s0")]
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, "en", len(x[1] or ""), "x", 1) for x in rows], "doc_id long, text string, source string, lang string, n_chars long, row string, gone int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(150)] + [(3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "...")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def as_rows(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def test_stages_by_brute_force(spark, corpus):
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{corpus}/documents.parquet")
    assert list(stages) == ["toxicity", "line_dedup", "simhash", "decontamination", "mixing"]

    def step(name, docs):
        out = stages[name](spark, docs, corpus)
        assert name == "mixing" or out.columns == docs.columns
        return shared.durable(out)

    clean = step("toxicity", docs)
    scored = toxicity.toxicity(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), spark.read.parquet(f"{corpus}/labels.parquet").where("false"))
    assert scored.count() == docs.count()
    model = toxicity.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    kept = [r for r in docs.collect() if model[0] + sum(w for k, w in zip(model[1].tolist(), model[2].tolist(), strict=True) if k in set(toxicity.features(r.text).tolist())) < 0]
    assert as_rows(clean) == sorted(((r.doc_id, r.text, r.source) for r in kept), key=str)
    assert not any("nastyword" in (r.text or "") for r in clean.collect()) and clean.count() >= 0.95 * docs.where("text is null or not contains(text, 'nastyword')").count()

    lines = step("line_dedup", clean)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    plain._KEYS.clear()
    plain._KEYS.update({(r.doc_id, r.text): r.k for r in clean.select("doc_id", "text", shared.row_key().alias("k")).collect()})
    gone = {(d, t, k) for d, t, k, _ in plain.slow_lines(rows)}
    less = lambda d, t: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, t, k) not in gone)
    assert as_rows(lines) == sorted(((r.doc_id, less(r.doc_id, r.text), r.source) for r in clean.collect()), key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())

    once = step("simhash", lines)
    left = lines.select("doc_id", "text", "source", shared.row_key().alias("k")).collect()
    marks = sorted({plain.slow_fingerprint(r.text) for r in left})
    of = plain.components({f: {g for g in marks if g != f and (f ^ g).bit_count() <= 4} for f in marks})
    first = {}
    for r in left:
        group, place = of[plain.slow_fingerprint(r.text)], (r.doc_id is None, r.doc_id or 0, r.k)
        first[group] = min(first.get(group, (place, None, None)), (place, r.text or "", r.doc_id or 0), key=lambda x: x[0])
    got = once.select("doc_id", "text", "source", shared.row_key().alias("k")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.k) for r in got) == sorted(p for p, *_ in first.values())

    sound = step("decontamination", once)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    assert as_rows(sound) == sorted(((r.doc_id, r.text, r.source) for r in once.collect() if not plain.slow_contamination(r.text, items)[-1]), key=str)

    mixed = step("mixing", sound)
    rows = sound.select("doc_id", "source", "text", mixing._digest().alias("u")).collect()
    taken = plain.slow_mix([(r.doc_id, r.source, len((r.text or "").split()), r.u) for r in rows], mixing.PACKET)
    assert sorted(((r.doc_id, r.text, r.taken) for r in mixed.collect()), key=str) == sorted(((r.doc_id, r.text, t) for r, t in zip(rows, taken, strict=True) if t), key=str)

    before = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
    whole = corpus_pipeline.run(spark, corpus)
    assert sorted(map(str, whole.collect())) == sorted(map(str, mixed.collect()))
    assert not [x for x in set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))) - before if x.startswith(tuple(stages))]


def test_stages_of_an_empty_table(spark, corpus):
    none = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, corpus).count() == 0
