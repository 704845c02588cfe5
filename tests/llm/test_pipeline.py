"""The pipeline's stages on the smallest tables, and planted cases."""

import pathlib
import random
import tracemalloc

import pyarrow as pa

import corpus_pipeline
from tessera.llm import linededup, simhash
from tessera.session import checkpoint_dir
from tests.llm.test_operators import prose

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        assert 0 < after.count() <= now.count()
        now = after
    assert "sequence_id" in corpus_pipeline.packing(spark, now, SF).columns


def test_run_is_repeatable(spark):
    a, b = [sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2)]
    assert a == b and a


def test_planted_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(21)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    passage = prose(rng, 60, 10**6)
    own = [prose(rng, 80, 10**6) for _ in range(6)]
    near = own[5].split()
    near[40] = "changed"
    texts = {10**6: own[0] + "\n" + passage, 10**6 + 1: own[1] + "\n" + passage, 10**6 + 2: own[2] + " " + item, 10**6 + 3: own[3], 10**6 + 4: own[3], 10**6 + 5: own[5], 10**6 + 6: " ".join(near), 10**6 + 7: None}
    more = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], docs.schema)
    mixed = docs.unionByName(more)
    lines = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, mixed, SF).where("doc_id >= 1000000").collect()}
    assert 10**6 + 4 not in lines and lines[10**6 + 3] == own[3] and lines[10**6] == texts[10**6] and lines[10**6 + 7] is None
    assert len(set(passage.split()) & set(lines[10**6 + 1].split())) <= 12
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, mixed, SF).where("doc_id >= 1000000").collect()}
    assert kept >= {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3, 10**6 + 5} and not kept & {10**6 + 4, 10**6 + 6}
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, mixed, SF).where("doc_id >= 1000000").collect()}
    assert clean == set(texts) - {10**6 + 2}


def test_arrow_batches_are_bounded_in_bytes(spark, monkeypatch):
    """Each stage's Python workers get batches of a few MB, however long the rows, and all rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key, None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    long = spark.range(0, 2500, 1, 1).selectExpr("id as doc_id", "repeat('word ', 1600) as text")
    for operator in ("drop_toxic", "dedup_lines", "drop_near_duplicates", "decontaminate", "pack"):
        monkeypatch.setattr(corpus_pipeline, operator, lambda docs, *_: docs.selectExpr("*", "0 as line_removed"))
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, long, SF)
            seen = long.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in seen) == 2500 and max(r.bytes for r in seen) < 5 << 20, name
        spark.conf.set(key, "1m")
        corpus_pipeline.packing(spark, long, SF)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key) if given is None else spark.conf.set(key, given)


def test_line_hashing_takes_little_memory():
    """4 MB of texts are hashed a few MB of arrays at a time, and no text is left out."""
    rng = random.Random(5)
    texts = pa.array([prose(rng, 300, 5000) for _ in range(1500)])
    powers, count = linededup._Powers(), 0
    tracemalloc.start()
    try:
        for _, group in linededup._chunks(texts):
            linededup.Words(group, powers).winnowed(48)
            count += len(group)
        assert count == 1500 and tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()


def test_near_dedup_writes_few_files(spark):
    """Its tables have as many parts as the texts, not as many as the shuffles; the components stay the same."""
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    given = {k: spark.conf.get(k) for k in conf}
    rng = random.Random(8)
    texts = [prose(rng, 60, 10**6).split() for _ in range(10)]
    # Of each text: a chain of five, of which neighbours differ in one word more.
    rows = [(5 * i + k, " ".join([*words[: 60 - k], *(f"new{i}x{j}" for j in range(k))])) for i, words in enumerate(texts) for k in range(5)]
    folder = pathlib.Path(checkpoint_dir(spark).removeprefix("file:"))
    count = lambda: sum(1 for _ in folder.rglob("part-*"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs, before = spark.createDataFrame(rows, "doc_id long, text string"), count()
        got = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    finally:
        for k, v in given.items():
            spark.conf.set(k, v)
    assert got == {i: i // 5 * 5 for i in range(50)}
    assert count() - before < 500
