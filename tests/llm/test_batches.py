import pyarrow as pa
import pytest

import corpus_pipeline
from tablewright.llm.common import BATCH_BYTES, BATCH_CONF, small_batches

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture
def unset(spark):
    before = spark.conf.getAll.get(BATCH_CONF)
    spark.conf.unset(BATCH_CONF)
    yield
    spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)


def test_stages_hand_bounded_batches_to_python(spark, unset):
    texts = spark.range(0, 8_000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 200) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    for stage in (corpus_pipeline.language_stage, corpus_pipeline.near_stage, corpus_pipeline.encoding_stage):
        spark.conf.unset(BATCH_CONF)
        stage(spark, spark.createDataFrame([], DOCS), SF)
        found = texts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in found) == 8_000
        assert max(r["size"] for r in found) <= BATCH_BYTES + 10_000


def test_bound_of_the_session_wins(spark, unset):
    spark.conf.set(BATCH_CONF, "12345")
    small_batches(spark)
    assert spark.conf.get(BATCH_CONF).removesuffix("b") == "12345"


def test_results_do_not_depend_on_the_batches(spark, unset):
    words = [f"w{i % 97}x{i // 3}" for i in range(120)]
    rows = [(i, " ".join([*words[: 60 + i % 7], f"tail{i % 11}"]), "en", "a") for i in range(60)] + [(None, None, None, None), (60, "", "en", "a"), (60, words[0], "en", "a")]
    docs = spark.createDataFrame(rows, DOCS)
    told = []
    for size in ("300", str(64 << 20)):
        spark.conf.set(BATCH_CONF, size)
        kept = corpus_pipeline.near_stage(spark, docs, SF)
        told.append((sorted(map(str, kept.collect())), sorted(map(str, corpus_pipeline.encoding_stage(spark, kept, SF).collect()))))
    assert told[0] == told[1]
    assert 0 < len(told[0][0]) < len(rows)
