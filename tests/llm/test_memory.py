"""What the operators keep in an executor's memory beside Spark's heap."""

import numpy as np
import pyarrow as pa
from pyspark import SparkContext

from recollect import session
from recollect.llm import common, decontaminate, pii, quality
from recollect.llm.components import components

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_to_workers_are_bounded_by_bytes(spark):
    def sizes(frames):
        for x in frames:
            yield pa.RecordBatch.from_arrays([pa.array([x.num_rows]), pa.array([x.nbytes])], names=["n", "size"])

    docs = session.prepare(spark).range(0, 6000, 1, 1).selectExpr("id", "repeat('x', 2000) AS text")
    got = docs.mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r["n"] for r in got) == 6000
    assert max(r["size"] for r in got) < 5 << 20


def test_a_limit_that_was_set_stays(spark):
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "8m")
        assert session.prepare(spark).conf.get(LIMIT) == "8m"
    finally:
        spark.conf.set(LIMIT, before)


def test_planted_values_start_no_python_workers(spark, monkeypatch):
    docs = spark.sql("SELECT id AS doc_id, concat('ask a', id, '@b.com or call +49 170 1234', 1000 + id, ' about it') AS text FROM range(50)")

    def refused(*_):
        raise AssertionError("rows would be unpickled by Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    assert pii.train(docs) is not None


def test_texts_are_read_in_small_pieces(spark):
    texts = [b"some Words, and %d more | of them\n" % i * 60 for i in range(1200)]  # over 2 MB
    rows = [{"item": "a", "n": 3, "window": b"and 7 more"}]
    for work in (lambda: quality.features(texts), lambda: decontaminate._scanner(spark, rows)([t.decode() for t in texts])):
        common._POWERS[:] = []
        work()
        assert sum(p.nbytes for p in common._POWERS) <= 16 << 20
    assert np.array_equal(quality.features(texts), np.concatenate([quality.features([t]) for t in texts]))


def _jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_ask_little_of_the_driver(spark):
    """A driver keeps each job's stages and plans: stars take no round, and a round is known to be the last."""
    star = [(n, 1) for n in range(2, 40)] + [(n, 50) for n in range(51, 60)]
    path = [(n, n + 1) for n in range(100, 120)]
    for name, edges, most in (("star", star, 8), ("path", star + path, 60)):
        df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)
        found, jobs = _jobs(spark, name, lambda df=df: {r.node: r.root for r in components(df).collect()})
        assert found == {n: 1 if n < 40 else 50 if n < 100 else 100 for e in edges for n in e}
        assert jobs <= most, (name, jobs)
