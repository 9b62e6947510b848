"""Versions that are replaced as a whole, and what is left after a write that was killed."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tillsight.sources import published


def _n(version, name="t"):
    return sorted(r.n for r in version.read(name).collect())


def test_readers_stay_with_their_version(spark):
    base = tempfile.mkdtemp(prefix="tillsight-published-")
    assert published.current(spark, base) is None and published.clean(spark, base) == []
    first = published.publish(spark, base, {"t": spark.range(3).select(F.col("id").alias("n")), "u": spark.range(1)})
    pinned = published.current(spark, base)
    published.publish(spark, base, {"t": spark.range(5).select(F.col("id").alias("n"))})
    assert first.number == 0 and _n(pinned) == [0, 1, 2] and _n(published.current(spark, base)) == [0, 1, 2, 3, 4]
    assert _n(published.pinned(spark, base, 0)) == [0, 1, 2]
    with pytest.raises(KeyError):
        published.current(spark, base).read("u")


def test_a_killed_write_leaves_the_version_before(spark):
    base = tempfile.mkdtemp(prefix="tillsight-published-")
    published.publish(spark, base, {"t": spark.range(3).select(F.col("id").alias("n"))})
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).cast("long").alias("n"))
    with pytest.raises(Exception, match="killed"):  # the second table of two, so the first is there whole
        published.publish(spark, base, {"a": spark.range(2), "t": broken})
    assert _n(published.current(spark, base)) == [0, 1, 2]
    assert len(published.list_names(spark, f"{base}/data")) == 2
    published.publish(spark, base, {"t": spark.range(1).select(F.col("id").alias("n"))}, number=1)
    again = published.publish(spark, base, {"t": spark.range(9).select(F.col("id").alias("n"))}, number=1)  # a batch that is tried again
    assert _n(again) == [0] and _n(published.current(spark, base)) == [0]
    gone = published.clean(spark, base, keep=1)
    assert len(gone) == 2 and published.versions(spark, base) == [1] and _n(published.current(spark, base)) == [0]
