"""The session's bound on what AQE joins into one task."""

from lakemart.session import ADVISORY, configure


def test_joined_partitions_are_bounded(spark):
    own = spark.newSession()
    for given, then in (("64MB", "16m"), ("67108864b", "16m"), ("67108864", "16m"), ("1g", "16m"), ("16m", "16m"), ("8m", "8m"), ("64k", "64k"), ("8388608", "8388608")):
        own.conf.set(ADVISORY, given)
        assert configure(own).conf.get(ADVISORY) == then
