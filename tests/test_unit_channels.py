"""How the rows of src4_unit_channels are dealt to tasks."""

from lamina.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_texts_are_made_and_read_in_many_tasks(spark):
    """The shuffled rows are few bytes, so merging them by bytes would leave the work to one task."""
    held = QUERIES["src4_unit_channels"](spark, SF).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    assert len([n for n in held if n]) >= parts // 2
    assert max(held) < 3 * sum(held) / parts
