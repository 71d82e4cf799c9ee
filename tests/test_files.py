"""Readers of files whose parts Spark deals out of order."""

from kinlink.sources import files as S


def test_id_lists_of_parts_and_blocks(spark, tmp_path):
    """Later part files that are larger, and files of several blocks, keep their places."""
    ids, at = [], 0
    for k, n in enumerate((3, 40, 400, 0, 90)):
        own = [f"S1-{at + i}" for i in range(n)]
        at += n
        ids += own
        (tmp_path / f"part-{k:05d}.csv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{x}\tS2-{x[3:]}\n" for x in own))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1500)
    try:
        order, pairs = S.read_id_lists(spark, str(tmp_path))
        got = [(r["ord"], r["entity_id"]) for r in order.orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(ids)) and pairs.count() == len(ids)
