"""A second walk trains every new file or says which it cannot train."""

import pytest

from raregrain.streaming.incremental import walk_chunks


def test_second_walk_skips_no_file(spark, tmp_path):
    at = str(tmp_path / "c")
    seen = []

    def write(where, ids):
        spark.range(*ids).coalesce(1).write.mode("append").parquet(f"{at}{where}")

    def walk(progress):
        seen.clear()
        numbers = walk_chunks(spark, at, spark.range(1).schema, str(tmp_path / progress), lambda df, no, _: seen.append((no, df.count())))
        return numbers

    for i in (1, 2):
        write(f"/chunk_no={i}", (0, 10 * i))
    write("", (0, 5))
    assert walk("p") == [1, 2, 3] and seen == [(1, 10), (2, 20), (3, 5)]
    assert walk("p") == [1, 2, 3] and seen == []
    write("/chunk_no=5", (0, 50))
    write("", (0, 7))
    assert walk("p") == [1, 2, 3, 5, 6] and seen == [(5, 50), (6, 7)]
    write("/chunk_no=3", (0, 30))
    with pytest.raises(ValueError, match="chunk_no=3/"):
        walk("p")
    assert seen == []
    assert walk("q")[:3] == [1, 2, 3] and (3, 30) in seen
    write("/chunk_no=2", (0, 4))
    with pytest.raises(ValueError, match="chunk_no=2/"):
        walk("q")
