"""Files of a growing folder, each worked on once."""

import pytest
from pyspark.sql import functions as F

from foldgrid.streaming import files


def test_each_file_once_also_after_failures(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in" / "sub").mkdir(parents=True)
    put = lambda name, text: (tmp_path / "in" / name).write_bytes(text.encode())
    stream = lambda: files.stream_lines(spark, folder, "*.txt", 2)
    count = lambda rows: rows.groupBy(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    done = lambda df: sorted((r.name, r.n) for r in df.collect())

    assert files.process_new(stream(), count, out, checkpoint).collect() == []
    put("a.txt", "one\r\ntwo"), put("b.txt", ""), put("sub/c.txt", "x\ny\nz"), put("other.csv", "no")
    first = [("a.txt", 2), ("c.txt", 3)]
    assert done(files.process_new(stream(), count, out, checkpoint)) == first
    assert done(files.process_new(stream(), count, out, checkpoint)) == first

    put("d.txt", "new"), put("e.txt", "new\nnew"), put("f.txt", "é"), put("a.txt", "changed\nnow\nlonger")

    def fails(rows):
        raise RuntimeError("before anything is written")

    def fails_late(rows):
        count(rows).write.mode("overwrite").parquet(f"{out}/batch=2")
        raise RuntimeError("after a part is written")

    for job in (fails, fails_late):
        with pytest.raises(Exception, match="written"):
            files.process_new(stream(), job, out, checkpoint)
    got = files.process_new(stream(), count, out, checkpoint)
    names = [r.name for r in got.collect()]
    assert sorted(set(names)) == ["a.txt", "c.txt", "d.txt", "e.txt", "f.txt"]
    assert {r.name: r.n for r in got.where("name > 'c.txt'").collect()} == {"d.txt": 1, "e.txt": 2, "f.txt": 1}
    assert len(names) == len(set(names)) and dict(done(got))["a.txt"] == 2


def test_packed_arrivals_once(spark, tmp_path):
    from foldgrid.sources.files import write_packed

    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    put = lambda *rows: write_packed(spark.createDataFrame(rows, "path string, content binary").coalesce(1), folder)
    count = lambda rows: rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    done = lambda: sorted((r.path, r.n) for r in files.process_new(files.stream_packed(spark, folder, 1), count, out, checkpoint).collect())
    put(("a", b"1"), ("b", b"2")), put(("c", None))
    first = [("a", 1), ("b", 1), ("c", 1)]
    assert done() == first and done() == first
    put(("d", b"3"))
    assert done() == [*first, ("d", 1)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["batch=0", "batch=1", "batch=2"]
