import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import compaction as C
from quillgraph.scratch import new_path

FRONT = "---\ntype: chunk\nsource: /srv/kb/eng/My Plan-7.md\nposition: 3\n---\n"


@pytest.mark.parametrize(
    "path,want",
    [
        ("eng/plan-7/03.txt", "eng/plan-7/03.txt"), ("./eng/plan-7/03.txt", "eng/plan-7/03.txt"), ("eng\\plan-7\\03.txt", "eng/plan-7/03.txt"), ("_staging/eng//plan-7/03.txt", "eng/plan-7/03.txt"),
        ("retry-2/eng/plan-7/.03.txt.swp", "eng/plan-7/03.txt"), ("eng/plan-7/03.txt~", "eng/plan-7/03.txt"), ("eng/plan-7/03 (copy).txt", "eng/plan-7/03.txt"), ("eng/plan-7/03 (2).txt", "eng/plan-7/03.txt"),
        ("eng/plan-7/03-1~.txt", "eng/plan-7/03.txt"), ("eng/plan-7/03.txt.bak", "eng/plan-7/03.txt"), ("plan-7/03.txt.tmp", "plan-7/03.txt"), ("eng/plan-7-v2/03.txt", "eng/plan-7-v2/03.txt"),
        ("_lost+found/#1234", "eng/myplan-7/03.txt"), ("eng/plan-7/_summary.txt", "eng/plan-7/_summary.txt"),
    ],
)
def test_names(spark, path, want):
    df = spark.createDataFrame([(path, FRONT + "x")], "path string, content string")
    assert df.select(C.chunk_path(F.col("path"), F.col("content"))).first()[0] == want


def repeats(spark, rows, **kw):
    c = C.compact(spark.createDataFrame(rows, "file_id long, path string, content string, size int, bucket int, grp int"), **kw)
    return sorted(r.file_id for r in c.repeats.collect()), c


def row(i, path, content):
    return (i, path, content, 9, 9, 9)


def test_bodies_that_read_the_same(spark):
    p = "eng/a/01.txt"
    rows = [
        row(1, p, "Café one\ntwo"), row(2, "./" + p, "Cafe\u0301 one \r\ntwo\n\n"), row(3, p + "~", FRONT + "Café one\ntwo"), row(4, p, "\ufeffCafé\u200b one\ntwo"),
        row(5, p, "Café ones\ntwo"), row(6, "eng/b/01.txt", "Café one\ntwo"), row(7, p, None), row(8, p, ""), row(9, p, FRONT), row(10, p, " \n"), row(11, None, "x"), row(12, None, "x"),
    ]
    got, c = repeats(spark, rows)
    assert got == [2, 3, 4, 12]
    kept = C.read_compacted(spark, c.path)
    assert sorted(r.file_id for r in kept.collect()) == [1, 5, 6, 11]
    assert {r.path for r in kept.where("file_id in (1, 5)").collect()} == {p}


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [row(1, "a/01.txt", "x")] * 3 + [row(None, "a/02.txt", "y")] * 2 + [row(None, "a/01.txt", "x")]
    got, c = repeats(spark, rows)
    assert got == []
    assert sorted((r.path, r.content) for r in C.read_compacted(spark, c.path).collect()) == [("a/01.txt", "x"), ("a/02.txt", "y")]
    got, c = repeats(spark, [])
    assert got == [] and c.manifest.count() == 0 and C.read_compacted(spark, c.path).count() == 0


def test_longest_first_to_the_least_loaded(tmp_path):
    import numpy as np
    import pyarrow as pa
    from pyarrow import fs

    b = C._Balanced(fs.LocalFileSystem(), str(tmp_path), 0, 3)
    sizes = np.array([9, 8, 7, 6, 5, 4, 3, 3])
    text = pa.array([str(s) for s in sizes])
    b.put(pa.table({"path": text, "content": text, "file_id": pa.array(range(8))}), sizes)
    assert sorted(x[2] for x in b.close()) == [13, 16, 16]


def test_groups_are_balanced_and_whole(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_BYTES", 50_000)
    rows = [row(i, f"d{i}/01.txt", f"{i} " + "x" * (37 * i % 900)) for i in range(1, 1500)] + [row(5000, "big/01.txt", "y" * 300_000)]
    out = new_path(spark, "test")
    got, c = repeats(spark, rows, out=out, target_bytes=100_000)
    assert got == []
    assert sorted(r.file_id for r in C.read_compacted(spark, out).collect()) == sorted(r[0] for r in rows)
    m = json.loads(Path(out.removeprefix("file:").replace("//", "/") + "/manifest.json").read_text())
    assert m["records"] == 1500 and len(m["files"]) == c.manifest.count()
    sizes = sorted(r.content_bytes for r in c.manifest.collect())
    assert sizes[-1] < 420_000 and sizes[-2] < 1.3 * sizes[1] and sum(sizes) == m["content_bytes"]
    with pytest.raises(RuntimeError):
        C._publish(spark, out, {})


def test_front_matter_needs_a_type(spark):
    df = spark.createDataFrame([("---\ntitle: x\n---\nbody",), (FRONT + "---\ntitle: x\n---\nbody",), ("---\n" + "a: b\n" * 20_000,)], "c string")
    assert [r[0] for r in df.select(C.body_of(F.col("c"))).limit(2).collect()] == ["---\ntitle: x\n---\nbody"] * 2
    assert df.select(C.on_screen(C.body_of(F.col("c")))).count() == 3
    long = "---\n" + "".join(f"source_{i}: x\n" for i in range(3000)) + "type: summary\nposition: 4\n" + "a: b\n" * 9000 + "---\nbody"
    df = spark.createDataFrame([(long,), (long.replace("---\nbody", "---"),), (long.replace("---\nbody", "--- x"),)], "c string")
    assert [r[0][:9] for r in df.select(C.body_of(F.col("c"))).collect()] == ["body", "", "---\nsourc"]
    assert df.select(C.front_value(F.col("c"), "position")).first()[0] == "4"
