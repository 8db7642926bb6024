"""Readers and writers: round trips, expansion of storage, malformed files."""

from __future__ import annotations

import pytest

from tropica import errors
from tropica.graph import equal
from tropica.sources import bundle, mtx, random_graph
from tropica.graph import Graph


def put(tmp_path, text: str) -> str:
    path = tmp_path / "m.mtx"
    path.write_text(text)
    return str(path)


def rows(m: mtx.Matrix) -> list[tuple]:
    return sorted(tuple(r) for r in m.entries.collect())


def test_coordinate_storage(spark, tmp_path):
    text = "%%MatrixMarket matrix coordinate {} {}\n% a comment\n\n3 3 2\n2 1 {}\n% inside\n3 2 {}\n"
    m = mtx.read_matrix(spark, put(tmp_path, text.format("integer", "symmetric", 5, -6)))
    assert rows(m) == [(0, 1, 5), (1, 0, 5), (1, 2, -6), (2, 1, -6)] and (m.nrows, m.ncols, m.kind) == (3, 3, "int64_t")
    assert rows(mtx.read_matrix(spark, put(tmp_path, text.format("real", "skew-symmetric", 1.5, "inf")))) == [(0, 1, -1.5), (1, 0, 1.5), (1, 2, float("-inf")), (2, 1, float("inf"))]
    for tag in ("%%Tropica", "%%tropica", "%%Other"):
        assert mtx.read_matrix(spark, put(tmp_path, text.format("integer", "general", 5, 6).replace("% a", f"{tag} type int8_t\n% a"))).kind == "int8_t"
    m = mtx.read_matrix(spark, put(tmp_path, text.format("pattern", "general", "", "").replace("% a", "%%Anything type bool\n% a")))
    assert rows(m) == [(1, 0, True), (2, 1, True)]


def test_arrays_and_bare_files(spark, tmp_path):
    m = mtx.read_matrix(spark, put(tmp_path, "%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n"))
    assert rows(m) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]
    m = mtx.read_matrix(spark, put(tmp_path, "%%MatrixMarket matrix array real symmetric\n3 3\n1\n2\n3\n4\n5\n6\n"))
    assert rows(m) == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 2.0), (1, 1, 4.0), (1, 2, 5.0), (2, 0, 3.0), (2, 1, 5.0), (2, 2, 6.0)]
    assert rows(mtx.read_matrix(spark, put(tmp_path, "2 2 1\n1 2 7\n"))) == [(0, 1, 7.0)]
    assert rows(mtx.read_matrix(spark, put(tmp_path, "2 3 0\n"))) == []


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("%%MatrixMarket matrix coordinate odd general\n1 1 1\n1 1 1\n", errors.ReadWriteError),
        ("%%MatrixMarket matrix coordinate real general\n2 2\n1 1 1\n", errors.ReadWriteError),
        ("%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n", errors.ReadWriteError),
        ("%%MatrixMarket matrix coordinate real general\n2 2 1\n1 x 1\n", errors.ReadWriteError),
        ("%%MatrixMarket matrix coordinate real symmetric\n2 3 1\n1 1 1\n", errors.ReadWriteError),
        ("%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1\n", errors.IndexOutOfBounds),
        ("%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n1 1 2\n", errors.InvalidValue),
        ("%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1 1\n", errors.NotImplementedKind),
        ("%%MatrixMarket matrix coordinate integer general\n%%Anything type int8_t\n1 1 1\n1 1 300\n", errors.ReadWriteError),
    ],
)
def test_malformed(spark, tmp_path, text, error):
    with pytest.raises(error):
        mtx.read_matrix(spark, put(tmp_path, text))


def test_round_trips(spark, tmp_path):
    for k, (cells, kind) in enumerate([([(0, 1, 2.5), (1, 0, 2.5)], "double"), ([(0, 1, 3), (1, 0, -3)], "int64_t"), ([(0, 1, 1), (2, 0, 1)], "int32_t"), ([(0, 0, 1.0), (0, 1, 0.1)], "double")]):
        spark_kind = {"double": "double", "int64_t": "long", "int32_t": "int"}[kind]
        n, m = (1, 2) if k == 3 else (3, 3)
        matrix = mtx.Matrix(spark.createDataFrame(cells, f"src long, dst long, w {spark_kind}"), n, m, kind)
        mtx.write_matrix(matrix, str(tmp_path / f"out{k}"), "made by a test")
        again = mtx.read_matrix(spark, str(tmp_path / f"out{k}"))
        assert equal(matrix.entries, again.entries, ["src", "dst"], "w") and (again.nrows, again.ncols, again.kind) == (n, m, kind)
    bundle.save(spark, str(tmp_path / "set"), {"m": matrix, "note": "text"}, "c")
    found = bundle.load(spark, str(tmp_path / "set"))
    assert found["note"] == "text" and rows(found["m"]) == rows(matrix)
    with pytest.raises(errors.ReadWriteError):
        bundle.load(spark, str(tmp_path / "nowhere"))


def test_random(spark):
    m = random_graph.random_matrix(spark, "double", 20, 30, 0.2, 4)
    cells = rows(m)
    assert 80 < len(cells) <= 120 and all(0 <= i < 20 and 0 <= j < 30 and 0 <= w <= 1 for i, j, w in cells) and cells == rows(random_graph.random_matrix(spark, "double", 20, 30, 0.2, 4))
    assert random_graph.random_matrix(spark, "bool", 3, 4, float("inf")).entries.count() == 12


def test_sampled_degrees(spark):
    from tests.test_graph import directed, undirected

    assert random_graph.sample_degree(undirected(spark, "A"), True, 5, 123456) == (4.6, 5)
    karate = undirected(spark, "karate")
    assert random_graph.sample_degree(karate, True, 5, 123456) == (3, 3)
    assert random_graph.sample_degree(karate, True, 15, 123456) == (pytest.approx(3.4667, abs=1e-3), 3)
    assert random_graph.sample_degree(karate, True, 5, 87654432) == (8.4, 6)
    cover = directed(spark, "cover")
    assert random_graph.sample_degree(cover, True, 5, 123456) == (1.4, 1) and random_graph.sample_degree(cover, False, 5, 123456) == (2.4, 3)
    assert not random_graph.prefers_presort(karate)
    assert isinstance(karate, Graph)


def test_parts_are_read_in_order_whatever_their_sizes(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "part-00000.txt").write_text("%%MatrixMarket matrix array integer general\n20 3\n")
    (tmp_path / "m" / "part-00001.txt").write_text("".join(f"{i}\n" for i in range(20)))
    (tmp_path / "m" / "part-00002.txt").write_text("".join(f"{i}\n" for i in range(20, 60)))
    found = mtx.read_matrix(spark, str(tmp_path / "m")).entries
    assert {(r["src"], r["dst"]): r["w"] for r in found.collect()} == {(i % 20, i // 20): i for i in range(60)}
