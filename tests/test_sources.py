import pytest

from orrery.operators import graph
from orrery.sources.edges import GraphRegistry, NamedGraph, edge_list_text, hashed_weights, undirected


@pytest.fixture
def folder(tmp_path):
    files = {
        "tabs_spaces.txt": "0 1\n1\t2\n 2   3 \n3 \t4\t\n",
        "comments.txt": "# head\n% note\n\n0 1\n",
        "tiny.txt": "0 1\n1 2\n2 2\n",
        "gap_ids.txt": "0 7\n",
        "three_cols.txt": "0 1 5\n",
        "m.mtx": "%%MatrixMarket matrix\n% c\n3 3 2\n1 2 7\n2 3 8\n",
        "bad.txt": "a b\n0 x\n4 5\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def rows(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_white_space(spark, folder):
    assert rows(edge_list_text(spark, str(folder / "tabs_spaces.txt"))) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_comments_and_garbage(spark, folder):
    assert rows(edge_list_text(spark, str(folder / "comments.txt"))) == [(0, 1)]
    assert rows(edge_list_text(spark, str(folder / "bad.txt"))) == [(4, 5)]


def test_matrix_market(spark, folder):
    assert rows(edge_list_text(spark, str(folder / "m.mtx"), matrix_market=True)) == [(1, 2), (2, 3)]


def test_matrix_market_edge_like_the_sizes(spark, folder):
    """The line of sizes is told by its place: an edge of the same text stays, and a folder's files each have one."""
    both = folder / "many.mtx"
    both.mkdir()
    (both / "a.mtx").write_text("%%MatrixMarket\n\n3 3 2\n3 3 2\n1 2 7\n")
    (both / "b.mtx").write_text("4 4 1\n3 3 2\n")
    assert rows(edge_list_text(spark, str(both / "a.mtx"), matrix_market=True)) == [(1, 2), (3, 3)]
    assert rows(edge_list_text(spark, str(both), matrix_market=True)) == [(1, 2), (3, 3), (3, 3)]


def test_undirected_keeps_loops_single(spark, folder):
    edges = edge_list_text(spark, str(folder / "tiny.txt"))
    assert edges.count() == 3
    assert rows(undirected(edges)) == [(0, 1), (1, 0), (1, 2), (2, 1), (2, 2)]


def test_isolated_ids_and_weights(spark, folder):
    assert graph.vertices(edge_list_text(spark, str(folder / "gap_ids.txt"))).count() == 8
    three = edge_list_text(spark, str(folder / "three_cols.txt"))
    assert three.first()["weight"] == 5
    assert graph.id_bounds(three).first()["max_id"] == 1
    assert 0 <= hashed_weights(three, 10, "w").first()["w"] < 10


def test_registry(spark, folder):
    registry = GraphRegistry({"sim": str(folder)}, {"tiny": NamedGraph("tiny.txt", directed=False, start=0), "d": NamedGraph("tiny.txt")})
    assert registry.load(spark, "tiny", "sim").count() == 5
    assert registry.load(spark, "d", "sim").count() == 3
    with pytest.raises(ValueError, match="unknown graph"):
        registry.load(spark, "none", "sim")
    with pytest.raises(ValueError, match="unknown mode"):
        registry.load(spark, "tiny", "none")
