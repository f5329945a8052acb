import pytest

from mergewright.llm import queries as Q

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name, columns", [
    ("p1_found", {"id1": "bigint", "id2": "bigint"}), ("p2_found", {"pair_id1": "bigint", "pair_id2": "bigint"}), ("p5_found", {"id": "bigint", "field": "string"}),
    ("p8_ids", {"doc_id": "bigint", "ids": "array<int>"}), ("p9_mix", None), ("p9_shares", None), ("p10_found", {"doc_id": "bigint", "kind": "string", "start_at": "bigint"}), ("p10_redacted", None), ("p6_shares", None),
])
def test_query_runs(name, columns, spark):
    df = Q.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if columns:
        assert dict(df.dtypes) == columns and (name.startswith("p8") or len(rows) == len({tuple(r) for r in rows}))


def test_nothing_else_imports_this_subpackage():
    from pathlib import Path

    import mergewright

    root = Path(mergewright.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert ".llm" not in f.read_text() and "import llm" not in f.read_text()
