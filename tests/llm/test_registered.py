"""The driver gets every operator of this package and the pipeline."""

from __future__ import annotations


def test_all_are_registered():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and {"op2_mixing", "op7_pq_dedup", "op8_secrets", "op12_ptolemaic", "op13_pii"} <= set(sql)


def test_stages():
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "secrets", "mixture", "encoding"]
