import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "codeweft"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "codeweft.llm" not in path.read_text(), path
