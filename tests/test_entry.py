import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert len(df.columns) == 33 + 30


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_optional_part():
    import ast
    from pathlib import Path

    root = Path(entry.__file__).parent / "courtlens"
    for path in root.rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
