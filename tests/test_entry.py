import re
from pathlib import Path

import __spark_entry__ as entry
from pyspark.sql import functions as F

from quire.functions import style_columns as S

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 40


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "quire").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"quire\.llm|corpus_pipeline", p.read_text()), p


def test_style_columns(spark):
    rows = spark.createDataFrame([(16.0, "px"), (10.0, "%"), (0.0, ""), (3.0, ""), (2.0, "vw"), (1.0, "IN")], "n double, u string")
    assert [r[0] for r in rows.select(S.em_length(F.col("n"), F.col("u"), 0.3)).collect()] == [1.0, 3.0, 0.0, None, None, 6.0]
    c = spark.createDataFrame([([(1, 1, 0), (0, 1000, 2), (0, 900, 0)],)], "c array<struct<a:bigint,b:bigint,c:bigint>>")
    assert c.select(S.specificity(F.col("c"))).first()[0] == (1 << 20) + (1023 << 10) + 2


def test_the_rest_works_without_the_corpus_operators(monkeypatch):
    import importlib
    import sys

    kept = {k: v for k, v in sys.modules.items() if k.startswith("quire.llm") or k == "corpus_pipeline"}
    for k in kept:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setitem(sys.modules, "quire.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        without = importlib.reload(entry)
        assert len(without.queries()) >= 40 and not any(q.startswith("op") and q[2].isdigit() for q in without.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
