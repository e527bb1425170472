"""The driver's contract."""

import __spark_entry__
from tidegauge import queries as engine


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 40 and df.columns[0] == "event_id"


def test_registered():
    names, sql = set(__spark_entry__.queries()), set(__spark_entry__.oracle_sql())
    assert set(engine.queries()) == set(engine.oracle_sql()) <= names and sql <= names


def test_engine_does_not_need_the_training_operators():
    import pathlib
    import re

    for path in pathlib.Path(engine.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
