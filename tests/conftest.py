import os
import sys
import threading

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from tidegate.session import local_session, ship  # noqa: E402
from tidegate.sources.banks import Banks, Keyword, KeywordBank, PatternBank  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    ship(session)
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def callbacks_by_name():
    """Spark's callback server, which streams start, runs in a thread called after the method ``run``; tests of the
    scorer look for such threads of its own."""
    for thread in threading.enumerate():
        if type(getattr(getattr(thread, "_target", None), "__self__", None)).__module__.startswith("py4j."):
            thread.name = "py4j callbacks"


@pytest.fixture(scope="session")
def small_banks():
    crisis = [
        Keyword("wish_to_be_dead", 1, "wish i was dead"),
        Keyword("wish_to_be_dead", 1, "want to be dead"),
        Keyword("active_intent", 5, "i am going to kill myself"),
        Keyword("active_intent", 5, "i will end my life"),
    ]
    malign = [
        Keyword("harm_to_others", None, "i want to kill you"),
        Keyword("harm_to_others", None, "going to attack"),
        Keyword("dangerous_misuse", None, "lethal dose of"),
        Keyword("dangerous_misuse", None, "how to overdose"),
    ]
    patterns = [
        {"id": "BYPASS_001", "pattern": r"ignore\s+(all\s+)?(previous|prior)\s+instructions?"},
        {"id": "BYPASS_010", "pattern": r"\bDAN\b|do\s+anything\s+now"},
    ]
    return Banks(
        KeywordBank.of("crisis", crisis),
        KeywordBank.of("malign", malign),
        PatternBank.from_mapping({"patterns": patterns}),
    )


@pytest.fixture(scope="session")
def banks():
    return Banks.load()


@pytest.fixture(scope="session")
def prompts(spark):
    """Prompt frame from (id, text[, session]) rows."""

    def make(*texts):
        rows = [(f"p{i:05d}", text, None) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "prompt_id string, text string, session_id string").coalesce(4)

    return make
