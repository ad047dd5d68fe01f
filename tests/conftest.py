import sys
import tempfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from talkweave.schema import MESSAGES  # noqa: E402
from talkweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture(scope="session")
def chat(spark):
    """Messages from ``(workspace, sender, minute, text)`` rows, numbered in order."""

    def build(rows, skip=1):
        start = datetime(2024, 1, 1)
        seen: dict[str, int] = {}
        out = []
        for ws, sender, minute, text in rows:
            seq = seen.get(ws, -skip) + skip
            seen[ws] = seq
            out.append((ws, seq, f"{ws}-{seq}", start + timedelta(minutes=minute), sender, text, False))
        return spark.createDataFrame(out, MESSAGES)

    return build
