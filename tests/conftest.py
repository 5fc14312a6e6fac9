import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import build_session
    s = build_session("local[*]", 8, app_name="ledgerline-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if isinstance(text, bytes):
        open(path, "wb").write(text)
    else:
        open(path, "w", encoding="utf-8", newline="").write(text)
    return path
