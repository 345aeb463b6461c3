import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docpipe.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("docpipe-tests", "local[8]", 4, spark__ui__enabled="false",
                            spark__ui__showConsoleProgress="false", spark__driver__memory="6g", spark__docpipe__spread="4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
