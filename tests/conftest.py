import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quadloom.session import local_session

    session = local_session(8, "tests", **{"spark__sql__shuffle__partitions": "4", "spark__default__parallelism": "4", "spark__sql__codegen__wholeStage": "false", "spark__sql__codegen__factoryMode": "NO_CODEGEN"})
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


@pytest.fixture(scope="session")
def graph(spark):
    """(s, p, o) of a Turtle text with the prefixes used in tests."""
    from quadloom.sources.io import graph_of_text

    head = "@prefix : <http://e/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . "
    return lambda text: graph_of_text(spark, head + text, "turtle").select("s", "p", "o")


@pytest.fixture(scope="session")
def engine(spark):
    """A query engine over a TriG text."""
    from quadloom.engine import Engine
    from quadloom.sources.io import graph_of_text
    from quadloom.store import QuadStore

    head = "@prefix : <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . "
    return lambda text: Engine(spark, QuadStore(graph_of_text(spark, head + text, "trig"), distinct=False), prefixes={"": "http://e/"})
