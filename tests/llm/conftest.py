import pytest

pytest.importorskip("strandloom.llm")
