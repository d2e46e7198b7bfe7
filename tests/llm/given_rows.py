"""Frames of hand-made documents."""

import pytest


@pytest.fixture
def documents(spark):
    """A frame of (doc_id, text), with columns whose names clash with those that operators use inside."""
    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
            "*", "1 as words", "2 as mark", "3 as hits", "4 as node", "5 as label", "6 as part", "7 as score", "8 as url", "9 as _text")
    return build
