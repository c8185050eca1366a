from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (doc_id, text)."""

    def make(items, extra: bool = False):
        rows = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(items)]
        df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(7) for c in ("node", "component", "log_weight", "gumbel_key", "label", "posting", "id", "range", "own", "copy_", "kept_id")})
        return df

    return make
