"""Plan inspection: the formatted physical plan as text, for plan tests and
for reviewing what Catalyst chose (pushed filters, read schema, broadcasts,
partial aggregates, codegen spans)."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()
