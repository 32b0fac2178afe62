"""The batch build: named steps in order, with a ledger of how each went."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from footfall.sources.sinks import write_text

Step = tuple[str, Callable[[], object]]


def run_steps(spark: SparkSession, steps: Sequence[Step], ledger: str | None = None, optional: Sequence[str] = ()) -> list[dict]:
    """Run the steps, stopping at the first failure unless the step is optional.

    The ledger is written either way, so that a failed build says where it stopped.
    """
    done: list[dict] = []
    try:
        for name, step in steps:
            try:
                step()
                done.append({"name": name, "ok": True})
            except Exception as error:
                done.append({"name": name, "ok": False, "error": f"{type(error).__name__}: {error}"})
                if name not in optional:
                    raise
    finally:
        if ledger:
            write_text(spark, ledger, json.dumps({"steps": done}, indent=2))
    return done
