"""A run of stages whose report is always written."""

from __future__ import annotations

import json
import time
import traceback
from collections.abc import Callable

from pyspark.sql import SparkSession

PASS, WARN, FAIL, SKIP = "PASS", "WARN", "FAIL", "SKIP"


class StageFailure(Exception):
    """A stage's check that does not hold; its text is the report's."""


def run_stages(stages: list[tuple[str, Callable[[dict], str], bool]], out: list[dict] | None = None) -> list[dict]:
    """Runs (name, function, critical) in order; a row for each, whatever happens, added to ``out`` as it ends.

    A function gets a dict for its figures, which the report keeps even if it fails, and
    returns a line of text.  A failure is FAIL for a critical stage, and the stages after it
    are SKIP; for any other stage it is WARN.
    """
    out = [] if out is None else out
    for name, function, critical in stages:
        if any(r["status"] == FAIL for r in out):
            out.append({"stage": name, "status": SKIP, "detail": "a critical stage before it failed", "figures": {}, "seconds": 0.0})
            continue
        figures: dict = {}
        began = time.monotonic()
        try:
            status, detail = PASS, function(figures)
        except StageFailure as e:
            status, detail = FAIL if critical else WARN, str(e)
        except Exception as e:  # noqa: BLE001  a stage may fail in any way, and the report must say so
            status, detail = FAIL if critical else WARN, f"{type(e).__name__}: {e}"
            figures["traceback"] = traceback.format_exc()
        out.append({"stage": name, "status": status, "detail": detail, "figures": figures, "seconds": round(time.monotonic() - began, 2)})
    return out


def exit_code(report: list[dict]) -> int:
    """0 if all stages passed, 1 if one failed or was skipped, 2 if there are warnings only."""
    found = {r["status"] for r in report}
    return 1 if found & {FAIL, SKIP} else 2 if WARN in found else 0


def write_report(spark: SparkSession, report: list[dict], path: str) -> int:
    """Writes the report as JSON lines, one a stage, and returns the exit code."""
    rows = [(i, json.dumps(r, sort_keys=True, default=str)) for i, r in enumerate(report)]
    spark.createDataFrame(rows, "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)
    return exit_code(report)


def staged_run(spark: SparkSession, stages: list[tuple[str, Callable[[dict], str], bool]], path: str) -> int:
    """Runs the stages and writes the report, also if the run itself is interrupted."""
    report: list[dict] = []
    try:
        run_stages(stages, report)
    finally:
        code = write_report(spark, report, path)
    return code
