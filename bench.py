"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

from inkfold import registry  # noqa: E402
from inkfold.session import build_session  # noqa: E402

HEADLINES = ["ensemble", "normalize_by_language", "extract_entities", "assemble_documents", "group_lines", "parse_extractions", "export_fields", "orientation", "counter", "gauge", "change_alerts", "cooldown"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        runs = []
        for _ in range(3):  # the first one warms up
            began = time.perf_counter()
            registry.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs[1:]), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
