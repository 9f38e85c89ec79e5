"""Compare registered queries with their SQL: ``check.py folder [name or module ...]``."""

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
from oracle import compare, connect  # noqa: E402
from somnia.plans import load  # noqa: E402
from somnia.plans.registry import Tables  # noqa: E402
from somnia.session import build_session  # noqa: E402


def main(folder, names):
    spark = build_session("check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed, times = connect(folder), [], []
    for name, q in load().items():
        if names and not any(n in name or q.build.__module__.endswith("." + n) for n in names):
            continue
        start, note, n = time.time(), None, 0
        try:
            got = q.build(Tables(spark, folder)).toPandas()
            n = len(got)
            note = "no rows" if got.empty else compare(got, con.sql(q.sql).df()) if q.sql else None
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - start
        times.append((took, name))
        print(f"{'FAIL' if note else 'ok  '} {took:6.2f}s {n:7d} {'sql ' if q.sql else 'rows'} {name} {note or ''}", flush=True)
        failed += [name] if note else []
    print(f"{len(times)} queries, {len(failed)} failed {failed}; slowest {[(n, round(s, 1)) for s, n in sorted(times)[-8:]]}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
