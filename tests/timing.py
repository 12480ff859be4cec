"""Time queries without comparing: ``python tests/timing.py names...``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from panelspark.session import build_session  # noqa: E402

sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
queries = entry.queries()
for name in sys.argv[1:]:
    for turn in range(int(os.environ.get("TURNS", "1"))):
        t = time.time()
        df = queries[name](spark, sf)
        built = time.time() - t
        df.write.format("noop").mode("overwrite").save()
        print(f"{name:40s} build {built:6.2f}s total {time.time() - t:6.2f}s", flush=True)
