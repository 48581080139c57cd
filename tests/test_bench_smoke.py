"""bench.py end to end on the smallest data set: one JSON line, every named
query timed, no errors."""

import json
import os
import subprocess
import sys

from paths import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2")
    from cartwheel.plans.registry import registered
    names = sorted(registered())
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), *names], env=env, cwd=ROOT,
                         capture_output=True, text=True, timeout=900)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert out.returncode == 0, out.stderr[-2000:]
    assert len(lines) == 1
    result = json.loads(lines[0])
    assert result["unit"] == "sec" and result["mode"] == "tables" and "errors" not in result
    assert set(result["queries"]) == set(names)
    assert result["value"] >= result["query_sec"] > 0
