"""Print the formatted physical plan of registered queries.

    python tools/explain_query.py [sf_dir] query [query ...]
    python tools/explain_query.py /root/testdata/sf0.01 checkout_orders --run   # final adaptive plan
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    args = [a for a in argv[1:] if not a.startswith("--")]
    run = "--run" in argv
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = args[1:] if args and os.path.isdir(args[0]) else args
    from cartwheel.session import build_session
    from cartwheel.plans.registry import QUERIES
    spark = build_session()
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        print(f"===== {name} =====")
        if run:
            df.write.format("noop").mode("overwrite").save()
            df.collect()
            print(df._jdf.queryExecution().executedPlan().toString())
        else:
            df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
