"""Seeded random stress: 600 users' cart histories (timestamp ties, negative
adds, sets before adds, clears) in one job; fold, stored state + batch and
compaction with late events all equal the sequential replay."""

import datetime as dt
import random

from cartwheel import schemas as S
from cartwheel.operators import cart
from test_model import replay


def test_random_histories_match_replay(spark):
    rng = random.Random(20241203)
    t0 = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for user in range(600):
        for _ in range(rng.randint(1, 30)):
            eid += 1
            op = rng.choice(["add", "add", "add", "set", "set", "remove", "clear"])
            product = None if op == "clear" else rng.randint(0, 4)
            value = None if op in ("remove", "clear") else rng.randint(-3, 6)
            rows.append((eid, t0 + dt.timedelta(minutes=rng.randint(0, 30)), user, product, op, value))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, S.CART_EVENTS)
    want = replay(rows)

    def lines(d):
        return {(r.user_id, r.product_id): r.quantity for r in d.collect()}

    assert lines(cart.fold_cart_events(df)) == want
    cut = t0 + dt.timedelta(minutes=15)
    state = cart.fold_cart_events(df.where(df.ts < cut))
    assert lines(cart.apply_cart_batch(state, df.where(df.ts >= cut))) == want
    seen, late = df.where(df.event_id % 4 != 0), df.where(df.event_id % 4 == 0)
    assert lines(cart.fold_cart_events(cart.compact_cart_log(seen).unionByName(late))) == want
