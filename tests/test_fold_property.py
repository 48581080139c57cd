"""Property test: the aggregate cart fold equals a sequential replay on
random event histories (negative adds, sets before adds, set <= 0, removes,
clears, equal timestamps). Many histories run as many users in one job."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cartwheel import schemas as S
from cartwheel.operators import cart
from test_model import replay

T0 = dt.datetime(2024, 1, 1)
OPS = st.sampled_from(["add", "add", "set", "remove", "clear"])
EVENT = st.tuples(OPS, st.integers(0, 3), st.integers(-3, 5), st.integers(0, 6))
HISTORY = st.lists(EVENT, min_size=1, max_size=25)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(HISTORY, min_size=40, max_size=60))
def test_fold_matches_replay(spark, histories):
    rows, eid = [], 0
    for user, hist in enumerate(histories):
        for op, product, value, minute in hist:
            eid += 1
            rows.append((eid, T0 + dt.timedelta(minutes=minute), user, None if op == "clear" else product,
                         op, None if op in ("remove", "clear") else value))
    events = spark.createDataFrame(rows, S.CART_EVENTS)
    got = {(r.user_id, r.product_id): r.quantity for r in cart.fold_cart_events(events).collect()}
    assert got == replay(rows)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(HISTORY, min_size=30, max_size=40), st.integers(0, 6))
def test_batch_on_state_matches_replay(spark, histories, cut):
    rows, eid = [], 0
    for user, hist in enumerate(histories):
        for op, product, value, minute in hist:
            eid += 1
            rows.append((eid, T0 + dt.timedelta(minutes=minute), user, None if op == "clear" else product,
                         op, None if op in ("remove", "clear") else value))
    events = spark.createDataFrame(rows, S.CART_EVENTS)
    split = T0 + dt.timedelta(minutes=cut)
    state = cart.fold_cart_events(events.where(events.ts < split))
    nxt = cart.apply_cart_batch(state, events.where(events.ts >= split))
    got = {(r.user_id, r.product_id): r.quantity for r in nxt.collect()}
    assert got == replay(rows)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(HISTORY, min_size=30, max_size=40), st.integers(0, 1000))
def test_compaction_is_exact_for_any_later_events(spark, histories, salt):
    """fold(compact(A) + B) == fold(A + B) for an arbitrary split of the
    events into A (already seen) and B (arriving later, older or newer)."""
    rows, eid = [], 0
    for user, hist in enumerate(histories):
        for op, product, value, minute in hist:
            eid += 1
            rows.append((eid, T0 + dt.timedelta(minutes=minute), user, None if op == "clear" else product,
                         op, None if op in ("remove", "clear") else value))
    seen = [r for r in rows if (r[0] * 7919 + salt) % 3 != 0]
    later = [r for r in rows if (r[0] * 7919 + salt) % 3 == 0]
    a = spark.createDataFrame(seen, S.CART_EVENTS)
    b = spark.createDataFrame(later, S.CART_EVENTS)
    got = {(r.user_id, r.product_id): r.quantity
           for r in cart.fold_cart_events(cart.compact_cart_log(a).unionByName(b)).collect()}
    assert got == replay(rows)
