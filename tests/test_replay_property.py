"""Property tests against sequential replays: status triggers and
registration intake on random inputs (ties in time included)."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cartwheel import schemas as S
from cartwheel.operators import ingest, orders

T0 = dt.datetime(2024, 1, 1)
STATUS_EVENT = st.tuples(st.integers(0, 7), st.sampled_from(["payment", "approval"]),
                         st.sampled_from(["Completed", "Pending", "Approved", "Rejected", "approved"]),
                         st.integers(0, 5))


def replay_status(start, events):
    state = {o: [s, a] for o, s, a in start}
    for eid, ts, oid, kind, value in sorted(events, key=lambda e: (e[1], e[0])):
        if oid not in state:
            continue
        v = value.lower()
        if kind == "payment" and v == "completed":
            state[oid][0] = "Processing"
        elif kind == "approval" and v == "approved":
            state[oid] = ["Processing", "Approved"]
        elif kind == "approval" and v == "rejected":
            state[oid] = ["Cancelled", "Rejected"]
    return {o: tuple(v) for o, v in state.items()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(STATUS_EVENT, min_size=0, max_size=40))
def test_status_triggers_match_replay(spark, raw_events):
    start = [(o, ["Pending", "Shipped", "Processing"][o % 3], ["Pending", "Approved", "Rejected"][o % 3])
             for o in range(6)]
    order_rows = [(o, 1, Decimal("1.00"), s, T0, a, None) for o, s, a in start]
    o_df = spark.createDataFrame(order_rows, S.ORDERS)
    events = [(i, T0 + dt.timedelta(minutes=m), oid, kind, value)
              for i, (oid, kind, value, m) in enumerate(raw_events)]
    e_df = spark.createDataFrame(events, S.STATUS_EVENTS)
    got = {r.order_id: (r.order_status, r.seller_approval_status)
           for r in orders.order_status_latest(o_df, e_df).collect()}
    assert got == replay_status(start, events)


EMAILS = st.sampled_from(["a@x.com", "A@X.com", " b@x.com", "c@x.com", "C@x.COM", "d@x.com"])


def replay_registration(existing, requests, max_id):
    known = {e.strip().lower() for e in existing}
    accepted, out, next_id = set(), {}, max_id
    for rid, email in sorted(requests):
        key = email.strip().lower()
        if key in known:
            out[rid] = ("duplicate_existing", None)
        elif key in accepted:
            out[rid] = ("duplicate_in_batch", None)
        else:
            next_id += 1
            accepted.add(key)
            out[rid] = ("accepted", next_id)
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(EMAILS, min_size=0, max_size=3), st.lists(EMAILS, min_size=1, max_size=15))
def test_registration_matches_replay(spark, existing, incoming):
    users = spark.createDataFrame([(10 + i, "n", e, "addr", "1", None) for i, e in enumerate(existing)]
                                  or [(10, "n", "zz@x.com", "addr", "1", None)], S.USERS)
    if not existing:
        existing = ["zz@x.com"]
    requests = [(100 + 3 * i, e) for i, e in enumerate(incoming)]
    regs = spark.createDataFrame([(rid, "n", e, "addr", "1") for rid, e in requests], S.REGISTRATIONS)
    report, new_users = ingest.registration_ingest(users, regs)
    got = {r.request_id: (r.status, r.user_id) for r in report.collect()}
    max_id = 10 + len(existing) - 1
    assert got == replay_registration(existing, requests, max_id)
    assert new_users.count() == sum(1 for s, _ in got.values() if s == "accepted")
