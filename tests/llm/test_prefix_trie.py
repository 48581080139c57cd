"""Conversation prefix trie against a plain recomputation."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from corpus_fixtures import CLASHING

from cartwheel.llm import prefix_trie as P

OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), tie, role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        stack, seen = [node], []
        while stack:
            seen.append(stack.pop())
            stack += children[seen[-1]]
        return seen

    out = []
    for node, m in members.items():
        sub = below(node)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in sub if x)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]),
                    sum(not children[x] for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    ddl = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in (*CLASHING, "depth", "d0", "home"))
    return spark.createDataFrame([(*r, *["x"] * (len(CLASHING) + 3)) for r in rows], ddl).repartition(3)


def check(spark, rows, **options):
    got = P.prefix_trie(*P.spliced(P.turns(table(spark, rows))), **options)
    assert sorted((tuple(r) for r in got.select(*OUT).collect()), key=str) == brute(rebuilt(rows))


def some(n, seed=1, longest=14):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes, please", "né", "", None])))
    return rows


def test_blocks_shards_and_chunks(spark):
    """Blocks of 4 turns, shards of 60 rows and chunks of 3 ids: everything that
    crosses their borders."""
    rows = some(60) + [(c, t, "user", "same") for c in range(100, 160) for t in range(9)]
    check(spark, rows, block=4, shard_rows=60, chunk_ids=3)


def test_whole_blocks(spark):
    check(spark, some(40, seed=2))


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [(None, 0, "user", "nobody"), (5, None, None, None), (5, None, None, None), (5, 1, "user", "a"), (5, 1, "user", "b"),
            (6, 0, "user", "a"), (9, 0, "user", None), (-7, 0, "user", "x"), (-5, 0, "user", "y"), (-3, 2, "assistant", "z"),
            (2 ** 40, 0, "user", "w" * 200_000)] + [(c, 0, "user", "short") for c in range(1000, 1030)]
    assert any(not t for t in rebuilt(rows).values())
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(1, 0, "user", "x")], [(3, 0, None, None)]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_conversations_as_they_are(spark):
    rows = some(30, seed=3)
    got = P.prefix_trie(*P.whole(P.turns(table(spark, rows))), block=4, shard_rows=50)
    own = defaultdict(list)
    for c, t, role, text in rows:
        own[c].append((role, text or ""))
    assert sorted((tuple(r) for r in got.select(*OUT).collect()), key=str) == brute(own)


def test_slot_table_is_minimal_and_verified():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 62, (5000, 5)).astype(np.uint64)
    table = P.SlotTable(np.concatenate((keys, keys[:1000])))
    slots = table.slots(keys)
    assert len(table) == 5000 and sorted(slots) == list(range(5000))
    assert (table.keys[slots] == keys).all()
    with pytest.raises(KeyError):
        table.slots(keys[:1] + np.uint64(1))
    assert len(P.SlotTable(keys[:0])) == 0


def test_hot_conversation_is_cut(spark):
    """One conversation with a third of the turns: its blocks go to several shards."""
    rows = [(500, t, "user", f"t{t % 50}") for t in range(900)] + some(140, seed=4)
    check(spark, rows, block=64, shard_rows=300)
