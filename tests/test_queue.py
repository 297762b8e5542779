"""Lease-queue replay against a plain model and restated scenarios."""

import random

import pytest

from ledgerline.operators.queue import queue_dead_letters, queue_depth, replay_leases, replay_outcomes, replay_state, queue_items

SCHEMA = "queue_id string, seq long, now_ms long, op string, msg_id string, delay_ms long, visibility_ms long, lease_ref long"


def model(rows, max_attempts):
    queues, out = {}, {}
    for q, seq, now, op, msg, delay, vis, ref in sorted(rows, key=lambda r: r[1]):
        items = queues.setdefault(q, [])

        def fail(i):
            i["ref"], i["n"], i["at"] = None, i["n"] + 1, now
            i["dead"] = i["n"] >= max_attempts

        if op == "enqueue":
            items.append(dict(id=msg, n=0, at=now + max(0, delay or 0), ref=None, until=0, dead=False))
            out[seq] = (True, msg, 0)
            continue
        for i in items:
            if not i["dead"] and i["ref"] is not None and i["until"] <= now:
                fail(i)
        if op == "lease":
            free = sorted((i["at"], i["id"]) for i in items if not i["dead"] and i["ref"] is None and i["at"] <= now)
            out[seq] = (False, None, None)
            if free:
                got = next(i for i in items if i["id"] == free[0][1])
                got["ref"], got["until"] = seq, now + max(1, vis or 0)
                out[seq] = (True, got["id"], got["n"])
        elif op == "count":
            live = [i for i in items if not i["dead"]]
            out[seq] = (sum(i["ref"] is None and i["at"] <= now for i in live), sum(i["ref"] is not None for i in live), len(items) - len(live))
        else:
            hit = [i for i in items if i["id"] == msg and ref is not None and i["ref"] == ref]
            for i in hit:
                items.remove(i) if op == "ack" else fail(i)
            out[seq] = (bool(hit), msg, hit[0]["n"] if hit else None)
    return out, queues


def outcomes(df):
    return {
        r.seq: (r.ready, r.leased, r.dead) if r.op == "count" else (r.done, r.out_msg, r.out_attempts) for r in df.collect()
    }


def random_log(seed, n):
    rng, now, rows, leases = random.Random(seed), 0, [], {}
    for seq in range(n):
        now += rng.choice([0, 1, 3, 20])
        q = rng.choice(["hot", "hot", "a", "b"])
        op = rng.choice(["enqueue", "enqueue", "lease", "lease", "lease", "ack", "nack", "count"])
        msg = f"m{seq:04}" if op == "enqueue" else f"m{rng.randrange(seq + 1):04}"
        ref = None
        if op in ("ack", "nack") and leases.get(q) and rng.random() < 0.9:
            ref = rng.choice(leases[q])
        if op == "lease":
            leases.setdefault(q, []).append(seq)
        rows.append((q, seq, now, op, msg, rng.choice([None, 0, 15]), rng.choice([5, 40]), ref))
    # Point acks and nacks at the message their lease got, as a real caller would.
    got, _ = model(rows, 3)
    return [r if r[7] is None else (*r[:4], got[r[7]][1] or r[4], *r[5:]) for r in rows]


@pytest.mark.parametrize("seed,max_attempts,max_rows", [(1, 3, 10**6), (2, 2, 10**6), (3, 3, 120)])
def test_replay_matches_model(spark, seed, max_attempts, max_rows):
    rows = random_log(seed, 400)
    want, left = model(rows, max_attempts)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out, items = replay_leases(df, max_attempts, max_rows)
    assert outcomes(out) == want
    items.persist()
    assert {(r.queue_id, r.msg_id): (r.attempts, r.available_at, r.lease_ref, r.dead) for r in items.collect()} == {
        (q, i["id"]): (i["n"], i["at"], i["ref"], i["dead"]) for q, all_ in left.items() for i in all_
    }
    dead = {(q, i["id"]) for q, all_ in left.items() for i in all_ if i["dead"]}
    assert dead and {(r.queue_id, r.msg_id) for r in queue_dead_letters(items).collect()} == dead
    now = max(r[2] for r in rows) + 30
    probes = [(q, 10_000 + n, now, "count", None, None, None, None) for n, q in enumerate(left)]
    counted, _ = model(rows + probes, max_attempts)
    assert {r.queue_id: (r.ready, r.leased, r.dead) for r in queue_depth(items, now, max_attempts).collect()} == {
        p[0]: counted[p[1]] for p in probes
    }


def test_state_carries_over(spark):
    rows = random_log(5, 200)
    want, _ = model(rows, 3)
    early = spark.createDataFrame([r for r in rows if r[1] < 110], SCHEMA)
    late = spark.createDataFrame([r for r in rows if r[1] >= 110], SCHEMA)
    assert outcomes(replay_outcomes(late, 3, replay_state(early, 3))) == {s: v for s, v in want.items() if s >= 110}


def test_scenarios(spark):
    def run(*cmds, max_attempts=3):
        rows = [("q", seq, *c) for seq, c in enumerate(cmds)]
        return outcomes(replay_outcomes(spark.createDataFrame(rows, SCHEMA), max_attempts))

    def enq(t, m, delay=0):
        return t, "enqueue", m, delay, None, None

    def lease(t, vis):
        return t, "lease", None, None, vis, None

    def end(t, op, m, ref):
        return t, op, m, None, None, ref

    def count(t):
        return t, "count", None, None, None, None

    # A lease that runs out counts an attempt; the message comes back.
    got = run(enq(0, "a"), lease(0, 40), count(0), lease(41, 40))
    assert got[1] == (True, "a", 0) and got[2] == (0, 1, 0) and got[3] == (True, "a", 1)
    # A wrong or missing lease changes nothing.
    got = run(enq(0, "a"), end(0, "ack", "a", None), lease(0, 9), end(1, "ack", "a", 99), end(1, "nack", "a", None), end(2, "ack", "a", 2), count(3))
    assert [got[i][0] for i in (1, 3, 4, 5)] == [False, False, False, True] and got[6] == (0, 0, 0)
    # A delayed message does not come before an older one.
    got = run(enq(0, "z"), enq(0, "a", 100), lease(0, 10), lease(5, 10), lease(120, 10))
    assert got[2][1] == "z" and got[3][0] is False and got[4][1] == "a"
    # Dead after the last attempt.
    got = run(enq(0, "p"), lease(0, 100), end(0, "nack", "p", 1), lease(0, 100), end(0, "nack", "p", 3), lease(0, 100), count(0), max_attempts=2)
    assert got[3] == (True, "p", 1) and got[5][0] is False and got[6] == (0, 0, 1)
