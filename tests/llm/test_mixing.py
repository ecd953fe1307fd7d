import random

from spotlake.llm import mixing


def test_every_source_stays_within_a_block():
    rng = random.Random(3)
    for _ in range(60):
        blocks = {f"s{i}": rng.randint(1, 200) for i in range(rng.randint(1, 12))}
        weights = {s: rng.randint(1, 20) for s in blocks}
        plan, total, got = mixing.schedule(blocks, weights), sum(weights.values()), dict.fromkeys(blocks, 0)
        assert len(plan) == sum(blocks.values())
        for t, (s, k, release, deadline) in enumerate(plan):
            assert k == got[s] and release <= t < deadline
            got[s] += 1
            assert all(abs(got[x] - weights[x] / total * (t + 1)) < 1 for x in blocks)
            if got[s] == blocks[s]:
                break


def slot_by_slot(blocks, weights):
    """The same schedule without periods: in every slot the released block with the earliest deadline."""
    left, done, out = dict(blocks), dict.fromkeys(blocks, 0), []
    while any(left.values()):
        active = {s: weights.get(s, 0) for s in left if left[s] and weights.get(s, 0) > 0} or {min(s for s in left if left[s]): 1}
        total, t0, k = sum(active.values()), len(out), dict.fromkeys(active, 0)
        while all(left[s] for s in active):
            t = len(out) - t0
            released = [(-(-(k[s] + 1) * total // w), s) for s, w in active.items() if k[s] * total // w <= t]
            deadline, s = min(released)
            out.append((s, done[s], t0 + k[s] * total // active[s], t0 + deadline))
            k[s], done[s], left[s] = k[s] + 1, done[s] + 1, left[s] - 1
    return out


def test_periods_say_what_slots_say():
    rng = random.Random(8)
    for _ in range(60):
        blocks = {f"s{i}": rng.randint(0, 90) for i in range(rng.randint(1, 7))}
        weights = {s: rng.randint(0, 9) for s in blocks}
        assert mixing.schedule(blocks, weights) == slot_by_slot(blocks, weights)


def check_all_rows(got, rows, weights, block):
    """Blocks, slots and positions of every row against the schedule written out."""
    sizes = {}
    for r in rows:
        sizes[r[3] or ""] = sizes.get(r[3] or "", 0) + 1
    plan = slot_by_slot({s: -(-n // block) for s, n in sizes.items()}, weights)
    slot_of, start, starts = {(s, k): t for t, (s, k, _, _) in enumerate(plan)}, 0, []
    for s, k, _, _ in plan:
        starts.append(start)
        start += min(block, sizes[s] - k * block)
    within = {}
    for r in sorted(got, key=lambda r: r.position):
        t = slot_of[r.source, r.block]
        n = within[t] = within.get(t, -1) + 1
        assert (r.slot, r.release, r.deadline, r.position) == (t, plan[t][2], plan[t][3], starts[t] + n)
    assert [within[t] + 1 for t in sorted(within)] == [min(block, sizes[s] - k * block) for s, k, _, _ in plan]


def test_rows_against_the_schedule(frame):
    rng = random.Random(2)
    rows = [(i, "t", "en", rng.choice(["a", "a", "a", "b", "b", "c", None, "d.e"])) for i in range(500)]
    sizes = {s: sum((r[3] or "") == s for r in rows) for s in {r[3] or "" for r in rows}}
    for block in (1, 7):
        check_all_rows(mixing.mix(frame(rows), block=block).collect(), rows, mixing.whole({s: n**mixing.FLATTEN for s, n in sizes.items()}), block)
    check_all_rows(mixing.mix(frame(rows), {"a": 0.2, "b": 0.7, "": 0.1, "nobody": 3}, block=4).collect(), rows, mixing.whole({"a": 0.2, "b": 0.7, "": 0.1, "nobody": 3}), 4)


def test_whole_and_in_order(frame):
    rows = [(i, f"t{i}", "en", f"s{i % 3}" if i % 2 else "big") for i in range(200)] + [(7, "t7", "en", "s1"), (None, "x", "en", None)]
    got = mixing.mix(frame(rows), {"big": 0.5, "s0": 0.25, "s1": 0.25}, block=4).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    early = [r.source for r in sorted(got, key=lambda r: r.position)[:40]]
    assert abs(early.count("big") - 20) <= 4 and abs(early.count("s0") - 10) <= 4
    assert max(r.position for r in got if r.source in ("s0", "s1", "big")) < min(r.position for r in got if r.source in ("s2", ""))


def test_many_sources_in_two_levels(frame):
    rows = [(i, "t", "en", f"s{i % 40}" if i % 3 else "large") for i in range(900)]
    weights = {f"s{i}": 1.0 for i in range(39)} | {"large": 13.0}
    got = mixing.mix(frame(rows), weights, block=2, group=8).collect()
    assert sorted(r.position for r in got) == list(range(900)) and {r.source for r in got} == {r[3] for r in rows}
    last = sum(r[3] == "s39" for r in rows)  # without a weight
    assert {r.source for r in got if r.position >= 900 - last} == {"s39"}
    early = [r.source for r in sorted(got, key=lambda r: r.position)[:400]]
    assert abs(early.count("large") - 100) <= 12 and all(early.count(f"s{i}") <= 16 for i in range(39))
    blocks = {}
    for r in got:
        blocks.setdefault((r.source, r.block), []).append(r.position)
    assert all(len(b) <= 2 for b in blocks.values())


def test_order_of_rows_and_odd_ones(odd, none, frame):
    out = mixing.in_mixed_order(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert mixing.mix(none).count() == 0 and mixing.in_mixed_order(none).count() == 0
    df = frame([(i, "t", "en", "ab"[i % 2]) for i in range(60)])
    want = [r.doc_id for r in sorted(mixing.mix(df).collect(), key=lambda r: r.position)]
    assert [r.doc_id for r in mixing.in_mixed_order(df).collect()] == want


def test_names_that_clash(frame):
    df = frame([(i, "t", "en", "ab"[i % 2]) for i in range(20)]).selectExpr("*", "77 as at", "78 as __at", "79 as id", "80 as `a.b`", "81 as position", "82 as i", "83 as s")
    out = mixing.in_mixed_order(df, position_col="where")
    assert out.columns == [*df.columns, "where"]
    assert {tuple(r)[4:11] for r in out.collect()} == {(77, 78, 79, 80, 81, 82, 83)}
    again = mixing.in_mixed_order(df, position_col="position")
    assert again.columns == [c for c in df.columns if c != "position"] + ["position"] and sorted(r.position for r in again.collect()) == list(range(20))
