"""A replayed stream of navigation events gives what a plain loop gives, whatever its batches."""

import random

import pytest

from umbra.streaming import session


def _events():
    draw, rows, ts = random.Random(8), [], 1_700_000_000_000
    for i in range(260):
        ts += draw.choice([0, 1000, 4000, 20_000])
        user = draw.randrange(3)
        kind = draw.choices(["fix", "route", "error"], [20, 1, 2])[0]
        offset = draw.choice([2.0, 30.0, 60.0, 80.0, 90.0, 95.0])
        rows.append((user, i, ts, kind, draw.random() * (700 if i < 230 else 900), offset, draw.choice([None, 5.0, 5.0, 70.0, 200.0]), draw.choice([400.0, 400.0, 400.0, 3.0 if i > 200 else 50.0]), 800.0 + user, draw.random() < 0.7))
    return rows


def _looped(rows):
    """The rules told once more, plainly."""
    users, out = {}, {}
    for user, i, now, kind, along, offset, accuracy, direct, total, inside in rows:
        u = users.setdefault(user, {"total": None, "at": None, "strikes": 0, "waits": False, "quiet": 0, "arrived": False})
        if u["total"] is None:
            u["total"] = total
        action = "ignored"
        if kind == "route":
            u.update(total=total, at=None, strikes=0, waits=False, quiet=now + 8000)
            action = "route"
        elif kind == "error":
            if u["waits"]:
                u.update(waits=False, quiet=now + 15000)
                action = "failed"
        elif not u["arrived"]:
            off = False
            if not u["waits"] and now >= u["quiet"] and (accuracy or 0) <= 100:
                u["strikes"] = u["strikes"] + 1 if offset > max(35, accuracy or 0) else 0
                off = u["strikes"] >= 3
            if off:
                u["strikes"] = 0
                if inside:
                    u["waits"] = True
                    action = "reroute"
                else:
                    u["quiet"] = now + 60000
                    action = "outside"
            elif u["waits"]:
                action = "waiting"
            else:
                if offset <= 20 or u["at"] is None:
                    u["at"] = along
                left = u["total"] - min(u["total"], max(0, u["at"]))
                u["arrived"] = direct <= 15 or (left <= 15 and offset <= 35)
                action = "arrived" if u["arrived"] else "progress"
        left = None if u["at"] is None else u["total"] - min(u["total"], max(0, u["at"]))
        out[i] = (action, u["at"], left, u["strikes"])
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_replay_equals_loop(spark, files):
    rows = _events()
    want = _looped(rows)
    assert {"route", "failed", "reroute", "outside", "waiting", "arrived", "progress", "ignored"} == {w[0] for w in want.values()}
    frame = spark.createDataFrame(rows, session.EVENTS.replace("ts timestamp", "ts long")).selectExpr(*(f"timestamp_millis({c}) AS {c}" if c == "ts" else c for c in [f.split()[0] for f in session.EVENTS.split(", ")]))
    got = {r.event_id: (r.action, r.along_m, r.remaining_m, r.strikes) for r in session.replayed(spark, frame, files=files).collect()}
    assert got == want


def test_no_events(spark):
    assert session.replayed(spark, spark.createDataFrame([], session.EVENTS)).count() == 0
