"""JOIN-8 against replaying the edits one after the other."""

import random

import pytest

from lectern.operators.workspace import apply_file_edits

WS = "ws string, path string, name string, is_dir boolean, is_tmpl boolean, is_immutable boolean, is_hidden boolean, contents string"


def replay(files, edits, sudo):
    """``files``: path → (is_dir, guarded, contents)."""
    files, out = dict(files), []
    for op, path, contents in edits:
        parent = path.rsplit("/", 1)[0] if "/" in path else None
        there = files.get(path)
        status = "applied"
        if parent is not None and not files.get(parent, (False,))[0]:
            status = "refused: no such file" if op == "remove" else "refused: parent is not a folder"
        elif there and there[1] and not sudo:
            status = "refused: protected file"
        elif op == "remove":
            if there is None:
                status = "refused: no such file"
            else:
                files = {p: f for p, f in files.items() if p != path and not p.startswith(path + "/")}
        elif op == "write":
            if there and there[0]:
                status = "refused: target is a folder"
            else:
                files[path] = (False, there[1] if there else False, contents)
        elif there and not there[0]:
            status = "refused: target is a file"
        elif there is None:
            files[path] = (True, False, None)
        out.append(status)
    return files, out


def _case(rng):
    files = {}
    for _ in range(rng.randrange(12)):
        path = rng.choice("abc")
        for _ in range(rng.randrange(4)):
            if files.get(path, (True,))[0]:
                files.setdefault(path, (True, rng.random() < 0.2, None))
                path += "/" + rng.choice("abc")
        files.setdefault(path, (rng.random() < 0.5, rng.random() < 0.2, "old"))
    files = {p: (d, g, None if d else c) for p, (d, g, c) in files.items()}
    edits = [(rng.choice(["write", "write", "mkdir", "mkdir", "remove"]), "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))), f"v{i}") for i in range(60)]
    return files, edits


@pytest.mark.parametrize("sudo", [False, True])
def test_equals_replay(spark, sudo):
    rng = random.Random(int(sudo))
    cases = {f"w{k}": _case(rng) for k in range(60)}
    ws = [(k, p, p.rsplit("/", 1)[-1], d, False, g, False, c) for k, (files, _) in cases.items() for p, (d, g, c) in files.items()]
    edits = [(k, 10 * i, op, p, None if op == "remove" else c) for k, (_, es) in cases.items() for i, (op, p, c) in enumerate(es)]
    new, outcomes = apply_file_edits(spark.createDataFrame(ws, WS), spark.createDataFrame(edits, "ws string, seq long, op string, path string, contents string"), ["ws"], sudo)
    got = {}
    for r in new.collect():
        assert got.setdefault(r.ws, {}).setdefault(r.path, (r.is_dir, r.is_immutable, r.contents)) is not None
    assert new.count() == sum(len(v) for v in got.values())
    status = {(r.ws, r.seq): r.status for r in outcomes.collect()}
    for k, (files, es) in cases.items():
        want, out = replay(files, es, sudo)
        assert [status[(k, 10 * i)] for i in range(len(es))] == out, k
        assert got.get(k, {}) == want, k


def test_nothing_to_do(spark):
    ws = spark.createDataFrame([("w", "a", "a", True, False, False, False, None)], WS)
    edits = spark.createDataFrame([], "ws string, seq long, op string, path string, contents string")
    new, outcomes = apply_file_edits(ws, edits, ["ws"])
    assert new.count() == 1 and outcomes.count() == 0
