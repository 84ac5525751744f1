"""Retries by a clock that only tests move."""

import json
import os
from collections import defaultdict

import pytest

from redraft.operators import attempts


class Clock:
    """Seconds in a file, so that tasks and driver read the same time."""

    def __init__(self, path):
        self.path = str(path)
        self.set(1000.0)

    def set(self, value):
        with open(self.path, "w") as f:
            f.write(repr(value))

    def __call__(self):
        with open(self.path) as f:
            return float(f.read())

    def sleep(self, seconds):
        assert seconds > 0
        self.set(self() + seconds)


def scripted(script, log):
    """A client that says for each file and call in turn what the script has; calls are logged in files, one for each."""

    def client(file, prompt, turns):
        folder = f"{log}/{file}"
        os.makedirs(folder, exist_ok=True)
        n = len(os.listdir(folder))
        with open(f"{folder}/{n}", "w") as f:
            json.dump([prompt, turns], f)
        said = script[file][n]
        if said == "late":
            raise TimeoutError("no answer in time")
        if said == "broken":
            raise ValueError("no connection")
        return tuple(said) if isinstance(said, list) else said

    return client


SCRIPT = {
    "fine": ["one", "two"], "empty once": ["", "one", "two"], "empty twice": ["x", "", "two"], "late": ["late", "one", "late", "two"], "late twice": ["late", "late"], "late then failed": ["late", [False, "half"], "two"],
    "empty then late": ["", "late", "one", "two"], "late then empty": ["late", "", "two"], "failed": [[False, "no"]], "broken": ["broken"], "single late": ["late"], "single empty": ["", "one"], "single": ["one"],
}
WANT = {
    "fine": ["ok", "ok"], "empty once": ["empty", "ok", "ok"], "empty twice": ["empty", "empty", "ok"], "late": ["timeout", "ok", "timeout", "ok"], "late twice": ["timeout", "timeout"], "late then failed": ["timeout", "failed", "ok"],
    "empty then late": ["empty", "timeout", "ok", "ok"], "late then empty": ["timeout", "empty", "ok"], "failed": ["failed"], "broken": ["error"], "single late": ["timeout"], "single empty": ["empty", "ok"], "single": ["ok"],
}


@pytest.fixture(scope="module")
def chunks(spark):
    rows = []
    for f in SCRIPT:
        rows += [(f, 0, 1, False, f"ask {f}")] if f.startswith("single") else [(f, 0, 3, f == "fine", f"ask {f} 0"), (f, 4, 60, False, f"ask {f} 4")]
    return spark.createDataFrame(rows, "file string, chunk int, n long, tests boolean, prompt string")


def test_delays_and_stops(spark, chunks, tmp_path):
    clock = Clock(tmp_path / "clock")
    made = attempts.run(chunks, scripted(SCRIPT, tmp_path / "calls"), 3, clock, clock.sleep).collect()
    of = defaultdict(list)
    for r in sorted(made, key=lambda r: (r["file"], r["chunk"], r["attempt"])):
        of[r["file"]].append(r)
    assert {f: [r["outcome"] for r in rs] for f, rs in of.items()} == WANT
    for rs in of.values():
        for a, b in zip(rs, rs[1:], strict=False):
            waited = b["started"].timestamp() - a["ended"].timestamp()
            if b["attempt"] > 1:
                assert waited >= (2 if a["outcome"] == "empty" else 10) and a["chunk"] == b["chunk"]
            assert waited >= 0
    calls = {f: [json.load(open(f"{tmp_path}/calls/{f}/{n}")) for n in range(len(rs))] for f, rs in of.items()}
    assert calls["single"] == [["ask single", 5]] and calls["fine"][0] == ["ask fine 0", 33] and calls["fine"][1] == ["ask fine 4\n\nDone before:\none", 40]
    assert attempts.AGAIN in calls["empty once"][1][0] and attempts.AGAIN not in calls["late"][1][0]
    assert clock() < 1000 + 60  # files wait side by side


def test_a_broken_run_goes_on(spark, chunks, tmp_path):
    clock = Clock(tmp_path / "clock")
    chunks = chunks.where("file in ('late then failed', 'empty once', 'single')")
    whole = attempts.run(chunks, scripted(SCRIPT, tmp_path / "calls"), 3, clock, clock.sleep)
    first = whole.where("chunk = 0 and attempt = 1")
    done = {r["file"]: 1 for r in first.collect()}
    rest = {f: s[done[f] :] for f, s in SCRIPT.items()}
    clock.set(1000.0)
    again = attempts.run(chunks, scripted(rest, tmp_path / "more"), 3, clock, clock.sleep, first)
    keys = ["file", "chunk", "attempt", "outcome", "answer"]
    assert sorted(map(tuple, again.select(*keys).collect())) == sorted(map(tuple, whole.select(*keys).collect()))


def test_nothing_to_do(spark, chunks, tmp_path):
    clock = Clock(tmp_path / "clock")
    assert attempts.run(chunks.limit(0), scripted({}, tmp_path), 3, clock, clock.sleep).collect() == []
    stand = attempts.standing(chunks, spark.createDataFrame([], attempts.ATTEMPTS)).collect()
    assert {(r["state"], r["reason"], r["attempt"], r["chunk"], r["due"]) for r in stand} == {("due", "first", 1, 0, None)} and len(stand) == len(SCRIPT)
