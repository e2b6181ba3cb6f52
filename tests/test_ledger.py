"""Requests are asked once, also by jobs that die, and models are made once a worker."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.sources import ledger, services


def counting(folder, fails=lambda prompt, n: None):
    """A generator that leaves a file for each call."""

    def generator(prompt):
        n = len([x for x in os.listdir(folder) if x.startswith(prompt + "-")])
        open(f"{folder}/{prompt}-{n}-{time.monotonic()}", "w").close()
        if wrong := fails(prompt, n):
            raise wrong
        return prompt.upper()

    return generator


def calls(folder):
    out = {}
    for name in os.listdir(folder):
        out[name.split("-")[0]] = out.get(name.split("-")[0], 0) + 1
    return out


@pytest.fixture
def prompts(spark):
    rows = [(i, f"p{i % 12}") for i in range(30)] + [(99, None)]
    return spark.createDataFrame(rows, "query_id long, prompt string").repartition(3)


def test_equal_prompts_are_one_request(spark, prompts, tmp_path):
    path, folder = str(tmp_path / "ledger"), str(tmp_path / "calls")
    os.mkdir(folder)
    for _ in range(2):
        got = {r["query_id"]: (r["answer"], r["error"]) for r in ledger.answered(prompts, counting(folder), path, rounds=3).collect()}
        assert got == {i: (f"P{i % 12}", None) for i in range(30)} | {99: (None, None)}
    assert calls(folder) == {f"p{i}": 1 for i in range(12)}
    ledger.answered(prompts, counting(folder), path, model="other", rounds=3).collect()
    assert calls(folder) == {f"p{i}": 2 for i in range(12)}


def test_a_job_that_dies_goes_on(spark, prompts, tmp_path):
    """Only the round in which it died is asked again."""
    path, folder = str(tmp_path / "ledger"), str(tmp_path / "calls")
    os.mkdir(folder)

    class Killed(BaseException):
        pass

    with pytest.raises(Exception):
        ledger.answered(prompts, counting(folder, lambda p, n: Killed() if p == "p5" else None), path, rounds=6)
    kept = {r["request"] for r in ledger.ledger(spark, path).collect()}
    asked = calls(folder)
    named = {r["request"]: r["prompt"] for r in prompts.where("prompt is not null").select("prompt", ledger.request_id(F.col("prompt"), "").alias("request")).collect()}
    done = {named[r] for r in kept}
    assert "p5" not in done
    got = {r["query_id"]: r["answer"] for r in ledger.answered(prompts, counting(folder), path, rounds=6).collect()}
    assert got == {i: f"P{i % 12}" for i in range(30)} | {99: None}
    again = calls(folder)
    assert all(again[p] == asked[p] == 1 for p in done) and all(again[f"p{i}"] >= 1 for i in range(12))


def test_failures_are_tried_again_and_given_up(spark, prompts, tmp_path):
    path, folder = str(tmp_path / "ledger"), str(tmp_path / "calls")
    os.mkdir(folder)
    flaky = counting(folder, lambda p, n: ValueError("busy") if (p == "p1" and n < 1) or p == "p2" else None)
    for _ in range(3):
        got = {r["query_id"]: (r["answer"], r["error"]) for r in ledger.answered(prompts, flaky, path, rounds=2, tries=2, runs=2, wait=0.01).collect()}
        assert got[1] == ("P1", None) and got[2] == (None, "ValueError: busy")
    made = calls(folder)
    assert made["p1"] == 2 and made["p2"] == 4 and made["p3"] == 1


def test_rate(spark, tmp_path):
    folder = str(tmp_path / "calls")
    os.mkdir(folder)
    few = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "query_id long, prompt string")
    assert ledger.answered(few, counting(folder), str(tmp_path / "ledger"), rounds=1, tasks=1, rate=10.0).count() == 6
    times = sorted(float(x.split("-")[2]) for x in os.listdir(folder))
    assert len(times) == 6 and min(b - a for a, b in zip(times, times[1:], strict=False)) > 0.09


def test_models_in_batches(spark, tmp_path):
    """The same vectors and scores as one text at a time; made once a worker and query."""
    folder = str(tmp_path / "made")
    os.mkdir(folder)

    def make():
        open(f"{folder}/{time.monotonic()}", "w").close()
        return services.HashingEncoder(16)

    texts = [None, "", *(f"word{i % 7} other{i}" for i in range(200))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r["i"]: r["v"] for r in df.select("i", ledger.batch_encoder(make)("t").alias("v")).collect()}
    want = services.HashingEncoder(16)([t or "" for t in texts])
    assert np.allclose([got[i] for i in range(len(texts))], want) and len(os.listdir(folder)) == 1
    score = ledger.batch_scorer(lambda: lambda pairs: [len(a) + 10.0 * len(b) for a, b in pairs])
    assert [r["s"] for r in df.where("i > 1").orderBy("i").limit(3).select(score("t", F.lit("xy")).alias("s")).collect()] == [len(t) + 20.0 for t in texts[2:5]]
