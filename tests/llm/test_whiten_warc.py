"""Whitening against eigenvectors of the covariance, archives against gzip and a second
reader, on whole small tables and odd rows."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import queries, warc, whiten

VECTORS = "vec_id long, embedding array<float>, label int"
PAGES = "page_id long, url string, html string"


def by_hand(vectors):
    """x as whole numbers, exact sums, covariance and its eigenvectors."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums, strict=True)] for row in x])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, values[::-1], turn[:, ::-1]


def check_whitening(rows, vectors):
    ids = sorted(vectors)
    deviation, centred, values, turn = by_hand([vectors[i] for i in ids])
    got = {(r["vec_id"], r["component"]): r for r in rows}
    k = min(32, centred.shape[1])
    assert len(rows) == len(got) == len(ids) * k
    assert all(r["n"] == len(ids) for r in rows)
    assert [got[i, 1]["deviation"] for i in ids] == deviation
    total = values.sum()
    for c in range(k):
        assert got[ids[0], c + 1]["explained"] == pytest.approx(values[c] / total, rel=1e-9)
        mine, his = np.array([got[i, c + 1]["whitened"] for i in ids]), centred @ turn[:, c] / np.sqrt(values[c])
        assert min(np.abs(mine - his).max(), np.abs(mine + his).max()) < 1e-6
    white = np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    off = np.abs(np.cov(white.T, bias=True) - np.eye(k)).max()
    assert off < 1e-9 and all(abs(r["identity_error"] - off) < 1e-9 for r in rows)


def test_whitening_of_the_table(spark, sf_dir):
    rows = queries.op11_whitening(spark, sf_dir).collect()
    check_whitening(rows, {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()})


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = {i: (rng.normal(size=5) * [1, 10, 100, 3, 0.5]).astype(np.float32).tolist() for i in range(60)}
    good |= {i: good[0] for i in range(60, 90)}  # a third is one vector
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [math.nan] * 5), (103, [math.inf, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in [*good.items(), *bad]], VECTORS).repartition(7)
    for name in ("n", "component", "y", "node", "data", "deviation"):
        df = df.withColumn(name, F.lit("x"))
    check_whitening(whiten.whiten(df).collect(), good)


def test_whitening_without_variance(spark):
    """Repeated rows stay, components without variance are null, nothing crashes."""
    assert whiten.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whiten.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS)).collect() == []
    rows = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], VECTORS)).collect()
    assert len(rows) == 4 and all(r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in rows)
    flat = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [3.0, 2.0], 0), (2, [5.0], 0)], VECTORS)).collect()
    by = {(r["vec_id"], r["component"], r["deviation"]) for r in flat}
    x = [[64, 128], [192, 128], [320, 0]]  # the shorter one ends in zeros
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {d for *_, d in by} == {sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x} and len(flat) == 6
    assert max(r["identity_error"] for r in flat) < 1e-9
    line = whiten.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(9)], VECTORS)).collect()
    assert {r["component"] for r in line if r["whitened"] is None} == {2} and sum(r["explained"] for r in line if r["vec_id"] == 0) == pytest.approx(1)


def test_whitening_beyond_longs(spark):
    """Exact, or null where a long can't hold it."""
    rows = whiten.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [3.0, 1e7]), (3, [0.0, -1e7])], "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None for r in rows) and len(rows) == 6
    big = [[float(3 * 10**5), 0.0], [0.0, 1.0], [5.0, -1e5]]
    rows = whiten.whiten(spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")).collect()
    assert [r["deviation"] for r in sorted(rows, key=lambda r: (r["vec_id"], r["component"]))][::2] == by_hand(big)[0]


@pytest.mark.parametrize("shape", [(1, 1), (5, 3), (3, 5), (40, 17)])
def test_rotations(shape):
    """Small deviations keep their digits."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=shape) * np.logspace(0, -9, shape[1])
    lengths, turn = whiten.jacobi(a)
    k = min(shape)
    assert np.allclose(lengths[:k], np.linalg.svd(a, compute_uv=False)[:k], rtol=1e-9)
    assert np.allclose(turn.T @ turn, np.eye(shape[1]), atol=1e-12)
    assert np.allclose(np.linalg.norm(a @ turn, axis=0), lengths, rtol=1e-9, atol=1e-14)


def test_triangles_merge_in_levels(spark, monkeypatch):
    """More tasks than a merge takes."""
    monkeypatch.setattr(whiten, "FAN", 2)
    rng = np.random.default_rng(2)
    good = {i: rng.normal(size=4).tolist() for i in range(50)}
    df = spark.createDataFrame([(i, v, 0) for i, v in good.items()], VECTORS).repartition(9)
    check_whitening(whiten.whiten(df).collect(), {r["vec_id"]: r["embedding"] for r in df.collect()})


# archives


def expected(rows, least=0):
    """(page_id, payload_bytes, digest, type, refers_to) of rows without ties."""
    body = {i: (h or "").encode() for i, _, h in rows}
    owner = {}
    for i, b in body.items():
        owner[b] = max(owner.get(b, i), i)
    out = set()
    for i, b in body.items():
        revisit = len(b) >= least and owner[b] != i
        out.add((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", owner[b] if revisit else None))
    return out


def digests(df):
    return [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    long_text = "".join(rng.choice("abcdefghijklmnop\n\0é漢") for _ in range(400_000))
    texts = [None, "", "x", "x", "\r\n\r\n", long_text, long_text, "\0\0\0", "WARC/1.1\r\n\r\n", "y" * 50, *["many"] * 40]
    rows = [(i, None if i % 5 == 0 else f"http://h/{i} a\r\nb%20é", t) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, PAGES).repartition(5)


def test_warc_of_the_table(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = queries.op12_warc(spark, sf_dir)
    assert got.where("problem is not null").isEmpty()
    assert sorted(digests(got)) == sorted(expected(rows))


@pytest.mark.parametrize("least", [0, 2])
def test_warc_of_odd_pages(spark, pages, least):
    rows, df = pages
    for name in ("key", "body", "digest", "owner", "c", "own", "value"):
        df = df.withColumn(name, F.lit("z"))
    got = warc.round_trip(df, least)
    assert sorted(digests(got), key=str) == sorted(expected(rows, least), key=str) and got.where("problem is not null").isEmpty()


def test_hot_payload_is_dealt(spark, monkeypatch):
    monkeypatch.setattr("gleaner.llm.common.HOT_ROWS", 3)
    monkeypatch.setattr("gleaner.llm.common.HOT_SHARE", 10)
    rows = [(i, "u", "same" if i % 3 else str(i)) for i in range(60)]
    assert sorted(digests(warc.round_trip(spark.createDataFrame(rows, PAGES))), key=str) == sorted(expected(rows), key=str)


def test_warc_of_ties_and_nulls(spark):
    """Rows that tie for the largest page_id are responses; nulls come last."""
    rows = [(3, "a", "t"), (3, "b", "t"), (3, "b", "t"), (1, "a", "t"), (None, "a", "t"), (None, "a", "u"), (None, None, "u"), (None, "a", None)]
    got = digests(warc.round_trip(spark.createDataFrame(rows, PAGES)))
    short = sorted(((i, size, kind, to) for i, size, _, kind, to in got), key=str)
    assert short == sorted([(3, 1, "response", None)] * 3 + [(1, 1, "revisit", 3), (None, 1, "revisit", 3)] + [(None, 1, "response", None)] * 2 + [(None, 0, "response", None)], key=str)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_files_are_gzip_members(spark, pages, tmp_path):
    """Other programs read the files: one member a record, payloads as they were."""
    rows, df = pages
    warc.write(warc.plan(df), str(tmp_path / "w"))
    found = {}
    for file in (tmp_path / "w").glob("part-*"):
        data = file.read_bytes()
        whole, at, members = gzip.decompress(data), 0, 0
        while at < len(data):
            unpack = zlib.decompressobj(31)
            text = unpack.decompress(data[at:])
            at, members = len(data) - len(unpack.unused_data), members + 1
            head, _, block = text.partition(b"\r\n\r\n")
            length = int(head.rsplit(b"Content-Length: ", 1)[1])
            assert block[length:] == b"\r\n\r\n" and b"WARC-Type: " in head
            if b"X-Page-ID" in head and b"WARC-Type: response" in head:
                found[int(head.split(b"X-Page-ID: ")[1].split(b"\r\n")[0])] = block[:length].partition(b"\r\n\r\n")[2]
        assert whole.count(b"WARC-Record-ID") == members
    assert found == {i: (next(h or "" for j, _, h in rows if j == i)).encode() for i, _, _, kind, _ in expected(rows) if kind == "response"}
    kept = warc.read(spark, str(tmp_path / "w"), keep=True).where("record_type = 'response'").collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in kept} == found


def test_damage_is_seen_and_passed_over():
    sha = hashlib.sha1(b"payload").hexdigest()
    one = warc.member(1, "u", b"payload", sha, "<urn:1>", None, None, "d")
    two = warc.member(2, "u", b"payload", sha, "<urn:2>", None, None, "d")
    wrong = warc.member(3, "u", b"other", sha, "<urn:3>", None, None, "d")
    broken = one[:40] + bytes([one[40] ^ 255]) + one[41:]
    short = gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    longer = gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n")
    none = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n")
    for bad in (broken, wrong, short, longer, none, one[:-9], b"junk", gzip.compress(b"x" * 99)):
        rows = list(warc.records("f", bad + two))
        assert rows[-1]["page_id"] == 2 and rows[-1]["problem"] is None, bad
        assert rows[0]["problem"]
    assert list(warc.records("f", two[:-3]))[0]["problem"] == "member cut short"
    assert [r["page_id"] for r in warc.records("f", one + b"\0\0" + two + b"\0")] == [1, 2]


def test_missing_response_is_seen(spark, tmp_path):
    sha = hashlib.sha1(b"payload").hexdigest()
    rows = [(1, "u", b"payload", sha, "<urn:1>", "<urn:2>", None), (2, "u", b"payload", sha, "<urn:4>", None, None)]
    schema = "page_id long, url string, body binary, digest string, record_id string, refers_to string, refers_to_uri string"
    warc.write(spark.createDataFrame(rows, schema), str(tmp_path / "w"))
    got = {r["page_id"]: r["problem"] for r in warc.resolve(warc.read(spark, str(tmp_path / "w"))).collect()}
    assert got == {1: "response missing", 2: None}
