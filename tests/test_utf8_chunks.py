"""Chunked UTF-8 decoding gives the verdict of the whole bytes, for tables and streams, any cut, order and restart."""

import random

import pytest
from pyspark.sql import functions as F

from glyphloom.streaming import utf8_chunks

PARTS = [b"a", "é".encode(), "€".encode(), "\U0001f600".encode(), b"\x80", b"\xc3", b"\xe2\x82", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe0\x80\x80", b"\xff", b"\xf0\x9f\x98", b"\xc0"]


def samples(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        good = rng.random() < 0.5
        yield k, b"".join(rng.choice(PARTS[: 4 if good else None]) for _ in range(rng.randrange(9))), rng.random() < 0.8


def cut(rng, data):
    """Pieces of one to five bytes, empty ones among them."""
    out, at = [], 0
    while at < len(data):
        size = rng.randrange(6)
        out.append(data[at : at + size])
        at += size
    return out or [b""]


def plain(verdict):
    return verdict["status"], tuple(verdict["reason"]) if verdict["reason"] else None, verdict["needed"] or 0, verdict["n_bytes"]


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    return [(k, data, last, cut(rng, data)) for k, data, last in samples(300, 3)]


@pytest.fixture(scope="module")
def wanted(spark, cases):
    whole = spark.createDataFrame([(k, data, last) for k, data, last, _ in cases], "k long, data binary, last boolean")
    return {r["k"]: plain(r["v"]) for r in whole.select("k", utf8_chunks.strict_result(F.col("data"), F.col("last")).alias("v")).collect()}


def python_verdict(data, last):
    try:
        data.decode()
        return "ok" if last else "incomplete", None
    except UnicodeDecodeError as e:
        if e.end == len(data) and "unexpected end" in e.reason and not last:
            return "incomplete", None
        return "rejected", e.start


def test_whole_bytes_agree_with_python(cases, wanted):
    for k, data, last, _ in cases:
        status, start = python_verdict(data, last)
        if wanted[k][0] != status:  # whole data that may go on is ok so far
            assert status == "incomplete" and wanted[k][0] == "ok" and not last
        if start is not None:
            assert start <= wanted[k][1][1] <= start + 3


def same(found, wanted, last):
    """Open documents without an unfinished sequence are incomplete with nothing needed in pieces."""
    status, reason, needed, n = wanted
    return found == ("incomplete" if status == "ok" and not last else status, reason, needed, n)


def test_pieces_of_tables(spark, cases, wanted):
    rows = [(k, i, p, last and i == len(ps) - 1) for k, _, last, ps in cases for i, p in enumerate(ps)]
    rows += rows[:50]  # repeats
    random.Random(1).shuffle(rows)
    pieces = spark.createDataFrame([*rows, (None, 0, b"x", True), (7, None, b"x", True)], "k long, seq int, data binary, last boolean")
    found = {r["k"]: plain(r["verdict"]) for r in utf8_chunks.verdicts(pieces, "k").collect()}
    assert [(k, found[k], wanted[k]) for k, _, last, _ in cases if not same(found[k], wanted[k], last)] == []
    assert utf8_chunks.verdicts(pieces.where("false"), "k").count() == 0


def test_pieces_of_streams_with_restarts(spark, cases, wanted, tmp_path):
    rows = [(k, i, p, last and i == len(ps) - 1) for k, _, last, ps in cases[:120] for i, p in enumerate(ps)]
    rows += rows[::7]
    random.Random(2).shuffle(rows)
    kind = "k long, seq int, data binary, last boolean"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found, batches = {}, []
    try:
        for part in range(3):  # each starts the query anew, from the checkpoint
            spark.createDataFrame(rows[part::3], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
            query = utf8_chunks.stream_verdicts(stream, "k").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
            run = query.foreachBatch(lambda df, _: batches.append(df.collect())).start()
            run.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(batches) == 3
    for batch in batches:
        found |= {r["k"]: plain(r["verdict"]) for r in batch}
    wrong = []
    for k, _, last, _ in cases[:120]:
        ok = same(found[k], wanted[k], last)
        if not ok and wanted[k][0] == "rejected" and found[k][:2] == wanted[k][:2]:
            ok = True  # a stream stops counting bytes at the fault
        wrong += [] if ok else [(k, found[k], wanted[k])]
    assert wrong == []


class _Calls:
    """A value or map of state that keeps a list of what is asked of it."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("get", "getValue"):
                return self.held.get(args)
            if name in ("exists", "containsKey"):
                return args in self.held
            if name in ("update", "updateValue"):
                self.held[args[:-1]] = args[-1]
            return None

        return call


def test_a_whole_document_costs_one_read_and_one_write_of_state():
    """The time of a stream goes with the calls to its state; pieces that have not to wait need none of their own."""
    calls = []
    decoder = utf8_chunks._Decoder()
    decoder.place, decoder.early = _Calls(calls), _Calls(calls)
    piece = {"n": 2, "head": b"", "after": b"a", "kind": None, "offset": None, "byte": None, "cp": None, "tail": b""}
    rows = [utf8_chunks.Row(seq=i, last=i == 4, **piece) for i in (3, 0, 1, 4, 2, 0)]
    found = list(decoder.handleInputRows((7,), iter(rows), None))
    assert [(r["key"], r["status"], r["n_bytes"]) for r in found] == [(7, "ok", 10)] and calls == ["get", "update"]
