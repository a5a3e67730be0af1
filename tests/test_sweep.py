import json
from types import SimpleNamespace

import pandas as pd
import pytest

from tillroll.schema import RULES_DDL
from tillroll.sources import ingest
from tillroll.streaming import jobs
from tillroll.streaming.jobs import document_stream, sweep, sweep_session

TEXT = "MAXIMA\nPiens {i}L\n{i},00 X 1 gab. {i},00 A\n01.02.2026"


@pytest.fixture(scope="module")
def session(spark):
    yield sweep_session(spark)


def run(session, folder, target, log, retain_ms=None):
    rules = session.createDataFrame([], RULES_DDL)
    sweep(document_stream(session, str(folder)), str(target), rules, str(log), retain_ms).awaitTermination()
    return {r.receipt_number: float(r.total) for r in session.read.parquet(f"{target}/receipts").collect()}


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.txt").write_text(text)


def test_files_are_swept_once_across_restarts(session, tmp_path):
    folder, target, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"
    put(folder, "r1", TEXT.format(i=1))
    put(folder, "r2", "no receipt")
    put(folder, "r3", "")
    assert run(session, folder, target, log) == {"r1": 1.0}
    put(folder, "r4", TEXT.format(i=4))
    put(folder, "other.r1", TEXT.format(i=9))
    assert run(session, folder, target, log) == {"r1": 1.0, "r4": 4.0, "other.r1": 9.0}
    lines = session.read.parquet(f"{target}/items")
    assert lines.count() == 3 and {r.name for r in lines.collect()} == {"Piens 1L", "Piens 4L", "Piens 9L"}


def rows(session, folder, documents):
    session.createDataFrame(documents, "receipt_number string, text string").coalesce(1).write.mode("append").parquet(str(folder))
    return session.readStream.schema("receipt_number string, text string").parquet(str(folder))


def test_state_decides_without_the_stored_receipts(session, tmp_path):
    folder, target, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    rules = session.createDataFrame([], RULES_DDL)
    first, second = TEXT.format(i=1), TEXT.format(i=2)
    batches = [[("a", second), ("a", first), ("b", "nothing"), (None, first)], [("a", second), ("b", first)], [("a", first), ("b", second), ("c", second)]]
    for batch in batches:
        documents = rows(session, folder, batch)
        sweep(documents, target, rules, log).awaitTermination()
        if batch is batches[0]:
            # what is stored may be moved away: the state remembers the numbers
            stored_first = {r.receipt_number: float(r.total) for r in session.read.parquet(f"{target}/receipts").collect()}
            target = str(tmp_path / "out2")
    assert stored_first == {"a": 1.0}
    assert {r.receipt_number: float(r.total) for r in session.read.parquet(f"{target}/receipts").collect()} == {"b": 1.0, "c": 2.0}


def test_marks_go_after_their_time(session, tmp_path):
    folder, target, log = (str(tmp_path / name) for name in ("in", "out", "log"))
    rules = session.createDataFrame([], RULES_DDL)
    for batch, retain_ms in (([("a", TEXT.format(i=1))], 1), ([("x", TEXT.format(i=2))], 1), ([("a", TEXT.format(i=3))], 1)):
        sweep(rows(session, folder, batch), target, rules, log, retain_ms).awaitTermination()
    totals = sorted((r.receipt_number, float(r.total)) for r in session.read.parquet(f"{target}/receipts").collect())
    assert totals == [("a", 1.0), ("a", 3.0), ("x", 2.0)]


class Handle:
    """State and timers of one key, with the calls counted."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


def swept(marks, numbers, now=0):
    parts = iter([pd.DataFrame({"receipt_number": numbers[k::2], "body": [f"{n}!" for n in numbers[k::2]]}) for k in (0, 1)])
    out = list(marks.handleInputRows((3,), parts, SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)))
    return sorted(n for df in out for n in df["receipt_number"])


def test_calls_of_a_batch_do_not_grow_with_its_numbers():
    """A call crosses from Python to Spark; the marks of a bucket are one value."""
    for retain_ms in (None, 10):
        handle, marks = Handle(), jobs.FirstDocuments(retain_ms)
        marks.init(handle)
        numbers = [f"r{i}" for i in range(1000)]
        assert swept(marks, numbers + numbers[:10]) == sorted(numbers) and handle.calls <= 4
        assert swept(marks, [*numbers[::2], "new"], 5) == ["new"] and handle.calls <= 10


def test_marks_of_a_bucket_go_one_by_one():
    """Each mark goes so long after its own number was last seen, whatever else is in the bucket."""
    handle, marks = Handle(), jobs.FirstDocuments(10)
    marks.init(handle)
    assert swept(marks, ["a", "b"], 0) == ["a", "b"] and swept(marks, ["b", "c"], 6) == ["c"] and handle.timers == {10}

    def fire(now):
        due, = handle.timers
        assert list(marks.handleExpiredTimer((3,), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda: due))) == []
        handle.timers.remove(due)  # as Spark does

    fire(12)
    assert handle.timers == {16} and swept(marks, ["a", "b", "c"], 13) == ["a"] and handle.timers == {23}
    fire(30)
    assert handle.timers == set() and handle.value is None and swept(marks, ["b"], 31) == ["b"]


def test_load_counts_refuses_faults_and_existing_targets(spark, tmp_path):
    receipt = {"date": "2026-01-01", "store": "A", "total": 2.5, "receipt_number": "n1", "items": [{"name": "Piens 1L", "quantity": 1, "price": 2.5}, {"name": "Maize"}]}
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "one.json").write_text(json.dumps({"synthetic": True, "receipts": [receipt, {**receipt, "receipt_number": "n2"}]}))
    rules = spark.createDataFrame([], RULES_DDL)
    assert [tuple(r) for r in ingest.load_nested(spark, str(source), target, rules).collect()] == [(2, 4)]
    with pytest.raises(FileExistsError):
        ingest.load_nested(spark, str(source), target, rules)
    assert [tuple(r) for r in ingest.load_nested(spark, str(source), target, rules, overwrite=True).collect()] == [(2, 4)]
    (source / "two.json").write_text(json.dumps({"synthetic": True, "receipts": [{**receipt, "total": "much"}]}))
    with pytest.raises(ValueError, match=r"two.json\[0\]: total"):
        ingest.load_nested(spark, str(source), str(tmp_path / "new"), rules)
    assert not (tmp_path / "new").exists()
