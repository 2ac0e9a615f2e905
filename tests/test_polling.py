"""The polling source against a server of the test's own."""

import http.server
import threading
import time

import pytest

from kurtosia.sources import polling


@pytest.fixture
def server():
    told = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            n = len(told)
            told.append(n)
            self.send_response(503 if n == 1 else 200)
            self.end_headers()
            self.wfile.write(b'{"n": %d}' % n)

        def log_message(self, *args):
            pass

    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/data", told
    httpd.shutdown()


def run_until(spark, url, at, wanted):
    query = polling.poll(spark, url, f"{at}/log").writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(processingTime="200 milliseconds").start(f"{at}/out")
    try:
        for _ in range(300):
            if query.exception():
                raise query.exception()
            if query.lastProgress and query.lastProgress["batchId"] + 1 >= wanted:
                return
            time.sleep(0.1)
        raise AssertionError("the stream stands still")
    finally:
        query.stop()


def test_a_restart_loses_and_repeats_nothing(spark, server, tmp_path):
    url, told = server
    run_until(spark, url, tmp_path, 3)
    run_until(spark, url, tmp_path, 7)
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows))) and len(rows) >= 7
    assert [r.body for r in rows] == [None if n == 1 else f'{{"n": {n}}}' for n in range(len(rows))]
    assert rows[1].status == 503 and rows[1].error and rows[0].status == 200 and rows[0].error is None
    assert all(a.read_at <= b.read_at for a, b in zip(rows, rows[1:], strict=False))
    assert len(told) - len(rows) <= 1  # the answer of a batch that was stopped waits in the log
    assert len(list((tmp_path / "log").glob("*.json"))) <= 3


def test_answers_are_replayed_from_the_log(server, tmp_path):
    url, told = server
    options = {"url": url, "log": str(tmp_path / "log")}
    rows, end = polling._Reader(options).read({"seq": 0})
    first = list(rows)
    again = polling._Reader(options)
    assert list(again.read({"seq": 0})[0]) == list(again.readBetweenOffsets({"seq": 0}, end)) == first and told == [0]
    again.commit(end)
    with pytest.raises(FileNotFoundError):
        list(again.readBetweenOffsets({"seq": 0}, end))


def test_no_server_is_a_row_with_an_error(tmp_path):
    rows, _ = polling._Reader({"url": "http://127.0.0.1:9/data", "log": str(tmp_path), "timeout": "1"}).read({"seq": 0})
    ((seq, at, status, body, error),) = rows
    assert (seq, status, body) == (0, None, None) and error and at is not None


def test_options_are_asked_for(spark, tmp_path):
    with pytest.raises(ValueError, match="needs url and log"):
        polling.HttpPoll({}).simpleStreamReader(None)
    with pytest.raises(ValueError, match="http or https"):
        polling.HttpPoll({"url": "file:///etc/hosts", "log": str(tmp_path)}).simpleStreamReader(None)
