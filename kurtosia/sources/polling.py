"""A stream of what an address answers when it is asked at each trigger.

An answer is there once, so it is written to a log in a shared folder before its offset is
told; a batch that runs again, also after a restart, reads it from there.  Answers of committed
batches leave the log.
"""

from __future__ import annotations

import datetime
import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

ANSWERS = "seq long, read_at timestamp, status int, body string, error string"


class _Log:
    """A file of JSON by number in a folder."""

    def __init__(self, folder: str) -> None:
        self.fs, self.at = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.at, recursive=True)

    def _place(self, n: int) -> str:
        return f"{self.at}/{n:019}.json"

    def get(self, n: int) -> dict | None:
        if self.fs.get_file_info(self._place(n)).type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(self._place(n)) as f:
            return json.loads(f.read())

    def put(self, n: int, answer: dict) -> None:
        with self.fs.open_output_stream(f"{self._place(n)}.part") as f:
            f.write(json.dumps(answer).encode())
        self.fs.move(f"{self._place(n)}.part", self._place(n))

    def forget(self, end: int) -> None:
        for info in self.fs.get_file_info(fs.FileSelector(self.at)):
            if info.base_name.endswith(".json") and int(info.base_name[:-5]) < end:
                self.fs.delete_file(info.path)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.url, self.timeout, self.log = options["url"], float(options.get("timeout", 5)), _Log(options["log"])

    def _ask(self) -> dict:
        answer = {"read_at": datetime.datetime.now(datetime.UTC).timestamp(), "status": None, "body": None, "error": None}
        try:
            with urllib.request.urlopen(self.url, timeout=self.timeout) as r:
                answer |= {"status": r.status, "body": r.read().decode("utf-8", "replace")}
        except urllib.error.HTTPError as e:
            answer |= {"status": e.code, "error": str(e)}
        except (OSError, ValueError) as e:
            answer["error"] = str(e) or type(e).__name__
        return answer

    @staticmethod
    def _row(n: int, a: dict) -> tuple:
        return n, datetime.datetime.fromtimestamp(a["read_at"], datetime.UTC), a["status"], a["body"], a["error"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["seq"]
        answer = self.log.get(n)
        if answer is None:
            answer = self._ask()
            self.log.put(n, answer)
        return iter([self._row(n, answer)]), {"seq": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for n in range(start["seq"], end["seq"]):
            answer = self.log.get(n)
            if answer is None:
                raise FileNotFoundError(f"answer {n} is not in the log")
            yield self._row(n, answer)

    def commit(self, end: dict) -> None:
        self.log.forget(end["seq"])


class HttpPoll(DataSource):
    """Format ``http_poll``; options ``url``, ``log`` (URI of a shared folder, one a query) and ``timeout`` in seconds."""

    @classmethod
    def name(cls) -> str:
        return "http_poll"

    def schema(self) -> str:
        return ANSWERS

    def simpleStreamReader(self, schema) -> _Reader:  # noqa: N802
        missing = [o for o in ("url", "log") if not self.options.get(o)]
        if missing:
            raise ValueError(f"http_poll needs {' and '.join(missing)}")
        if not self.options["url"].startswith(("http://", "https://")):
            raise ValueError("http_poll asks addresses of http or https only")
        return _Reader(dict(self.options))


def poll(spark: SparkSession, url: str, log: str, timeout: float = 5.0):
    """ANSWERS as a stream: one row a trigger, an answer or the error in its place, and the time of reading.

    ``seq`` counts from 0 without gaps; a restart from the query's checkpoint with the same
    ``log`` loses and repeats none.
    """
    spark.dataSource.register(HttpPoll)
    return spark.readStream.format("http_poll").option("url", url).option("log", log).option("timeout", timeout).load()
