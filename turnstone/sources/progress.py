"""Which sessions another process is ingesting: a marker for each run, with the process that must still live."""

from __future__ import annotations

import json
import os
import socket
import uuid

from pyspark.sql import SparkSession

from turnstone.sources import files


class InProgress:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder, self.mine = spark, f"{root.rstrip('/')}/_in_progress", f"{uuid.uuid4().hex}.json"

    def mark(self, sessions: list[str]) -> None:
        files.write(self.spark, f"{self.folder}/{self.mine}", json.dumps({"pid": os.getpid(), "host": socket.gethostname(), "sessions": sessions}))

    def unmark(self) -> None:
        files.delete(self.spark, f"{self.folder}/{self.mine}")

    def sessions(self) -> set[str]:
        """The sessions of all runs that still live; markers of dead processes of this host are removed, those of other hosts count."""
        found: set[str] = set()
        for name in files.names(self.spark, self.folder):
            if not name.endswith(".json"):
                continue
            text = files.read(self.spark, f"{self.folder}/{name}")
            held = json.loads(text) if text else None
            if held is None or held["host"] == socket.gethostname() and not alive(held["pid"]):
                files.delete(self.spark, f"{self.folder}/{name}")
            else:
                found.update(held["sessions"])
        return found


def alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True
