"""A job whose tasks run at once, hold their rows and add up sums with each other many times: a barrier stage, in which the
first task is the hub. They find it by the stage's own messages, which take a second each, and then talk over sockets."""

from __future__ import annotations

import hmac
import pickle
import secrets
import socket
import struct
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a task's blocks that stay in memory; what is beyond goes to a file of the task.
HELD, CONNECT_S = 16 << 20, 120


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once; 0 if that may change, as then no stage can count on it."""
    context = spark.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    inner = context._jsc.sc()
    return int(inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile()))


class Held:
    """Blocks (fold, known, n, data) to be gone through many times."""

    def __init__(self, blocks: Iterable[tuple]):
        self.near, self.far, self.file, size = [], [], None, 0
        for fold, known, n, data in blocks:
            size += len(data)
            if size <= HELD:
                self.near.append((fold, known, n, data))
                continue
            self.file = self.file or tempfile.TemporaryFile()  # it has no name, so it goes with the task
            self.file.write(data)
            self.far.append((fold, known, n, len(data)))

    def __iter__(self) -> Iterator[tuple]:
        yield from self.near
        if self.file:
            self.file.seek(0)
            for fold, known, n, length in self.far:
                yield fold, known, n, self.file.read(length)


def _send(to: socket.socket, data: bytes) -> None:
    to.sendall(struct.pack("<q", len(data)) + data)


def _exactly(of: socket.socket, n: int) -> bytes:
    parts = []
    while n:
        part = of.recv(min(n, 1 << 20))
        if not part:
            raise ConnectionError("another task ended")
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def _receive(of: socket.socket) -> bytes:
    return _exactly(of, struct.unpack("<q", _exactly(of, 8))[0])


def run(data: DataFrame, descent: object, kinds: tuple[Callable, ...], blocks: Callable[[pa.RecordBatch], Iterable[tuple]]) -> tuple[list, np.ndarray | None]:
    """descent.models after descent.run(reduce), and what that gave. data has at most slots() partitions. kinds: the functions
    that may be reduced. Doubles only are sent, after a secret of this job."""
    secret = secrets.token_bytes(32)

    def task(batches):
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        held = Held(block for batch in batches for block in blocks(batch))
        tasks, me = context.getTaskInfos(), context.partitionId()
        host = tasks[0].address.rsplit(":", 1)[0]
        if me:
            port = int(context.allGather("")[0])
            with socket.create_connection((host, port), CONNECT_S) as hub:
                hub.settimeout(None)
                hub.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                hub.sendall(secret + struct.pack("<q", me))
                while asked := _receive(hub):
                    kind, n, *_ = head = np.frombuffer(asked, np.float64)
                    folds = [None if np.isnan(x) else int(x) for x in head[2 : 2 + int(n)]]
                    _send(hub, kinds[int(kind)](head[2 + int(n) :].reshape(int(n), -1), folds, held).tobytes())
            return
        with socket.create_server(("", 0), backlog=len(tasks)) as door:
            context.allGather(str(door.getsockname()[1]))
            door.settimeout(CONNECT_S)
            others: dict[int, socket.socket] = {}
            while len(others) < len(tasks) - 1:
                one, _ = door.accept()
                one.settimeout(CONNECT_S)
                said = _exactly(one, 40)
                if not hmac.compare_digest(said[:32], secret):
                    one.close()
                    continue
                one.settimeout(None)
                one.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                others[struct.unpack("<q", said[32:])[0]] = one

            def reduce(kind, lines, folds):
                k = [f.__name__ for f in kinds].index(kind.__name__)
                message = np.concatenate([[k, len(lines)], [np.nan if x is None else x for x in folds], lines.ravel()]).tobytes()
                for one in others.values():
                    _send(one, message)
                total = kind(lines, folds, held)
                for i in sorted(others):  # always in one order
                    total = total + np.frombuffer(_receive(others[i])).reshape(total.shape)
                return total

            got = descent.run(reduce)
            for one in others.values():
                _send(one, b"")
                one.close()
        yield pa.RecordBatch.from_pydict({"got": pa.array([pickle.dumps((descent.models, got))], pa.binary())})

    return pickle.loads(data.mapInArrow(task, "got binary", barrier=True).collect()[0].got)
