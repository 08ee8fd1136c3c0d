"""Writes of a project one at a time: in this process by turns, across processes by a lock on a file.

The lock is the operating system's (flock): it ends with the process that holds
it, however that ends, so a lock never has to be judged or taken over. The file
stays; what it says only tells others who is writing.
"""

from __future__ import annotations

import fcntl
import os
import socket
import threading
import time
from contextlib import contextmanager


class IndexLockedError(RuntimeError):
    """Another writer is at work; ``said`` is what it left in the lock file."""

    def __init__(self, path: str, said: str) -> None:
        super().__init__(f"The index is in use by {said or 'another writer'}; its lock is {path}. Try again when that has finished.")


@contextmanager
def file_lock(path: str):
    """Holds the lock on path's file, or raises IndexLockedError at once if some other handle has it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a+", encoding="utf-8") as held:
        try:
            fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            held.seek(0)
            raise IndexLockedError(path, held.read(200).strip()) from None
        held.truncate(0)
        held.write(f"process {os.getpid()} on {socket.gethostname()} since {time.strftime('%Y-%m-%d %H:%M:%S')}")
        held.flush()
        try:
            yield
        finally:
            held.truncate(0)  # closing the file ends the lock


class WriteQueue:
    """Turns of writers in order of arrival, for each project; readers can wait for those that came before them."""

    def __init__(self) -> None:
        self._guard = threading.Condition()
        self._next: dict[str, int] = {}
        self._serving: dict[str, int] = {}

    @contextmanager
    def write(self, project: str, lock_path: str):
        with self._guard:
            turn = self._next.get(project, 0)
            self._next[project] = turn + 1
            self._guard.wait_for(lambda: self._serving.get(project, 0) == turn)
        try:
            with file_lock(lock_path):
                yield
        finally:
            with self._guard:
                self._serving[project] = turn + 1
                self._guard.notify_all()

    def wait(self, project: str) -> None:
        with self._guard:
            turn = self._next.get(project, 0)
            self._guard.wait_for(lambda: self._serving.get(project, 0) >= turn)
