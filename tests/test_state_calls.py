"""Calls of the state store per batch do not grow with the rows; each call leaves the Python process."""

import pandas as pd

from auditloom.streaming import event_time


class Handle:
    """Counts every call on the handle and on its states."""

    def __init__(self):
        self.calls, self.rows = 0, []

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return self if name.startswith("get") and name.endswith("State") else self.answer(name, args)

        return call

    def answer(self, name, args):
        if name in ("appendList", "put"):
            self.rows = (self.rows if name == "appendList" else []) + list(args[0])
        return iter(self.rows) if name == "get" else False


def calls(processor, frame):
    handle = Handle()
    processor.init(handle)
    list(processor.handleInputRows(("key",), iter([frame]), None))
    return handle.calls


def test_calls_do_not_grow_with_rows():
    for n in (10, 1000):
        carry = pd.DataFrame({"snapshot_id": range(n), "vec": [[1.0]] * n})
        assert calls(event_time.OrderedCarry(0.5, 1000, 1000), carry) <= 5
        assert calls(event_time.AnchoredWindows(10), pd.DataFrame({"ts_us": range(n)})) <= 8
