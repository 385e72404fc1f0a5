"""A user function over rows, where one bad row never takes others down."""

from __future__ import annotations

import math
import multiprocessing
import numbers
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBERS = ("x", "y", "theta", "scale", "score")
OUTPUT = "x double, y double, theta double, scale double, found int, score double, error string, seconds double"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
_BLANK = dict.fromkeys(NUMBERS, 0.0) | {"found": 0}


def checked(got: object) -> dict:
    """The answer's numbers; what is missing is 0. Anything but finite numbers, and found other than 0 or 1, is an error: nothing is converted."""
    if not isinstance(got, dict):
        raise TypeError("no dictionary")
    out = _BLANK | {k: got[k] for k in _BLANK if k in got}
    for k, v in out.items():
        if isinstance(v, bool) and k != "found" or not isinstance(v, numbers.Real) or not math.isfinite(v):
            raise TypeError(k)
    if out["found"] not in (0, 1):
        raise ValueError("found")
    return {k: int(v) if k == "found" else float(v) for k, v in out.items()}


def _tried(answer: Callable, model: object, row: dict) -> tuple[dict, str | None]:
    try:
        got = answer(model, row)
    except Exception as e:  # noqa: BLE001 - any failure of the user's function is a refusal
        return _BLANK, type(e).__name__
    try:
        return checked(got), None
    except Exception:  # noqa: BLE001 - whatever else the user's function gave
        return _BLANK, "not a number"


class _Here:
    """Answers in this process."""

    def __init__(self, make, answer):
        self.answer, self.model = answer, make()

    def __call__(self, row: dict) -> tuple[dict, str | None]:
        return _tried(self.answer, self.model, row)

    def close(self) -> None:
        pass


class _Apart:
    """Answers in a child process that is killed when one takes too long, whatever it hangs in; the next row gets a new child."""

    def __init__(self, make, answer, limit: float):
        self.make, self.answer, self.limit, self.child = make, answer, limit, None

    def _serve(self, pipe) -> None:
        try:
            model = self.make()
        except BaseException as e:  # noqa: BLE001 - told to the task, which fails with it
            pipe.send(repr(e))
            return
        pipe.send(None)
        while (row := pipe.recv()) is not None:
            pipe.send(_tried(self.answer, model, row))

    def _start(self) -> None:
        forked = multiprocessing.get_context("fork")
        self.pipe, other = forked.Pipe()
        self.child = forked.Process(target=self._serve, args=(other,), daemon=True)
        self.child.start()
        other.close()
        try:
            failed = self.pipe.recv()
        except EOFError:
            failed = "its process ended"
        if failed:
            self.close()
            raise RuntimeError(f"the model can't be made: {failed}")

    def __call__(self, row: dict) -> tuple[dict, str | None]:
        if self.child is None:
            self._start()
        try:
            self.pipe.send(row)
            if self.pipe.poll(self.limit):
                return self.pipe.recv()
            error = "late"
        except (EOFError, OSError):  # the child is gone, as after a crash in native code
            error = "died"
        self.close()
        return _BLANK, error

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


def isolated_map(rows: DataFrame, key: str, make: Callable[[], object], answer: Callable[[object, dict], dict], limit: float | None = None) -> DataFrame:
    """key and OUTPUT: answer(model, row) for each row, in order, with the model made once in each task.

    A row whose answer raises, isn't of finite numbers with found 0 or 1, or, where limit is given, takes longer than
    limit seconds, is refused: found 0, zeros, and the reason in error (the exception's name, "not a number", "late", or
    "died" if its process ended). With a limit answers come from a child process of the task, which is killed with a late one:
    calls in native code that no signal interrupts are stopped too. No row is ever missing, and none takes others down. Keys
    are passed through as they are, nulls among them. A model that can't be made fails the task.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = rows.columns

    def run(it):
        asked = None
        try:
            for batch in it:
                asked = asked or (_Here(make, answer) if limit is None else _Apart(make, answer, limit))
                out = []
                for row in batch.select(names).to_pylist():
                    began = time.perf_counter()
                    got, error = asked(row)
                    out.append(got | {"error": error, "seconds": time.perf_counter() - began})
                types = [pa.int32() if n == "found" else pa.string() if n == "error" else pa.float64() for n in _NAMES]
                columns = [pa.array([r[n] for r in out], t) for n, t in zip(_NAMES, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(len(names)), *columns], ["_key", *_NAMES])
        finally:
            if asked:
                asked.close()

    # the key goes along once more by a name of its own, beside the row that the function sees
    apart = rows.withColumn("_key", F.col(f"`{key}`"))
    return apart.mapInArrow(run, f"_key {kind}, {OUTPUT}").withColumnRenamed("_key", key)
