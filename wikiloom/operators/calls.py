"""How calls to models are tried again: an ordered list of models, a bounded number of attempts each, waits that double.

The call itself is the caller's. ``Caller`` is made where it is used, in a task, so that its pace is that of one executor's
worker.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Attempts with a model, attempts that it may be overloaded, seconds before the second attempt, and at most added.
ATTEMPTS, OVERLOADED_ATTEMPTS, FIRST_WAIT, JITTER = 4, 2, 1.0, 0.25
OVERLOADED, TOO_MANY = 503, 429


class CallError(Exception):
    """What a call failed with: an HTTP status, or None where no answer came in time."""

    def __init__(self, status: int | None, text: str = ""):
        super().__init__(text or f"status {status}")
        self.status = status

    def __reduce__(self):
        return CallError, (self.status, str(self))


def passes(error: Exception) -> bool:
    """Whether another attempt may succeed: too many requests, an error of the server, no answer in time."""
    if isinstance(error, TimeoutError | ConnectionError):
        return True
    return isinstance(error, CallError) and (error.status is None or error.status == TOO_MANY or 500 <= error.status < 600)


@dataclass
class Caller:
    """call(model, request) with the models in order: an error that doesn't pass is raised at once; one that does is tried
    again after a wait, until the attempts are used up, and then with the next model; the last error is raised.

    per_second: the calls begun in a second at most, None for any number.
    """

    call: Callable[[str, object], object]
    models: tuple[str, ...]
    attempts: int = ATTEMPTS
    overloaded_attempts: int = OVERLOADED_ATTEMPTS
    per_second: float | None = None
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    jitter: Callable[[], float] = field(default=lambda: random.random() * JITTER)
    free_at: float = 0.0

    def __call__(self, request: object) -> tuple[str, object]:
        """(the model that answered, its answer)."""
        last: Exception | None = None
        for model in dict.fromkeys(self.models):
            for attempt in range(1, self.attempts + 1):
                self._pace()
                try:
                    return model, self.call(model, request)
                except Exception as error:
                    if not passes(error):
                        raise
                    last = error
                overloaded = isinstance(last, CallError) and last.status == OVERLOADED
                if attempt == self.attempts or overloaded and attempt >= self.overloaded_attempts:
                    break
                self.sleep(FIRST_WAIT * 2 ** (attempt - 1) + self.jitter())
        if last is None:
            raise ValueError("no models to call")
        raise last

    def _pace(self) -> None:
        if self.per_second:
            now = self.clock()
            if now < self.free_at:
                self.sleep(self.free_at - now)
            self.free_at = max(now, self.free_at) + 1 / self.per_second


def answered(prompts: DataFrame, make: Callable[[], Caller], id_col: str = "id", prompt_col: str = "prompt") -> DataFrame:
    """(id, answer, model, error) for each row of prompts: one that fails for good has its error and no answer. A null prompt
    isn't sent. Calls are made in the tasks, by a Caller each."""
    kind = prompts.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = make()
        for frame in frames:
            out = []
            for key, prompt in zip(frame["id"], frame["prompt"], strict=True):
                answer = model = error = None
                if prompt is not None:
                    try:
                        model, answer = caller(prompt)
                    except Exception as e:
                        error = str(e)[:1000]
                out.append((key, answer, model, error))
            yield pd.DataFrame(out, columns=["id", "answer", "model", "error"])

    own = prompts.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"))
    return own.mapInPandas(run, f"id {kind}, answer string, model string, error string").withColumnRenamed("id", id_col)
