"""Calls of an outside model: bounded concurrency, a deadline for each call, attempts and a list of models, failures as rows."""

from __future__ import annotations

import inspect
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future

import pyarrow as pa
from pyspark.sql import DataFrame

Answerer = Callable[..., dict]
RESULT = "text string, model string, prompt_tokens bigint, completion_tokens bigint, latency_s double, attempt int, error string"
_TYPES = {"text": pa.string(), "model": pa.string(), "prompt_tokens": pa.int64(), "completion_tokens": pa.int64(), "latency_s": pa.float64(), "attempt": pa.int32(), "error": pa.string()}


class CallFailed(RuntimeError):
    """A reply that is no answer. status: the provider's status code, if it gave one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status

    @property
    def refused(self) -> bool:
        """The provider refused this model or request (a status of 400 to 499), so that another model may do."""
        return self.status is not None and 400 <= self.status < 500


def checked(reply: object) -> dict:
    """The reply, if it is one: a client that returns nothing, an error or an empty text has failed."""
    if not isinstance(reply, dict):
        raise CallFailed(f"no reply: {reply!r}"[:300])
    if reply.get("error"):
        status = reply.get("status")
        raise CallFailed(str(reply["error"])[:400], status if isinstance(status, int) else None)
    text = reply.get("text")
    if not isinstance(text, str) or not text.strip():
        raise CallFailed("empty reply")
    return reply


def within(call: Callable[[], object], timeout_s: float) -> object:
    """call()'s result, or CallFailed after timeout_s seconds. A thread cannot be stopped: a call that hangs is left behind as a
    daemon, which neither holds a place nor keeps the worker from ending."""
    future: Future = Future()

    def run() -> None:
        try:
            future.set_result(call())
        except BaseException as e:  # handed to the caller, whatever it is
            future.set_exception(e)

    threading.Thread(target=run, daemon=True).start()
    try:
        return future.result(timeout_s)
    except TimeoutError as e:
        if future.done():  # the client's own
            raise
        raise CallFailed(f"no reply within {timeout_s:g} s") from e


def ask(client: Answerer, prompt: str, models: list[str | None], attempts: int, timeout_s: float, pause_s: float) -> dict:
    """The first answer of the models in their order, each asked up to ``attempts`` times, pause_s longer each time. The first model
    is left for the next only if it was refused: an outage is not mended by another model. attempt counts all calls."""
    takes_model = len(inspect.signature(client).parameters) > 1
    n, error = 0, "no model"
    for i, model in enumerate(models):
        refused = False
        for attempt in range(1, attempts + 1):
            n += 1
            began = time.monotonic()
            try:
                reply = checked(within((lambda m=model: client(prompt, m)) if takes_model else (lambda: client(prompt)), timeout_s))
            except Exception as e:  # the model is outside; whatever it raises is its row's error
                error, refused = str(e) or type(e).__name__, isinstance(e, CallFailed) and e.refused
                if pause_s and (attempt < attempts or i + 1 < len(models)):
                    time.sleep(pause_s * attempt)
                continue
            took = round(time.monotonic() - began, 2)
            return {"model": model, "prompt_tokens": 0, "completion_tokens": 0, "latency_s": took} | {k: v for k, v in reply.items() if k in _TYPES and v is not None} | {"attempt": n, "error": None}
        if i == 0 and not refused:
            break
    return {"text": None, "model": None, "prompt_tokens": 0, "completion_tokens": 0, "latency_s": 0.0, "attempt": n, "error": error}


def call_model(prompts: DataFrame, client: Answerer, models: list[str | None] | None = None, workers: int = 9, attempts: int = 1, timeout_s: float = 120.0, pause_s: float = 0.0) -> DataFrame:
    """The columns of prompts and text, model, prompt_tokens, completion_tokens, latency_s, attempt, error of each prompt's call.

    client(prompt) or client(prompt, model) returns a dict with text and, if known, the counts; it runs on the executors, ``workers`` calls at a time in each
    task. A call that raises, outlasts timeout_s, returns an error, nothing or an empty text has a row with NULL text, zero counts and
    its error; so does a NULL prompt, which is not sent. What ends the worker itself ends the job. Rows keep their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _replies(batch.column("prompt").to_pylist().__getitem__, len(batch), client, models, workers, attempts, timeout_s, pause_s)
            yield pa.RecordBatch.from_arrays([*batch.columns, *_result(out)], [*batch.schema.names, *_TYPES])

    return prompts.mapInArrow(run, f"{_fields(prompts)}, {RESULT}")


#: Characters of a document's prompts that a task holds at once, about; of a longer document one prompt.
PROMPT_CHARS = 1 << 27


def call_model_about(questions: DataFrame, documents: DataFrame, on: list[str], compose: Callable[..., str | None], client: Answerer, models: list[str | None] | None = None, workers: int = 9, attempts: int = 1, timeout_s: float = 120.0, pause_s: float = 0.0) -> DataFrame:
    """call_model() for prompts that hold a long document each: the columns of questions, chars (of the prompt) and the reply's. A document comes to the task once for its questions there,
    and compose(question row, document row or None) makes a prompt when its call is made, so it neither passes from Spark to Python nor waits.

    documents: at most a row for each key; on: its key, also in questions. Fewer calls run at once where a document is so long that their prompts exceed PROMPT_CHARS."""
    n = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, long work: not to be gathered in few tasks

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        rows, document = asked.to_pylist(), next(iter(known.to_pylist()), None)
        long = sum(len(v) for v in (document or {}).values() if isinstance(v, str))
        chars: list[int | None] = [None] * len(rows)

        def prompt(i: int) -> str | None:
            made = compose(rows[i], document)
            chars[i] = None if made is None else len(made)
            return made

        out = _replies(prompt, len(rows), client, models, max(1, min(workers, PROMPT_CHARS // max(1, long))), attempts, timeout_s, pause_s)
        return pa.table([*asked.columns, pa.array(chars, pa.int32()), *_result(out)], [*asked.schema.names, "chars", *_TYPES])

    left, right = (x.repartition(n, *on).groupBy(*on) for x in (questions, documents))
    return left.cogroup(right).applyInArrow(run, f"{_fields(questions)}, chars int, {RESULT}")


def _fields(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _result(out: list[dict]) -> list[pa.Array]:
    return [pa.array([r.get(n) for r in out], t) for n, t in _TYPES.items()]


def _replies(prompt: Callable[[int], str | None], n: int, client: Answerer, models: list[str | None] | None, workers: int, attempts: int, timeout_s: float, pause_s: float) -> list[dict]:
    """The replies to prompt(0) to prompt(n - 1), ``workers`` calls at a time."""
    out: list[dict] = [{}] * n
    fatal: list[BaseException] = []
    todo = iter(range(n))
    lock = threading.Lock()

    def work() -> None:
        while not fatal:
            with lock:
                at = next(todo, None)
            if at is None:
                return
            try:
                text = prompt(at)
                out[at] = ask(client, text, models or [None], attempts, timeout_s, pause_s) if isinstance(text, str) else {"attempt": 0, "error": "no prompt", "prompt_tokens": 0, "completion_tokens": 0, "latency_s": 0.0}
            except BaseException as e:  # no failure of a call but of the worker
                fatal.append(e)

    pool = [threading.Thread(target=work, daemon=True) for _ in range(min(workers, n))]
    for t in pool:
        t.start()
    for t in pool:
        t.join()
    if fatal:
        raise fatal[0]
    return out
