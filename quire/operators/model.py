"""Apply a model to rows in Arrow batches (UD1).

The model is a plain callable ``list[input] -> list[str]`` (JSON text per
input), called once per batch with the options given (model name,
temperature, max tokens, retries). Its JSON output is parsed against a fixed
schema. An output that is not valid is asked for again, with the reason added to
its input, while the valid outputs of its batch stand; an input that is never
answered validly, or whose call keeps failing, lands in ``rejects`` with the
reason, never aborting the job or taking its batch along.

``model_partials`` is for callables that answer step by step: every partial
output is a row, in order, for the last-partial fold (AG5) or its stream (SM1).
"""

from __future__ import annotations

import json
from typing import Any, Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "_model_output"
ERR = "_model_error"
AGAIN = "Your last answer was not accepted: "


def _plain(v):
    """Rows, arrays and nested values of a frame as plain dicts and lists."""
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, str)):
        return [_plain(x) for x in (v.tolist() if hasattr(v, "tolist") else v)]
    return v


def invalid_json(output: str | None, schema: T.StructType) -> str | None:
    """Why an output is no JSON object with a field of ``schema``; None if it is one."""
    if output is None:
        return "unparseable output"
    try:
        value = json.loads(output)
    except ValueError:
        return "unparseable output"
    if not isinstance(value, dict) or all(value.get(f.name) is None for f in schema.fields):
        return "unparseable output"
    return None


def ask_again(given: Any, output: str | None, reason: str) -> Any:
    """The input with the reason its last output was refused for: one more line of a prompt, one more user message of a list."""
    note = f"{AGAIN}{reason}"
    if isinstance(given, list):
        said = [{"role": "assistant", "content": output}] if output else []
        return [*given, *said, {"role": "user", "content": note}]
    return f"{given}\n\n{note}"


def _answers(fn: Callable[..., list], inputs: list, max_retries: int, check: Callable[[str | None], str | None], again: Callable, options: dict) -> list[tuple]:
    """(output, error) of each input.

    A call that fails is made again in halves, down to single inputs, of which each is
    asked up to ``max_retries`` times; invalid outputs are asked again, together, as often.
    """

    def text(o) -> str | None:
        return o if isinstance(o, str) or o is None else json.dumps(o)

    def call(part: list) -> list[tuple]:
        tries = max_retries if len(part) == 1 else 1
        for _ in range(max(1, tries)):
            try:
                outs = list(fn(part, **options))
                if len(outs) != len(part):
                    raise ValueError("model returned a different number of outputs")
                return [(text(o), None) for o in outs]
            except Exception as e:  # asked again, then reported per row
                err = f"{type(e).__name__}: {e}"
        if len(part) == 1:
            return [(None, err)]
        half = len(part) // 2
        return call(part[:half]) + call(part[half:])

    inputs = list(inputs)
    found = call(inputs) if inputs else []
    for attempt in range(max(1, max_retries)):
        refused = [(i, check(o)) for i, (o, e) in enumerate(found) if e is None]
        refused = [(i, why) for i, why in refused if why is not None]
        if not refused:
            break
        if attempt == max(1, max_retries) - 1:
            for i, why in refused:
                found[i] = (found[i][0], why)
            break
        for i, why in refused:
            inputs[i] = again(inputs[i], found[i][0], why)
        asked = call([inputs[i] for i, _ in refused])
        for (i, _), new in zip(refused, asked, strict=True):
            found[i] = new
    return found


def model_outcomes(df: DataFrame, input_col: str, fn: Callable[..., list], schema: T.StructType,
                   keep: list[str] | None = None, max_retries: int = 3, check: Callable[[str | None], str | None] | None = None,
                   again: Callable[[Any, str | None, str], Any] = ask_again, **options) -> DataFrame:
    """One row per input: ``keep``, the fields of ``schema`` (null on failure), ``output`` (raw text) and ``reason`` (null = ok).

    ``check`` gives the reason an output is refused for, or None (default: it must be a JSON
    object with a field of ``schema``); ``again`` makes the next input from the last one, the
    refused output and the reason. Nothing is asked more than ``max_retries`` times for its
    output, and as often for a call that fails. Checkpoint the result where both outcomes are
    needed, so that the model answers once.
    """
    keep = keep or [c for c in df.columns if c != input_col]
    out_schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(RAW, T.StringType()),
                                                             T.StructField(ERR, T.StringType())])
    checked = check or (lambda output: invalid_json(output, schema))

    def run(it):
        for pdf in it:
            found = _answers(fn, [_plain(v) for v in pdf[input_col]], max_retries, checked, again, options)
            res = pdf[keep].copy()
            res[RAW] = [o for o, _ in found]
            res[ERR] = [e for _, e in found]
            yield res

    raw = df.select(*keep, input_col).mapInPandas(run, out_schema)
    parsed = raw.withColumn("_rec", F.from_json(RAW, schema, {"mode": "PERMISSIVE"}))
    all_null = F.coalesce(*[F.col("_rec")[f.name].isNotNull() for f in schema.fields], F.lit(False))
    reason = F.coalesce(F.col(ERR), F.when(~all_null, F.lit("unparseable output")))
    fields = [F.when(reason.isNull(), F.col("_rec")[f.name]).alias(f.name) for f in schema.fields]
    return parsed.select(*keep, *fields, F.col(RAW).alias("output"), reason.alias("reason"))


def model_partials(df: DataFrame, input_col: str, fn: Callable[..., list], keep: list[str] | None = None, **options) -> DataFrame:
    """(``keep``, seq, record, error): every partial output of a model, numbered from 0 in its order.

    ``fn`` takes a list of inputs and gives, for each, an iterable of partial outputs (JSON
    text or values). They are read one by one, so an input whose iterable fails keeps what
    came before, and its error is one last row without a record; a call that fails gives
    each of its inputs such a row. Rows leave the task in slices, whatever their number.
    """
    import pandas as pd
    keep = keep or [c for c in df.columns if c != input_col]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("seq", T.LongType()), T.StructField("record", T.StringType()), T.StructField("error", T.StringType())])
    slice_rows = 4096

    def run(it):
        for pdf in it:
            rows: list[tuple] = []

            def frame() -> pd.DataFrame:
                at = [r[0] for r in rows]
                res = pdf[keep].iloc[at].reset_index(drop=True)
                for j, name in enumerate(("seq", "record", "error"), 1):
                    res[name] = pd.Series([r[j] for r in rows], dtype="int64" if j == 1 else object)
                return res

            inputs = [_plain(v) for v in pdf[input_col]]
            try:
                outs, failed = list(fn(inputs, **options)) if inputs else [], None
                if len(outs) != len(inputs):
                    raise ValueError("model returned a different number of outputs")
            except Exception as e:  # reported per row
                outs, failed = [()] * len(inputs), f"{type(e).__name__}: {e}"
            for i, parts in enumerate(outs):
                n, err = 0, failed
                parts = iter(parts)
                while err is None:
                    try:
                        o = next(parts)
                    except StopIteration:
                        break
                    except Exception as e:
                        err = f"{type(e).__name__}: {e}"
                        break
                    rows.append((i, n, o if isinstance(o, str) or o is None else json.dumps(o), None))
                    n += 1
                    if len(rows) >= slice_rows:
                        yield frame()
                        rows.clear()
                if err is not None:
                    rows.append((i, n, None, err))
            if rows:
                yield frame()
                rows.clear()

    return df.select(*keep, input_col).mapInPandas(run, schema)


def apply_model(df: DataFrame, input_col: str, fn: Callable[..., list], schema: T.StructType,
                keep: list[str] | None = None, max_retries: int = 3, **options) -> tuple[DataFrame, DataFrame]:
    """(ok, rejects) of ``model_outcomes``, both lazy: writing both runs the model twice."""
    keep = keep or [c for c in df.columns if c != input_col]
    done = model_outcomes(df, input_col, fn, schema, keep, max_retries, **options)
    return (done.filter("reason IS NULL").select(*keep, *[f.name for f in schema.fields]),
            done.filter("reason IS NOT NULL").select(*keep, "output", "reason"))


def echo_model(inputs: list, **_) -> list[str]:
    """Deterministic offline stand-in: answers with the first context line it was given."""
    out = []
    for msgs in inputs:
        ctx = msgs[-1]["content"] if msgs else ""
        out.append(json.dumps({"thought_process": ["read the retrieved documents"],
                               "answer": ctx.splitlines()[1] if len(ctx.splitlines()) > 1 else "",
                               "enough_context": len(ctx) > 40}))
    return out


