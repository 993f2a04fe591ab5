"""Named DataFrame transformations that users add: registered by name, used with ``df.transform``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Processor = Callable[[DataFrame], DataFrame]
_processors: dict[str, Processor] = {}


def register(name: str) -> Callable[[Processor], Processor]:
    def put(processor: Processor) -> Processor:
        _processors[name] = processor
        return processor

    return put


def get(name: str) -> Processor:
    if name not in _processors:
        raise KeyError(f"no processor named {name}; there are: {', '.join(sorted(_processors)) or 'none'}")
    return _processors[name]


def names() -> list[str]:
    return sorted(_processors)


def mapped(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Applies a Python function to each row (as a dict), which returns a dict; a row that fails
    gets an ``error`` instead of stopping the job.  For what built-in functions can't express."""
    import pandas as pd

    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out.append({**dict.fromkeys(columns), **function(row), "error": None})
                except Exception as e:  # noqa: BLE001  the error is the result
                    out.append({**dict.fromkeys(columns), "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[*columns, "error"])

    return df.mapInPandas(run, f"{schema}, error string")


def mapped_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Applies a Python function to whole batches (pandas frames in and out, a row for each row).  A batch that
    fails is halved until the rows that fail stand alone: they get an ``error``, all others their result, for
    about 2 log2(n) calls for each failing row."""
    import pandas as pd

    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            todo, done = [batch], []
            while todo:
                part = todo.pop()
                if not len(part):
                    continue
                try:
                    out = function(part.reset_index(drop=True))
                    if len(out) != len(part):
                        raise ValueError(f"{len(out)} rows for {len(part)}")
                    done.append(out.reset_index(drop=True).reindex(columns=columns).assign(error=None))
                except Exception as e:  # noqa: BLE001  the error is the result
                    if len(part) == 1:
                        done.append(pd.DataFrame([{**dict.fromkeys(columns), "error": f"{type(e).__name__}: {e}"}], columns=[*columns, "error"]))
                    else:
                        half = len(part) // 2
                        todo += [part.iloc[half:], part.iloc[:half]]
            yield from done

    return df.mapInPandas(run, f"{schema}, error string")
