"""Batch generation data path (GEN-1..4) and the predictions table (JOIN-5).

The model is user-supplied: `run` ships rows to Python workers in Arrow batches, sets the
model up once per task with `init_fn()` and calls the returned function once per
`batch_size` prompts; whatever it loads lives in the worker, never on the driver. Deterministic stand-ins that need no model are plain column expressions.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icx.functions.text import first_line, py_strip

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package


def strip_prompt(raw: Column, prompt: Column) -> Column:
    """`output[len(prompt):]` — code points on both sides; by bytes, without counting, where the output begins with its prompt."""
    rest = F.lit(2147483647)
    by_bytes = raw.cast("binary").substr(F.octet_length(prompt) + 1, rest).cast("string")
    return F.when(raw.startswith(prompt), by_bytes).otherwise(raw.substr(F.char_length(prompt) + 1, rest))


def clean(raw: Column, prompt: Column) -> Column:
    """`output[len(prompt):].strip().split("\\n")[0]` (GEN-2, GEN-3)."""
    return first_line(py_strip(strip_prompt(raw, prompt)))


def batch_ids(df: DataFrame, position: str, batch_size: int) -> DataFrame:
    """GEN-4: batch = floor(position / batch_size) over a dense position column."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return df.withColumn("batch_id", F.floor(F.col(position) / batch_size).cast("bigint"))


def _answered(model: Callable[[list[str]], list[str]], texts: list[str | None]) -> list[str | None]:
    """Outputs of one model call; null prompts are not sent and get none."""
    at = [i for i, t in enumerate(texts) if t is not None]
    out: list[str | None] = [None] * len(texts)
    got = model([texts[i] for i in at]) if at else []
    if len(got) != len(at):
        raise ValueError(f"the model returned {len(got)} outputs for {len(at)} prompts")
    for i, g in zip(at, got):
        out[i] = g
    return out


def _whole_groups(batches, column: str):
    """Arrow tables of the incoming rows, cut only where `column` changes; rows come ordered by it.

    What is held back is the last group of a batch, as the next batch may go on with it.
    """
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        ids = rows.column(column).to_numpy()
        cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        whole = int(cuts[-1]) if len(cuts) else 0
        held = rows.slice(whole)
        if whole:
            yield rows.slice(0, whole)
    if held is not None and held.num_rows:
        yield held


def run_batches(prompts: DataFrame, init_fn: Callable[[], Callable[[list[str]], list[str]]], batch_size: int,
                position: str, prompt: str = "prompt") -> DataFrame:
    """GEN-1 with GEN-4: every model call gets the prompts of one assigned batch, in position order.

    `position` numbers the rows 0, 1, ... without gaps or repeats (`dense_index`). Batches are
    dealt over the tasks by their number, so none is split between two; a task joins the Arrow
    batches it reads at their borders and holds back less than one model batch. Returns the
    columns of `prompts`, `batch_id` and `raw`. Null prompts keep their place in a batch, are not
    sent and get a null output. A null position, or more rows in a batch than `batch_size`, fails the job.
    """
    placed = F.when(F.col(position).isNull(), F.raise_error(F.lit("a prompt has no position")).cast("bigint")).otherwise(F.col(position))
    numbered = batch_ids(prompts.withColumn(position, placed), position, batch_size)
    schema = T.StructType([*numbered.schema.fields, T.StructField("raw", T.StringType(), True)])

    def apply(batches):
        import numpy as np
        import pyarrow as pa

        model = init_fn()
        for rows in _whole_groups(batches, "batch_id"):
            ids, texts = rows.column("batch_id").to_numpy(), rows.column(prompt).to_pylist()
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            out: list[str | None] = []
            for a, b in zip(edges, edges[1:]):
                if b - a > batch_size:
                    raise ValueError(f"batch {ids[a]} has {b - a} rows: positions repeat")
                out += _answered(model, texts[a:b])
            yield from rows.append_column("raw", pa.array(out, pa.string())).combine_chunks().to_batches()

    return numbered.repartition("batch_id").sortWithinPartitions("batch_id", position).mapInArrow(apply, schema)


def run(prompts: DataFrame, init_fn: Callable[[], Callable[[list[str]], list[str]]], batch_size: int,
        prompt: str = "prompt") -> DataFrame:
    """GEN-1: apply a user batch model; the columns of `prompts`, and `raw`.

    `init_fn` runs once per task, in the worker, and returns the batch function: a model is
    loaded there and never pickled. Null prompts are not sent and get a null output. A
    model that returns another number of outputs than it got prompts fails the job.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("raw", T.StringType(), True)])

    def apply(batches):
        import pyarrow as pa

        model = init_fn()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(prompt)).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            out: list[str | None] = [None] * len(texts)
            for a in range(0, len(at), batch_size):
                some = at[a:a + batch_size]
                for i, g in zip(some, _answered(model, [texts[i] for i in some])):
                    out[i] = g
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "raw"])

    return prompts.mapInArrow(apply, schema)


def echo_stand_in(prompt: Column, hyp: Column) -> Column:
    """A model that answers `hyp` after the prompt, then rambles on a new line."""
    return F.concat(prompt, F.lit(" "), hyp, F.lit("\nextra"))


def predictions(prompts: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-5 for outputs made elsewhere: (keys..., prompt, hypothesis, reference), joined on keys.

    Every prompt stays; one without an output has a null hypothesis. Outputs of `run` carry
    their prompts and need no join.
    """
    j = prompts.select(*keys, "prompt", "reference").join(outputs.select(*keys, "raw"), keys, "left")
    return j.select(*keys, "prompt", clean(F.col("raw"), F.col("prompt")).alias("hypothesis"), "reference")


def lost_rows(prompts: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts without an output."""
    answered = outputs.filter(F.col("raw").isNotNull()).select(*keys)
    return prompts.select(*keys).join(answered, keys, "left_anti")
