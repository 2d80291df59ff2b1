"""Passes over whole notes in Python, by Arrow batches: what would cost Catalyst an array element for every word."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Notes that are turned into Python strings at once, and rows from which on a batch goes out.
NOTES, ROWS = 256, 50_000
TYPES = {"int": pa.int32(), "string": pa.string()}
#: Column values of one note and the lists to which its rows' columns are appended.
Emit = Callable[..., None]


def each_note(notes: DataFrame, args: Sequence[str], columns: dict[str, str], make: Callable[[], Emit], at_once: int = NOTES) -> DataFrame:
    """(note_id, *columns): the rows that make()(*values of args, *lists) appends for each note; make() is called once a task. at_once notes are
    turned into Python objects together."""
    key = notes.schema["note_id"].dataType.simpleString()
    names, kinds = list(columns), [TYPES[x] for x in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = make()
        for batch in batches:
            for k in range(0, batch.num_rows, at_once):
                few = batch.slice(k, at_once)
                lists, ids, times = [[] for _ in names], [], []

                def out() -> pa.RecordBatch:
                    repeated = few.column(0).take(pa.array(np.repeat(np.array(ids, np.int64), times)))
                    return pa.RecordBatch.from_arrays([repeated, *(pa.array(x, kind) for x, kind in zip(lists, kinds))], ["note_id", *names])

                for i, values in enumerate(zip(*(few.column(j).to_pylist() for j in range(1, len(args) + 1)))):
                    before = len(lists[0])
                    emit(*values, *lists)
                    if len(lists[0]) > before:
                        ids.append(i)
                        times.append(len(lists[0]) - before)
                    if len(lists[0]) >= ROWS:
                        yield out()
                        lists, ids, times = [[] for _ in names], [], []
                if ids:
                    yield out()

    return notes.select("note_id", *args).mapInArrow(run, ", ".join([f"note_id {key}", *(f"`{n}` {kind}" for n, kind in columns.items())]))
