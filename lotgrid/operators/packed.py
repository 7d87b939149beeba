"""Several values packed in one text field: one row per value, its place kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that end a value outside quotes. Blanks count, brackets enclose.
DELIMITERS = b";,|\t\n\r\v\f []{}"
DOUBLE, SINGLE = 0x22, 0x27

_IS_DELIMITER = np.zeros(256, bool)
_IS_DELIMITER[list(DELIMITERS)] = True


def split_text(text: str) -> list[str]:
    """The values of one text by a plain scan: the definition, and the way for rows with odd quoting.

    A quote opens only where a value begins and closes only where a delimiter or the end follows;
    inside, a doubled quote is one quote. A quote that never closes is an ordinary character.
    """
    bound = DELIMITERS.decode()
    items, i, n = [], 0, len(text)
    while i < n:
        if text[i] in bound:
            i += 1
            continue
        if text[i] in "\"'":
            mark, j, got = text[i], i + 1, []
            while j < n:
                if text[j] == mark:
                    if j + 1 < n and text[j + 1] == mark:
                        got.append(mark)
                        j += 2
                        continue
                    if j + 1 == n or text[j + 1] in bound:
                        break
                got.append(text[j])
                j += 1
            if j < n:
                items.append("".join(got).strip())
                i = j + 1
                continue
        j = i
        while j < n and text[j] not in bound:
            j += 1
        items.append(text[i:j].strip())
        i = j
    return [x for x in items if x]


def split_array(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Parents (row numbers), ordinals (from 1) and values of all texts, by masks over their bytes.

    Quote parity (a running count of quotes, reset at each row) tells inside from outside; delimiters
    outside end values; quotes that enclose, and the first of a doubled pair, are masked out of the
    value bytes. Rows that mix both kinds of quote, or quote inside a value, are scanned by split_text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    m = len(data)
    row = np.repeat(np.arange(n), np.diff(at))
    double, single = data == DOUBLE, data == SINGLE
    quote = double | single
    running = np.concatenate([[0], np.cumsum(quote)])
    inside = ((running[1:] - running[at[:-1]][row]) & 1).astype(bool)  # an opening quote is inside, a closing one is not
    ends = (running[at[1:]] - running[at[:-1]]) & 1
    delimiter = _IS_DELIMITER[data] & ~inside
    first = np.zeros(m + 1, bool)
    first[at[:-1]] = True
    last = np.zeros(m + 1, bool)
    last[at[1:][at[1:] > 0] - 1] = True
    first, last = first[:m], last[:m]
    before = first | np.concatenate([[True], (delimiter | (quote & ~inside))[:-1]])[:m]
    after = last | np.concatenate([(delimiter | (quote & inside))[1:], [True]])[:m]
    wrong = (quote & inside & ~before) | (quote & ~inside & ~after)
    odd = ends.astype(bool)
    odd |= np.bincount(row[wrong], minlength=n).astype(bool)
    odd |= np.bincount(row[double], minlength=n).astype(bool) & np.bincount(row[single], minlength=n).astype(bool)
    usable = ~delimiter & ~odd[row]
    starts = usable & (first | np.concatenate([[True], ~usable[:-1]])[:m])
    begin = np.flatnonzero(starts)
    encloses = quote & (~inside | starts)
    keep = usable & ~encloses
    size = np.concatenate([[0], np.cumsum(keep)])
    stop = np.flatnonzero(usable & (last | np.concatenate([~usable[1:], [True]])[:m])) + 1
    offsets = np.concatenate([[0], np.cumsum(size[stop] - size[begin])]).astype(np.int64)
    plain = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes())])
    counts = np.bincount(row[begin], minlength=n)
    values = pc.utf8_trim_whitespace(plain)
    if odd.any():
        scanned = {int(i): split_text(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
        counts[list(scanned)] = [len(x) for x in scanned.values()]
        place = np.concatenate([[0], np.cumsum(counts)])
        source = np.full(place[-1], -1, np.int64)
        source[np.flatnonzero(~np.repeat(odd, counts))] = np.arange(len(begin))
        extra = [x for i in sorted(scanned) for x in scanned[i]]
        source[np.flatnonzero(np.repeat(odd, counts))] = len(begin) + np.arange(len(extra))
        values = pa.concat_arrays([values, pa.array(extra, pa.large_string())]).take(pa.array(source))
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64()), values)
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    parent, flat = parent[full], flat.filter(pa.array(full))
    new = np.concatenate([[True], parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    ordinal = np.arange(len(parent)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(parent)]]))) + 1
    return parent, ordinal.astype(np.int32), flat


def unpack(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """One row per value of ``text``: the id columns, ``item_no`` from 1, and ``item``.

    Null, empty and blank texts, and texts of delimiters only, give no row; repeated values and
    repeated input rows are kept; other columns of the input are ignored whatever their names.
    """
    plain = df.select(*[F.col(c) for c in ids], F.col(text).cast("string").alias("lg_text")).where(F.col("lg_text").isNotNull())
    schema = T.StructType([*plain.select(*ids).schema.fields, T.StructField("item_no", T.IntegerType()), T.StructField("item", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, ordinal, values = split_array(batch.column(batch.num_columns - 1))
            if len(parent):
                take = pa.array(parent)
                columns = [batch.column(i).take(take) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ordinal), values.cast(pa.string())], [*ids, "item_no", "item"])

    return plain.mapInArrow(run, schema)
