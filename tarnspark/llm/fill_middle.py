"""Fill-in-middle examples: texts cut in three at places found by a sparse index of checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two checkpoints.
EVERY = 512
#: Bytes that are counted at once.
STEP = 1 << 20

#: What a text can be cut into.
UNITS = ("code_point", "line")


def _starts(data: np.ndarray, unit: str, fresh: bool) -> np.ndarray:
    """Where units begin in UTF-8 bytes. fresh: whether the first byte follows the end of a unit."""
    if unit == "code_point":
        return np.flatnonzero((data & 0xC0) != 0x80)
    after = np.flatnonzero(data[:-1] == 0x0A) + 1
    return np.append(0, after) if fresh and len(data) else after


class Checkpoints:
    """The byte and code-point offsets of every EVERY-th unit of a text, recorded while its units are counted.

    `cut(u)` finds the byte and code-point offset at which unit u begins: the last checkpoint at or before it by binary
    search, then a short scan from there. Only checkpoints are kept, so a text of any length takes 24 bytes for EVERY units
    beside its own.
    """

    def __init__(self, data: np.ndarray, unit: str = "code_point", every: int = EVERY):
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {', '.join(UNITS)}: {unit}")
        self.data, self.unit, self.every, self.n, self.n_chars = data, unit, every, 0, 0
        units, at, chars = [], [], []
        for low in range(0, len(data), STEP):
            piece = data[low : low + STEP]
            begin = _starts(piece, unit, low == 0 or data[low - 1] == 0x0A)
            mark = begin[-self.n % every :: every]
            units.append(self.n + (-self.n % every) + every * np.arange(len(mark)))
            at.append(low + mark)
            lead = begin if unit == "code_point" else _starts(piece, "code_point", True)
            chars.append(self.n_chars + np.searchsorted(lead, mark))
            self.n, self.n_chars = self.n + len(begin), self.n_chars + len(lead)
        self.units, self.at, self.chars = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (units, at, chars))

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which this unit begins; the text's end for n and beyond."""
        if unit >= self.n:
            return len(self.data), self.n_chars
        k = int(np.searchsorted(self.units, unit, side="right")) - 1
        left, begin = unit - int(self.units[k]), int(self.at[k])
        end = int(self.at[k + 1]) if k + 1 < len(self.at) else len(self.data)
        window = self.data[begin:end]
        byte = begin + int(_starts(window, self.unit, True)[left]) if left else begin
        return byte, int(self.chars[k]) + int(np.count_nonzero((self.data[begin:byte] & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 for a document: the first hex digits of sha256 of seed:doc_id (a null id: nothing after the colon)."""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(d[k : k + 4], "big") for k in (0, 4, 8, 12))


def fill_in_middle(docs: DataFrame, *, plain_percent: int = 10, spm_percent: int = 20, seed: int = 1, unit: str = "code_point", every: int = EVERY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points) and output for each row.

    A text's two cuts are drawn from its id (`draws`), each at any unit or the end. Of the texts that can be cut,
    plain_percent stay as they are; of the others spm_percent have the suffix first (spm), the rest the prefix first
    (psm). An empty or null text, and one that holds <P>, <S> or <M>, is always plain, so `restore` is exact.

    Row by row, without a shuffle. A null id is an id of its own; rows that repeat an id are cut by the same draws. Texts
    of any length are taken whole, a block of some MB at a time. Other columns, whatever they are called, are left out. No
    rows: no rows.
    """
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.blocks_of(batch, "text"):
                data, offsets = shared.text_buffers(part.column("text"))
                out = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
                for i, a, b in zip(part.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
                    raw = data[a:b].tobytes()
                    index = Checkpoints(data[a:b], unit, every)
                    h1, h2, h3, h4 = draws(i, seed)
                    form, prefix, middle, made = "plain", None, None, raw
                    if raw and not any(x in raw for x in marks) and h3 % 100 < 100 - plain_percent:
                        (one, prefix), (two, end) = (index.cut(u) for u in sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
                        middle, form = end - prefix, "spm" if h4 % 100 < spm_percent else "psm"
                        if form == "psm":
                            made = b"".join((p, raw[:one], s, raw[two:], m, raw[one:two]))
                        else:
                            made = b"".join((s, raw[two:], p, raw[:one], m, raw[one:two]))
                    for name, value in zip(out, (index.n, form, prefix, middle, made), strict=True):
                        out[name].append(value)
                kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
                columns = {c: pa.array(out[c], t) for c, t in kinds.items()}
                yield pa.record_batch({"doc_id": part.column("doc_id"), **columns, "output": pa.array(out["output"], pa.binary()).cast(pa.string())})

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return shared.map_arrow(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(examples: DataFrame, *, into: str = "text", output: str = "output", form: str = "form") -> DataFrame:
    """examples with the text that `output` was made of, as a column `into`, read from `output` and `form` alone.

    Only texts without a mark are ever cut, and no mark can arise where a part and a mark meet, so the three marks part the
    output for certain. A plain output is the text. A null output stays null. Spark's own functions only."""
    part = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return examples.withColumn(into, F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output)))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(fill_in_middle(shared.table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))
