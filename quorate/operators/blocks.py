"""Texts cut by the tokens of a model: blocks without overlap, and windows that overlap, as its tokenizer file says."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quorate.functions.tokens import decodes, encoders, latin
from quorate.sources.shared import lean

#: Tokens of finished runs that a task holds before it gives them on.
HELD = 1 << 18


class Cut(NamedTuple):
    """Runs of `size` tokens, one every `stride`; special: with the tokens that the file puts around a text."""

    size: int
    stride: int
    special: bool


#: A model takes 512 tokens. Blocks leave room for those around a text; windows share 50 with the one before.
CUTS = {"block": Cut(500, 500, False), "overlap": Cut(512, 462, True)}


def token_runs(df: DataFrame, key: str, text: str, path: str, cuts: dict[str, Cut] = CUTS) -> DataFrame:
    """(key, kind, start, ids, text): the runs of each of `cuts` in each text, by the tokenizer file at `path`.

    What fits into one run is one run, with the text as it is; the text of any other is its ids decoded without special
    tokens, so a character that a cut parts comes as U+FFFD. Runs at the end may be shorter. Blank and null texts have none;
    repeated keys each have theirs. Texts of Latin letters are encoded and decoded by tiktoken where that says what the file
    says (quorate/functions/tokens.py). `path` is read by every task: it lies on each machine, or in a shared folder. A text is
    encoded whole: one of 6 MB took 800 MB, about 560 bytes a token.
    """
    names = [key, "kind", "start", "ids", "text"]
    kinds = [df.schema[key].dataType, StringType(), IntegerType(), ArrayType(IntegerType(), False), StringType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, quick, names_special = encoders(path)
        added = t.num_special_tokens_to_add(False) if any(c.special for c in cuts.values()) else 0
        if added or not decodes(path):
            quick = None
        for batch in batches:
            rows, held = [], 0

            def told(batch=batch, rows=rows):
                owner, kind, start, ids, said = zip(*rows, strict=True)
                cells = [batch.column(0).take(pa.array(owner)), pa.array(kind), pa.array(start, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(said)]
                return pa.RecordBatch.from_arrays(cells, names)

            for i in range(batch.num_rows):
                whole = batch.column(1)[i].as_py()
                fast = quick is not None and latin(whole, names_special)
                coded = {False: quick.encode_ordinary(whole)} if fast else {}
                if not fast:  # encoded once: the tokens around a text are put there afterwards
                    plain = t.encode(whole, add_special_tokens=False)
                    coded[False] = plain.ids
                coded[True] = t.post_process(plain, None, True).ids if added else coded[False]
                for kind, (size, stride, special) in cuts.items():
                    ids = coded[special]
                    if len(ids) <= size:
                        rows.append((i, kind, 0, ids, whole))
                        held += len(ids)
                        continue
                    for a in range(0, len(ids), stride):
                        part = ids[a : a + size]
                        rows.append((i, kind, a, part, quick.decode(part) if fast else t.decode(part, skip_special_tokens=True)))
                        held += len(part)
                        if held >= HELD:
                            yield told()
                            rows.clear()
                            held = 0
            if rows:
                yield told()

    given = lean(df).select(key, F.col(text).alias("text")).where(F.col("text").rlike(r"(?U)\S"))
    return given.mapInArrow(run, StructType([StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
