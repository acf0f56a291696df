"""Raters: pluggable models that run over Arrow batches, a client to a partition, answers as raw text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from quorate.functions.answers import parsed


class Rater(Protocol):
    def rate(self, text: str, company: str, version: str) -> str | None:
        """The raw answer; None where the rater gives up on this one. An exception stops the run."""


class SignRater:
    """A rater without a model, for tests and dry runs: the remainder of the text's length decides."""

    def rate(self, text: str, company: str, version: str) -> str | None:
        note = (len(text or "") + len(company or "")) % 4
        return None if note == 3 else f'{{"note_llm": {note}, "justification": "{version}"}}'


#: Makers rather than raters: each partition makes its own client.
REGISTRY: dict[str, Callable[[], Rater]] = {"sign": SignRater}


def rate(requests: DataFrame, rater: str, version: str) -> DataFrame:
    """requests (custom_id, company, text) -> custom_id, raw, and what parsed() adds.

    Calls cost money: write the result, and read that back, before anything else uses it.
    """
    make = REGISTRY[rater]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            yield pd.DataFrame({"custom_id": b["custom_id"], "raw": [client.rate(t, c, version) for t, c in zip(b["text"], b["company"], strict=True)]})

    return parsed(requests.select("custom_id", "company", "text").mapInPandas(run, "custom_id string, raw string"))
