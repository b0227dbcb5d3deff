"""A second coder that can be plugged in, such as a remote model. Off by default:
nothing in the library calls one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A coder takes texts and returns, for each, a record or None to keep the local coding.
Coder = Callable[[list[str]], list[dict | None]]
BATCH = 20
EMOTIONS = ["frustration", "anxiety", "sadness", "anger", "relief", "hope", "gratitude", "pride", "confusion", "trust", "distrust", "resignation", "neutral"]


def recode(codes: DataFrame, coder: Coder, batch: int = BATCH, text: str = "text") -> DataFrame:
    """codes with label, emotion, valence and confidence as a coder reads them.
    A record counts only if it is whole and within bounds; a batch that fails
    keeps the local coding, so a coder's outage loses nothing."""
    names = codes.columns

    def valid(r: dict | None) -> bool:
        try:
            return bool(r) and bool(str(r["label"]).strip()) and r["emotion"] in EMOTIONS and -1 <= float(r["valence"]) <= 1 and 0 <= float(r["confidence"]) <= 1
        except (KeyError, TypeError, ValueError):
            return False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found: list[dict | None] = []
            for at in range(0, len(frame), batch):
                part = frame[text].iloc[at : at + batch].tolist()
                try:
                    got = list(coder(part))
                except Exception:  # noqa: BLE001  whatever a remote coder raises
                    got = []
                found += [r if valid(r) else None for r in (got + [None] * len(part))[: len(part)]]
            for column in ("label", "emotion", "valence", "confidence"):
                frame[column] = [old if r is None else r[column] for r, old in zip(found, frame[column], strict=True)]
            frame["recoded"] = [r is not None for r in found]
            yield frame[[*names, "recoded"]]

    return codes.mapInPandas(run, codes.withColumn("recoded", F.lit(False)).schema)
