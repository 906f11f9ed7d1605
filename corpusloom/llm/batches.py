"""Helpers for functions that get a partition as an iterator of pandas frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def slices(pdf: pd.DataFrame, column: str, most: int) -> Iterator[pd.DataFrame]:
    """The frame in runs of rows of at most `most` characters (a longer text stands alone)."""
    begin = total = 0
    for i, n in enumerate(pdf[column].str.len().to_numpy()):
        if i > begin and total + n > most:
            yield pdf.iloc[begin:i]
            begin, total = i, 0
        total += n
    if len(pdf):
        yield pdf.iloc[begin:]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of a partition sorted by keys, so that no group is divided between two of them."""
    held: list[pd.DataFrame] = []  # rows of the last group, which may go on in the next batch
    for pdf in batches:
        if not len(pdf):
            continue
        last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1)
        if last.all() and held and (held[0][keys].iloc[0] == pdf[keys].iloc[0]).all():
            held.append(pdf)
            continue
        ready = pd.concat([*held, pdf[~last]])
        held = [pdf[last]]
        if len(ready):
            yield ready
    if held:
        yield pd.concat(held)
