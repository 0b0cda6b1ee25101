"""Scorers of texts that run in Arrow batches and are opened once in each Python worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PREDICTION = "aspects array<int>, aspect_probs array<double>, confidence double, stressed boolean, failed string"
_OPEN: dict[str, Callable] = {}


PLACES = 4096


def hashed_scorer(n: int = 9, seed: int = 7) -> Callable[[list[str]], np.ndarray]:
    """A stand-in model: weights of words (parts between spaces) from digests, the same in every engine."""
    part = lambda what, digits: int(hashlib.md5(what.encode()).hexdigest()[:digits], 16)
    weights = np.array([[part(f"{seed}|{p}|{j}", 8) / 2**32 * 2.4 - 1.2 for j in range(n)] for p in range(PLACES)])
    places: dict[str, int] = {}

    def score(texts: list[str]) -> np.ndarray:
        out = np.full((len(texts), n), -1.0)
        for i, t in enumerate(texts):
            words = [w for w in t.split(" ") if w]
            for w in words:
                if w not in places:
                    if len(places) > 200_000:
                        places.clear()
                    places[w] = part(w, 3)
            out[i] += weights[[places[w] if w in places else part(w, 3) for w in words]].sum(0) / np.sqrt(max(1, len(words)))
        return out

    return score


def onnx_scorer(path: str) -> Callable[[list[str]], np.ndarray]:
    """Logits of a model file that takes texts; opened by the worker."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path)
    name = session.get_inputs()[0].name
    return lambda texts: session.run(None, {name: np.array(texts, dtype=object)})[0]


def predict(text: Column, open_scorer: Callable[[], Callable[[list[str]], np.ndarray]], version: str, n: int = 9, threshold: float = 0.5) -> Column:
    """Labels above the threshold, all probabilities, the highest one (0 without a label) and whether there is a label.

    Null and blank texts get no label and n zeros; so do texts of a batch on which the scorer fails, with the reason in failed.
    """

    @F.pandas_udf(PREDICTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if version not in _OPEN:
            _OPEN[version] = open_scorer()
        for texts in batches:
            probs, failed = np.zeros((len(texts), n)), [None] * len(texts)
            some = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            if some:
                try:
                    probs[some] = 1 / (1 + np.exp(-_OPEN[version]([texts.iloc[i] for i in some])))
                except (RuntimeError, ValueError) as error:
                    for i in some:
                        failed[i] = f"{type(error).__name__}: {error}"[:200]
            labels = [[int(j) for j in np.flatnonzero(p > threshold)] for p in probs]
            yield pd.DataFrame({"aspects": labels, "aspect_probs": [p.tolist() for p in probs], "confidence": [float(p.max()) if ids else 0.0 for p, ids in zip(probs, labels, strict=True)], "stressed": [bool(ids) for ids in labels], "failed": failed})

    return run(text)
