"""Character n-grams of batches of texts with numpy, inside tasks. Texts are spaced words (functions.text.spaced_words)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

SLICE = 500_000  # characters that are counted at a time; a longer text is alone
MOST = 300_000  # words or terms that a task holds


class Grams:
    """n-grams as numbers: those given, or else new ones as they come."""

    def __init__(self, terms: list[str] | None = None):
        self.fixed, self.ids, self.words = terms is not None, {t: i for i, t in enumerate(terms or ())}, {}

    def of(self, word: str) -> np.ndarray:
        """All n-grams of a word with a space at either end; they depend on the word alone, so each word is cut once."""
        if (known := self.words.get(word)) is not None:
            return known
        w, ids = f" {word} ", self.ids
        grams = [w[i : i + z] for z in (2, 3, 4) for i in range(len(w) - z + 1)]
        out = np.array([ids[g] for g in grams if g in ids] if self.fixed else [ids.setdefault(g, len(ids)) for g in grams], dtype=np.int64)
        if len(self.words) >= MOST:
            self.words.clear()
        self.words[word] = out
        return out

    def counted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the text, n-gram, how often it has it), ascending."""
        each = [[self.of(w) for w in t.split(" ")] if t else [] for t in texts]
        size = np.array([sum(map(len, e)) for e in each], dtype=np.int64)
        many = max(1, len(self.ids))
        if not size.sum():
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        pairs = np.repeat(np.arange(len(texts)) * many, size) + np.concatenate([g for e in each for g in e])
        if len(texts) * many <= 4 * len(pairs):
            counts = np.bincount(pairs)
            pairs = np.flatnonzero(counts)
            n = counts[pairs]
        else:
            pairs, n = np.unique(pairs, return_counts=True)
        return pairs // many, pairs % many, n


def slices(texts: list[str]) -> Iterator[slice]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    yield slice(start, len(texts))


def frequencies(groups: int):
    """For mapInPandas over (text, g0, g1, ...): (term, d0, d1, ...), how many of these texts of each group have an n-gram."""

    def run(frames):
        import pandas as pd

        def told():
            return pd.DataFrame({"term": list(grams.ids), **{f"d{i}": known[i, : len(grams.ids)] for i in range(groups)}})

        grams, known = Grams(), np.zeros((groups, 0), dtype=np.int64)
        for frame in frames:
            texts = frame["text"].tolist()
            flags = [frame[f"g{i}"].to_numpy(dtype=bool) for i in range(groups)]
            for s in slices(texts):
                at, gram, _ = grams.counted(texts[s])
                if len(grams.ids) > known.shape[1]:
                    known = np.pad(known, ((0, 0), (0, 2 * len(grams.ids) - known.shape[1])))
                for i, f in enumerate(flags):
                    known[i] += np.bincount(gram[f[s][at]], minlength=known.shape[1])
                if len(grams.ids) > MOST:
                    yield told()
                    grams, known = Grams(), np.zeros((groups, 0), dtype=np.int64)
        if grams.ids:  # a task without rows or words tells nothing: pandas makes floats of an empty list, which are no terms
            yield told()

    return run


def cosines(terms: list[str], weights: list[np.ndarray], asked: list[np.ndarray], norms: list[float]):
    """For a pandas UDF over texts: cosines with each query, of which weights[j] and asked[j] are the terms' weights and counts."""

    def run(texts):
        import pandas as pd

        grams = made.setdefault("grams", Grams(terms))
        texts = texts.tolist()
        out = np.zeros((len(texts), len(norms)))
        for s in slices(texts):
            at, gram, n = grams.counted(texts[s])
            here = s.stop - s.start
            some = np.flatnonzero(any_asked[gram])
            few_at, few, few_n = at[some], gram[some], n[some]
            for j, norm in enumerate(norms):
                i = weights[j][few]
                product = np.bincount(few_at, few_n * i * asked[j][few] * i, here)
                length = np.bincount(at, (n * weights[j][gram]) ** 2, here)
                out[s, j] = product / (np.where(length == 0, 1.0, np.sqrt(length)) * norm)
        return pd.Series(list(out))

    made, any_asked = {}, np.any(asked, axis=0)
    return run
