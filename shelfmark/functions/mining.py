"""Names and brands in text, folder classes, and small image features over pixel arrays."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import text as T

_PLAIN = str.maketrans(dict(zip(T.ACCENTED, T.PLAIN)) | {"'": None, "’": None})
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def plain(word: str) -> str:
    """Lower case without accents and apostrophes."""
    return word.translate(_PLAIN).lower()


def find_brands(text: str, lexicon: list[str], ambiguous: frozenset[str]) -> list[str]:
    """Lexicon entries in a text as whole words, the longest first; a word serves one entry.

    Case and accents don't matter. An ambiguous entry counts only where all its letters are
    capitals.
    """
    words = _WORD.findall(text)
    low = [plain(w) for w in words]
    free = [True] * len(words)
    at: dict[str, list[int]] = {}
    for i, w in enumerate(low):
        at.setdefault(w, []).append(i)
    found: set[str] = set()
    for entry in sorted(lexicon, key=lambda e: (-len(e.split()), -len(e), e)):
        parts = plain(entry).split()
        for i in at.get(parts[0], ()) if parts else ():
            span = range(i, i + len(parts))
            if low[i : i + len(parts)] == parts and all(free[k] for k in span) and (entry not in ambiguous or all(ch.isupper() for k in span for ch in words[k] if ch.isalpha())):
                found.add(entry)
                for k in span:
                    free[k] = False
    return sorted(found)


def brands(lexicon: list[str], ambiguous: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    """A function of a text column: array of the brands in it. The lexicon is part of the plan."""
    odd = frozenset(ambiguous)

    @F.pandas_udf("array<string>")
    def detect(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find_brands(t or "", lexicon, odd))

    return detect


def find_names(text: str, dictionary: frozenset[str], most: int = 4) -> list[str]:
    """Runs of up to `most` capitalised words of a line with a word outside the dictionary.

    Dictionary words are cut off both ends; a single word has four letters or more.
    """
    found: set[str] = set()
    for line in re.split(r"[\n.!?;:|]", text):
        run: list[str] = []
        for word in [*_WORD.findall(line), ""]:
            if word and word[0].isupper() and not word.isupper():
                run.append(word)
                continue
            while run and run[0].lower() in dictionary:
                run.pop(0)
            while run and run[-1].lower() in dictionary:
                run.pop()
            if run and len(run) <= most and (len(run) > 1 or len(run[0]) >= 4):
                found.add(" ".join(run))
            run = []
    return sorted(found)


def names(dictionary: tuple[str, ...]) -> Callable[[Column], Column]:
    known = frozenset(dictionary)

    @F.pandas_udf("array<string>")
    def detect(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find_names(t or "", known))

    return detect


def classify(photos: Column, with_faces: Column, faces: Column, share: Callable[[str], Column], top: Column) -> Column:
    """What a folder shows. share(kind): part of its photographs tagged so. The order counts."""
    face = with_faces / photos
    return (
        F.when(share("scan") >= 0.40, "scanned prints")
        .when((share("bride") >= 0.08) | (share("wedding") >= 0.15), "wedding")
        .when((face >= 0.3) & (share("child") >= 0.2), "children")
        .when((face >= 0.6) & (faces * 2 <= with_faces * 3), "portraits")
        .when((face < 0.2) & (share("object") >= 0.5), "products")
        .when((face >= 0.5) & (share("event") >= 0.15), "event")
        .when(face >= 0.5, "people")
        .otherwise(top)
    )


def colour_stats(pixels: Column) -> Column:
    """(mean, saturation, is_grey) of an array of (r, g, b) with values of 0 to 255."""
    total = lambda f: F.aggregate(pixels, F.lit(0.0), lambda s, p: s + f(p))
    high, low = (lambda p: F.greatest(p["r"], p["g"], p["b"])), (lambda p: F.least(p["r"], p["g"], p["b"]))
    n = F.size(pixels)
    grey = total(lambda p: F.when(high(p) - low(p) <= 8, 1.0).otherwise(0.0)) / n
    saturation = total(lambda p: F.when(high(p) > 0, (high(p) - low(p)) / high(p)).otherwise(0.0)) / n
    return F.struct(F.round(total(lambda p: (p["r"] + p["g"] + p["b"]) / 3.0) / n, 6).alias("mean"), F.round(saturation, 6).alias("saturation"), (grey > 0.95).alias("is_grey"))


def scan_artifacts(border: Column) -> Column:
    """Whether the pixels of a picture's border, (r, g, b) of 0 to 255, are a scanner's paper:
    brighter than 0.6 and less saturated than 0.5 in the mean."""
    stats = colour_stats(border)
    return (stats["mean"] / 255 > 0.6) & (stats["saturation"] < 0.5)


#: The colour that a word of a search stands for.
COLOURS = {"sea": (40, 90, 160), "sky": (110, 170, 230), "forest": (40, 100, 50), "snow": (235, 240, 245), "night": (20, 20, 40), "sunset": (230, 120, 60)}
SYNONYMS = {"ocean": "sea", "beach": "sea", "wood": "forest", "winter": "snow", "evening": "sunset"}


def render_words(text: str) -> tuple[np.ndarray, float]:
    """A 4 x 4 grid of RGB from the words that have a colour, and the part of words that do."""
    words = [w.lower() for w in _WORD.findall(text)]
    known = []
    for w in words:
        w = SYNONYMS.get(w, w)
        if w not in COLOURS and w.endswith("s") and len(w) > 3:
            w = SYNONYMS.get(w[:-1], w[:-1])
        if w in COLOURS:
            known.append(COLOURS[w])
    grid = np.zeros((4, 4, 3))
    for i, rgb in enumerate(known):
        grid[i * 4 // len(known) : (i + 1) * 4 // len(known) or 1] = rgb
    return grid, len(known) / len(words) if words else 0.0


def embed_grid(grid: np.ndarray) -> np.ndarray:
    """65 values: RGB and brightness of each cell, and a constant; of length 1."""
    cells = np.concatenate([grid / 255, grid.mean(axis=2, keepdims=True) / 255], axis=2).ravel()
    v = np.append(cells, 0.5)
    return v / math.sqrt(float(v @ v))


# Parts of labels that tell a place under the sky from one inside.
OUTDOOR = ["outdoor", "sky", "beach", "mountain", "field", "forest", "garden", "landscape", "sea", "ocean", "snow", "street", "park", "tree", "plant", "water", "sunset"]
INDOOR = ["indoor", "room", "furniture", "kitchen", "table", "document", "screenshot", "food", "wall", "curtain", "bed", "chair"]


def place(labels: Column) -> Column:
    """(indoor, outdoor) of an array of (name, confidence): the largest confidence of a label that
    holds one of the words, 0 without one."""

    def best(words: list[str]) -> Column:
        hits = F.filter(labels, lambda x: F.lower(x["name"]).rlike("|".join(words)))
        return F.coalesce(F.array_max(F.transform(hits, lambda x: x["confidence"].cast("double"))), F.lit(0.0))

    return F.struct(best(INDOOR).alias("indoor"), best(OUTDOOR).alias("outdoor"))
