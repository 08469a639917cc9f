"""Alignment of the notes of two sides of one key, and the choice among shifts by octaves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import ship

# What a note without a partner costs, the largest table that is filled (larger pairs are reported as skipped), and the shifts.
GAP = 18.0
MOST_CELLS = 5_000_000
SHIFTS = (-24, -12, 0, 12, 24)


def _pair_costs(a: np.ndarray, b: np.ndarray, basis: float) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs: cost without that of the pitches, and pitches apart. Columns: start, end, pitch."""
    at = np.abs((a[:, 0] / basis)[:, None] - (b[:, 0] / basis)[None, :])
    both = np.maximum(0.0, np.minimum(a[:, 1][:, None], b[:, 1]) - np.maximum(a[:, 0][:, None], b[:, 0]))
    whole = np.maximum(a[:, 1][:, None], b[:, 1]) - np.minimum(a[:, 0][:, None], b[:, 0])
    shared = np.divide(both, whole, out=np.zeros_like(both), where=whole > 1e-9)
    return np.minimum(4.0, at * 4.0), (1.0 - shared) * 0.1


def align(a: np.ndarray, b: np.ndarray, basis: float, shift: int = 0, tolerance: int = 0) -> tuple[float, int, int, float]:
    """Least cost of an alignment in order, and its pairs, pairs of one pitch and sum of pitches apart.

    A pair costs pitches apart, four times its distance in parts of `basis` (4 at most) and a tenth of what the intervals do not share. Of equal
    costs more pairs win, then fewer pitches apart. The table is filled by its diagonals, which need the two before them only.
    """
    n, m = len(a), len(b)
    near, shared = _pair_costs(a, b, basis)
    far = np.abs(a[:, 2][:, None] - (b[:, 2] + shift)[None, :])
    pair, same = far + near + shared, far <= tolerance
    # cost, pairs, matches, pitches apart of diagonal d, by row i; those of d - 1 and d - 2 are at hand
    older = old = None
    for d in range(n + m + 1):
        rows = np.arange(max(0, d - m), min(n, d) + 1)
        now = np.zeros((4, n + 1))
        now[0] = np.inf
        if d == 0:
            now[:, 0] = 0
        else:
            ways = []
            inner = rows[(rows > 0) & (rows < d)]
            step = np.full((4, n + 1), np.inf)
            if len(inner):
                i, j = inner - 1, d - inner - 1
                step[:, inner] = older[:, inner - 1] + np.stack([pair[i, j], np.ones(len(i)), same[i, j], far[i, j]])
            ways.append(step)
            for back in (1, 0):  # a note of `a` left out, then one of `b`
                skip = np.full((4, n + 1), np.inf)
                own = rows[rows > 0] if back else rows[rows < d]
                skip[:, own] = old[:, own - back]
                skip[0, own] += GAP
                ways.append(skip)
            now = ways[0]
            for way in ways[1:]:
                better = (way[0] < now[0]) | ((way[0] == now[0]) & ((way[1] > now[1]) | ((way[1] == now[1]) & (way[3] < now[3]))))
                better &= np.isfinite(way[0])
                now = np.where(better, way, now)
        older, old = old, now
    cost, pairs, matches, apart = old[:, n]
    return float(cost), int(pairs), int(matches), float(apart)


def align_best_shift(expected: DataFrame, predicted: DataFrame, key: str, shifts: tuple[int, ...] = SHIFTS) -> DataFrame:
    """Per key the shift of the predicted pitches that aligns best, the smaller one of equals: cost a note, pairs and shares of notes with one pitch.

    Keys with an empty side or a table over MOST_CELLS are told from counts and skipped, with the reason, so no group exceeds a known size.
    """
    side = lambda df, x: ship(df).select(key, F.lit(x).alias("side"), "start_sec", "end_sec", F.col("pitch").cast("double").alias("pitch"))
    both = side(expected, 0).unionByName(side(predicted, 1))
    sizes = both.groupBy(key).agg(F.count_if(F.col("side") == 0).alias("n_expected"), F.count_if(F.col("side") == 1).alias("n_predicted"))
    cells = F.col("n_expected") * F.col("n_predicted")
    sizes = sizes.withColumn("skipped_reason", F.when(cells == 0, "empty_note_sequence").when(cells > MOST_CELLS, "too_many_note_pairs"))

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_sec", "pitch", "end_sec"], kind="stable")
        a, b = (pdf.loc[pdf["side"] == s, ["start_sec", "end_sec", "pitch"]].to_numpy(float) for s in (0, 1))
        basis = max(*(x[:, 1].max() - x[:, 0].min() for x in (a, b)), 1.0)
        tries = [(cost / (len(a) + len(b)), abs(s), k, s, pairs, matches, apart) for k, s in enumerate(shifts) for cost, pairs, matches, apart in [align(a, b, basis, s)]]
        cost, _, _, shift, pairs, matches, apart = min(tries)
        return pd.DataFrame({key: [group[0]], "shift": [shift], "cost": [cost], "pairs": [pairs], "recall": [matches / len(a)], "precision": [matches / len(b)], "mean_pitch_delta": [apart / pairs if pairs else 0.0]})

    kind = dict(expected.dtypes)[key]
    fits = both.join(sizes.where("skipped_reason is null").select(key), key, "left_semi")
    found = fits.groupBy(key).applyInPandas(run, f"{key} {kind}, shift int, cost double, pairs long, recall double, precision double, mean_pitch_delta double")
    return sizes.join(found, key, "left").select(key, "n_expected", "n_predicted", "shift", "cost", F.coalesce("pairs", F.lit(0)).alias("pairs"), "recall", "precision", "mean_pitch_delta", "skipped_reason")
