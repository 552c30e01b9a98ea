"""Answers in plain numpy, for the tests."""

import numpy as np


def nearest(values, queries, k, exclude_self=False):
    """Brute force in plain numpy: ``{(qid, rn, id, dist)}``."""
    out = set()
    for qid, (pos, q) in queries.items():
        pos, q = np.asarray(pos), np.asarray(q, dtype=float)
        found = [
            (float(np.abs(np.asarray(v, dtype=float)[pos] - q).max()), i)
            for i, v in values.items()
            if len(v) > pos.max() and not (exclude_self and i == qid)
        ]
        out |= {(qid, rn, i, d) for rn, (d, i) in enumerate(sorted(found)[:k], 1)}
    return out


def answers(df):
    return {(r.qid, r.rn, r.id, r.dist) for r in df.collect()}
