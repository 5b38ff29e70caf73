"""Rows of two results without regard to order, floats to five digits."""

import numpy as np


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)

    def plain(v):
        if v is None or isinstance(v, (bool, np.bool_)):
            return None if v is None else bool(v)
        if isinstance(v, (float, np.floating)):
            return None if np.isnan(v) else round(float(v), 5)
        return int(v) if isinstance(v, (int, np.integer)) else v

    def one(v):
        v = plain(v)
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    return sorted((tuple(one(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)
