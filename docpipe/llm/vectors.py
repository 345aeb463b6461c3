"""Vectors as numpy rows, for the vector operators."""


def rows(lists):
    """An Arrow list column -> (list of float64 rows or None, list of flags).

    A vector is None if it is null, empty or zero, or holds null or non-finite components.
    """
    import numpy as np

    out = []
    for value in lists:
        value = value.values if value.is_valid else None
        if value is None or not len(value) or value.null_count:
            out.append(None)
            continue
        row = value.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(row if np.isfinite(row).all() and row.any() else None)
    return out
