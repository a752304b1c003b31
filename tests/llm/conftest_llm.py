"""Helpers of the tests in this folder."""


def plain(df, *keys):
    """Rows as dicts, in the order of keys."""
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple((r[k] is None, r[k]) for k in keys))
