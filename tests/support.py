"""Helpers of the tests."""


def rows(df):
    return [tuple(r) for r in df.collect()]
