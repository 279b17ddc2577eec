"""Rows of a frame as a set."""


def as_set(df):
    return {tuple(r) for r in df.collect()}
