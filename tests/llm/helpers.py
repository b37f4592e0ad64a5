"""Small tables with awkward rows, and the other engine."""

import duckdb
import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, size long, part string, rank int, line string, slot long, sig long, host string"


def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog while forty two other animals watch from the shade of an old tree near the quiet river bank " * 3
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + "indeed it does", "en", "b"), (4, None, "en", "a"), (5, "", None, "b"), (6, " \n\t ", "en", None), (7, "one two", "en", "a"), (8, "ONE two", "en", "a"),
        (9, "x " * 30000, "fr", "c"), (10, "w" * 50000, "fr", "c"), (None, base, None, None), (None, None, None, None), (1, base, "en", "a"), (11, "Über straße 日本語 😀 Released under the MIT License.\nReleased under the MIT License.", "de", "c"),
        (12, "\n".join(f"line {k} of a longer text with words {k * k}" for k in range(3000)), "en", "a"), (13, "<|endoftext|> a  b\x1cc", "en", ""),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None, 7, 8, "p", 1, "l", 9, 10, "h") for i, t, lang, s in texts], SCHEMA)


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.sql(sql).df()


def normal(df: pd.DataFrame):
    def text(x):
        if x is None or x is pd.NA or isinstance(x, float) and x != x:
            return None
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted([tuple(map(text, row)) for row in df[sorted(df.columns)].astype(object).values.tolist()], key=str)
