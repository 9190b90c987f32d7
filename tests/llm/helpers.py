"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    """A reproducible text of n words with a full stop every seventh."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        w = WORDS[x % len(WORDS)] + (WORDS[(x >> 8) % len(WORDS)] if x % 3 == 0 else "")
        out.append(w + ("." if i % 7 == 6 else ""))
    return " ".join(out)


def awkward():
    """(doc_id, text): see the module."""
    return [
        (1, prose(1, 60)),
        (2, prose(1, 60)),
        (2, prose(1, 60)),
        (3, None),
        (4, ""),
        (5, prose(5, 4000)),
        (6, "word"),
        (7, "  \n\t "),
        (None, prose(7, 40)),
        (9, "Größe élan 漢字 😀 ▁x\n\nnul"),
        (10, prose(10, 30) + "\n" + prose(10, 30)),
        (11, "1234 5678 !!! ### 99"),
    ]


def table(spark, rows=None, extra=False):
    full = [(i, t, "en" if (i or 0) % 2 else None, None if i == 5 else "s1", len(t) if t else None) for i, t in (awkward() if rows is None else rows)]
    df = spark.createDataFrame(full, COLUMNS)
    if extra:
        for c in ("score", "fp", "kept", "_text", "h1", "body", "prob", "stratum", "label"):
            df = df.withColumn(c, df["lang"])
    return df


def key(x):
    return (x is not None, x if x is not None else 0)
