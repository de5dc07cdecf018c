import pytest


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names the operators use inside."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    passage = " ".join(f"p{i}" for i in range(70))
    long = " ".join(f"{words[(i * i + i // 7) % 12]}{i % 997}" for i in range(60_000))
    texts = [
        (5, "the same  text\there", "a"), (3, "the same text here", "a"), (9, "the same\n\ntext here", "b"), (3, "the same text here", "a"),
        (1, None, "a"), (2, "", None), (4, " \t\n", "b"), (None, "the same text here", "c"), (None, None, None),
        (10, "start " + passage + " end one", "a"), (11, "other words " + passage + " finish", "b"), (12, passage, "b"), (12, passage, "b"),
        (13, long, "a"), (14, long + " tail", "a"), (15, "Word " * 40, "c"), (16, "SHOUT NOW!! " * 20, "c"), (17, "€uro ẞ İstanbul 😀 " * 3, "c"),
        (18, "<|endoftext|> literal <|ENDOFTEXT|> \x01 mark", "c"), (19, "Licensed under the Apache License, Version 2.0.", "c"),
    ]
    names = ["fp", "norm", "row", "k_doc", "k_sha", "rank", "salt", "text_hash", "m_text", "d_row", "source_", "n_tokens", "copy", "size", "kept"]
    rows = [(i, t, "en", s, None if t is None else len(t), *[None if k % 2 else str(k) for k, _ in enumerate(names)]) for i, t, s in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)).repartition(3)


@pytest.fixture(scope="session")
def rows_of(tricky):
    return [(r["doc_id"], r["text"]) for r in tricky.collect()]


@pytest.fixture(scope="session")
def empty(tricky):
    return tricky.where("false")
