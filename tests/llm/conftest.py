import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Texts with copies, near copies, nulls, blanks, repeated rows and a very long text; and columns of clashing names."""
    words = [f"w{i * 7919 % 9973}" for i in range(6000)]
    base = words[:120]
    near = base[:118] + ["edit", "more"]
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t"), (7, "one two"), (7, "one two"), (8, "One  TWO"),
        (9, " ".join(words)), (10, "x " + " ".join(words[200:270]) + " y"), (11, "All rights reserved. Cc by, all  Rights reserved"),
        (12, "licensed undr the apache license"), (None, "no id"), (13, "ab " * 300), (14, "é ß 日本 😀, ok. it's I'll  x\n\ny"),
        (15, " ".join(base[:60] + [f"u{i}" for i in range(60)])),
    ]
    return spark.createDataFrame([(i, t, "en", 0, "k") for i, t in rows], "doc_id long, text string, lang string, n_chars long, set_key string")
