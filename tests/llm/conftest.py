import random

import pytest

#: Extra columns with the names that the operators use inside.
CLASHES = ("ids", "words", "w", "n", "key", "h", "part", "first", "mark", "digest", "kind", "value", "train", "held_out", "size", "start", "place")


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents() -> list[tuple]:
    """(doc_id, text, lang): copies, near copies, shared passages, and every odd case."""
    base, long_ = prose(1, 300), prose(2, 4000)
    near = base.split()
    near[150] = "changed"
    passage = prose(3, 80)
    rows = [(1, base, "en"), (2, base, "en"), (3, " ".join(near), "en"), (4, long_, "en"), (5, f"{prose(5, 60)} {passage} {prose(6, 60)}", "en"), (6, f"{prose(7, 30)} {passage}", "de"), (7, passage[: len(passage) // 2], "en")]
    rows += [(8, None, "en"), (9, "", "en"), (10, " \n\t ", None), (11, "one two three", "en"), (12, "one two three", "de"), (13, "!!! ??? 123", "fr"), (14, "To " * 400, "en"), (15, "To " * 300, "en"), (16, "Ünïcödé ñandú straße <|endoftext|> 🤔 中文", "es")]
    rows += [(None, base, "en"), (None, None, None), (17, prose(8, 100), "en"), (17, prose(8, 100), "en"), (18, prose(9, 90), "en"), (18, prose(10, 90), "en"), (19, "x" * 50_000, "en")]
    return rows + [(20 + i, prose(100 + i, 40 + i), ("en", "de")[i % 2]) for i in range(20)]


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(*r, *range(len(CLASHES))) for r in documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("false")
