import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, size string, kept_text string, key int, first int, score string, b int"


def corpus(seed=5, n=40):
    """(doc_id, text, source) with exact, spaced and near copies, shared lines and passages, nulls, blanks, repeated rows and ids, one very long text."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "ka lo mi nu pe ro sta tri vo zé".split() for b in "ban del fir gos hul".split()]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    lines = ["  The same notice stands under each of these documents, Again ", "Another line that is shared by many of the documents here\t"]
    passage = text(30)
    rows = []
    for i in range(n):
        body = text(rng.randint(3, 120))
        if i % 4 == 0:
            body += "\n" + lines[i % 3 % 2] + "\n" + text(12)
        if i % 5 == 0:
            body = text(9) + " " + passage + " " + body
        rows.append((i + 1, body, f"s{i % 3}"))
    for i in range(0, n, 3):
        own = rows[i][1].split(" ")
        rows.append((100 + i, " ".join(own), "s1"))
        rows.append((200 + i, "  ".join(own), "s0"))
        if len(own) > 30:
            own[rng.randrange(len(own))] = "changed"
            rows.append((300 + i, " ".join(own), None))
    rows += [(900, text(30_000), "s2"), (901, None, "s0"), (902, "", "s0"), (903, " \n\t ", None), (904, "three words only", "s1"), (905, "three words only", "s1")]
    rows += [(None, rows[0][1], "s0"), (None, "a text whose row has no id but words enough to be a window", None), (None, None, None)]
    rows += [(7, rows[6][1], "s0"), (7, rows[6][1], "s0"), (8, "a second text with an id that another row has too, and it is long enough", "s1")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), "r", None, "big", "k", 1, 2, "x", 3) for d, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
