import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Cases every operator on documents must stand: nulls, empty and very long texts, ties, repeats.
EDGES = [
    (None, "a text without an id but with a few words in it", "en", "s1", 47),
    (1, None, None, None, None),
    (2, "", "en", "s1", 0),
    (3, " \n\t\n ", "en", None, 5),
    (4, "the same words in the same line of text\n" * 3, "en", "s2", None),
    (4, "the same words in the same line of text\n" * 3, "en", "s2", None),
    (5, "the same words in the same line of text", "en", "s1", 39),
    (6, "THE SAME words in the same line of text  ", "de", "s3", 41),
    (7, " ".join(f"word{i % 977}x{i}" for i in range(30_000)), "en", "s1", None),
    (8, "größe über äpfel – naïve façade 漢字 <|endoftext|>   end", "de", "s3", None),
    (-9, "#*$%&|<> 12345 !!!", None, "s1", 18),
]


def sentence(rng: random.Random, n: int, lang: str) -> str:
    pool = {"en": "the of and to in that with from there which would their about other these could people than first",
            "de": "der die und nicht über schon werden können müssen zwischen während größer für aber diese wieder auch",
            "fr": "le des une pour dans avec plus être cette leur après même comme aussi très tout depuis elle nous"}[lang].split()
    return " ".join(rng.choice(pool) + rng.choice(["", "a", "e", "is", "en"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """About 150 documents with copies, near copies, shared lines, junk and skewed sources."""
    rng = random.Random(5)
    out = []
    for i in range(100):
        lang = ("en", "de", "fr")[i % 3]
        lines = [sentence(rng, rng.randint(3, 40), lang) + "." for _ in range(rng.randint(1, 8))]
        if i % 7 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "Released under the terms of a shared license.")
        if i % 11 == 0:
            lines.append("  released UNDER the terms of a shared license.\t")
        out.append((i, "\n".join(lines), lang, "s0" if i % 3 else f"s{i % 5}", None))
    for i in range(100, 130):  # copies and near copies of the first ones
        words = out[i % 6][1].split(" ")
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words), "en", "s1", None))
    for i in range(130, 150):
        out.append((i, " ".join(w + "$$$" for w in sentence(rng, 60, "en").split()), "en", "s2", None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
