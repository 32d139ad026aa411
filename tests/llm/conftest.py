"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""
import pytest

from llm_samples import prose


@pytest.fixture(scope="session")
def rows():
    base = prose(300, 1)
    words = base.split()
    near = " ".join(words[:140] + ["changed"] + words[141:])
    far = " ".join(w if k % 9 else "x" + w for k, w in enumerate(words))
    out = [(0, base, "en", "a"), (1, base, "en", "a"), (2, near, "en", "b"), (3, far, None, "a"), (4, None, "en", "a"),
           (5, "", "de", None), (6, " \n\t ", "de", "b"), (7, "two words", "en", "b"), (8, "TWO Words", "en", "b"),
           (9, prose(9000, 2), "en", "a"), (10, "line\n" * 50, "en", "a"), (11, "Straße é naïve 日本 🙂 " * 30, "de", "b"),
           (12, base.upper() + "!! ###", "en", "b"), (13, 'token = "0cab398dc11d1a2a11dc6572c8df8bd2" ' + base, "en", "a"),
           (14, "Mail ann.lee@site7.example.org or call +1 (456) 555-2186. Mrs. Anna Smith lives at 10.1.2.3", "en", "a")]
    out += [(20 + k, prose(60 + k, 50 + k), "en" if k % 2 else "fr", "ab"[k % 2]) for k in range(40)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    clash = "doc_id long, text string, lang string, source string, id string, node long, score double, words int, secrets string, bin long"
    return spark.createDataFrame([(*r, "x", 1, 0.5, 2, "s", 3) for r in rows], clash).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
