import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fixtures import ITEM, prose  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    """Documents with near copies, repeated lines, a test item and the odd cases."""
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(20)]
    texts = list(base)
    for t in base[:8]:
        words = t.split()
        words[10] = "changed"
        texts += [t, " ".join(words), t.upper()]
    shared = prose(rng, 30)
    texts += [prose(rng, 20) + "\n" + shared + "\n" + prose(rng, 20) for _ in range(3)]
    texts += [prose(rng, 20) + "\n" + shared.replace(shared.split()[3], "other", 1) + "x"]
    texts += [prose(rng, 100) + " " + ITEM + " " + prose(rng, 100), prose(rng, 30_000),
              "mail 12.ab@mail7.example.com or +1 (301) 555-0346, 10.2.3.4; 4111 1111 1111 1111", "12 34", "", " \n\t ", None, "one", "One"]
    out = [(k + 1, t, ["en", "fr", None][k % 3], ["a", "b", None, "z"][k % 4], 7, 0.5) for k, t in enumerate(texts)]
    out += [out[0], out[0], (None, base[1], "en", "a", 7, 0.5), (None, None, None, None, None, None)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, score int, h double"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, "a question that occurs in no document at all, is it so? yes it is so in fact"),
                                  (3, None), (4, ""), (4, "few")], "item_id long, text string")
