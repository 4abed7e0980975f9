import random

import pytest

#: Columns that clash with what the operators might use within.
CLASH = ["tie", "doc", "n", "h", "key", "value", "block", "q_kept", "s_removed", "b_n", "row", "keep", "score"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def make_texts(seed=7):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdéßñ") for _ in range(r.randint(1, 6))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, long_one = say(60), say(9000)
    texts = [None, "", " \n\t ", "one", "one two", "One  two", say(19), say(20), say(21)]
    base = [say(r.randint(60, 250)) for _ in range(25)]
    texts += base
    texts += [base[0]] * 4 + [base[1] + " extra"]  # exact and near copies
    for i in range(8):
        words = base[2].split()
        words[r.randrange(len(words))] = "edit%d" % i
        texts.append(" ".join(words))
    texts += [say(30) + " " + passage + " " + say(30) for _ in range(6)] + [passage + " " + passage, passage.upper()]
    texts += [long_one, long_one[:20000] + " " + say(500), "same line\n" * 80, "a " * 500, "x" * 5000, "ab" * 3000 + " tail", "# | & < > * " * 30]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def rows(texts):
    """(doc_id, text): ids out of order."""
    ids = list(range(0, 3 * len(texts), 3))
    random.Random(3).shuffle(ids)
    return sorted(zip(ids, texts))


def frame(spark, pairs, parts=4):
    data = [(i, t, ["en", "de", None][k % 3], "src%d" % (k % 2), len(t or ""), *["c"] * len(CLASH)) for k, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [(1, "x")]).where("doc_id < 0")
