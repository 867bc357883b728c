import random

import pytest

CLASHING = "'x' AS th, 'x' AS data, 1 AS fp, 'x' AS host, 2 AS n, 'x' AS component_id, 'x' AS lang_pred, 'x' AS token_ids, 'x' AS anchors, 'x' AS two"


def words(rng, n):
    return [rng.choice(["ab", "cd", "ef", "gh", "éa", "zz", "q"]) + str(rng.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): copies, shared passages, nulls, blanks, long texts, a row given twice."""
    rng = random.Random(3)
    passage, other, long = words(rng, 80), words(rng, 60), words(rng, 9000)
    plain = [words(rng, 120) for _ in range(12)]
    out = [(i, " ".join(w)) for i, w in enumerate(plain)]
    out += [(20 + i, " ".join(w[:40] + passage + w[40:])) for i, w in enumerate(plain[:5])]
    out += [(30 + i, "\n".join(w[:10] + other + w[10:])) for i, w in enumerate(plain[5:8])]
    near = plain[3][:]
    near[60] = "changed"
    out += [(40, " ".join(plain[3])), (41, " ".join(near)), (42, None), (43, ""), (44, " \t\n"), (45, "one"), (46, "one two"), (47, "... !!! 12 34"), (48, " ".join(long)), (49, " ".join(words(rng, 30) + long[200:900])), (50, "again " * 300), (51, "again " * 80)]
    out += [(52, "x" * 1200), (53, "x" * 450), (2, " ".join(plain[2])), (None, " ".join(plain[6][:70]))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a table with extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars", *CLASHING.split(", ")).repartition(3)
