import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, t int, h int, ck int, k int, size int, key int, n int, kept int, score double, bucket int, rid int, keys int"


def corpus(seed: int = 5) -> list[tuple[int | None, str | None]]:
    """Documents with copies, near copies, shared passages, repeats, odd spaces, secrets, nulls, empty and long texts, repeated rows and ids."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(400)] + ["é", "Über", "日本", "naïve", "\x00"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, line, base = prose(60), prose(14), prose(300)
    out: list[tuple[int | None, str | None]] = []
    for i in range(80):
        words = prose(rng.choice([0, 1, 3, 5, 12, 13, 14, 60, 200]))
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = passage[rng.randint(0, 20) : rng.randint(30, 60)]
        if i % 4 == 0:
            words += line
        if i % 10 == 1:
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = "edited"
        if i % 9 == 0:
            words += ["password=", "hunter2hunter", "AKIA" + "Q" * 16, "0123456789abcdef" * 2, 'API_KEY:"x-y_z=1"', "secret:token:abcdefg", "token=a"]
        out.append((i * 7 % 83, rng.choice([" ", "\n", " \t", "  "]).join(words)))
    out += [(200, out[3][1]), (201, out[3][1]), (202, out[3][1]), (203, None), (204, None), (205, ""), (206, " \n"), (None, out[5][1]), (None, "null id " + out[6][1]), (None, None)]
    out += [(300, "same row " * 40), (300, "same row " * 40), (301, " ".join(passage)), (301, " ".join(passage[1:]))]
    out += [(400, "Que " * 900), (401, "x" * 3000), (402, " ".join(prose(6000))), (403, "12345 !!! 678"), (404, "ſecret=abcdefgh")]
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


def table(spark, rows):
    langs, sources = ["en", "fr", None, "de"], ["b", "a", None, "c", "hot", "hot", "hot"]
    return spark.createDataFrame([(i, t, langs[k % 4], sources[k % 7], 0, "x", *[1] * 8, 0.5, 1, 1, 1) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
