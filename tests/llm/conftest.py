import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_links long, _shard int, row int"


def sentence(seed: int, n: int) -> str:
    state, out = seed * 7919 + 13, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def doc_rows():
    """Nulls in each column, empty and very long texts, copies, near copies, repeated rows, clashing extra columns."""
    texts = [sentence(i, 5 + 17 * i % 90) for i in range(60)]
    texts += [texts[3]] * 5 + [texts[4].replace(" ", " \t\n"), texts[5] + " extra", texts[6].upper()]
    texts += [None, "", " ", "\n\n", "12 34 !!", "one", "two words", "<|endoftext|> x", "a b  c", "été \U0001f600 中文"]
    texts += [sentence(99, 60_000), "x" * 50_000, "line one of many words\nline two of many words\nline three\n" * 3]
    texts += ["line one of many words\nline two of many words\nunique tail", sentence(7, 80) + "\nend", "start\n" + sentence(7, 80)]
    rows = [(i, t, "en", f"s{i % 4}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None), (None, None, None, None, None), (7, texts[7], "en", None, 3), (7, texts[7], "en", None, 3)]
    rows += [(8, "another text of the same id", "de", "s1", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame([(*r, "clash", 5, 6, 7) for r in doc_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def write_tables(spark, tmp_path_factory):
    def write(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return write


