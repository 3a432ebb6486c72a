import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000)) + " " + "z" * 70_000 + " end"
SHARED = " ".join(f"shared{i}" for i in range(120))
#: Nulls, empties, white space, one word, long words, copies, near copies, a passage, a long text, other scripts, personal data.
TEXTS = [
    None, "", "  \t\n ", "one", "One two THREE four", "a b c d e", SHARED, SHARED, SHARED.upper(), "start " + SHARED + " end of it", SHARED.replace("shared60", "other"),
    "x y z " + SHARED + " tail", "same same same " * 60, "same same same " * 60 + "but not quite", LONG, "Ünïcödé тест 日本語 " * 30, "mail me@example.org or (at) joe (at) example (dot) com, 4111 1111 1111 1111, 10.0.0.255, +44 20 7946 0958",
    "12345 67890", "The quick brown fox jumps over the lazy dog. " * 12, "The quick brown fox jumps over the lazy dog. " * 12 + "More.", "ab" * 900, "no break here" + "q" * 2000, "é" * 500, "tab\tseparated\x0bwords\x0chere and more words to make it long enough for a window of some size",
]


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with gaps between ids and a null id; the last two rows are equal."""
    rows = [(3 * i, t) for i, t in enumerate(TEXTS)]
    return rows + [(None, SHARED), (1000, SHARED + " again"), (1000, SHARED + " again")]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names operators use themselves."""
    names = ["token_ids", "decoded", "bucket", "home", "node", "part", "tokens", "mix", "row", "k", "slot", "guest", "_bits"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, t, ["en", "de", None][n % 3], ["src0", "src1", None, "src0"][n % 4], len(t or ""), *["x"] * len(names)) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def folder(docs, tmp_path_factory):
    """The same as a table folder."""
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="session")
def nothing(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    docs.limit(0).write.parquet(f"{path}/documents.parquet")
    return str(path)
