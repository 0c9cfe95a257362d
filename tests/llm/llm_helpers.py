import random

#: Columns whose names the operators use inside.
EXTRA = ["id", "hash", "fp", "row", "at", "chunks", "lines", "gone", "found", "cell", "rank", "n", "grp", "ids", "k", "words"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = "aeiou", "bcdfg", "xyzäöü"


def docs_frame(spark, texts, ids=None, langs=None, extra=False):
    """Documents with the given texts; with ``extra`` columns whose names clash with inner ones."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    langs = ["en"] * n if langs is None else langs
    rows = [(i, t, g, f"s{k % 3}", None if t is None else len(t)) for k, (i, t, g) in enumerate(zip(ids, texts, langs))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in EXTRA})
    return df


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


def odd_texts(rng):
    """Null, empty, blank, long without and with spaces, ties and repeats."""
    return [None, "", " ", "\n\n", "\t x", "a" * 5000, "é日 本 <|im_end|>", "1234 5678", "!?", prose(rng, 3000), "same", "same", None]


def seeded(n):
    return random.Random(n)
