import zlib

import corpus_pipeline
import numpy as np
from llm_helpers import docs_frame, odd_texts, prose, seeded
from test_decontam import brute as leak
from test_langid import brute as languages
from test_linededup import brute as lines_left, case
from test_records import library
from test_simhash import brute_components, brute_fingerprint


def brute(docs, items):
    """(doc_id, crc32 of its ids) of each document that all stages keep."""
    docs = [d for d, r in zip(docs, languages(docs)) if r[2] != "und"]
    left = lines_left([(i, t) for i, t, _ in docs])
    docs = [(i, left[i, t][0]) for i, t, _ in docs]
    fps = [brute_fingerprint(t) for _, t in docs]
    named = brute_components([i for i, _ in docs], fps)
    docs = [d for d, c in zip(docs, named) if d[0] == c]
    docs = [d for d in docs if not any(leak(d[1], t) for t in items)]
    lib = library()
    return sorted((i, zlib.crc32(np.array(lib.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes())) for i, t in docs)


def test_run_equals_brute_force(spark, tmp_path):
    rng = seeded(8)
    items = [prose(rng, n) for n in (20, 30, 40)]
    texts = case(5) + odd_texts(rng)
    base = prose(rng, 150)
    texts += [base, base + " end", "start " + base, prose(rng, 20) + " " + items[1] + " " + prose(rng, 20)]
    docs = [(i, t, "en" if i % 3 else "fr") for i, t in enumerate(texts)]
    docs_frame(spark, texts, langs=[d[2] for d in docs], extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(docs, items)
    assert sorted({r.doc_id for r in rows}) == [i for i, _ in want]
    # Short documents are one piece, so the checksum of the piece is that of the document.
    whole = {r.doc_id: r.ids_crc32 for r in rows if r.length == r.doc_tokens}
    assert len(whole) > 10 and all(dict(want)[i] == c for i, c in whole.items())


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near duplicates", "decontamination", "packing"]
    df = docs_frame(spark, ["a text of words", "another text"], extra=True)
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, df, "").columns == df.columns


def test_odd_tables(spark, tmp_path):
    """Null and repeated ids, no labels, and empty tables on either side."""
    texts = ["one text of some words", None, "", "another text, of other words", "another text, of other words", "12"]
    df = docs_frame(spark, texts, [None, 1, 2, 3, 3, 4], langs=[None] * 6, extra=True)
    items = spark.createDataFrame([(1, "a benchmark item that stands in no document of this small table")], "item_id long, text string")
    for name, docs, bench, want in (("all", df, items, {None, 3}), ("items", df, items.limit(0), {None, 3}), ("docs", df.limit(0), items, set())):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()} == want
