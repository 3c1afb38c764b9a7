"""The pipeline's stages one by one, each against a plain statement of what it must do."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from loomquill.llm import neardup, pieces, secrets
from loomquill.llm.queries import tokenizer_path

GOOD = ["the", "house", "stands", "by", "a", "river", "and", "old", "trees", "grow", "near", "its", "walls."]


def prose(seed, n):
    out, x = [], seed + 1
    for _ in range(n):
        x = (x * 48271) % 2147483647
        out.append(GOOD[x % len(GOOD)])
    return " ".join(out)


@pytest.fixture()
def store(spark, tmp_path):
    docs = [(i, prose(i, 80)) for i in range(60)] + [(i, "%%% ".join(["zz", "qq"] * 40)) for i in range(60, 120)]
    docs += [(200, prose(1, 80)), (201, prose(2, 78) + " walls. grow"), (202, prose(500, 40) + " " + prose(900, 12) + " " + prose(501, 30)), (203, prose(600, 60) + " password=abcdef99 end"), (204, None), (205, ""), (203, prose(600, 60) + " password=abcdef99 end")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(900, 12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_and_run(spark, store, tmp_path):
    docs = spark.read.parquet(f"{store}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, store)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = before, docs
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    before, after = seen["quality classifier"]
    assert not set(ids(after)) & set(range(60, 120)) and set(range(60)) <= set(ids(after))
    before, after = seen["MinHash near-dedup"]
    classes = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(before).collect()}
    assert ids(after) == sorted({c for _, c in classes}, key=str)
    assert 200 not in ids(after) and ids(after).count(203) == 1
    before, after = seen["benchmark decontamination"]
    assert set(ids(before)) - set(ids(after)) == {202}
    before, after = seen["secret scans"]
    assert ids(before) == ids(after)
    texts = {r.doc_id: r.text for r in after.collect()}
    assert texts[203].endswith(" [SECRET] end") and not re.search("abcdef99", texts[203])
    assert after.join(before.select("doc_id", F.col("text").alias("t")), "doc_id").filter("text <> t").count() == 1
    assert secrets.scan_secrets(after).filter("size(base) > 0").count() == 0
    before, after = seen["SentencePiece encoding and decoding"]
    assert ids(before) == ids(after) and all(r.round_trip for r in after.collect())
    again = corpus_pipeline.run(spark, store)
    assert sorted(map(str, again.collect())) == sorted(map(str, after.collect()))
    want = {r.doc_id: r.ids_sha256 for r in pieces.encode(before, tokenizer_path("piece_bpe_32k.model")).collect()}
    assert {r.doc_id: r.ids_sha256 for r in after.collect()} == want


def test_last_stage_gives_the_texts_back(spark):
    docs = spark.createDataFrame([(1, "Hello  world\n"), (2, ""), (3, "ñandú 𝔸")], "doc_id long, text string")
    out = corpus_pipeline.pieces_stage(spark, docs, "")
    back = pieces.decode(out, tokenizer_path("piece_bpe_32k.model"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in docs.collect()}


def test_columns_of_any_name_odd_rows_and_empty_tables(spark, store, tmp_path):
    """Names that the operators use themselves, dotted ones, null ids, one long text; then no rows at all."""
    long_text = " ".join(prose(7000 + k, 1000) for k in range(160))
    assert len(long_text) > 700_000
    docs = spark.read.parquet(f"{store}/documents.parquet").unionByName(
        spark.createDataFrame([(None, prose(4000, 80), "en", "s", 1), (None, None, None, None, None), (300, long_text, "en", "s", 2), (300, long_text, "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    odd = ["score", "predicted", "base", "spans", "row", "key", "text_key", "hash", "text_hash", "id", "a.b", "is_first", "window", "words"]
    docs = docs.withColumns({name: F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for name in odd if "." not in name})
    docs = docs.select("*", F.lit(1.5).alias("a.b"))
    columns = docs.columns
    for frame in (docs, docs.limit(0)):
        now = frame
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, store)
            if k + 1 == len(corpus_pipeline.STAGES):
                assert out.filter("not round_trip").count() == 0 and out.count() == now.count()
                break
            assert out.columns == columns and out.dtypes == docs.dtypes
            path = str(tmp_path / f"odd-{k}-{len(list(tmp_path.iterdir()))}")
            out.write.parquet(path)
            now = spark.read.parquet(path)
            for r in now.collect():
                assert all(r[name] == f"{name} of {'none' if r.doc_id is None else r.doc_id}" for name in odd if "." not in name) and r["a.b"] == 1.5
    assert now.count() == 0
