"""The pipeline as a whole and its stages on rows without ids, repeated ones and empty tables; foreign media; ids that are no token's."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, jpeg, language
from corpusloom.llm.queries import piece_vocabulary, word_vocabulary
from corpusloom.operators import storage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    en, fr = ["the", "house", "of", "green", "water", "and", "stone", "walks", "over", "bridge"], ["la", "maison", "de", "l'eau", "verte", "et", "pierre", "marche", "sur", "pont"]
    out = [(i, prose(rng, en if i % 2 else fr, 90) + f" n{i}", "en" if i % 2 else "fr", "s", 1) for i in range(40)]
    same = out[3][1]
    out += [(50, same, "en", "s", 1), (51, same + " end", "en", "s", 1), (3, same, "en", "s", 1), (4, prose(rng, fr, 80), "fr", "s", 1)]
    out += [(None, prose(rng, en, 70), None, None, None), (None, None, None, None, None), (60, None, "en", "s", 0), (61, "", None, "s", 0), (62, "12 34 !!", None, "s", 8)]
    return out


def test_run_and_stages(spark, rows, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    with storage.scope():
        out = p.run(spark, str(tmp_path)).collect()
        ids = {r["doc_id"] for r in out}
        assert ids >= {0, 1, 2, 3, 4, None} and not ids & {50, 51, 60, 61, 62}
        assert all(r["start"] + r["length"] > 0 and r["offset"] + r["length"] <= p.CAPACITY for r in out)
        assert len([r for r in out if r["doc_id"] == 4]) == 2  # two texts of one id
    assert not storage._TABLES


def test_stages_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    none = spark.createDataFrame([], SCHEMA)
    for name, stage in p.STAGES:
        got = stage(spark, none, "")
        assert got.count() == 0, name
        if name != p.STAGES[-1][0]:
            assert got.columns == list(p.COLUMNS)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_rows_without_ids(spark, rows):
    import corpus_pipeline as p

    docs = spark.createDataFrame([r for r in rows if r[0] is None and r[1]] + rows[:6], SCHEMA)
    for _, stage in p.STAGES[1:4]:
        docs = stage(spark, docs, "").cache()
        assert docs.where("doc_id IS NULL").count() == 1 and docs.count() == 7


def test_foreign_comments(spark):
    whole = jpeg.write_payload(jpeg.padded(b"x" * 2000), jpeg.NOTE + b"2000")
    other = [jpeg.write_payload(jpeg.padded(b"x" * 2000), jpeg.NOTE + x) for x in (b"", b"abc", b"-5", b"999999999")]
    table = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([whole, *other])], "doc_id long, media binary")
    got = {r["doc_id"]: r["n_bytes"] for r in jpeg.digest(table).collect()}
    assert got == {0: 2000, 1: None, 2: None, 3: None, 4: None}


def test_ids_that_are_no_tokens(spark):
    from tokenizers import Tokenizer

    ids = [[5, 600, 49407, 60_000_000, 7], [], [60_000_000]]
    lib = Tokenizer.from_file(word_vocabulary())
    table = spark.createDataFrame([*enumerate(ids), (9, None), (10, [-1, 5, None])], "doc_id long, token_ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(table, word_vocabulary()).collect()}
    assert [got[i] for i in range(3)] == [lib.decode(x, skip_special_tokens=False) for x in ids] and got[9] == "" and got[10] == lib.decode([5])


def test_long_runs_of_letters_are_learnt(spark):
    docs = spark.createDataFrame([(i, "ab" * 700 if i % 2 else "zq " * 50, "x" if i % 2 else "y") for i in range(1, 30)], "doc_id long, text string, lang string")
    words = {(r["lang"], len(r["word"])) for r in language.training_words(docs).collect()}
    assert words == {("x", 1400), ("y", 2)}
    model = language.train(docs, piece_vocabulary())
    got = {r["lang_pred"] for r in language.predict(docs.where("lang = 'x'"), model).collect()}
    assert got == {"x"} and np.isfinite(model.table).all()


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some words here", f"l{i % 9}") for i in range(200)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.train(docs, piece_vocabulary())
