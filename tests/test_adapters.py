"""Adapters of the less regular sources."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import adapters
from tests.test_images import png


def rows(spark, adapter, data, schema, **more):
    return [r.asDict() for r in adapters.ADAPTERS[adapter](spark.createDataFrame(data, schema), **more).collect()]


def test_exams(spark):
    one, two = rows(spark, "exams", [("a.png", None, "See <image 1> and <IMAGE 2>?", "['x', 'y, z']", "B"), ("a.png", "b.png", "How much?", "[]", "['4', 'four']")], "image_1 string, image_2 string, question string, options string, answer string")
    assert one["problem"] == "See <image> and <image>?\nOptions:\nA. x\nB. y, z\n" and one["answer"] == ["B"] and one["answer_type"] == "multiple-choice" and one["images"] == ["a.png"]
    assert two["problem"] == "How much?" and two["answer"] == ["4"] and two["answer_type"] == "math-expressions" and two["images"] == ["a.png", "b.png"]
    (three,) = rows(spark, "exams", [("q", ["x"], ["A", "B"])], "question string, options array<string>, answer array<string>")
    assert three["answer"] == ["A"] and three["images"] == []


def test_spatial(spark):
    text = "Question: <image> Is it so?Answer with the text of the option.\nAnswer Choices:\nA. yes\nB. no\n"
    data = [(["i"], f"{text}", "no"), (["i"], f"Question: {k} <image> Is it so?\nAnswer Choices:\nA. yes\nB. no", "no")] if (k := 1) else []
    data += [(["i"], f"Question: {k} <image> Is it so?\nAnswer Choices:\nA. yes\nB. no", "no") for k in range(2, 30)]
    got = rows(spark, "spatial", data, "image_paths array<string>, problem string, answer string")
    assert {(r["answer"][0], r["answer_type"]) for r in got} == {("B", "multiple-choice"), ("no", "boolean")}
    assert all(r["problem"].endswith("Is it so?\nChoices:\n(A) yes\n(B) no" if r["answer"] == ["B"] else "Is it so?") for r in got)
    with pytest.raises(Exception, match="no such choice"):
        rows(spark, "spatial", [(["i"], text, "perhaps")], "image_paths array<string>, problem string, answer string")


def test_others(spark):
    (r,) = rows(spark, "visual_search", [(["i"], "Which? (A) x (B) yAnswer with the option's letter from the given choices directly.", " b ")], "image_paths array<string>, problem string, answer string")
    assert r["problem"] == " <image>\nWhich? Choices:\n(A) x (B) y" and r["answer"] == ["B"] and r["prompt_type"] == "normal"
    got = rows(spark, "vectors", [("p", "q", "<svg/>", "ISVGEN"), (None, None, "a", "ISVGEN"), ("p", "q", "a", "other")], "image_path string, q_text string, a_text string, type string")
    assert [(x["images"], x["problem"], x["answer"]) for x in got] == [(["p"], "q", ["<svg/>"]), ([], "", ["a"])]
    (r,) = rows(spark, "infographics", [("i", "q?", "12..")], "image string, query string, answer string")
    assert r["answer"] == ["12"] and r["answer_type"] == "ocrtext"
    (r,) = rows(spark, "web_pages", [("i", "<html>")], "image string, text string")
    assert r["answer_type"] == "html-code" and r["answer"] == ["<html>"]
    (r,) = rows(spark, "located_choices", [("aGk=", "q", "A. x", "A")], "image string, question string, `multi-choice options` string, answer string")
    assert r["problem"] == "<image>\nq\nA. x" and r["problem_type"] == "grounding"


def test_masks(spark):
    import numpy as np

    x = np.zeros((2, 4, 1), int)
    x[1, 1] = 255
    table = spark.createDataFrame([("i", "point at", "it", bytearray(png(x, 8, 0))), ("j", "p", "s", bytearray(b"no image"))], "image string, prompt string, suffix string, mask binary")
    one, two = adapters.adapt_masks(table).orderBy(F.col("images")[0]).collect()
    assert one["answer"] == ["[[0.25, 0.5, 0.5, 1.0]]"] and one["problem"] == "<image>\npoint at it" and two["answer"] == [None]
