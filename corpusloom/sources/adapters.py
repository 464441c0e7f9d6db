"""Adapters of published data sets' rows to the training row (SRC-19, FLT-21, UDF-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = ("id", "images", "problem", "answer", "problem_type", "answer_type", "source", "prompt_type")
"""Fixed values: columns of a reinforcement-learning row; answer is an array."""


def adapted(rows: DataFrame, source: str, **columns) -> DataFrame:
    """SRC-19: a source's rows as training rows; what isn't said is null, an empty list of images, prompt type long, problem type general and answer type any."""
    defaults = {
        "id": F.lit(None).cast("string"), "images": F.array().cast("array<string>"), "problem": F.lit("").cast("string"), "answer": F.array().cast("array<string>"), "problem_type": F.lit("general"),
        "answer_type": F.lit("any"), "source": F.lit(source), "prompt_type": F.lit("long"),
    }
    return rows.select(*[columns.get(c, defaults[c]).alias(c) for c in ROW])


def marked(problem: Column, images: Column) -> Column:
    """A problem with as many image marks as images: those beyond are cut off with what follows, missing ones come before it."""
    marks, n = F.size(F.split(problem, "<image>", -1)) - 1, F.size(images)
    cut = F.array_join(F.slice(F.split(problem, "<image>", -1), F.lit(1), n + 1), "<image>")
    return F.when(marks > n, cut).when(marks < n, F.concat(F.repeat(F.lit(" <image>"), n - marks), F.lit("\n"), problem)).otherwise(problem)


def lettered(options: Column) -> Column:
    """Options as lines A. to Z., after a line that says so; nothing without options."""
    lines = F.transform(options, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), o, F.lit("\n")))
    return F.when(F.size(options) > 0, F.concat(F.lit("\nOptions:\n"), F.array_join(lines, ""))).otherwise(F.lit(""))


def adapt_reasoning(rows: DataFrame, source: str = "reasoning") -> DataFrame:
    """Of (image array, question, answer, category): as many marks as images, boxed answers opened, a single letter is a choice."""
    problem = marked(F.col("question"), F.col("image"))
    answer = F.when(F.col("answer").startswith("\\boxed{"), F.expr("substr(answer, 8, length(answer) - 8)")).otherwise(F.col("answer"))
    choice = F.upper(F.trim(answer)).rlike("^[A-J]$")
    kind = F.when(F.col("category") == "Spatial Reasoning", "spatial-reasoning").when(F.col("category") == "Tables/Diagrams/Charts", "ocr").otherwise("stem")
    return adapted(rows, source, images=F.col("image"), problem=problem, answer=F.array(F.when(choice, F.upper(F.trim(answer))).otherwise(answer)), problem_type=kind, answer_type=F.when(choice, "multiple-choice").otherwise("math-expressions"))


def adapt_grounding(rows: DataFrame, source: str = "grounding") -> DataFrame:
    """Of (file_name, caption, bbox x y width height, width, height): the box in shares of the image, as text."""
    from corpusloom.functions.similarity import corners

    box = corners(*[F.col("bbox")[i] for i in range(4)], F.col("width"), F.col("height"))
    problem = F.concat(F.lit("<image>\nWhere in the image is this: "), F.lower("caption"), F.lit("\nAnswer as [x_min, y_min, x_max, y_max], each from 0 to 1."))
    return adapted(rows, source, images=F.array("file_name"), problem=problem, answer=F.array(F.concat(F.lit("["), F.array_join(F.transform(box, lambda v: v.cast("string")), ", "), F.lit("]"))), problem_type=F.lit("grounding"), answer_type=F.lit("bbox"), prompt_type=F.lit("normal"))


def adapt_choices(rows: DataFrame, source: str = "choices") -> DataFrame:
    """Of (image, question, answer)."""
    return adapted(rows, source, images=F.array("image"), problem=F.concat(F.lit("<image>\n"), "question"), answer=F.array("answer"), answer_type=F.lit("multiple-choice"))


def adapt_counting(rows: DataFrame, source: str = "counting") -> DataFrame:
    """Of (image, label, count)."""
    return adapted(rows, source, images=F.array("image"), problem=F.concat(F.lit("<image>\nHow many "), "label", F.lit(" are there?")), answer=F.array(F.col("count").cast("string")), problem_type=F.lit("counting"), answer_type=F.lit("number"))


def adapt_programs(rows: DataFrame, source: str = "programs") -> DataFrame:
    """FLT-21 and SRC-19: of (description, input_format, output_format, official_tests, generated_checker): problems without a checker of their own; the answer holds the tests."""
    own = rows.where("generated_checker IS NULL")
    problem = F.concat_ws("\n", "description", F.concat(F.lit("Input: "), "input_format"), F.concat(F.lit("Output: "), "output_format"), F.lit("Answer with one function solution(input) that returns the output."))
    return adapted(own, source, problem=problem, answer=F.array(F.to_json(F.struct(F.col("official_tests").alias("tests")))), problem_type=F.lit("coding"), answer_type=F.lit("general-code"))


def adapt_diagrams(rows: DataFrame, source: str = "diagrams") -> DataFrame:
    """Of (images array, texts array of (user, assistant)): the first exchange; a single capital letter is a choice."""
    said = F.col("texts")[0]
    question, answer = F.trim(F.replace(said["user"], F.lit("Answer with the letter."), F.lit(""))), F.trim(F.replace(said["assistant"], F.lit("Answer: "), F.lit("")))
    kind = F.when(answer.rlike("^[A-Z]$"), "multiple-choice").otherwise("any")
    return adapted(rows, source, images=F.col("images"), problem=F.concat(F.lit("<image>\n"), question), answer=F.array(answer), problem_type=F.lit("stem"), answer_type=kind, prompt_type=F.lit("normal"))


def adapt_documents(rows: DataFrame, source: str = "documents") -> DataFrame:
    """Of (image, question, answers array): text to be read off."""
    return adapted(rows, source, images=F.array("image"), problem=F.concat(F.lit("<image>\n"), "question"), answer=F.col("answers"), problem_type=F.lit("ocr"), answer_type=F.lit("ocrtext"))


def adapt_infographics(rows: DataFrame, source: str = "infographics") -> DataFrame:
    """Of (image, question, answers array), or of (image, query, answer) as the training part has it, whose answers lose full stops at their end."""
    trained = "query" in rows.columns
    answer = F.array(F.regexp_replace("answer", r"\.+$", "")) if trained else F.col("answers")
    problem = F.concat(F.lit("<image>\n"), F.col("query" if trained else "question"))
    return adapted(rows, source, images=F.array("image"), problem=problem, answer=answer, problem_type=F.lit("ocr"), answer_type=F.lit("ocrtext"), prompt_type=F.lit("normal"))


def adapt_problems(rows: DataFrame, source: str = "problems") -> DataFrame:
    """Of (decoded_image, question, options array, answer): choices where there are options, else expressions."""
    kind = F.when(F.size("options") > 0, "multiple-choice").otherwise("math-expressions")
    return adapted(rows, source, images=F.array("decoded_image"), problem=F.concat(F.lit("<image>\n"), "question", lettered(F.col("options"))), answer=F.array("answer"), problem_type=F.lit("stem"), answer_type=kind)


def adapt_exams(rows: DataFrame, source: str = "exams") -> DataFrame:
    """Of (image_1 .. image_7, question, options and answer as text or as array): numbered image marks become plain ones; of several answers the first counts; options of text are a written list."""
    from corpusloom.functions.similarity import literal_items

    images = F.filter(F.array(*[F.col(f"image_{i}") if f"image_{i}" in rows.columns else F.lit(None).cast("string") for i in range(1, 8)]), lambda x: x.isNotNull())
    kinds = dict(rows.dtypes)
    options = F.col("options") if kinds["options"].startswith("array") else F.coalesce(literal_items(F.col("options")), F.array().cast("array<string>"))
    first = F.regexp_replace(F.trim(F.split(F.expr("substr(answer, 2, length(answer) - 2)"), ",")[0]), "^'(.*)'$", "$1")
    answer = F.col("answer")[0] if kinds["answer"].startswith("array") else F.when(F.col("answer").rlike(r"^\[.*\]$"), first).otherwise(F.col("answer"))
    problem = F.regexp_replace(F.concat("question", lettered(options)), r"(?i)<image\s*\d+>", "<image>")
    return adapted(rows, source, images=images, problem=problem, answer=F.array(answer), problem_type=F.lit("stem"), answer_type=F.when(F.size(options) > 0, "multiple-choice").otherwise("math-expressions"))


def adapt_located_choices(rows: DataFrame, source: str = "located_choices") -> DataFrame:
    """Of (image as base64, question, `multi-choice options`, answer); images stay base64."""
    problem = F.concat(F.lit("<image>\n"), "question", F.lit("\n"), F.col("`multi-choice options`"))
    return adapted(rows, source, images=F.array("image"), problem=problem, answer=F.array("answer"), problem_type=F.lit("grounding"), answer_type=F.lit("multiple-choice"))


def adapt_visual_search(rows: DataFrame, source: str = "visual_search") -> DataFrame:
    """Of (image_paths array, problem, answer)."""
    told = F.replace(F.replace("problem", F.lit("Answer with the option's letter from the given choices directly."), F.lit("")), F.lit("(A)"), F.lit("Choices:\n(A)"))
    return adapted(rows, source, images=F.col("image_paths"), problem=marked(told, F.col("image_paths")), answer=F.array(F.upper(F.trim("answer"))), problem_type=F.lit("grounding"), answer_type=F.lit("multiple-choice"), prompt_type=F.lit("normal"))


def adapt_spatial(rows: DataFrame, source: str = "spatial", seed: int = 42) -> DataFrame:
    """Of (image_paths array, problem with `Answer Choices:` and lines such as `A. text`, answer as a choice's text): half of the problems, by a hash, ask for the letter, the others for the text. Without one such part, or with another answer, the row raises when it is read."""
    told = F.replace(F.replace("problem", F.lit("Question: "), F.lit("")), F.lit("Answer with the text of the option."), F.lit(""))
    parts = F.split(marked(told, F.col("image_paths")), "Answer Choices:", -1)
    choices = F.transform(F.split(F.regexp_replace(parts[1], r"^\s+|\s+$", ""), "\n"), lambda x: F.substring(F.regexp_replace(x, r"^\s+|\s+$", ""), 4, 1 << 30))
    at = F.array_position(choices, F.col("answer"))
    letter = F.when((F.size(parts) == 2) & (at > 0), F.char(at + 64)).otherwise(F.raise_error(F.concat(F.lit("no such choice: "), "problem")).cast("string"))
    question = F.regexp_replace(parts[0], r"^\s+|\s+$", "")
    lines = F.array_join(F.transform(choices, lambda x, i: F.concat(F.lit("("), F.char(F.lit(65) + i), F.lit(") "), x)), "\n")
    listed = F.pmod(F.xxhash64(F.lit(seed), "problem"), F.lit(2)) == 0
    kind = F.when(F.col("answer").rlike("^[A-J]$"), "multiple-choice").when(F.lower("answer").isin("true", "false", "yes", "no"), "boolean").when(F.col("answer").rlike("^[0-9]+$"), "number").otherwise("any")
    return adapted(
        rows, source, images=F.col("image_paths"), problem=F.when(listed, F.concat(question, F.lit("\nChoices:\n"), lines)).otherwise(question),
        answer=F.array(F.when(listed, letter).when(letter.isNotNull(), F.col("answer"))), problem_type=F.lit("spatial-reasoning"), answer_type=F.when(listed, "multiple-choice").otherwise(kind),
    )


def adapt_vectors(rows: DataFrame, source: str = "vectors") -> DataFrame:
    """Of (image_path, q_text, a_text, type): those of type ISVGEN; no image where there is no path."""
    own = rows.where("type = 'ISVGEN'")
    images = F.when(F.coalesce("image_path", F.lit("")) != "", F.array("image_path")).otherwise(F.array().cast("array<string>"))
    return adapted(own, source, images=images, problem=F.coalesce("q_text", F.lit("")), answer=F.array(F.coalesce("a_text", F.lit(""))), problem_type=F.lit("coding"), answer_type=F.lit("svg-code"), prompt_type=F.lit("default"))


def adapt_web_pages(rows: DataFrame, source: str = "web_pages") -> DataFrame:
    """Of (image, text): the page's code from its picture."""
    return adapted(rows, source, images=F.array("image"), problem=F.lit("<image>\nPlease Generate the HTML code for this webpage design."), answer=F.array("text"), problem_type=F.lit("coding"), answer_type=F.lit("html-code"))


def adapt_masks(rows: DataFrame, source: str = "masks") -> DataFrame:
    """Of (image, prompt, suffix, mask as an image file): the box around the mask, in shares of the image, as a list of one; a mask that can't be decoded gives none."""
    from corpusloom.functions.images import mask_box

    told = F.concat(F.lit("[["), F.array_join(F.transform(mask_box(F.col("mask")), lambda v: v.cast("string")), ", "), F.lit("]]"))
    problem = F.concat(F.lit("<image>\n"), "prompt", F.lit(" "), "suffix")
    return adapted(rows, source, images=F.array("image"), problem=problem, answer=F.array(told), problem_type=F.lit("embodied"), answer_type=F.lit("bbox"))


ADAPTERS = {
    "reasoning": adapt_reasoning, "grounding": adapt_grounding, "choices": adapt_choices, "counting": adapt_counting, "programs": adapt_programs, "diagrams": adapt_diagrams, "documents": adapt_documents,
    "infographics": adapt_infographics, "problems": adapt_problems, "exams": adapt_exams, "located_choices": adapt_located_choices, "visual_search": adapt_visual_search, "spatial": adapt_spatial,
    "vectors": adapt_vectors, "web_pages": adapt_web_pages, "masks": adapt_masks,
}
"""UDF-07: adapters by source; a source names its own with ADAPTERS[name] = function."""


def adapt_all(sources: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """The union of sources, each as (adapter, rows)."""
    out = None
    for name, (adapter, rows) in sources.items():
        part = ADAPTERS[adapter](rows, name)
        out = part if out is None else out.unionByName(part)
    return out
