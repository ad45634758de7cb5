"""Prompts to try the rules on: five kinds of task, three degrees of wordiness, three variants each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TRIMMED

TASK_TYPES = ("CODING", "DEBUG", "EXPLAIN", "WRITING", "COMPARE")
VERBOSITIES = ("LOW", "MEDIUM", "HIGH")
SOURCES = ("template", "ai")
_TASKS = {
    "CODING": ("write a function that merges two sorted lists", "write a query that counts orders by month", "implement a queue with two stacks"),
    "DEBUG": ("fix the error in my loop that never ends", "find the bug that makes my parser crash on empty lines", "see why my form is not working after a reload"),
    "EXPLAIN": ("explain what is meant by recursion", "describe how a hash table finds its keys", "explain how does a browser load a page"),
    "WRITING": ("draft a blog post about city gardens", "draft a short note that thanks a colleague", "draft a paragraph on the history of maps"),
    "COMPARE": ("compare arrays and linked lists", "say which is better, trains or planes, for short trips", "name the pros and cons of remote work"),
}
_FRAMES = {
    "LOW": "{T}.",
    "MEDIUM": "Hello! Could you please {t}? It is important to note that I need it in the near future. Thanks in advance!",
    "HIGH": "Good morning! I hope you don't mind, I was wondering if you could basically {t}. Please use bullet points. Each and every step matters due to the fact that I am new to this!! Answer as a list. Be concise. Please let me know if you need more. Kind regards!",
}


def _rows() -> list[tuple[str, str, int, str]]:
    return [
        (task, level, k, frame.format(t=text, T=text[0].upper() + text[1:]))
        for task, texts in _TASKS.items()
        for level, frame in _FRAMES.items()
        for k, text in enumerate(texts)
    ]


def templates(spark: SparkSession) -> DataFrame:
    """task_type, verbosity, variant, prompt: 45 rows."""
    return spark.createDataFrame(_rows(), "task_type string, verbosity string, variant int, prompt string")


def checked(task_type: str | None, verbosity: str | None, source: str | None = None) -> tuple[str, str, str]:
    """The parameters in their usual form; ValueError for unknown ones."""
    task, level, origin = (task_type or "").strip().upper(), (verbosity or "").strip().upper(), (source or "template").strip().lower()
    for value, known, what in ((task, TASK_TYPES, "task type"), (level, VERBOSITIES, "verbosity"), (origin, SOURCES, "source")):
        if value not in known:
            raise ValueError(f"{what} {value!r}: one of {', '.join(known)}")
    return task, level, origin


def pick(spark: SparkSession, task_type: str, verbosity: str, seed: int | None = None, source: str = "template", generate: Callable[[str, str], str] | None = None) -> DataFrame:
    """One prompt of the kind, at random (the same for the same seed): task_type, verbosity, prompt, source.

    With source "ai" the prompt is what generate(task_type, verbosity) returns; its failure becomes the text.
    """
    task, level, origin = checked(task_type, verbosity, source)
    if origin == "ai":
        if generate is None:
            raise ValueError("source 'ai' needs a generate function")
        try:
            prompt = generate(task, level)
        except Exception as e:  # the text is the report
            prompt = f"AI generation failed: {e}"
        return spark.createDataFrame([(task, level, prompt, origin)], "task_type string, verbosity string, prompt string, source string")
    some = templates(spark).where((F.col("task_type") == task) & (F.col("verbosity") == level))
    return some.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(1).select("task_type", "verbosity", "prompt", F.lit(origin).alias("source"))


def answers(df: DataFrame, id_col: str, task_col: str, verbosity_col: str, source_col: str) -> DataFrame:
    """Requests for prompts, a row each -> id, task_type, verbosity, source in their usual form, error, prompt.

    error says what the first unknown parameter is, and what is known; it is null where all are known. A null source is
    the template; other nulls are unknown. Which variant a row gets hangs on its id alone. Requests of source "ai" have
    no prompt here: their prompts are the caller's to fetch.
    """
    tidy = lambda c, change: change(F.btrim(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(TRIMMED)))
    source = F.when(F.col(f"`{source_col}`").isNull(), "template").otherwise(tidy(source_col, F.lower))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), tidy(task_col, F.upper).alias("task_type"), tidy(verbosity_col, F.upper).alias("verbosity"), source.alias("source"))
    wrong = [
        F.when(~F.col(c).isin(*known), F.concat(F.lit(f"{what} '"), F.col(c), F.lit(f"': one of {', '.join(known)}")))
        for c, known, what in (("task_type", TASK_TYPES, "task type"), ("verbosity", VERBOSITIES, "verbosity"), ("source", SOURCES, "source"))
    ]
    rows = rows.withColumn("error", F.coalesce(*wrong))
    wants = F.col("error").isNull() & (F.col("source") == "template")
    keyed = rows.withColumn("variant", F.when(wants, number_of(F.col("id"), 3).cast("int")))
    table = F.broadcast(templates(df.sparkSession))  # 45 rows, whatever the input
    return keyed.join(table, ["task_type", "verbosity", "variant"], "left").select("id", "task_type", "verbosity", "source", "error", "prompt")


def number_of(c: Column, n: int) -> Column:
    """A number under n from the md5 of a value's text: the same on every run and in every engine. Null counts as empty."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(n))


def assign(df: DataFrame, id_col: str) -> DataFrame:
    """df with a template for each row, chosen by the id's hash: the same on every run.

    Columns task_type, verbosity, variant and prompt of df give way.
    """
    number = "_n"
    while number.lower() in {c.lower() for c in df.columns}:
        number = f"_{number}"
    numbered = [(k, *r) for k, r in enumerate(_rows())]  # 45 rows, whatever the input
    table = df.sparkSession.createDataFrame(numbered, f"{number} long, task_type string, verbosity string, variant int, prompt string")
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("task_type", "verbosity", "variant", "prompt")]
    return df.select(*own, number_of(F.col(f"`{id_col}`"), len(numbered)).alias(number)).join(F.broadcast(table), number).drop(number)
