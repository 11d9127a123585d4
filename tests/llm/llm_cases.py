"""Documents with awkward rows, and plain Python answers."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; as columns of the input they must not matter.
CLASHES = ("doc", "tie", "raw", "h1", "h2", "fp", "digest", "key", "pos", "part", "words", "size", "number", "block", "start", "held", "url")


def prose(rng: random.Random, count: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(count)]


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars)"""
    rng = random.Random(7)
    passage, line = prose(rng, 60), "This Line is shared by very many documents"
    long_text = " ".join(prose(rng, 20_000, 3000))
    rows: list[tuple] = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b ", None, "a", 5),
        (4, "Éa ß İx naïve   zzzİ <|endoftext|> don't we'LL 123 日本語 \U0001f600", "fr", None, None),
        (None, "a text without an id but with words enough to count as one", "en", "b", 3),
        (None, None, None, None, None),
        (5, "same text here", "en", "b", 1),
        (5, "same text here", "en", "b", 1),
        (5, "other text under the same id", "en", "b", 1),
        (6, "same  text\there", "de", "c", 1),
        (7, "SAME TEXT HERE", "de", "c", 1),
        (8, "tie one", "es", "c", 1),
        (9, "tie one", "es", "c", 1),
        (10, long_text, "en", "a", 1),
        (11, long_text[:50_000] + " tail", "en", "a", 1),
        (12, "la " * 70, "en", "d", 1),
    ]
    for i in range(13, 40):
        body = prose(rng, 30) + passage[: rng.randrange(15, 60)] + prose(rng, 25)
        lines = [" ".join(body[k : k + 12]) for k in range(0, len(body), 12)]
        shared = ["", f"  {line}", line.upper(), line + "\t"][i % 4]
        rows.append((i, "\n".join([*lines[:3], shared, shared, *lines[3:]]), rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), 9))
    return rows


def frame(spark: SparkSession, rows: list[tuple], clashes: bool = True) -> DataFrame:
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumns({name: F.lit("clash") for name in CLASHES}) if clashes else docs


def words_of(text: str | None) -> list[str]:
    out, word = [], ""
    for char in text or "":
        if char in SPACE:
            out, word = out + [word] if word else out, ""
        else:
            word += char
    return out + [word] if word else out


def fast_words(text: str | None) -> list[str]:
    return [word.decode() for word in (text or "").encode().split()]


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
