"""Fixtures: a small adversarial table of documents and the driver's smallest tables."""

from __future__ import annotations

import os
import random

SF = "/root/testdata/sf0.001"
HAVE_DATA = os.path.isdir(SF)


def prose(rng: random.Random, n: int, words: int = 300) -> str:
    return " ".join(rng.choice(VOCABULARY[:words]) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2 + i % 7)) for i in range(2000)]


def odd_documents() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, one large group of copies, near copies, shared passages."""
    rng = random.Random(5)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    rows = [(1, base), (2, base), (2, base), (3, None), (None, "a text without an id that has several words in it for once"), (None, None), (4, ""), (5, ""), (6, " \n\t "), (7, "one"), (7, "another text under the same id")]
    rows += [(10 + i, base) for i in range(40)]
    for i in range(30):  # near copies of one text
        words = base.split()
        words[rng.randrange(len(words))] = f"changed{i}"
        rows.append((100 + i, " ".join(words)))
    for i in range(30):  # one passage inside different texts
        rows.append((200 + i, f"{prose(rng, 50, 2000)} {passage} {prose(rng, 50, 2000)}"))
    line = "the same short line that ends in very many texts"
    rows += [(300 + i, f"{prose(rng, 40, 2000)} {line}") for i in range(40)]
    rows.append((400, prose(rng, 30_000, 2000)))
    rows.append((401, "x " * 3000))
    rows.append((402, "Ünïcode wörds ŞTRANGE   no-break spaces <s> [INST] \\ </s> <|endoftext|> é ﬁ"))
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)
