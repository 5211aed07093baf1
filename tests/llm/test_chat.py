import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat
from millrace.llm.queries import tokenizer_path

from .cases import HAVE_DATA, SF, prose

TOKENIZER = tokenizer_path("byte_bpe_50k.tiktoken")
TURNS = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(3)
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, "system", "be \\ brief"), (2, 1, None, "no role"), (2, 2, "[ROLE]x", "\\</s>\\\\<s>")]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "tie"), (3, None, "user", "no turn"), (4, 0, "assistant", "é 😀 \u0000 ﬁ\r\n"), (4, 1, "assistant", prose(rng, 20_000))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 10**12, "user", "far"), (5, -4, "assistant", "before")]
    rows += [(6, i, "user" if i % 2 else "assistant", f"{i} <|endoftext|>") for i in range(3000)]
    return rows


def want(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in groups.items():
        turns.sort()
        learnt = "".join(t for _, _, r, t in turns if r == "assistant")
        everything = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(everything.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [1024, 7])
def test_round_trip(spark, block):
    rows = conversations()
    table = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as ids", "2 as block", "3 as n_tokens", "4 as base")
    turns = chat.format_turns(table, TOKENIZER, turns_per_block=block)
    assert got(chat.digests(turns, TOKENIZER)) == want(rows)


def test_written_form_and_masks(spark):
    rows = conversations()
    turns = chat.format_turns(spark.createDataFrame(rows, TURNS), TOKENIZER).collect()
    chars = defaultdict(int)
    for r in turns:
        ids, mask = np.array(r["ids"]), np.array(r["mask"])
        form = chat.written(ids, TOKENIZER)
        assert len(form) == r["formatted_chars"] and len(ids) == len(mask) == r["n_tokens"]
        inner = form.removeprefix("<s>").removesuffix("</s>")
        for mark in ("[INST]", "[/INST]") if r["role"] == "user" else ("[ROLE]", "[/ROLE]") if r["role"] != "assistant" else ():
            assert inner.count(mark) == 1
            inner = inner.replace(mark, "")
        assert not any(m in inner for m in chat.MARKS)
        assert mask.sum() == (len(ids) - 2 if r["role"] == "assistant" else 0)
        chars[r["conv_id"]] += len(form)
    read = {r["conv_id"]: r["formatted_chars"] for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, TURNS), TOKENIZER), TOKENIZER).collect()}
    assert read == chars
    assert len(chat.written(np.array(next(r["ids"] for r in turns if r["conv_id"] == -7 and r["turn"] == 1)), TOKENIZER)) > len("<s></s>[INST] ok [/INST]</s>")


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "[ROLE]", "\\", ""]), st.lists(st.sampled_from([*chat.MARKS, "\\", "<", "s>", "/s>", "[", "INST]", " ", "é", "x"]), max_size=12))
def test_any_mixture_of_marks(role, parts):
    text = "".join(parts)
    ids, mask, _ = chat.encode_turn(role, text, TOKENIZER)
    assert chat.decode_turn(ids, mask, TOKENIZER) == (role, text, text if role == "assistant" else "")
    assert chat.unescape(chat.escape(text)) == text and not any(m in chat.escape(text) for m in chat.MARKS)


def test_empty(spark):
    assert chat.digests(chat.format_turns(spark.createDataFrame([], TURNS), TOKENIZER), TOKENIZER).count() == 0


@pytest.mark.skipif(not HAVE_DATA, reason="no test data")
def test_test_data(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert got(chat.digests(chat.format_turns(table, TOKENIZER), TOKENIZER)) == want([tuple(r) for r in table.collect()])
