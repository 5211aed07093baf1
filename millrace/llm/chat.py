"""Chat formatting on the token level.

Each part of a turn is encoded on its own; marks of the template are reserved ids beyond the tokenizer's vocabulary that
are spliced in between, so no text can produce one. In the written form marks are strings; where such a string occurs in
a text it is escaped with a backslash (as are backslashes), and reading undoes that. Loss masks are prefix sums of +1 at
the start and -1 at the end of what is learnt.

Template of a turn, with text and role escaped:
user ``<s>[INST]text[/INST]</s>``, assistant ``<s>text</s>``, any other role ``<s>[ROLE]role[/ROLE]text</s>``.
Only the assistant's text is learnt.

Nulls: a null text or role is empty; a null conv_id is a conversation of its own; null turns come first. Rows that tie
on turn are ordered by role, then text; repeated rows are repeated turns. Empty table: empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

#: Marks of the template; each has the reserved id of its place after the vocabulary.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
BOS, EOS, USER, USER_END, ROLE, ROLE_END = range(len(MARKS))
_CONTROL = re.compile("|".join(re.escape(m) for m in MARKS))

TURN_SCHEMA = "conv_id long, turn long, role string, text string, ids array<int>, mask array<byte>, n_tokens long, formatted_chars long"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def escape(text: str) -> str:
    """Double backslashes, then break every control string after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@functools.lru_cache(4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 2


def parts_of(role: str, text: str) -> list[tuple[int | str, bool]]:
    """The turn as marks (int) and escaped texts (str), with whether each is learnt."""
    body = escape(text)
    if role == "user":
        return [(BOS, False), (USER, False), (body, False), (USER_END, False), (EOS, False)]
    if role == "assistant":
        return [(BOS, False), (body, True), (EOS, False)]
    return [(BOS, False), (ROLE, False), (escape(role), False), (ROLE_END, False), (body, False), (EOS, False)]


def encode_turn(role: str, text: str, path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Token ids, loss mask and length of the written form."""
    enc, first = _encoding(path)
    pieces, chars = [], 0
    for part, learnt in parts_of(role, text):
        pieces.append(([first + part] if isinstance(part, int) else enc.encode_ordinary(part), learnt))
        chars += len(MARKS[part]) if isinstance(part, int) else len(part)
    ids = np.array([i for p, _ in pieces for i in p], np.int32)
    edges, at = np.zeros(len(ids) + 1, np.int8), 0
    for p, learnt in pieces:
        edges[at] += learnt
        at += len(p)
        edges[at] -= learnt
    return ids, np.cumsum(edges[:-1], dtype=np.int8), chars


def decode_turn(ids: np.ndarray, mask: np.ndarray, path: str) -> tuple[str, str, str]:
    """Role, text and learnt text of one turn, read from its ids and mask alone."""
    enc, first = _encoding(path)
    marks = np.flatnonzero(ids >= first)
    names = [int(i) - first for i in ids[marks]]
    between = [unescape(enc.decode_bytes(ids[a + 1 : b].tolist()).decode()) for a, b in zip(marks[:-1], marks[1:], strict=True)]
    if names == [BOS, USER, USER_END, EOS]:
        role, text = "user", between[1]
    elif names == [BOS, EOS]:
        role, text = "assistant", between[0]
    elif names == [BOS, ROLE, ROLE_END, EOS]:
        role, text = between[1], between[2]
    else:
        raise ValueError(f"not a turn of the template: {names}")
    return role, text, unescape(enc.decode_bytes(ids[mask > 0].tolist()).decode())


def written(ids: np.ndarray, path: str) -> str:
    """The written form of ids."""
    enc, first = _encoding(path)
    marks = np.flatnonzero(ids >= first)
    begins, ends = [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)]
    plain = [enc.decode_bytes(ids[a:b].tolist()).decode() for a, b in zip(begins, ends, strict=True)]
    return plain[0] + "".join(MARKS[int(ids[m]) - first] + text for m, text in zip(marks, plain[1:], strict=True))


def format_turns(conversations: DataFrame, tokenizer: str, *, turns_per_block: int = 1024) -> DataFrame:
    """conv_id, turn, role, text, ids, mask, start (token offset in the conversation), n_tokens, formatted_chars by turn.

    Turns are encoded where they lie, without a shuffle. Offsets are prefix sums in two steps, so that a conversation
    with very many turns is not one group: within blocks of consecutive turn numbers, then over the blocks' totals.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = (["" if v is None else v for v in batch.column(c).to_pylist()] for c in ("role", "text"))
            for at in range(0, len(roles), 1024):
                done = [encode_turn(r, t, tokenizer) for r, t in zip(roles[at : at + 1024], texts[at : at + 1024], strict=True)]
                part = batch.slice(at, len(done))
                yield pa.RecordBatch.from_pydict({
                    "conv_id": part.column("conv_id").cast(pa.int64()), "turn": part.column("turn").cast(pa.int64()),
                    "role": pa.array(roles[at : at + 1024], pa.string()), "text": pa.array(texts[at : at + 1024], pa.string()),
                    "ids": pa.array([d[0] for d in done], pa.list_(pa.int32())), "mask": pa.array([d[1] for d in done], pa.list_(pa.int8())),
                    "n_tokens": pa.array([len(d[0]) for d in done], pa.int64()), "formatted_chars": pa.array([d[2] for d in done], pa.int64()),
                })

    turns = conversations.select("conv_id", "turn", "role", "text").mapInArrow(encode, TURN_SCHEMA)
    turns = turns.withColumn("block", F.floor(F.col("turn") / turns_per_block))
    order = ["turn", "role", "text"]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("conv_id", "block")
    turns = turns.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).withColumn("of_block", F.sum("n_tokens").over(everything))
    turns = cut(turns)
    totals = turns.groupBy("conv_id", "block").agg(F.first("of_block").alias("total"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    joined = turns.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    return joined.withColumn("start", F.col("base") + F.col("inside")).drop("c", "b", "base", "inside", "of_block", "block")


def digests(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Reads the formatted turns back and digests each conversation. All figures come from the ids and masks.

    The digest of a conversation is one chain over its turns, so they pass through one task in order; they stream through
    it, sorted by Spark (which spills), and only the running hash is held.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, state, at = object(), None, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("conv_id", "ids", "mask", "start")]
            convs, starts = cols[0].to_pylist(), cols[3].to_pylist()
            for i, conv in enumerate(convs):
                if state is None or conv != now:
                    if state:
                        rows.append(close(now, state))
                    now, at, state = conv, 0, {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "loss_chars": 0, "tokens": 0, "loss_tokens": 0}
                ids, mask = cols[1][i].values.to_numpy(), cols[2][i].values.to_numpy()
                if starts[i] != at:
                    raise ValueError(f"conversation {conv}: a turn starts at {starts[i]}, the one before ends at {at}")
                at += len(ids)
                role, text, learnt = decode_turn(ids, mask, tokenizer)
                state["turns"] += 1
                state["all"].update(f"{role}\n{text}\n".encode())
                state["loss"].update(learnt.encode())
                state["loss_chars"] += len(learnt)
                state["chars"] += len(written(ids, tokenizer))
                state["tokens"] += len(ids)
                state["loss_tokens"] += int(mask.sum())
            if len(rows) >= 10_000:
                yield table(rows)
                rows = []
        if state:
            rows.append(close(now, state))
        yield table(rows)

    def close(conv, s) -> tuple:
        return conv, s["turns"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["tokens"], s["loss_tokens"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    order = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "start")
    return order.select("conv_id", "ids", "mask", "start").mapInArrow(read, DIGEST_SCHEMA)
