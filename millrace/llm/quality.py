"""Quality rules by weak supervision.

Each rule votes good or bad on a document, or abstains; most look for one defect and abstain where they don't find it.
Nobody says how far to trust a rule: expectation-maximisation over the votes of the whole corpus estimates how often each
rule votes good, votes bad or abstains on good and on bad documents, and how many documents are good. A document's verdict
is the posterior probability of good given its votes, so one odd feature is outweighed by signs of prose, and two that
agree are not; a rule that votes good on everything counts for nothing.

With R rules there are at most 3**R patterns of votes, so the corpus is counted into a table of that bound, which alone
reaches the driver; EM runs on it. A second pass applies the posterior of each pattern to the rows where they lie. No
document is shuffled.

Nulls: a null text has no words and no lines. Repeated and tied rows get the same verdict each. An empty table gives an
empty result (the model is then its prior). Columns beyond the text pass through `judge` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .runtime import U64, Rolling, mix, per_row, slices, split_words, word_codes

SYMBOLS = b"#*$%&|<>"
#: A word that reads like prose: letters or digits, joined by ' or -, with usual punctuation around.
PLAIN = r"^[\"'(\[«„“‘¿¡]*[\pL\pN]+(?:['’-][\pL\pN]+)*[\"')\]»”’]*[.,;:!?…]?[\"')\]»”’]*$"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GOOD, BAD, ABSTAIN = 1, 0, 2


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts for each text; see STATS, and the further ones that rules use."""
    texts = pc.fill_null(texts, "")
    words, offsets = split_words(texts)
    codes, distinct, hashes = word_codes(words)
    out = {"n_words": np.diff(offsets)}
    by_word = lambda values: per_row(values.to_numpy(zero_copy_only=False).astype(np.int64)[codes], offsets)
    out["word_chars"] = by_word(pc.utf8_length(distinct))
    out["n_plain"] = by_word(pc.match_substring_regex(distinct, PLAIN))
    out["n_upper"] = by_word(pc.and_(pc.utf8_is_upper(distinct), pc.greater(pc.utf8_length(distinct), 1)))
    out["n_ends"] = by_word(pc.match_substring_regex(distinct, r"[.!?…][\"')\]»”’]*$"))

    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    if len(texts) and texts.buffers()[2] is not None:
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        out["n_symbols"] = per_row(is_symbol[np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]], at - at[0])
    else:
        out["n_symbols"] = np.zeros(len(texts), np.int64)

    lines = pc.split_pattern(texts, "\n")
    line_offsets = lines.offsets.to_numpy().astype(np.int64)
    line_row = np.repeat(np.arange(len(texts)), np.diff(line_offsets))
    flat = lines.flatten()
    with_word = pc.binary_length(pc.ascii_trim_whitespace(flat)).to_numpy(zero_copy_only=False) > 0
    line_codes = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False)
    key = np.unique((line_row[with_word] << 32) | line_codes[with_word])
    out["n_lines"] = np.bincount(line_row[with_word], minlength=len(texts))
    out["n_dup_lines"] = out["n_lines"] - np.bincount(key >> 32, minlength=len(texts))

    row = np.repeat(np.arange(len(texts)), out["n_words"])
    again = np.zeros(len(row), np.int64)
    again[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    out["n_runs"] = per_row(again, offsets)
    out["n_distinct"] = np.bincount(np.unique((row.astype(np.int64) << 32) | codes) >> 32, minlength=len(texts))
    out["n_repeat_words"] = _repeated(hashes[codes], row, offsets, len(texts))
    return out


def _repeated(word_hashes: np.ndarray, row: np.ndarray, offsets: np.ndarray, n: int, width: int = 5) -> np.ndarray:
    """Words of each row that lie in a window of `width` words found at least twice in it."""
    begin = np.flatnonzero(np.arange(len(row)) + width <= offsets[1:][row]) if len(row) else np.zeros(0, np.int64)
    if not len(begin):
        return np.zeros(n, np.int64)
    key = Rolling(word_hashes).runs(begin, begin + width) ^ mix(row[begin].astype(U64) + U64(1))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = begin[twice[place] == key]
    edge = np.zeros(len(row) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n)


class Rule(NamedTuple):
    """Good and bad are masks over the counts of a batch; neither: the rule abstains. start: what EM starts from, see Model."""

    name: str
    good: object
    bad: object
    start: tuple[tuple[float, float, float], tuple[float, float, float]]


def _share(part: str, whole: str = "n_words"):
    return lambda s: s[part] / np.maximum(s[whole], 1)


def _never(s):
    return np.zeros(len(s["n_words"]), bool)


def _rules() -> tuple[Rule, ...]:
    words = lambda s: s["n_words"]
    symbols, plain, upper, repeat, runs = map(_share, ("n_symbols", "n_plain", "n_upper", "n_repeat_words", "n_runs"))
    dup, length, ends = _share("n_dup_lines", "n_lines"), _share("word_chars"), _share("n_ends")
    variety = lambda s: s["n_distinct"] / np.sqrt(np.maximum(words(s), 1))
    defect = ((0.02, 0.01, 0.97), (0.4, 0.01, 0.59))
    sign = ((0.02, 0.9, 0.08), (0.4, 0.4, 0.2))
    return (
        Rule("symbols", _never, lambda s: symbols(s) > 0.15, defect),
        Rule("plain words", lambda s: plain(s) > 0.9, lambda s: plain(s) < 0.75, sign),
        Rule("upper case", _never, lambda s: upper(s) > 0.3, defect),
        Rule("repeated windows", _never, lambda s: repeat(s) > 0.2, defect),
        Rule("equal lines", _never, lambda s: (dup(s) > 0.3) & (s["n_lines"] > 2), defect),
        Rule("word runs", _never, lambda s: (runs(s) > 0.2) & (words(s) >= 10), defect),
        Rule("little variety", _never, lambda s: (variety(s) < 2.5) & (words(s) >= 40), defect),
        Rule("word length", _never, lambda s: (length(s) < 2) | (length(s) > 20), defect),
        Rule("sentences", lambda s: (ends(s) > 0.02) & (ends(s) < 0.5), lambda s: (words(s) >= 30) & ((ends(s) < 0.003) | (ends(s) > 0.7)), sign),
    )


RULES = _rules()


def votes(stats: Mapping[str, np.ndarray], rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """The pattern of votes of each document as one number in base 3, rule by rule."""
    code = np.zeros(len(stats["n_words"]), np.int64)
    for rule in reversed(rules):
        code = code * 3 + np.where(rule.bad(stats), BAD, np.where(rule.good(stats), GOOD, ABSTAIN))
    return code


class Model(NamedTuple):
    """Share of good documents; rates[c, r, v], the probability that rule r votes v (BAD, GOOD, ABSTAIN) on a good (c = 0) or bad (c = 1) document."""

    good: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        score = np.full(len(patterns), np.log(self.good / (1 - self.good)))
        for weight in np.log(self.rates[0] / self.rates[1]):
            score += weight[patterns % 3]
            patterns = patterns // 3
        return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, *, rounds: int = 200, prior: float = 20.0, good: float = 0.85) -> Model:
    """Rules vote independently given the class. start[r, c, v] are the rates to begin with, kept as `prior` pseudo-votes.

    A vote never counts against its own side: no rule votes bad on good documents more often than on bad ones, or good
    on bad more often than on good, so the classes cannot change places.
    """
    begin = np.swapaxes(np.array(start, float), 0, 1)
    vote = np.stack([patterns // 3**r % 3 for r in range(begin.shape[1])]) if len(patterns) else np.zeros((begin.shape[1], 0), np.int64)
    model = Model(good, begin)
    for _ in range(rounds):
        p = model.posterior(patterns)
        rates = begin * prior
        for c, weight in enumerate((counts * p, counts * (1 - p))):
            for v in range(3):
                rates[c, :, v] += ((vote == v) * weight).sum(1)
        rates /= rates.sum(2, keepdims=True)
        rates[1, :, BAD] = np.maximum(rates[1, :, BAD], rates[0, :, BAD])
        rates[0, :, GOOD] = np.maximum(rates[0, :, GOOD], rates[1, :, GOOD])
        rates /= rates.sum(2, keepdims=True)
        share = ((counts * p).sum() + good * prior) / (counts.sum() + prior)
        new = Model(float(np.clip(share, 1e-3, 1 - 1e-3)), rates)
        done = abs(new.good - model.good) < 1e-10 and np.allclose(new.rates, model.rates, atol=1e-10)
        model = new
        if done:
            break
    return model


def fit(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES, chunk_bytes: int = 4 << 20) -> Model:
    """One pass over all documents, counting patterns of votes; EM on the counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for at, n in slices(batch.column(0), chunk_bytes):
                for p, c in zip(*np.unique(votes(statistics(batch.column(0).slice(at, n)), rules), return_counts=True), strict=True):
                    total[int(p)] = total.get(int(p), 0) + int(c)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    seen = docs.select(F.col(text).cast("string")).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # at most 3 ** rules
    return expectation_maximisation(np.array([r["pattern"] for r in seen], np.int64), np.array([r["n"] for r in seen], float), np.array([r.start for r in rules]))


def base_failed(stats: Mapping[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def judge(docs: DataFrame, model: Model, *, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, only_kept: bool = False, chunk_bytes: int = 4 << 20) -> DataFrame:
    """The columns of docs but for the text, STATS, base_failed, kept, quality; with only_kept, the kept rows as they are."""
    counts = [(name, pa.int64()) for name in STATS]
    added = [*counts, ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("quality", pa.float64())]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for at, n in slices(column, chunk_bytes):
                stats = statistics(column.slice(at, n))
                quality, failed = model.posterior(votes(stats, rules)), base_failed(stats)
                kept, part = ~failed & (quality >= threshold), batch.slice(at, n)
                if only_kept:
                    yield part.filter(pa.array(kept))
                    continue
                names = [c for c in part.schema.names if c != text and c not in dict(added)]
                values = [part.column(c) for c in names] + [pa.array(stats[c].astype(np.int64)) for c, _ in counts] + [pa.array(failed), pa.array(kept), pa.array(quality)]
                yield pa.RecordBatch.from_arrays(values, [*names, *dict(added)])

    if only_kept:
        return docs.mapInArrow(apply, docs.schema)
    others = [f for f in docs.schema.fields if f.name != text and f.name not in dict(added)]
    schema = StructType(others).add("n_words", "long")
    for name in STATS[1:]:
        schema = schema.add(name, "long")
    return docs.mapInArrow(apply, schema.add("base_failed", "boolean").add("kept", "boolean").add("quality", "double"))
