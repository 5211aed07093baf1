"""Substring deduplication: matching statistics against suffix automata of repeated passages.

A window is `window` consecutive words of one document. Words are removed that lie in a window whose word sequence also
starts earlier (in a smaller document, or before in the same one).

Comparing every document with an automaton of every shard of the corpus would be quadratic, and broadcasting one is only
allowed for a bounded reference. So shards are made of the places that can match at all, and each is sent the passages
that can match in it, instead of everything to everyone:

1. Anchors. In each window the `gram`-word run of least hash is selected; equal windows select the same run. About one
   position in seven is an anchor. A window can only repeat if its anchor does.
2. Anchors that occur once are dropped by a count over the corpus and an equi-join (whose hot keys Spark can split).
3. An anchor's surroundings, as far as windows with it reach, are its snippet. Of equal snippets the first keeps, all
   later ones go, whatever their number; the first of each text alone goes on. This is done in each batch before
   anything is shuffled, so a passage with very many copies sends one row from each batch.
4. Anchors with several different snippets are the reference shards: one suffix automaton is built over the snippets of
   a shard, noting the earliest place of each state; then the snippets are streamed through it, and every word window
   with a match of at least `window` words that starts earlier is removed.
5. A shard is bounded: anchors with more than `shard` different snippets (say, a short line in very many documents) are
   narrowed to their full windows, each a shard of a single text, where rule 3 decides all.

Documents are ordered by id, then by a hash of the text; rows that repeat both are one document and share its result.
Nulls: a null id sorts before all others; a null text has no words and stays null. Ties and repeats within a document
count like any. An empty table gives an empty result. Extra columns pass through `remove` unchanged.
Hashes have 64 bits; equal hashes are taken for equal text in rule 3, and words themselves are compared in rule 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .runtime import TOP, U64, Rolling, cut, mix, slices, slide, split_words, word_codes

PLACE = "struct<doc_id:bigint,tie:bigint,start:int,size:int>"
ANCHORS = f"anchor long, snippet long, doc_id long, tie long, start int, size int, pos int, later array<{PLACE}>"


def find_anchors(word_hashes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Hash, position, and snippet start and end of every anchor; positions count over all texts of the batch."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    end = offsets[1:][row]
    at = np.arange(len(row))
    rolling = Rolling(word_hashes)
    runs = np.full(len(row), TOP, U64)
    inside = np.flatnonzero(at + gram <= end)
    runs[inside] = rolling.runs(inside, inside + gram) & ~U64(1)  # below TOP
    width = window - gram + 1
    least = slide(runs, width, np.minimum)
    valid = at[: len(least)] + window <= end[: len(least)]
    least = np.where(valid, least, U64(0))
    # A run is selected if it is the least of any valid window that holds it, that is, of the window with the largest least.
    padded = np.concatenate((np.zeros(width - 1, U64), least, np.zeros(max(0, len(row) - len(least)), U64)))
    pos = np.flatnonzero((slide(padded, width, np.maximum)[: len(row)] == runs) & (runs != TOP)) if len(row) else at
    left = np.maximum(offsets[:-1][row[pos]], pos - (window - gram))
    right = np.minimum(end[pos], pos + window)
    full = right - left >= window
    pos, left, right = pos[full], left[full], right[full]
    snippet = mix(rolling.runs(left, right) ^ mix(((pos - left) * 4096 + (right - pos)).astype(U64)))
    return runs[pos], snippet, pos, left, right, row[pos]


def _anchors(docs: DataFrame, window: int, gram: int, chunk_bytes: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(2), chunk_bytes):
                words, offsets = split_words(batch.column(2).slice(at, n))
                codes, _, hashes = word_codes(words)
                anchor, snippet, pos, left, right, row = find_anchors(hashes[codes], offsets, window, gram)
                known = pc.is_valid(batch.column(0).slice(at, n)).to_numpy(zero_copy_only=False)
                ids = pc.fill_null(batch.column(0).slice(at, n), 0).to_numpy(zero_copy_only=False)
                ties = batch.column(1).slice(at, n).to_numpy(zero_copy_only=False)
                rank = np.empty(n, np.int64)
                rank[np.lexsort((ties, ids, known))] = np.arange(n)
                order = np.lexsort((pos - offsets[row], rank[row], snippet, anchor))
                anchor, snippet, pos, left, right, row = (x[order] for x in (anchor, snippet, pos, left, right, row))
                start = left - offsets[row]
                first = np.ones(len(order), bool)
                first[1:] = (anchor[1:] != anchor[:-1]) | (snippet[1:] != snippet[:-1])
                group = np.cumsum(first) - 1
                lead = np.flatnonzero(first)
                # Rows that repeat id and text are the same place, not a later one.
                same = (ids[row] == ids[row[lead[group]]]) & (ties[row] == ties[row[lead[group]]]) & (known[row] == known[row[lead[group]]]) & (start == start[lead[group]]) if len(order) else first
                more = ~first & ~same
                id_column = batch.column(0).slice(at, n)
                place = lambda k: [id_column.take(pa.array(row[k])), pa.array(ties[row[k]]), pa.array(start[k].astype(np.int32)), pa.array((right - left)[k].astype(np.int32))]
                k = np.flatnonzero(more)
                later = pa.StructArray.from_arrays([*place(k)], ["doc_id", "tie", "start", "size"])
                counts = np.bincount(group[k], minlength=len(lead))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), later)
                out = [pa.array(anchor[lead].view(np.int64)), pa.array(snippet[lead].view(np.int64)), *place(lead), pa.array((pos - offsets[row])[lead].astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in ANCHORS.split(", ", 7)])

    return docs.select("doc_id", "tie", "text").mapInArrow(scan, ANCHORS)


# -- rule 4 -----------------------------------------------------------------------------------------------------------


class SuffixAutomaton:
    """Of several word sequences, inserted from the earliest place to the latest; each state knows its first end."""

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [None]

    def _state(self, step: dict, link: int, size: int, first) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def _clone(self, p: int, word, q: int) -> int:
        copy = self._state(dict(self.step[q]), self.link[q], self.size[p] + 1, self.first[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def insert(self, words, ends) -> None:
        """ends: for each word, the place (document, end) of a run that ends with it."""
        last = 0
        for word, end in zip(words, ends, strict=True):
            q = self.step[last].get(word)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._clone(last, word, q)
                continue
            cur, p = self._state({}, 0, self.size[last] + 1, end), last
            while p >= 0 and word not in self.step[p]:
                self.step[p][word] = cur
                p = self.link[p]
            if p >= 0:
                q = self.step[p][word]
                self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._clone(p, word, q)
            last = cur

    def matches(self, words, least: int):
        """(index of the last word, first place) of each run of at least `least` words that the automaton knows."""
        state, length = 0, 0
        for i, word in enumerate(words):
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.step[state]:
                state = self.step[state][word]
                length += 1
            while self.link[state] >= 0 and self.size[self.link[state]] >= least:
                state = self.link[state]
                length = self.size[state]
            if length >= least:
                yield i, self.first[state]


def repeated_spans(snippets: list[tuple[object, int, list]], window: int) -> list[tuple[int, int, int]]:
    """snippets: (document, start, words), ordered by document and start, documents comparable. (index, start, end) of words to remove."""
    automaton = SuffixAutomaton()
    for doc, start, words in snippets:
        automaton.insert(words, [(doc, start + i + 1) for i in range(len(words))])
    out = []
    for index, (doc, start, words) in enumerate(snippets):
        begin = upto = -1
        for i, place in automaton.matches(words, window):
            if place < (doc, start + i + 1):
                if upto >= start + i + 1 - window:
                    upto = start + i + 1
                else:
                    if upto >= 0:
                        out.append((index, begin, upto))
                    begin, upto = start + i + 1 - window, start + i + 1
        if upto >= 0:
            out.append((index, begin, upto))
    return out


# -- the operator -----------------------------------------------------------------------------------------------------


def removable(docs: DataFrame, *, window: int = 20, gram: int = 8, shard: int = 256, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, tie, spans (array of start, end in words). docs: doc_id, tie, text."""
    found = _anchors(docs, window, gram, chunk_bytes)
    times = found.select("anchor", (F.size("later") + 1).alias("n")).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    found = cut(found.join(times, "anchor"))

    place = F.struct("doc_id", "tie", "start", "size")
    firsts = found.groupBy("anchor", "snippet").agg(F.min(F.struct("doc_id", "tie", "start", "size", "pos")).alias("lead"))
    spans = found.select(F.explode("later").alias("place")).select("place.*")
    behind = found.join(firsts, ["anchor", "snippet"]).where(F.struct("doc_id", "tie", "start") > F.struct("lead.doc_id", "lead.tie", "lead.start"))
    spans = spans.unionByName(behind.select(place.alias("place")).select("place.*"))

    # Hot anchors: how many different snippets there are is counted map-side first; rows of the join can be split.
    several = firsts.groupBy("anchor").agg(F.count("*").alias("texts")).where("texts > 1")
    reference = firsts.join(several, "anchor").select("anchor", "lead.*", (F.col("texts") > shard).alias("hot"))
    wanted = reference.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("anchor", "start", "size", "pos", "hot")).alias("wanted"))  # bounded by the document
    texts = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.tie") == F.col("w.tie")))
    texts = texts.select("d.doc_id", "d.tie", "d.text", "w.wanted")
    snippets = cut(_snippets(texts, window, gram).dropDuplicates(["anchor", "doc_id", "tie", "start", "size"]))

    cold = snippets.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "tie", "start")
    by_automaton = _match(cold, window)
    hot = snippets.where("hot").withColumn("place", place)
    lead = hot.groupBy("anchor").agg(F.min("place").alias("lead"))
    narrowed = hot.join(lead, "anchor").where(F.col("place") > F.col("lead")).select("place.*")
    spans = spans.unionByName(by_automaton).unionByName(narrowed)
    return spans.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("spans"))


def _snippets(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The words of wanted snippets; those of hot anchors as their windows, with the window's hash for an anchor."""
    schema = "anchor long, doc_id long, tie long, start int, size int, words string, hot boolean"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                part = batch.slice(at, 256)
                for doc, tie, text, wanted in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    words = (text or "").encode().split()
                    for w in wanted:
                        begin, end = w["start"], w["start"] + w["size"]
                        if not w["hot"]:
                            rows.append((w["anchor"], doc, tie, begin, w["size"], b" ".join(words[begin:end]).decode(), False))
                            continue
                        for s in range(max(begin, w["pos"] + gram - window), min(w["pos"], end - window) + 1):
                            key = xxhash.xxh3_64_intdigest(b" ".join(words[s : s + window])) - (1 << 63)
                            rows.append((key, doc, tie, s, window, "", True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])

    return texts.mapInArrow(read, schema)


def _match(snippets: DataFrame, window: int) -> DataFrame:
    """Streams snippets sorted by anchor; holds those of one anchor, of which there are at most `shard`."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            out: list[tuple] = []
            for anchor, doc, tie, start, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if anchor != now:
                    out += solve(own)
                    now, own = anchor, []
                own.append((((doc is not None, doc or 0), tie), start, words.split(" ")))
            yield table(out)
        yield table(solve(own))

    def solve(own: list[tuple]) -> list[tuple]:
        if len(own) < 2:
            return []
        return [(own[i][0][0][1] if own[i][0][0][0] else None, own[i][0][1], a, b - a) for i, a, b in repeated_spans(own, window)]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "tie", "start", "size"])

    return snippets.select("anchor", "doc_id", "tie", "start", "words").mapInArrow(stream, "doc_id long, tie long, start int, size int")


def remove(docs: DataFrame, *, window: int = 20, gram: int = 8, shard: int = 256, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """docs with repeated words taken out of the text; the words kept are joined by one space where any was removed.

    With digest, instead: doc_id, n_words, n_removed, kept_sha256.
    """
    # A document's id and the hash of its text; each side of the final join moves once.
    tie = F.xxhash64(F.col(text).cast("string"))
    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), tie.alias("tie"), F.col(text).cast("string").alias("text"))
    spans = removable(keyed, window=window, gram=gram, shard=shard).select(F.col("doc_id").alias("__sub_doc"), F.col("tie").alias("__sub_tie"), F.col("spans").alias("__sub_spans"))
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")) if digest else docs
    own, words = ("doc_id", "text") if digest else (key, text)
    columns = docs.columns
    joined = base.join(spans, F.col(own).cast("long").eqNullSafe(F.col("__sub_doc")) & (F.xxhash64(F.col(words).cast("string")) == F.col("__sub_tie")), "left").drop("__sub_doc", "__sub_tie")

    def keep(value: str | None, spans: list | None) -> tuple[int, int, bytes]:
        parts = (value or "").encode().split()
        gone = np.zeros(len(parts) + 1, np.int32)
        for s in spans or []:
            gone[s["start"]] += 1
            gone[s["end"]] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        return len(parts), int(mask.sum()), b" ".join(parts[i] for i in np.flatnonzero(~mask).tolist()) if mask.any() else b" ".join(parts)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                done = [keep(*x) for x in zip(part.column("text").to_pylist(), part.column("__sub_spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_words": pa.array([d[0] for d in done], pa.int64()), "n_removed": pa.array([d[1] for d in done], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string()),
                })

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(words).to_pylist()
                for i, spans in enumerate(part.column("__sub_spans").to_pylist()):
                    if spans:
                        texts[i] = keep(texts[i], spans)[2].decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == words else part.column(c) for c in columns], columns)

    if digest:
        return joined.mapInArrow(digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return joined.mapInArrow(rewrite, StructType(docs.schema.fields))
