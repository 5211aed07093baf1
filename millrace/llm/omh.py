"""Near-duplicate detection by order MinHash and banded alignment.

A document is the sequence of its words. Its k-mers (`k` consecutive words; a shorter document is one k-mer) are labelled
by occurrence, so that a repeated k-mer counts as often as it occurs. Each of `sketches` hash functions takes the
`sample` least labelled k-mers and keeps their text order; the keys of the sketch are its pairs of k-mers in that order.
Two documents that have a pair in common are a candidate: the chance follows the k-mers that they share and hold in the
same order, and so edit similarity. The defaults are for recall at an edit similarity of 0.8, where scattered changes
leave 5-mers a Jaccard similarity of 0.2: two sketches of 4 then have a pair in common in 27 % of the cases (those of 2
in 4 %), so that none of 12 has in about 2 % of the document pairs.

Short texts: a change in a text of few words leaves it few or no k-mers in common with the other, and texts of fewer than
`sample` k-mers have fewer pairs than longer ones. So a text of up to 3 * k words also has a key for each of its first
words in the order of a hash, so many that similar texts share one (see prefixes). Between two such texts nothing is missed.

Candidates are verified by banded alignment: word edit distance within the band that the similarity allows,
1 - distance / longer length >= `threshold`. Classes are the connected components of verified pairs.

Copies: equal texts are one node, whatever their number. Large buckets: first every node meets the least node of its
buckets only, then in those of several classes one other node, which differs from bucket to bucket; classes of near
copies, however large, come together by that, with work in proportion to the buckets. Then all pairs of different classes are
compared in buckets that still hold several: directly in buckets of up to `hot` members. Larger ones come from a passage
that very many documents share. Their members meet by rare words instead: similar texts have one of their rarest fifth
(1 - threshold) in common, whatever they are, so that of the pairs of a large bucket none that is similar is lost, and
`hot` decides on the way only. The texts' rows are joined once, and then multiplied by their words. Bounds on the distance from hashed word counts reject most pairs before any text is fetched.
Nothing is cut off by rank or number. Bucket members are counted map-side; joins by bucket are equi-joins whose hot keys
Spark can split, and no bucket is gathered in one task.

Nodes are 64-bit hashes of the text. Components contract round by round, with every round's table cut.

Nulls: a null text equals nothing, not even another null, and is a class of its own; a null id takes part, and is the
class's id only if all its ids are null. Empty texts are equal to each other. Repeated rows each get a row. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import U64, Rolling, cut, mix, slices, split_words, word_codes

#: Words are counted in so many hashed classes, few and then more, for lower bounds of the edit distance.
COARSE, FINE = 128, 512

#: And in so many for pairs from large buckets, of which most come near the threshold and do not reach it.
FINER = 1024

#: So many edges at most are joined into components by the driver, in one step instead of rounds of joins.
FEW = 1 << 17

#: Words are counted in so many hashed classes to tell rare ones from common ones.
WORD_CLASSES = 1 << 16

#: Texts of up to so many times k words also meet by single words.
SHORT = 3

#: So many keys of each text are shuffled at a time, which bounds the disk they take.
FAMILY = 36

#: A rare word knows so many of those before it, by which a pair is made once for a run of shared words, not once for each.
AHEAD = 16

#: The rare words are dealt into so many parts, which are shuffled one after the other, which bounds the disk they take.
WORD_PARTS = 3

#: Classes of more texts in large buckets are compared by pairs of classes.
CROWD = 64

# -- sketches -------------------------------------------------------------------------------------------------------


def labelled_kmers(word_hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of all texts in order, and offsets by text."""
    n = np.diff(offsets)
    counts = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    upto = np.concatenate(([0], np.cumsum(counts)))
    row = np.repeat(np.arange(len(n)), counts)
    begin = offsets[:-1][row] + np.arange(upto[-1]) - upto[:-1][row]
    kmers = Rolling(word_hashes).runs(begin, np.minimum(begin + k, offsets[1:][row]))
    keys = kmers ^ mix(row.astype(U64) + U64(1))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys)
        at = at[np.argsort(keys[at], kind="stable")]
        first = np.concatenate(([True], keys[at][1:] != keys[at][:-1]))
        group_start = np.flatnonzero(first)
        place = np.arange(len(at)) - np.repeat(group_start, np.diff(np.append(group_start, len(at))))
        at, place = at[place > 0], place[place > 0].astype(U64)  # the first keeps its hash, as where it is the only one
        kmers[at] = mix(kmers[at] + place * U64(0x9E3779B97F4A7C15))
    return kmers, upto


def sketch(kmers: np.ndarray, upto: np.ndarray, sketches: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts, and the row of each: for each sketch the pairs, in text order, of its `sample` least k-mers.

    A text of one k-mer has that k-mer as its key.
    """
    starts = upto[:-1]
    size = np.diff(upto)
    row = np.repeat(np.arange(len(size)), size)
    seeds = mix(np.arange(1, sketches + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
    # The least values of a text are below this bound but in rare cases, which are done again without it.
    bound = np.where(size > 10 * sample, (10.0 * sample / np.maximum(size, 1)) * 2.0**64, 2.0**64 - 4096).astype(U64)[row]
    want = np.minimum(size, sample)
    padded = np.append(kmers, U64(0))
    full = np.flatnonzero(size)
    keys, rows = [], []
    for t, seed in enumerate(seeds):
        x = kmers * (seed | U64(1))  # k-mers are scrambled already
        at = np.flatnonzero(x <= bound)
        short = np.bincount(row[at], minlength=len(size)) < want
        if short.any():
            at = np.flatnonzero((x <= bound) | short[row])
        at = at[np.lexsort((x[at], row[at]))]
        first = np.searchsorted(row[at], np.arange(len(size)))
        picked = np.full((sample, len(size)), len(kmers))
        for s in range(sample):
            has = want > s
            picked[s, has] = at[first[has] + s]
        picked.sort(axis=0)
        for i in range(sample):
            for j in range(i + 1, sample):
                own = full if (i, j) == (0, 1) else np.flatnonzero(want > j)
                key = mix(padded[picked[i, own]] * U64(0x9E3779B97F4A7C15) + U64(t + 1))
                keys.append(mix(key * U64(0x9E3779B97F4A7C15) + padded[picked[j, own]]))
                rows.append(own)
    return np.concatenate(keys), np.concatenate(rows)


def prefixes(word_hashes: np.ndarray, offsets: np.ndarray, threshold: float, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled words of all texts, and the row of each: so many of the least of a text that similar texts share one.

    Texts that reach the threshold share at least threshold * n words, n being the words of the longer one. So the first
    n - threshold * n + 1 of either, in any order common to all, hold one of them. Here rare classes by `common` come first.
    """
    words, upto = labelled_kmers(word_hashes, offsets, 1)
    size = np.diff(upto)
    row = np.repeat(np.arange(len(size)), size)
    words = words[np.lexsort((words, common[words % U64(len(common))], row))]
    want = size - np.ceil(threshold * size - 1e-6).astype(np.int64) + 1
    keep = np.arange(len(words)) - upto[:-1][row] < want[row]
    return words[keep], row[keep]


def _sketches(docs: DataFrame, k: int, sketches: int, sample: int, threshold: float, chunk_bytes: int) -> DataFrame:
    schema = "doc_id long, node long, words int, keys array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(2), chunk_bytes):
                words, offsets = split_words(batch.column(2).slice(at, n))
                codes, _, hashes = word_codes(words)
                kmers, upto = labelled_kmers(hashes[codes], offsets, k)
                keys, row = sketch(kmers, upto, sketches, sample)
                size = np.diff(offsets)
                small = size <= SHORT * k
                own, of = prefixes(hashes[codes][np.repeat(small, size)], np.concatenate(([0], np.cumsum(size * small))), threshold, np.zeros(1, np.int64))
                row = np.concatenate((row, of))
                order = np.argsort(row, kind="stable")  # the sketches of a text, then its words
                flat = np.concatenate((keys, mix(own ^ U64(0xD6E8FEB86659FD93))))[order]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, n) for i in range(2)), pa.array(np.diff(offsets).astype(np.int32)), lists], ["doc_id", "node", "words", "keys"])

    return docs.select("doc_id", "node", "text").mapInArrow(scan, schema)


def _bags(texts: DataFrame, chunk_bytes: int, **sizes: int) -> DataFrame:
    """node, and a column for each of sizes: how many words of the text each of so many classes has, 127 at most, which
    only lowers differences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # bounds the table of counts, as slices bound the words
                part = batch.slice(at, min(1024, batch.num_rows - at))
                for begin, n in slices(part.column(1), chunk_bytes):
                    words, offsets = split_words(part.column(1).slice(begin, n))
                    codes, _, hashes = word_codes(words)
                    row, own = np.repeat(np.arange(n), np.diff(offsets)), hashes[codes]
                    bags = [part.column(0).slice(begin, n)]
                    for size in sizes.values():
                        counts = np.minimum(np.bincount(row * size + (own % U64(size)).astype(np.int64), minlength=n * size), 127).astype(np.int8)
                        bags.append(pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size, dtype=np.int32)), pa.array(counts)))
                    yield pa.RecordBatch.from_arrays(bags, ["node", *sizes])

    return texts.select("node", "text").mapInArrow(count, ", ".join(["node long", *(f"{name} array<byte>" for name in sizes)]))


# -- banded alignment -----------------------------------------------------------------------------------------------


def positions(words) -> dict:
    """For each distinct word the bit mask of its places."""
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def edit_distance(a, b, most: int, places: dict | None = None) -> int:
    """Edit distance of two sequences if it is at most `most`, else most + 1. places: positions(a), if known.

    Bit-parallel: a column of the alignment is two integers whose bits say where it rises and falls, so a step costs a
    few operations on integers as wide as the band of 2 * most + 1 diagonals.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return max(n, m)
    places = positions(a) if places is None else places
    if 2 * most + 1 >= n or not most:
        return min(_whole_column(n, b, places), most + 1) if most or list(a) != list(b) else 0
    width = 2 * most + 1
    mask = (1 << width) - 1
    top = 1 << (width - 1)
    rise, fall, score = (mask >> most) << most, 0, most  # bit j of step i stands for place i - most + j of a
    level = 1 << (width - 2)
    for i, word in enumerate(b):
        own = places.get(word, 0)
        own = (own >> (i - most) if i >= most else own << (most - i)) & mask
        same = ((((own & rise) + rise) ^ rise) | own | fall) & mask
        up = (fall | ~(same | rise)) & mask
        down = same & rise
        if i < n - most:  # down the lowest diagonal
            score += not same & top
        else:  # along the last place of a
            score += bool(up & level) - bool(down & level)
            level >>= 1
        if score > most + (n - most if i < n - most else m - 1 - i) and i >= n - most:
            return most + 1
        same >>= 1
        rise = (down | ~(same | up)) & mask
        fall = same & up
    return min(score, most + 1)


def _whole_column(n: int, b, places: dict) -> int:
    mask, last = (1 << n) - 1, 1 << (n - 1)
    rise, fall, score = mask, 0, n
    for word in b:
        own = places.get(word, 0)
        same = ((((own & rise) + rise) ^ rise) | own | fall) & mask
        up = (fall | ~(same | rise)) & mask
        down = same & rise
        score += bool(up & last) - bool(down & last)
        up = (up << 1 | 1) & mask
        down = (down << 1) & mask
        rise = (down | ~(same | up)) & mask
        fall = same & up
    return score


class _Text:
    """A text's words, how often each occurs, and their places, made when first needed."""

    def __init__(self, text: str):
        self.words = text.encode().split()
        self.counts = Counter(self.words)

    @functools.cached_property
    def places(self) -> dict:
        return positions(self.words)


def similarity(a: _Text, b: _Text, threshold: float) -> float:
    """1 - edit distance / longer length where that reaches the threshold, else 0."""
    longer = max(len(a.words), len(b.words))
    if not longer:
        return 1.0
    most = int((1 - threshold) * longer + 1e-9)
    few, many = sorted((a.counts, b.counts), key=len)
    if longer - sum(min(c, many[w]) for w, c in few.items()) > most:  # words that only one has must be edited
        return 0.0
    d = edit_distance(a.words, b.words, most, a.places)
    return 1 - d / longer if d <= most else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b of those pairs that are similar. texts: node, text, one row for each node."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = functools.lru_cache(64)(_Text)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                good = [similarity(words(s), words(t), threshold) > 0 for s, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(align, "a long, b long")


# -- components -----------------------------------------------------------------------------------------------------


def _components_of_few(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, found by the driver."""
    pairs = edges.select("a", "b").toArrow()
    root: dict[int, int] = {}

    def find(node: int) -> int:
        up = root.setdefault(node, node)
        while up != root[up]:
            root[up] = root[root[up]]
            up = root[up]
        root[node] = up
        return up

    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    found = pa.table({"node": pa.array(root, pa.int64()), "root": pa.array(map(find, list(root)), pa.int64())})
    return edges.sparkSession.createDataFrame(found)


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node with an edge (a, b).

    Each round orders nodes, hooks each to its first neighbour if that comes before it, and contracts. Odd rounds order
    by id, which takes a star around the least node at once; even ones by a new hash, so that a chain, whatever its ids,
    shrinks by a constant factor. Once FEW edges are left, the driver ends it.
    """
    edges = cut(edges.where("a != b").select("a", "b").distinct(), plain=True)
    roots, rounds = None, 0
    while left := edges.count():
        rounds += 1
        if left <= FEW:
            last = cut(_components_of_few(edges), plain=True)
            if roots is None:
                return last
            return cut(roots.join(last.select(F.col("node").alias("root"), F.col("root").alias("root_root")), "root", "left").select("node", F.coalesce("root_root", "root").alias("root")), plain=True)
        place = lambda c: F.struct((F.xxhash64(c, F.lit(rounds)) if rounds % 2 == 0 else F.col(c)).alias("rank"), F.col(c).alias("node"))  # noqa: E731, B023
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = sides.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("near"))
        hook = cut(hook.select("node", F.least(place("node"), "near")["node"].alias("root")), plain=True)
        as_key = lambda name: hook.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        if roots is None:
            roots = hook
        else:
            roots = cut(roots.join(as_key("root"), "root", "left").select("node", F.coalesce("root_root", "root").alias("root")), plain=True)
        edges = cut(edges.join(as_key("a"), "a").join(as_key("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a != b").distinct(), plain=True)
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


# -- the operator ---------------------------------------------------------------------------------------------------


def _mixed(member: DataFrame) -> DataFrame:
    """Of key, node, words, root: the rows of keys that hold several roots."""
    keys = member.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.count("*").alias("n")).where("one != other").select("key", "n")
    return member.join(keys, "key")


def _rare_words(texts: DataFrame, threshold: float, chunk_bytes: int) -> list[DataFrame]:
    """The columns of texts but for text, key and before: a row for each word of a text's prefix, rare words first, by a
    table of counts of fixed size. key: 32 bits of the word's hash; before: those of the AHEAD words before it. A frame
    for each part of the keys."""
    columns = [c for c in texts.columns if c != "text"]

    def scan(column: pa.Array):
        for at, n in slices(column, chunk_bytes):
            words, offsets = split_words(column.slice(at, n))
            codes, _, hashes = word_codes(words)
            yield at, hashes[codes], offsets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORD_CLASSES, np.int64)
        for batch in batches:
            for _, hashes, offsets in scan(batch.column(0)):
                total += np.bincount((labelled_kmers(hashes, offsets, 1)[0] % U64(WORD_CLASSES)).astype(np.int64), minlength=WORD_CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["class", "n"])

    counts = texts.select("text").mapInArrow(count, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(WORD_CLASSES, np.int64)
    common[counts.column("class").to_numpy()] = counts.column("n").to_numpy()

    def first(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, offsets in scan(batch.column(len(columns))):
                words, row = prefixes(hashes, offsets, threshold, common)
                codes = (words >> U64(32)).astype(np.uint32)
                begin = np.searchsorted(row, row)  # where the word's text begins
                ahead = np.minimum(np.arange(len(row)) - begin, AHEAD)
                own = np.flatnonzero(codes % WORD_PARTS == part)  # by the key itself, so that equal keys are in one part
                for start in range(0, len(own), 1 << 14):  # a row of the text's columns for each word: not all at once
                    place = own[start : start + (1 << 14)]
                    of, upto = pa.array(row[place] + at), np.concatenate(([0], np.cumsum(ahead[place])))
                    held = codes[np.repeat(place - ahead[place] - upto[:-1], ahead[place]) + np.arange(upto[-1])]
                    before = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(held.view(np.int32)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(len(columns))), pa.array(codes[place].view(np.int32)), before], [*columns, "key", "before"])

    schema = T.StructType([*texts.select(*columns).schema.fields, T.StructField("key", T.IntegerType()), T.StructField("before", T.ArrayType(T.IntegerType()))])
    return [texts.select(*columns, "text").mapInArrow(functools.partial(first, part=part), schema) for part in range(WORD_PARTS)]


def _close(bag: str, threshold: float):
    """Words that only one side has, by class, must be edited: a bound below the distance, so nothing similar is lost."""
    apart = F.aggregate(F.zip_with(f"{bag}_a", f"{bag}_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda acc, x: acc + x)
    return (apart + F.abs(F.col("words_a") - F.col("words_b"))) / 2 <= (1 - threshold) * F.greatest("words_a", "words_b") + 1e-6


def _near(threshold: float):
    return F.least("words_a", "words_b") >= threshold * F.greatest("words_a", "words_b") - 1e-6


def _pairs_with_hubs(mixed: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """a, b: each member of a bucket with one other, which differs from bucket to bucket, without what bounds reject."""
    hub = mixed.groupBy("key").agg(F.min_by(F.struct("node", "root", F.col("words").alias("words_b")), F.xxhash64("key", "node")).alias("hub"))
    met = mixed.withColumnRenamed("words", "words_a").join(hub.select("key", "hub", "hub.words_b"), "key")
    met = met.where((F.col("root") != F.col("hub.root")) & _near(threshold)).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    for own in (["words", "coarse"], ["words", "fine"]):  # few rows are left when the longer counts are fetched
        for end in "ab":
            met = met.join(bags.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in own)), end)
        met = met.where(_near(threshold) & _close(own[1], threshold)).select("a", "b")
    return met


def _pairs_between_classes(mixed: DataFrame, bags: DataFrame, texts: DataFrame, threshold: float, hot: int, chunk_bytes: int) -> DataFrame:
    """a, b of different classes that share a bucket, without those that bounds show to be below the threshold."""
    small = F.array_sort(F.collect_list(F.when(F.col("n") <= hot, F.col("key"))))
    large = F.array_sort(F.collect_list(F.when(F.col("n") > hot, F.col("key"))))
    shown = cut(mixed.groupBy("node").agg(F.first("root").alias("root"), small.alias("small"), large.alias("large")).join(bags, "node"))  # at most a key for each pair of a sketch

    def side(rows: DataFrame, end: str, *columns: str) -> DataFrame:
        return rows.select(*(F.col(c) if c == "key" else F.col(c).alias(f"{c}_{end}") for c in columns))

    def within(left: DataFrame, right: DataFrame, on: list[str], met, *bags: str) -> DataFrame:
        found = left.join(right, on).where((F.col("root_a") != F.col("root_b")) & _near(threshold) & met)
        for bag in bags:
            found = found.where(_close(bag, threshold))
        return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))

    columns, in_order = ["key", "node", "root", "words", "coarse"], F.col("node_a") < F.col("node_b")
    # A pair that shares several keys is made at the first of them only.
    few = shown.withColumn("key", F.explode("small"))
    left, right = (side(few, end, *columns, "fine", "small") for end in "ab")
    pairs = within(left, right, ["key"], in_order & (F.get(F.array_intersect("small_a", "small_b"), F.lit(0)) == F.col("key")), "coarse", "fine")
    many = shown.where(F.size("large") > 0)
    if many.limit(1).count():
        crowds = many.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("root", F.lit(True).alias("crowd"))
        lean = many.select("node", "root", "words", "coarse").join(crowds, "root", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
        parts = _rare_words(cut(lean.join(texts, "node")), threshold, chunk_bytes)  # made anew for each use: kept, they take several times the texts' size
        crowded = crowds.limit(2).count() > 1
        # Members of one large class need not meet each other: others meet all, and large classes meet by pairs of classes.
        # A pair that shares several words is made where no earlier one is known to be shared: at the first, at least.
        columns, first = [*columns, "before"], ~F.arrays_overlap("before_a", "before_b")
        for i, words in enumerate(parts):
            met = within(side(words.where("not crowd"), "a", *columns), side(words, "b", *columns, "crowd"), ["key"], (F.col("crowd_b") | in_order) & first, "coarse")
            if crowded:
                crowd = words.where("crowd")
                at = cut(crowd.select("key", "root").distinct())
                both = cut(side(at, "a", "key", "root").join(side(at, "b", "key", "root"), "key").where("root_a < root_b"))
                left = side(crowd, "a", *columns).join(both, ["key", "root_a"])
                met = met.unionByName(within(left, side(crowd, "b", *columns), ["key", "root_b"], first, "coarse"))
            parts[i] = cut(met.distinct())
        met = functools.reduce(DataFrame.unionByName, parts).distinct()
        finer = cut(_bags(texts.join(many.select("node"), "node", "left_semi"), chunk_bytes, finer=FINER).join(many.select("node", "words", "large"), "node"))
        for end in "ab":
            met = met.join(side(finer, end, "node", "words", "finer", "large"), F.col(end) == F.col(f"node_{end}"))
        pairs = pairs.unionByName(met.where(F.arrays_overlap("large_a", "large_b") & _close("finer", threshold)).select("a", "b"))
    return pairs.distinct()


def classes(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, sketches: int = 12, sample: int = 4, hot: int = 100, key: str = "doc_id", text: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, class_id (least id of the class), node (hash of the text), class_size, class_node for each row of docs."""
    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("node"), body.alias("text"))
    found = cut(_sketches(rows.where("text is not null"), k, sketches, sample, threshold, chunk_bytes))
    nodes = cut(found.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words"), F.first("keys").alias("keys")))
    parts, most = [], sketches * sample * (sample - 1) // 2 + SHORT * k  # keys of a text: pairs, and words if it is short
    for begin in range(1, most + 1, FAMILY):
        buckets = nodes.select("node", F.explode(F.slice("keys", begin, FAMILY)).alias("key"))
        shared = buckets.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("greatest")).where("least != greatest").select("key", "least")
        parts.append(cut(buckets.join(shared, "key")))
    member = functools.reduce(DataFrame.unionByName, parts)

    # Texts of the nodes in question, once each; the copy with the least id stands for all.
    involved = cut(nodes.select("node", "doc_id", "words").join(member.select("node").distinct(), "node", "left_semi"))
    texts = rows.where("text is not null").alias("r").join(involved.alias("i"), (F.col("r.node") == F.col("i.node")) & F.col("r.doc_id").eqNullSafe(F.col("i.doc_id")))
    texts = cut(texts.select("r.node", "r.text").dropDuplicates(["node"]))

    def with_classes(nodes: DataFrame, merged: DataFrame) -> DataFrame:
        return nodes.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")

    def merge(pairs: DataFrame) -> DataFrame:
        """root of a class as node, and the root of that which it is part of by similar pairs."""
        found = _verified(cut(pairs.join(stars, ["a", "b"], "left_anti")), texts, threshold)
        for end in "ab":
            found = found.join(classed.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end)
        return components(found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))

    stars = cut(member.where("node != least").select(F.least("node", "least").alias("a"), F.greatest("node", "least").alias("b")).distinct())
    roots = components(_verified(stars, texts, threshold))
    classed = cut(involved.select("node", "words").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), plain=True)
    mixed = cut(_mixed(member.select("key", "node").join(classed, "node")), plain=True)
    bags = cut(_bags(texts.join(mixed.select("node").distinct(), "node", "left_semi"), chunk_bytes, coarse=COARSE, fine=FINE).join(classed.select("node", "words"), "node"))
    merged = merge(_pairs_with_hubs(mixed, bags, threshold))
    classed = cut(with_classes(classed, merged), plain=True)
    mixed = cut(_mixed(with_classes(mixed.drop("n"), merged)), plain=True)
    merged = merge(_pairs_between_classes(mixed, bags, texts, threshold, hot, chunk_bytes))
    classed = cut(with_classes(classed, merged), plain=True)

    own = found.select("doc_id", "node").join(classed.select("node", F.col("root").alias("class_node")), "node", "left").withColumn("class_node", F.coalesce("class_node", "node"))
    own = cut(own, plain=True)
    named = cut(own.groupBy("class_node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))  # apart, so that Spark can split the join below
    result = own.join(named, "class_node").select("doc_id", "class_id", "node", "class_size", "class_node")
    alone = rows.where("text is null").select("doc_id", F.col("doc_id").alias("class_id"), "node", F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("long").alias("class_node"))
    return result.unionByName(alone)


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their class: the one with the least id; all rows whose text is null."""
    found = cut(classes(docs, key=key, text=text, **options))
    lead = found.where(F.col("class_node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
    lead = lead.groupBy("class_node", "node").agg(F.first("class_id").alias("id"), F.count("*").alias("rows"))
    # Rows of a class may share the least id: the text of least hash stays then, once.
    lead = lead.groupBy("class_node").agg(F.min(F.struct("node", "id", "rows")).alias("s"))
    lead = cut(lead.select(F.col("s.node").alias("__omh_node"), F.col("s.id").alias("__omh_id"), F.col("s.rows").alias("__omh_rows")))
    mark = F.xxhash64(F.col(text).cast("string"))
    kept = docs.where(F.col(text).isNotNull()).join(lead, F.col(key).cast("long").eqNullSafe(F.col("__omh_id")) & (mark == F.col("__omh_node")))
    if lead.where("__omh_rows > 1").limit(1).count():
        kept = kept.where("__omh_rows = 1").unionByName(kept.where("__omh_rows > 1").dropDuplicates(["__omh_id", "__omh_node"]))
    return kept.select(*docs.columns).unionByName(docs.where(F.col(text).isNull()))
