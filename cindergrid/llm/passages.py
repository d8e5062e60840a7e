"""Passages that repeat across documents: paragraph MinHash banding, and runs of words found by anchored blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import blocks, common
from cindergrid.llm.components import components

WIDTH, SIMILARITY = 5, 0.8
PARAGRAPH_WORDS = 50  # shorter lines are compared as parts of runs only
PASSAGE_WORDS = 50  # words in a row that make a passage, whatever sentences they are cut from
ANCHOR_WORDS = 16

#: Which characters are white space; none is beyond the ideographic space, and the last entry stands for all beyond.
SPACES = np.array([chr(c).isspace() for c in range(0x3002)])
GROUP_WORDS = 50_000  # of texts whose blocks are made together


def bands_for(similarity: float, recall: float, rows: int = 3) -> int:
    """Fewest bands of `rows` minima each that let a pair of this similarity meet with this chance."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


ROWS = 3
BANDS = bands_for(SIMILARITY, 0.985, ROWS)
_SEEDS = np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)


def bands_of(parts: list[np.ndarray]) -> np.ndarray:
    """A key for each band of the MinHash signature of each paragraph, WIDTH words or more; one row a paragraph."""
    sizes = np.array([len(p) for p in parts])
    stops = np.cumsum(sizes)
    # runs that cross from one paragraph into the next are left out
    edges = np.stack([stops - sizes, stops - WIDTH + 1], 1).ravel()
    marks = common.shingles(np.concatenate(parts), WIDTH)
    least = np.empty((len(parts), ROWS * BANDS), np.uint64)
    values = np.empty(len(marks) + 1, np.uint64)
    values[-1] = 2**64 - 1
    for n, seed in enumerate(_SEEDS):
        own = (marks ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
        own ^= own >> np.uint64(32)
        values[:-1] = own * np.uint64(0xC4CEB9FE1A85EC53)
        least[:, n] = np.minimum.reduceat(values, edges)[::2]
    least = least.reshape(len(parts), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(parts), BANDS))
    for i in range(ROWS):
        keys = (keys ^ least[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def band_keys(words: np.ndarray) -> list[int]:
    """A key for each band of a paragraph's MinHash signature."""
    return bands_of([words])[0].tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    one, two = np.unique(common.shingles(a, WIDTH)), np.unique(common.shingles(b, WIDTH))
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return shared / max(1, len(one) + len(two) - shared)


def runs_of(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words in order, made from runs half as long; none for a shorter text."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    found, have = common.mix(words, width), 1
    while have < width:
        step = min(have, width - have)
        found = common.mix(found[: len(found) - step] * np.uint64(0x9E3779B97F4A7C15) + found[step:], have)
        have += step
    return found


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all short runs, and for each place the least short run inside the PASSAGE_WORDS from there.

    What is picked depends on these words only, so equal passages have the same anchor.
    """
    short = runs_of(words, ANCHOR_WORDS)
    span = PASSAGE_WORDS - ANCHOR_WORDS + 1
    if len(short) < span:
        return short, np.zeros(0, np.int64)
    return short, np.lib.stride_tricks.sliding_window_view(short, span).argmin(1) + np.arange(len(short) - span + 1)


def blocks_of(words: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, keys, firsts, lasts, windows): the blocks of texts that follow each other, and a hash of each window of PASSAGE_WORDS.

    A block is all windows in a row that have their anchor at the same place. Its first and
    last window together hold all its words, so that blocks with one key are equal word by
    word. Equal windows have equal anchors, so a window that another text has too lies in
    blocks with one anchor. `sizes` are the numbers of words of the texts; windows that
    cross into the next text are in no block.
    """
    short, least = anchors(words)
    windows = runs_of(words, PASSAGE_WORDS)
    at = np.arange(len(least))
    if sizes is not None:
        at = at[at + PASSAGE_WORDS <= np.repeat(np.cumsum(sizes), sizes)[: len(at)]]
    new = np.flatnonzero(np.diff(least[at], prepend=-1))
    firsts, lasts = at[new], at[np.append(new[1:], len(at))[: len(new)] - 1]
    shape = ((lasts - firsts) * 64 + least[firsts] - firsts).astype(np.uint64)
    keys = common.mix(windows[firsts] * np.uint64(0x9E3779B97F4A7C15) + windows[lasts], 1) ^ common.mix(shape, 2)
    return short[least[firsts]], keys, firsts, lasts, windows


def word_spans(text: str) -> np.ndarray:
    """Start and end of each white-space separated chunk of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = ~SPACES[np.minimum(codes, len(SPACES) - 1)]
    return np.flatnonzero(np.diff(inside, prepend=False, append=False)).astype(np.int32).reshape(-1, 2)


def chunk_hashes(chunks: list[str], hashes: common.WordHashes) -> np.ndarray:
    """A hash for each white-space separated chunk, so that places are those of the chunks."""
    return np.fromiter(map(hashes.__getitem__, chunks), np.uint64, len(chunks))


def paragraphs(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and text of each line with PARAGRAPH_WORDS words or more."""
    at = 0
    for line in text.split("\n"):
        if len(line) >= 2 * PARAGRAPH_WORDS - 1 and len(line.split()) >= PARAGRAPH_WORDS:
            yield at, at + len(line), line
        at += len(line) + 1


TABLE = "k bigint, bands array<bigint>, lines array<int>, anchors array<bigint>, blocks array<bigint>"
ROW = "k bigint, i int, a int, b int, words int, w binary, key bigint, keeper bigint"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")


def _table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Paragraph bands and blocks of each document with a key and a text."""
    types = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]

    def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind.value_type), type=kind)

    def group(keys: pa.Array, words: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        long, lines, paragraph = [], [], np.zeros(len(words), np.int64)
        for n, (own, lengths) in enumerate(zip(words, sizes, strict=True)):
            stops = np.cumsum(lengths)
            for number, stop in enumerate(np.flatnonzero(lengths >= PARAGRAPH_WORDS)):
                line = own[stops[stop] - lengths[stop] : stops[stop]]
                line = line[line != 0]
                if len(line) >= WIDTH:
                    long.append(line), lines.append(number)
                    paragraph[n] += BANDS
        bands = bands_of(long).ravel() if long else np.zeros(0, np.int64)
        totals = np.array([len(own) for own in words])
        marks, blocks, firsts, _, _ = blocks_of(np.concatenate(words), totals)
        held = np.bincount(np.searchsorted(np.cumsum(totals), firsts, "right"), minlength=len(words))
        columns = (lists(bands, paragraph, types[0]), lists(np.repeat(np.array(lines, np.int32), BANDS), paragraph, types[1]))
        return pa.RecordBatch.from_arrays([keys, *columns, lists(marks.view(np.int64), held, types[2]), lists(blocks.view(np.int64), held, types[3])], _names(TABLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for part, own in common.text_rows(batches, "t"):
            words, sizes, held, start = [], [], 0, 0
            for n, t in enumerate(own):
                chunks = [line.split() for line in t.split("\n")]
                sizes.append(np.fromiter(map(len, chunks), np.int64, len(chunks)))
                words.append(np.fromiter(map(hashes.__getitem__, chain.from_iterable(chunks)), np.uint64, int(sizes[-1].sum())))
                held += len(words[-1])
                if held >= GROUP_WORDS or n == len(own) - 1:
                    yield group(part.column("k").slice(start, n + 1 - start), words, sizes)
                    words, sizes, held, start = [], [], 0, n + 1

    return _narrow(docs, key, text).mapInArrow(run, TABLE)


def _met(table: DataFrame) -> DataFrame:
    """key, k, i, keeper, place: the paragraphs of each band that several documents have, and the least of them."""
    each = table.select("k", F.explode(F.arrays_zip("bands", "lines")).alias("u")).select("k", F.col("u.lines").alias("i"), F.col("u.bands").alias("key"))
    least = each.groupBy("key").agg(F.min("k").alias("keeper"), F.max("k").alias("last"), F.min(F.struct("k", "i")).alias("p"))
    least = common.stage(least.where("keeper < last").select("key", "keeper", F.col("p.i").alias("place")), "bands")
    met = common.stage(each.join(least, "key").select("key", "k", "i", "keeper", "place"), "met")
    common.discard(least)
    return met


def _wanted(table: DataFrame) -> DataFrame:
    """k and its blocks that matter: the least document that has the block, or null where its windows are to be listed.

    A block that an earlier document has is repeated as a whole. Of the documents with one
    block only the least lists its windows, if its anchor has other blocks too: as any
    window's first document is the least one with its block, no match is lost.
    """
    each = table.select("k", F.explode(F.arrays_zip("anchors", "blocks")).alias("u")).select("k", F.col("u.anchors").alias("anchor"), F.col("u.blocks").alias("block"))
    blocks = common.stage(each.groupBy("anchor", "block").agg(F.min("k").alias("keeper"), F.max("k").alias("last")), "blocks")
    several = blocks.groupBy("anchor").agg(F.count("*").alias("n"), F.min("keeper").alias("x"), F.max("last").alias("y")).where("n > 1 and x < y")
    marked = blocks.join(several.select("anchor", F.lit(True).alias("several")), "anchor", "left").where("several or keeper < last")
    marked = common.stage(marked.select("block", "keeper", F.coalesce("several", F.lit(False)).alias("several")), "marked")
    common.discard(blocks)
    found = each.select("k", "block").join(marked, "block").where("k <> keeper or several")
    # a document's own blocks bound this list
    lists = found.groupBy("k").agg(F.collect_set(F.struct("block", F.when(F.col("k") != F.col("keeper"), F.col("keeper")).alias("keeper"))).alias("wanted"))
    lists = common.stage(lists, "wanted")
    common.discard(marked)
    return lists


def _cut(docs: DataFrame, key: str, text: str, met: DataFrame, wanted: DataFrame) -> DataFrame:
    """One more reading of the texts that have candidates: their paragraphs (w), repeated runs (keeper) and listed windows (key)."""
    places = met.groupBy("k").agg(F.collect_set("i").alias("places"))
    lists = common.stage(places.join(wanted, "k", "full"), "lists")
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())

    def rows(n: int, *columns) -> pa.RecordBatch:
        arrays = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, _names(ROW))

    def lines(k: int, t: str, places: list, hashes: common.WordHashes) -> Iterator[pa.RecordBatch]:
        chosen, out = set(places), []
        for number, (a, b, line) in enumerate(paragraphs(t)):
            if number in chosen:
                words = (hashes.of(line) >> np.uint64(32)).astype("<u4")
                out.append((number, a, b, len(line.split()), words.tobytes()))
        if out:
            yield rows(len(out), np.full(len(out), k), *zip(*out, strict=True), None, None)

    def windows(k: int, t: str, wanted: pa.Array, hashes: common.WordHashes) -> Iterator[pa.RecordBatch]:
        spans = word_spans(t)
        _, keys, firsts, lasts, whole = blocks_of(chunk_hashes(t.split(), hashes))
        given, keeper = wanted.field("block").to_numpy().view(np.uint64), wanted.field("keeper")
        order = np.argsort(given)
        known = np.isin(keys, given)
        own = order[np.searchsorted(given, keys[known], sorter=order)]
        firsts, lasts = firsts[known], lasts[known]
        listed = keeper.is_null().to_numpy(zero_copy_only=False)[own]
        # blocks one after the other that the same document has are one run
        a, b, of = firsts[~listed], lasts[~listed], keeper.fill_null(0).to_numpy()[own[~listed]]
        if len(a):
            start = np.flatnonzero(np.append(True, (a[1:] != b[:-1] + 1) | (of[1:] != of[:-1])))
            a, b, of = a[start], b[np.append(start[1:], len(a)) - 1], of[start]
            yield rows(len(a), np.full(len(a), k), a, spans[a, 0], spans[b + PASSAGE_WORDS - 1, 1], b - a + 1, None, None, of)
        if listed.any():
            at = np.concatenate([np.arange(x, y + 1) for x, y in zip(firsts[listed], lasts[listed], strict=True)])
            yield rows(len(at), np.full(len(at), k), at, spans[at, 0], spans[at + PASSAGE_WORDS - 1, 1], np.ones(len(at), np.int32), None, whole[at].view(np.int64), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for part, own in common.text_rows(batches, "t"):
            held, size = [], 0
            for k, t, places, wanted in zip(part.column("k").to_pylist(), own, part.column("places").to_pylist(), part.column("wanted"), strict=True):
                for found in chain(lines(k, t, places or [], hashes), windows(k, t, wanted.values, hashes) if wanted.is_valid else ()):
                    held.append(found)
                    size += found.nbytes
                if size > 4_000_000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    # the lists grow with the corpus, so they are merged, not broadcast
    out = common.stage(_narrow(docs, key, text).join(lists.hint("merge"), "k").mapInArrow(run, ROW), "cut")
    common.discard(lists)
    return out


def _repeated(cut: DataFrame) -> DataFrame:
    """k, a, b, words, keeper of all runs of PASSAGE_WORDS words or more that an earlier document has."""
    windows = cut.where("key is not null").select("k", "i", "a", "b", "words", "key")
    first = windows.groupBy("key").agg(F.min("k").alias("keeper"), F.max("k").alias("last")).where("keeper < last").select("key", "keeper")
    single = windows.join(common.stage(first, "first-windows").hint("merge"), "key").where("k <> keeper")
    met = single.select("k", "i", "a", "b", "words", "keeper").unionByName(cut.where("keeper is not null").select("k", "i", "a", "b", "words", "keeper"))
    # a document's own words bound this list
    lists = met.groupBy("k").agg(F.collect_list(F.struct("i", "a", "b", "words", "keeper")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, found in zip(batch.column("k").to_pylist(), batch.column("found"), strict=True):
                place, start, stop, number, keeper = (found.values.field(c).to_numpy() for c in ("i", "a", "b", "words", "keeper"))
                order = np.argsort(place, kind="stable")
                # each row holds `number` windows from its place on
                after = np.maximum.accumulate((place + number)[order])
                for group in np.split(order, np.flatnonzero(place[order][1:] >= after[:-1] + PASSAGE_WORDS) + 1):
                    end = group[np.argmax((place + number)[group])]
                    names, where = np.unique(keeper[group], return_inverse=True)
                    often = np.bincount(where, number[group])
                    words = place[end] + number[end] - 1 - place[group[0]] + PASSAGE_WORDS
                    out.append((k, start[group[0]], stop[end], words, names[often.argmax()]))
            if out:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types, strict=True)], ["k", "a", "b", "words", "keeper"])

    return lists.mapInArrow(run, "k bigint, a int, b int, words int, keeper bigint")


def _near(met: DataFrame, cut: DataFrame) -> DataFrame:
    """The same columns for paragraphs whose exact Jaccard similarity to another is high enough."""
    pairs = met.where("k <> keeper").select("k", "i", "keeper", F.col("place").alias("j")).distinct()
    pairs = common.stage(pairs, "paragraph-pairs")
    lines = common.stage(cut.where("w is not null").select("k", "i", "a", "b", "words", "w").dropDuplicates(["k", "i"]), "paragraphs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(w.as_py(), "<u4").astype(np.uint64) for w in batch.column(c)] for c in ("w", "x"))
            keep = pa.array([jaccard(x, y) >= SIMILARITY for x, y in zip(one, two, strict=True)])
            yield batch.select(["k", "i", "keeper", "j"]).filter(keep)

    both = pairs.join(lines.select("k", "i", "w"), ["k", "i"]).join(lines.select(F.col("k").alias("keeper"), F.col("i").alias("j"), F.col("w").alias("x")), ["keeper", "j"])
    links = common.stage(both.select("k", "i", "keeper", "j", "w", "x").mapInArrow(verify, "k bigint, i int, keeper bigint, j int"), "paragraph-links")
    common.discard(pairs)
    node = F.xxhash64("k", "i")
    links = links.select(node.alias("a"), F.xxhash64("keeper", "j").alias("b"))
    # the leader has met all others of its bucket; those are compared with each other where they are not joined
    rest = met.where("k <> keeper or i <> place").select("key", node.alias("id"), F.col("k").alias("part"))
    rest = rest.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rest = common.stage(rest, "unsettled")
    more = blocks.settled(rest, lines.select(node.alias("id"), "w"), lambda words: common.shingles(words, WIDTH), SIMILARITY)
    roots = components(links.union(common.stage(more, "settled")))
    named = lines.drop("w").withColumn("node", node)
    # the roots themselves are members of their components too
    held = named.join(roots, "node").unionByName(named.join(roots.select(F.col("root").alias("node")).distinct(), "node").withColumn("root", F.col("node")))
    held = common.stage(held.select("k", "i", "a", "b", "words", "root"), "classes")
    common.discard(lines)
    keepers = common.stage(held.groupBy("root").agg(F.min("k").alias("keeper")), "keepers")
    return held.join(keepers, "root").where("k <> keeper").select("k", "a", "b", "words", "keeper")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, words, keeper_doc_id) of each passage to remove, places in characters.

    Paragraphs (lines of 50 words or more) that share a MinHash band are joined, compared by
    the exact Jaccard similarity of their five-word shingles, and clustered by connected
    components; the least document of a cluster keeps its paragraph. Passages that begin or
    end anywhere are found word by word: every run of 50 words that an earlier document has,
    case and outer punctuation ignored, to its true ends. Overlapping finds are joined. A
    key may be shared by any number of documents: each is compared with the key's least
    document, and paragraphs of a band that are then in several components are all compared
    with each other. Ties go to the least document, and there to the first paragraph.

    Null, empty and short texts have no passages, and rows with a null key are left out.
    Rows that repeat a key count as one document; repeats inside a document stay. No rows
    in, no rows out. Other columns are ignored.
    """
    table = common.stage(_table(docs, key, text), "blocks")
    met = _met(table)
    wanted = _wanted(table)
    common.discard(table)
    cut = _cut(docs, key, text, met, wanted)
    common.discard(wanted)
    near = _near(met, cut)
    common.discard(met)
    found = near.unionByName(_repeated(cut))
    lists = found.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("a", "b", "words", "keeper"))).alias("spans"))

    def join_spans(spans):
        empty = F.array().cast("array<struct<a:int,b:int,words:int,keeper:bigint>>")

        def step(done, new):
            last = F.element_at(done, -1)
            longer = F.struct(
                last["a"].alias("a"), F.greatest(last["b"], new["b"]).alias("b"),
                F.greatest(last["words"], new["words"]).alias("words"), F.least(last["keeper"], new["keeper"]).alias("keeper"),
            )
            meets = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] >= new["a"])
            return F.when(meets, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(new)))

        return F.aggregate(spans, empty, step)

    each = lists.select("k", F.explode(join_spans(F.col("spans"))).alias("s"))
    return each.select(
        F.col("k").alias("doc_id"), F.col("s.a").alias("start"), F.col("s.b").alias("end"), F.col("s.words").alias("words"),
        F.col("s.keeper").alias("keeper_doc_id"),
    )


def without_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """The rows of docs with repeated passages cut out of their texts, all columns in place.

    `size`, if there is such a column, holds the new number of characters. A document of
    which nothing but blanks is left goes; every other row stays.
    """
    spans = common.stage(repeated_passages(docs, key, text), "spans")
    lists = spans.groupBy(F.col("doc_id").alias("__doc")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__cuts"))
    joined = docs.join(common.stage(lists, "cuts"), F.col(key).cast("bigint") == F.col("__doc"), "left")
    kept = F.aggregate(
        F.col("__cuts"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda done, cut: F.struct(
            cut["end"].alias("at"), F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, cut["start"] - done["at"])).alias("out")
        ),
        lambda done: F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.length(text))),
    )
    changed = F.col("__cuts").isNotNull()
    out = joined.withColumn(text, F.when(changed, kept).otherwise(F.col(text)))
    if size in docs.columns:
        out = out.withColumn(size, F.when(changed, F.length(text).cast(dict(docs.dtypes)[size])).otherwise(F.col(size)))
    return out.where(~changed | (F.regexp_count(F.col(text), F.lit(r"\S")) > 0)).select(*docs.columns)
