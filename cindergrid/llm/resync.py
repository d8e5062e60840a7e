"""Token counts of texts of any length: huge ones are encoded in overlapping chunks that are spliced."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import common
from cindergrid.llm.tokens import ChunkIds, default_vocabulary

HUGE = 32_768  # characters of the longest text that is one chunk
CHUNK = 16_384  # characters of a chunk of longer ones
OVERLAP = 512  # of them shared with the chunk before, at first
LIMIT = 2048

#: One blank between two other characters. No piece reaches over its left side.
BLANK = re.compile(r"(?<=\S) (?=\S)")


class Window:
    """A chunk of a text with its ids, and which of them is the first that counts."""

    def __init__(self, coder: Resynchroniser, text: str, start: int, end: int, first: int = 0):
        self.start, self.end, self.first = start, end, first
        self.encoding = coder.tokenizer.encode(text[start:end], add_special_tokens=False)
        self.ids = self.encoding.ids

    def boundary(self, place: int) -> tuple[int, int, int] | None:
        """(number of the first id after the blank at `place`, end of the id before, start of that id), if no id holds both sides."""
        before = self.encoding.char_to_token(place - 1 - self.start)
        after = self.encoding.char_to_token(place + 1 - self.start)
        if before is None or after is None or after != before + 1:
            return None
        end, start = self.encoding.token_to_chars(before)[1] + self.start, self.encoding.token_to_chars(after)[0] + self.start
        return (after, end, start) if end <= place <= start else None


class Resynchroniser:
    """Ids of a whole text from its overlapping chunks.

    A boundary counts as proven when a blank stands alone between two other characters, so
    that no piece of the vocabulary's rule reaches over it whatever stands around (checked
    once for the vocabulary, with and without the text before), when it is farther from
    either end of the overlap than the longest special token, and when both chunks have
    the same id at the same place on each side of it.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, huge: int = HUGE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.margin = max(map(len, added), default=0) + 1
        self.chunk, self.overlap = max(chunk, 4 * self.margin), max(overlap, 2 * self.margin + 2)
        self.chunk = max(self.chunk, 2 * self.overlap)
        self.huge = max(huge, self.chunk)
        if any(re.search(r"\s", a) for a in added) or any(
            self.whole(one + two) != self.whole(one) + self.whole(two)
            for one, two in (("on", " a"), ("tion.", " 'S'"), ("1", " 2"), ("été", " -x"), ("'", " s"), ("日本", " 語"))
        ):
            raise ValueError("pieces of the vocabulary must not reach from a word over the blank after it")

        try:
            self.words = ChunkIds(path)
        except ValueError:  # its pieces hold white space
            self.words = None

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        return [i for window, last in self.windows(text) for i in window.ids[window.first : last]]

    def count(self, text: str) -> int:
        """Tokens of a text; one of a single chunk is read through the cache of white-space separated chunks, if the vocabulary has one."""
        if len(text) > self.huge:
            return sum(last - window.first for window, last in self.windows(text))
        return len(self.words.ids(text) if self.words is not None else self.whole(text))

    def windows(self, text: str) -> Iterator[tuple[Window, int]]:
        """Chunks in order, each with the number of its last id; ids from `first` to there make up the text.

        Where the overlap has no proven boundary it is doubled; where it has become the whole
        chunk before, that chunk is doubled. So a text without blanks ends as one chunk.
        """
        size = len(text)
        own = Window(self, text, 0, min(size, self.chunk))
        while own.end < size:
            end, width, spliced = min(size, own.end + self.chunk - self.overlap), self.overlap, None
            while spliced is None:
                start = max(own.start, own.end - width)
                places = [m.start() for m in BLANK.finditer(text, start + self.margin, own.end - self.margin)]
                if places:
                    spliced = self._splice(own, Window(self, text, start, end), places)
                if start == own.start:
                    break
                width *= 2
            if spliced is None:
                own = Window(self, text, own.start, min(size, 2 * own.end - own.start), own.first)
            else:
                last, following = spliced
                yield own, last
                own = following
        yield own, len(own.ids)

    def _splice(self, one: Window, two: Window, places: list[int]) -> tuple[int, Window] | None:
        for place in reversed(places):
            a, b = one.boundary(place), two.boundary(place)
            if a is None or b is None or a[1:] != b[1:] or a[0] < one.first:
                continue
            i, j = a[0], b[0]
            if one.ids[i - 1 : i + 1] == two.ids[j - 1 : j + 1]:
                two.first = j
                return i, two
        return None


def count_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
    limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, huge: int = HUGE, with_ids: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row (and input_ids, if asked for).

    Counts are those of the vocabulary's own library over the whole text, without added
    special tokens; strings of special tokens inside a text become those, as is the
    library's default. Texts of up to `chunk` characters are encoded whole, longer ones in
    chunks that overlap (`Resynchroniser`), so that memory does not grow with a text; a
    stretch without a lone blank is encoded in one piece. The vocabulary is a `tokenizers`
    file whose pieces do not reach over a blank after a word.

    A null text is an empty one and has no tokens; a null key stays null; repeated rows are
    counted each; other columns are ignored; an empty table gives no rows. No shuffle.
    """
    path = vocabulary or default_vocabulary()
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"] + ["input_ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Resynchroniser(path, chunk, overlap, huge)
        for part, texts in common.text_rows(batches, "t"):
            found = [coder.ids(t or "") if with_ids else coder.count(t or "") for t in texts]
            counts = [len(f) for f in found] if with_ids else found
            columns = [part.column("k"), part.column("b"), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            if with_ids:
                columns.append(pa.array(found, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    sized = narrow.select("k", F.coalesce(F.octet_length("t"), F.lit(0)).cast("bigint").alias("b"), "t")
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean" + ", input_ids array<int>" * with_ids
    return sized.mapInArrow(run, schema)
