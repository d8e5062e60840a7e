"""Language of texts by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.llm import common

HIDDEN = 16
DOCS_PER_LANGUAGE = 400  # about so many texts of each language are learned from
WORDS_PER_DOC = 150  # words of each, chosen by hash from the whole text
LANGUAGES = 500  # more distinct values are refused
PIECE = 24  # most bytes that the network reads at once
LETTERS = re.compile(r"[^\W\d_]+")
NONE = "und"
CACHE_WORDS = 400_000  # words are letters of one run; the table of their labels is emptied at this size, which changes no result


def pieces(word: str) -> list[bytes]:
    """A word between blanks, cut so that no piece has more than PIECE bytes."""
    data = b" " + word.encode("utf-8", "replace") + b" "
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


class Network:
    """Two gated recurrent layers, one in each direction, and a softmax at every byte."""

    def __init__(self, languages: list[str], seed: int = 11):
        draw = np.random.default_rng(seed)
        k, h = len(languages), HIDDEN
        self.languages = languages
        self.p = {"out": draw.normal(0, 0.2, (2 * h, k)).astype("f4"), "bias": np.zeros(k, "f4")}
        for side in "fb":
            self.p["x" + side] = draw.normal(0, 0.3, (256, 3 * h)).astype("f4")
            self.p["u" + side] = draw.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype("f4")

    def layer(self, data: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States at every byte; data is (bytes, texts), read in its order."""
        x, u, h = self.p["x" + side], self.p["u" + side], HIDDEN
        state = np.zeros((data.shape[1], h), "f4")
        states = np.empty((*data.shape, h), "f4")
        for t, row in enumerate(data):
            inner, lifted = x[row], state @ u
            gates = 1 / (1 + np.exp(-(inner[:, : 2 * h] + lifted[:, : 2 * h])))
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(inner[:, 2 * h :] + r * lifted[:, 2 * h :])
            if keep is not None:
                keep.append((state, z, r, new, lifted[:, 2 * h :]))
            state = new + z * (state - new)
            states[t] = state
        return states

    def log_probabilities(self, data: np.ndarray) -> np.ndarray:
        """(bytes, texts, languages) for texts of one length."""
        both = np.concatenate([self.layer(data, "f"), self.layer(data[::-1], "b")[::-1]], 2)
        raw = both @ self.p["out"] + self.p["bias"]
        raw -= raw.max(2, keepdims=True)
        return raw - np.log(np.exp(raw).sum(2, keepdims=True))

    def slopes(self, data: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Loss over every byte and its gradient, by backpropagation through time."""
        kept = {"f": [], "b": []}
        both = np.concatenate([self.layer(data, "f", kept["f"]), self.layer(data[::-1], "b", kept["b"])[::-1]], 2)
        raw = both @ self.p["out"] + self.p["bias"]
        raw -= raw.max(2, keepdims=True)
        share = np.exp(raw)
        share /= share.sum(2, keepdims=True)
        n, cols = data.size, np.arange(data.shape[1])
        loss = -np.log(share[:, cols, labels] + 1e-9).mean()
        error = share.copy()
        error[:, cols, labels] -= 1
        error /= n
        out = {"out": np.einsum("tbh,tbk->hk", both, error), "bias": error.sum((0, 1))}
        back = error @ self.p["out"].T
        h = HIDDEN
        for side, own, rows in (("f", back[:, :, :h], data), ("b", back[::-1, :, h:], data[::-1])):
            u = self.p["u" + side]
            slope_x, slope_u = np.zeros_like(self.p["x" + side]), np.zeros_like(u)
            carry = np.zeros((data.shape[1], h), "f4")
            for t in range(len(data) - 1, -1, -1):
                state, z, r, new, lifted = kept[side][t]
                total = own[t] + carry
                d_new = total * (1 - z) * (1 - new * new)
                d_z = total * (state - new) * z * (1 - z)
                d_r = d_new * lifted * r * (1 - r)
                inner = np.concatenate([d_z, d_r, d_new], 1)
                np.add.at(slope_x, rows[t], inner)
                inner[:, 2 * h :] *= r
                slope_u += state.T @ inner
                carry = total * z + inner @ u.T
            out["x" + side], out["u" + side] = slope_x, slope_u
        return float(loss), out


def fit(texts: list[str], labels: list[str], steps: int = 900, size: int = 256, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam over batches of pieces of one length, drawn evenly from the languages."""
    languages = sorted(set(labels))
    model = Network(languages)
    if len(languages) < 2:
        return model
    draw = np.random.default_rng(seed)
    pools: list[dict[int, np.ndarray]] = []
    for language in languages:
        own: dict[int, list[bytes]] = {}
        for text, label in zip(texts, labels, strict=True):
            if label == language:
                for word in text.split(" "):
                    for piece in pieces(word):
                        own.setdefault(len(piece), []).append(piece)
        pools.append({n: np.frombuffer(b"".join(v), np.uint8).reshape(-1, n) for n, v in own.items()})
    weight: dict[int, float] = {}
    for pool in pools:
        total = sum(len(v) for v in pool.values())
        for n, v in pool.items():
            weight[n] = weight.get(n, 0) + len(v) * n / max(1, total)
    lengths = np.array(sorted(weight))
    chance = np.array([weight[n] for n in lengths])
    chance = chance / chance.sum()
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        n = int(draw.choice(lengths, p=chance))
        parts, marks = [], []
        for number, pool in enumerate(pools):
            if n in pool:
                # as often as pieces of this length are in the language
                share = len(pool[n]) / sum(len(v) for v in pool.values())
                take = max(1, round(size * share / sum(len(q.get(n, ())) / sum(len(v) for v in q.values()) for q in pools)))
                parts.append(pool[n][draw.integers(0, len(pool[n]), take)])
                marks.append(np.full(take, number))
        _, slope = model.slopes(np.concatenate(parts).T, np.concatenate(marks))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in slope.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            model.p[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype("f4")
    return model


class WordLabels(dict):
    """word -> row of the table of its labels, summed over its bytes; words of a batch are read together."""

    def __init__(self, model: Network):
        super().__init__()
        self.model = model
        self.table = np.zeros((0, 2 * len(model.languages) + 1))

    def learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self)
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            self.table = self.table[:0]
            new = sorted(words)
        k = len(self.model.languages)
        sums = np.zeros((len(new), 2 * k + 1))
        by: dict[int, tuple[list[int], list[bytes]]] = {}
        for number, word in enumerate(new):
            for piece in pieces(word):
                own = by.setdefault(len(piece), ([], []))
                own[0].append(number)
                own[1].append(piece)
        for n, (numbers, parts) in by.items():
            for i in range(0, len(parts), 8192):
                data = np.frombuffer(b"".join(parts[i : i + 8192]), np.uint8).reshape(-1, n).T
                logs = self.model.log_probabilities(data)
                own = np.concatenate([logs.sum(0), np.exp(logs).sum(0), np.full((data.shape[1], 1), n)], 1)
                np.add.at(sums, numbers[i : i + 8192], own)
        for number, word in enumerate(new, len(self.table)):
            self[word] = number
        self.table = np.concatenate([self.table, sums])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """A network fitted on the driver to words of about DOCS_PER_LANGUAGE texts of each language.

    Learns only from rows with a text, a language and a key checksum whose rest by 4 is not 2.
    """
    rows = docs.select(
        F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"),
        common.checksum_rest(key, 4).alias("rest"),
    ).where("l is not null and t is not null and (rest is null or rest <> 2)")
    counts = rows.groupBy("l").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return Network([])
    shares = F.create_map(*[F.lit(x) for c in counts for x in (c["l"], min(1.0, DOCS_PER_LANGUAGE / c["count"]))])
    drawn = rows.where(F.pmod(F.xxhash64("k", F.length("t")), F.lit(1_000_000)) < shares[F.col("l")] * 1_000_000)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in common.text_rows(batches, "t"):
            texts = []
            for t in own:
                found = LETTERS.findall(t.lower())
                if len(found) > WORDS_PER_DOC:
                    order = sorted(range(len(found)), key=lambda i: xxhash.xxh32_intdigest(str(i)))
                    found = [found[i] for i in order[:WORDS_PER_DOC]]
                texts.append(" ".join(found))
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(texts, "string"), part.column("l")], ["k", "t", "l"])

    sample = drawn.limit(2 * DOCS_PER_LANGUAGE * len(counts)).mapInArrow(words, "k string, t string, l string").where("t <> ''")
    found = sample.toPandas().sort_values(["k", "t"])
    return fit(list(found.t), list(found.l))


def detect(docs: DataFrame, model: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row, from every letter of its text.

    Each byte of each word is labelled by the network, which reads the word in both
    directions; a text's language has the largest mean log-probability over these bytes, and
    its score is the mean probability. Words that repeat are read once and counted.

    A null text, a text without letters, and any text if no language was learned is `und`
    with score 0. Ties go to the first language by name. Repeated rows have equal results;
    a null key stays null and is not held out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, k = WordLabels(shared.value), len(shared.value.languages)
        for part, own in common.text_rows(batches, "t"):
            found = [LETTERS.findall(t.lower()) if t else [] for t in own]
            # superscripts and the like are word characters, but no letters
            found = [w if any(c.isalpha() for x in w for c in x) else [] for w in found]
            best, score = [NONE] * len(own), np.zeros(len(own))
            if k:
                for i in range(0, len(found), 500):
                    labels.learn({w for words in found[i : i + 500] for w in words})
                    for j, words in enumerate(found[i : i + 500], i):
                        if words:
                            total = labels.table[np.fromiter(map(labels.__getitem__, words), np.int64, len(words))].sum(0)
                            at = int(total[:k].argmax())
                            best[j], score[j] = shared.value.languages[at], min(1.0, total[k + at] / total[-1])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(best, "string"), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    narrow = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.coalesce(common.checksum_rest(key, 4) == 2, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("t"),
    )
    return narrow.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
