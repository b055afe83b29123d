"""Language ID by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability
of a word (with a word-start mark) is the sum over all its segmentations into pieces of the
product of their probabilities, by a forward algorithm; a text's is the product over its words.
The probabilities are trained by expectation-maximisation over the segmentations of all words
of a bounded sample of labelled rows; each round is a Spark job that sums expected counts, so
only pieces by languages reach the driver.

The forward and backward steps run over many words of one length at once, as arrays. A task takes
the distinct words of a batch by dictionary encoding and remembers the log probabilities of words.

Rows: a text that is null or holds no letter is `und` with score 0; so is every text if there
is nothing to learn from. Rows that repeat are predicted each; ties between languages go to the
name that sorts first. Words of more than LONG letters teach nothing when pieces are fitted, a bound on
the sample that is learned from; all words of a text are scored. Columns of the input are kept, but for lang_pred and score, which replace
columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from hearthline.llm import hashing
from hearthline.llm.memory import released
from hearthline.storage import forget, written

MARK = "▁"  # the vocabulary's word start
NO_WORD = r"[^\pL]+"
CACHED = 1 << 22  # letters of the words that a task remembers, and 40 for each word
SLICE = 1 << 21  # bytes of text that are looked at together, at least one text
UNKNOWN = 1e-8  # of a letter that is no piece
LONG = 64  # letters; longer words are summed each by itself
STATES = 1 << 17  # cells for the states of words that are summed together
SMALL = 1e-100  # probabilities below this are scaled up


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(vocabulary: str) -> set[str]:
    """The pieces that lower-case words can be cut into."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = (model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    return {x for x in found if x.strip(MARK).isalpha() and MARK not in x[1:] and x == x.lower()} | {MARK}


class Pieces:
    """The pieces by number, as a trie whose edges are the sorted numbers state * letters + letter."""

    def __init__(self, names: list[str]):
        self.names = names
        self.longest = max(map(len, names), default=1)
        self.letters = np.array(sorted({ord(c) for x in names for c in x}), np.uint32)
        code = {chr(c): k + 1 for k, c in enumerate(self.letters)}
        self.base = len(code) + 1
        states: dict[tuple[int, int], int] = {}
        piece = [-1]
        for number, name in enumerate(names):
            at = 0
            for c in name:
                key = (at, code[c])
                if key not in states:
                    states[key] = len(piece)
                    piece.append(-1)
                at = states[key]
            piece[at] = number
        keys = np.array([a * self.base + c for a, c in states], np.int64)
        order = np.argsort(keys)
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.edges, self.targets = keys[order], np.fromiter(states.values(), np.int64, len(states))[order]
        self.piece = np.array(piece, np.int64)
        # hashed places of the edges: an edge stands at most `probes` cells after its own
        self.table = np.full((1 << bits) + 64, -1, np.int64)
        self.value = np.zeros((1 << bits) + 64, np.int64)
        self.probes = 0
        for key, target, at in zip(self.edges.tolist(), self.targets.tolist(), self._cell(self.edges).tolist(), strict=True):
            k = at
            while self.table[k] >= 0:
                k += 1
            self.table[k], self.value[k] = key, target
            self.probes = max(self.probes, k - at + 1)

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The states after one more letter; -1: no piece goes on so."""
        keys = states * self.base + letters
        at = self._cell(keys)
        out = np.where(self.table[at] == keys, self.value[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.table[at] >= 0))
        for k in range(1, self.probes):
            if not len(open_):
                break
            found = self.table[at[open_] + k]
            hit = found == keys[open_]
            out[open_[hit]] = self.value[at[open_[hit]] + k]
            open_ = open_[~hit & (found >= 0)]
        return out

    def codes(self, words: list[str]) -> np.ndarray:
        """Words of one length, with their mark, as numbers of letters: (words, length); 0: in no piece."""
        points = np.array([MARK + x for x in words]).view(np.uint32).reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, 0).astype(np.int64)

    def lattice(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, words, pieces) of the segments of words that are pieces, by end and then length."""
        n, m = codes.shape
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for begin in range(m):
            rows, states = np.arange(n), np.zeros(n, np.int64)
            for end in range(begin + 1, min(m, begin + self.longest) + 1):
                states = self.step(states, codes[rows, end - 1])
                alive = states >= 0
                rows, states = rows[alive], states[alive]
                if not len(rows):
                    break
                number = self.piece[states]
                named = number >= 0
                if named.any():
                    found[begin, end] = rows[named], number[named]
        for begin, end in sorted(found, key=lambda x: (x[1], -x[0])):
            yield begin, end, *found[begin, end]


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    prob: np.ndarray  # pieces x languages


def forward(words: list[str], pieces_: Pieces, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Of words of one length: (states x words x languages, the logarithms of their scales by words
    and languages, the lattice). The sum over all segmentations is the last state times its scale."""
    codes = pieces_.codes(words)
    n, m = codes.shape
    ahead = np.zeros((m + 1, n, prob.shape[1]))
    ahead[0] = 1.0
    scale = np.zeros((n, prob.shape[1]))
    lattice = list(pieces_.lattice(codes))
    k = 0
    for end in range(1, m + 1):
        reached = np.zeros(n, bool)
        while k < len(lattice) and lattice[k][1] == end:
            begin, _, rows, number = lattice[k]
            if len(rows) == n:
                ahead[end] += ahead[begin] * prob[number]
                reached[:] = True
            else:
                ahead[end, rows] += ahead[begin, rows] * prob[number]
                reached[rows] = True
            k += 1
        if not reached.all():  # a letter that no piece ends with
            ahead[end, ~reached] = ahead[end - 1, ~reached] * UNKNOWN
        low = ahead[end] < SMALL
        if low.any():
            first = max(0, end - pieces_.longest)
            ahead[first : end + 1, low] *= 1 / SMALL
            scale[low] += np.log(SMALL)
    return ahead, scale, lattice


def log_probabilities(words: list[str], model: Model) -> np.ndarray:
    """words x languages: the log of the sum over segmentations of each word."""
    out = np.zeros((len(words), len(model.languages)))
    for at in _by_length(words):
        ahead, scale, _ = forward([words[k] for k in at], model.pieces, model.prob)
        out[at] = np.log(np.maximum(ahead[-1], 1e-300)) + scale
    return out


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """The places of words of one length, as many as may be summed together."""
    lens = np.array(list(map(len, words)), np.int64)
    order = np.argsort(lens, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lens[order])) + 1) if len(order) else []:
        n = max(1, STATES // (int(lens[group[0]]) + 2))
        for lo in range(0, len(group), n):
            yield group[lo : lo + n]


def long_word(word: str, model: Model) -> np.ndarray:
    """As log_probabilities, of one word of any length, in memory that doesn't grow with it."""
    names, longest = {x: k for k, x in enumerate(model.pieces.names)}, model.pieces.longest
    s = MARK + word
    ahead = [np.ones(len(model.languages))]  # the last `longest` states
    scale = np.zeros(len(model.languages))
    for j in range(1, len(s) + 1):
        total = None
        for back in range(1, len(ahead) + 1):
            k = names.get(s[j - back : j])
            if k is not None:
                part = ahead[-back] * model.prob[k]
                total = part if total is None else total + part
        ahead.append(ahead[-1] * UNKNOWN if total is None else total)
        low = ahead[-1] < SMALL
        if low.any():
            ahead = [np.where(low, x / SMALL, x) for x in ahead]
            scale += np.where(low, np.log(SMALL), 0.0)
        del ahead[:-longest]
    return np.log(np.maximum(ahead[-1], 1e-300)) + scale


def _expected(shared):
    """The expected uses of pieces by language, over all segmentations of this task's words."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_, prob = shared.value
        gained = np.zeros_like(prob)
        for batch in batches:
            words, langs, counts = batch.column("word").to_pylist(), np.asarray(batch.column("k")), np.asarray(batch.column("n"))
            for at in _by_length(words):
                if len(words[at[0]]) > LONG:
                    continue  # no use of a piece in words this long tells a language
                ahead, _, lattice = forward([words[k] for k in at], pieces_, prob)
                own, rows_all = langs[at], np.arange(len(at))
                back = np.zeros(ahead.shape[:2])
                back[-1] = 1.0
                whole = ahead[-1, rows_all, own]
                unit = np.where(whole > SMALL, counts[at] / np.maximum(whole, SMALL), 0.0)
                for begin, end, rows, number in reversed(lattice):
                    p = prob[number, own[rows]]
                    np.add.at(gained, (number, own[rows]), unit[rows] * ahead[begin, rows, own[rows]] * p * back[end, rows])
                    back[begin, rows] += p * back[end, rows]
        number, k = np.nonzero(gained)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(k), pa.array(gained[number, k])], names=["piece", "k", "used"])

    return run


def train(labelled: DataFrame, vocabulary: str | None = None, docs_per_language: int = 1_000, rounds: int = 2, prior: float = 50.0) -> Model:
    """labelled: doc_id, text, lang. About docs_per_language rows of each language are taken, by
    a hash; of these all words count."""
    usable = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    found = Pieces(sorted(pieces(vocabulary or default_vocabulary())))
    if not languages:
        return Model([], found, np.zeros((len(found.names), 0)))
    # one row for each language
    chosen = labelled.sparkSession.createDataFrame([(x, k, min(1.0, docs_per_language / counts[x])) for k, x in enumerate(languages)], "lang string, k int, share double")
    sample = usable.join(F.broadcast(chosen), "lang").where("pmod(xxhash64(doc_id, text), 1000000) < share * 1000000")
    words = sample.select("k", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("k", "word").agg(F.count("*").alias("n"))
    words = written(words, "words")
    prob = np.full((len(found.names), len(languages)), 1.0 / len(found.names))
    for _ in range(rounds):
        shared = labelled.sparkSession.sparkContext.broadcast((found, prob))
        used = words.mapInArrow(_expected(shared), "piece long, k long, used double").groupBy("piece", "k").agg(F.sum("used").alias("used"))
        expected = np.zeros_like(prob)
        for r in used.collect():  # pieces by languages
            expected[r["piece"], r["k"]] = r["used"]
        shared.destroy()
        pooled = expected.sum(1, keepdims=True) + 0.01
        prob = (expected + prior * pooled / pooled.sum()) / (expected.sum(0) + prior)
    forget(words)
    return Model(languages, found, prob)


class _Scores:
    """The log probabilities of words, remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.rows = np.zeros((0, len(self.model.languages)))

    def of(self, words: list[str]) -> np.ndarray:
        """words x languages; words are distinct."""
        if self.held > CACHED:
            self.clear()
        get = self.known.get
        at = np.array([get(x, -1) for x in words], np.int64)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.rows[at]
        names = [words[k] for k in new]
        short = np.array([len(x) <= LONG for x in names])
        scores = np.zeros((len(new), self.rows.shape[1]))
        scores[short] = log_probabilities([x for x, s in zip(names, short, strict=True) if s], self.model)
        for k in np.flatnonzero(~short):
            scores[k] = long_word(names[k], self.model)
        out = np.zeros((len(words), self.rows.shape[1]))
        out[at >= 0], out[new] = self.rows[at[at >= 0]], scores
        kept = [x for x in names if len(x) <= LONG]
        self.known.update(zip(kept, range(len(self.known), len(self.known) + len(kept)), strict=True))
        self.held += sum(map(len, kept)) + 40 * len(kept)
        self.rows = np.concatenate([self.rows, scores[short]])
        return out


def _predict(shared, text_at: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        scores = _Scores(model)
        for batch in batches:
            for offset, part in hashing.slices(batch.column(text_at), SLICE):
                # pyarrow's patterns know Unicode letters
                split = pc.split_pattern_regex(pc.utf8_lower(part), NO_WORD)
                text, words = np.asarray(pc.list_parent_indices(split)), pc.list_flatten(split)
                full = np.asarray(pc.not_equal(words, ""), bool)
                text, coded = text[full], words.filter(pa.array(full)).dictionary_encode()
                names, values = np.full(len(part), "und", object), np.zeros(len(part))
                if len(text) and model.languages:
                    own = scores.of(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
                    starts = np.flatnonzero(np.diff(text, prepend=-1))
                    total = np.add.reduceat(own, starts)
                    best = total.argmax(1)
                    names[text[starts]] = np.array(model.languages, object)[best]
                    values[text[starts]] = 1 / np.exp(np.maximum(total - total[np.arange(len(best)), best][:, None], -700.0)).sum(1)
                rest = batch.slice(offset, len(part))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(names, pa.string()), pa.array(values, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, the probability of that language given equal priors."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predict(shared, docs.columns.index("text")), schema)
