"""Language identification by unigrams of vocabulary pieces, marginalised over all segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, keep_rows, map_texts, written

RUN = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Sign of a word's start in the vocabulary.
START = "▁"
#: Probability of a letter that the vocabulary lacks, the same in every language.
UNKNOWN = 1e-7
#: Documents for each language that training reads, about; documents whose words are scored at once; words kept scored.
TRAIN_DOCS, TOGETHER, KEPT_WORDS = 6000, 512, 500_000
#: Bytes of the table of kept words' scores at most; many languages keep fewer words.
KEPT_BYTES = 64 << 20
ROUNDS = 3
#: Signs whose probabilities stay above the least float, at ``UNKNOWN`` each; words' signs that are worked on at once.
SAFE, SIGNS = 40, 1 << 15


def vocabulary(path: str) -> list[str]:
    """The pieces of a SentencePiece model that lower-cased words can hold."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p.replace(START, "", 1).isalpha() and p == p.lower()})


def marked(word: str) -> str:
    """A run of letters, however long, marked as a word's start; empty if it has no letter."""
    letters = "".join(c for c in word if c.isalpha())
    return START + letters if letters else ""


@dataclass
class PieceIndex:
    """Finds the piece that each stretch of a word is, by 64-bit values of the pieces' beginnings, a length at a time."""

    pieces: list[str]

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        #: Positions worked on at once: with the pieces that reach beyond them, ``SAFE`` signs.
        self.segment = max(SAFE - self.longest, 1)
        self.mix = np.array([pow(0xD6E8FEB86659FD93, 2 * i + 1, 1 << 64) for i in range(self.longest)], np.uint64)
        place = {p: i for i, p in enumerate(self.pieces)}
        self.levels = []
        for k in range(1, self.longest + 1):
            begun = sorted((self._value(p), place.get(p, -1)) for p in {p[:k] for p in self.pieces if len(p) >= k})
            self.levels.append((np.array([v for v, _ in begun], np.uint64), np.array([i for _, i in begun], np.int64)))

    def _value(self, piece: str) -> int:
        return sum(ord(c) * int(m) for c, m in zip(piece, self.mix, strict=False)) & (1 << 64) - 1

    def hits(self, letters: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that start in the segment at ``low`` of words (sign, word), as (from, to, piece), and bounds by start.

        From and to are places (position in the segment, word) laid flat. A letter that is no piece counts as the piece
        after the last. Only stretches that begin some piece are lengthened.
        """
        n = letters.shape[1]
        here = letters[low : low + self.segment + self.longest - 1].ravel()
        live = np.nonzero(here[: self.segment * n])[0]
        value = here[live] * self.mix[0]
        sources, targets, found = [], [], []
        for k, (values, ids) in enumerate(self.levels):
            if k:
                inside = np.searchsorted(live, len(here) - k * n)
                live, value = live[:inside], value[:inside] + here[live[:inside] + k * n] * self.mix[k]
            if not len(live) or not len(values):
                break
            at = np.minimum(np.searchsorted(values, value), len(values) - 1)
            begins = values[at] == value
            piece = np.where(begins, ids[at], -1)
            if k == 0:
                sources.append(live)
                targets.append(live + n)
                found.append(np.where(piece < 0, len(self.pieces), piece))
            else:
                whole = piece >= 0
                sources.append(live[whole])
                targets.append(live[whole] + (k + 1) * n)
                found.append(piece[whole])
            live, value = live[begins], value[begins]
        if not sources:
            sources, targets, found = [live], [live + n], [np.full(len(live), len(self.pieces))]
        source = np.concatenate(sources)
        start = (source // n).astype(np.int16)
        order = np.argsort(start, kind="stable")
        bounds = np.searchsorted(start[order], np.arange(self.segment + 1))
        return source[order], np.concatenate(targets)[order], np.concatenate(found)[order], bounds


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sign, word) code points, zero beyond a word's end, and the words' lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    wide = int(sizes.max())
    letters = np.array(words, f"U{wide}").view(np.uint32).reshape(len(words), wide).T
    return np.ascontiguousarray(letters).astype(np.uint64), sizes


def _scaled(state: np.ndarray, longest: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The states of some positions with the greatest of each word as one, and the logarithms of what that took out."""
    state = state.reshape(longest, n, -1)
    most = state.max(axis=0)
    most[most == 0] = 1
    return (state / most).reshape(longest * n, -1), np.log(most)


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of words of like lengths, up to a few thousand at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    like = np.where(sizes <= SAFE, (sizes + 3) // 4, SAFE + np.log2(np.maximum(sizes, 1)) * 4).astype(np.int64)
    for size in np.unique(like):
        rows = np.nonzero(like == size)[0]
        yield from chunks(rows, max(1, min(4096, SIGNS // int(sizes[rows].max()))))


@dataclass
class Model:
    """Piece probabilities (piece, language); its size is bounded by the vocabulary and the number of languages."""

    pieces: list[str]
    languages: list[str]
    chance: np.ndarray

    def _tables(self) -> tuple[PieceIndex, np.ndarray]:
        """The index, and the pieces' probabilities with a last row for unknown letters, which no letter falls below."""
        if "_made" not in self.__dict__:
            table = np.vstack([self.chance, np.full((1, len(self.languages)), UNKNOWN)])
            single = [i for i, p in enumerate(self.pieces) if len(p) == 1]
            table[single] = np.maximum(table[single], UNKNOWN)
            self._made = PieceIndex(self.pieces), table
        return self._made

    def score(self, words: list[str]) -> np.ndarray:
        """(word, language) log probabilities of marked words: sums over all segmentations of each whole word.

        The forward state of the last positions is carried, scaled, from segment to segment of long words.
        """
        index, table = self._tables()
        out, longest = np.zeros((len(words), len(self.languages))), index.longest
        for rows in _by_length(words):
            letters, sizes = _letters([words[i] for i in rows])
            n, scale = len(rows), np.zeros((len(rows), len(self.languages)))
            state = np.ones((n, len(self.languages)))
            for low in range(0, len(letters), index.segment):
                alpha = _forward(index, n, index.hits(letters, low), state, lambda _, pieces: table[pieces])
                ends = np.nonzero((sizes > low) & (sizes <= low + index.segment))[0]
                out[rows[ends]] = np.log(alpha[(sizes[ends] - low) * n + ends]) + scale[ends]
                if low + index.segment < len(letters):
                    state, more = _scaled(alpha[index.segment * n :], longest, n)
                    scale += more
        return out

    def expected(self, words: list[str], language: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(piece, language) expected uses over all segmentations of words, each of one language and counted so often.

        Long words keep the forward state of each segment's start and are worked backwards from the last segment.
        """
        index, table = self._tables()
        longest, segment, width = index.longest, index.segment, len(self.languages)
        raw = np.vstack([self.chance, np.zeros((1, width))])
        uses = np.zeros(raw.size)
        for rows in _by_length(words):
            letters, sizes = _letters([words[i] for i in rows])
            lang, n = language[rows], len(rows)
            chance = lambda at, pieces, lang=lang, n=n: table[pieces, lang[at % n]][:, None]
            state, scale, total = np.ones((n, 1)), np.zeros((n, 1)), np.zeros(n)
            starts = []
            for low in range(0, len(letters), segment):
                starts.append((low, state, scale[:, 0].copy()))
                alpha = _forward(index, n, hits := index.hits(letters, low), state, chance)
                ends = np.nonzero((sizes > low) & (sizes <= low + segment))[0]
                total[ends] = np.log(alpha[(sizes[ends] - low) * n + ends, 0]) + scale[ends, 0]
                if low + segment < len(letters):
                    state, more = _scaled(alpha[segment * n :], longest, n)
                    scale += more
            last, after, back = starts[-1][0], np.zeros((longest * n, 1)), np.zeros(n)
            for low, state, scale_here in reversed(starts):
                if low < last:
                    alpha = _forward(index, n, hits := index.hits(letters, low), state, chance)
                source, target, piece, bounds = hits
                beta = np.concatenate([np.zeros(segment * n), after[:, 0]])
                ends = np.nonzero((sizes > low) & (sizes <= low + segment))[0]
                beta[(sizes[ends] - low) * n + ends] = 1
                through = chance(source, piece)[:, 0]
                for i in range(segment - 1, -1, -1):
                    if (a := bounds[i]) < (b := bounds[i + 1]):
                        beta[i * n : (i + 1) * n] += np.bincount(source[a:b] - i * n, through[a:b] * beta[target[a:b]], minlength=n)
                word = source % n
                weight = counts[rows] * np.exp(np.where(sizes > low, scale_here + back - total, 0))
                share = alpha[source, 0] * raw[piece, lang[word]] * beta[target] * weight[word]
                uses += np.bincount(piece * width + lang[word], share, minlength=len(uses))
                if low:
                    after, more = _scaled(beta[: longest * n], longest, n)
                    back += more[:, 0]
        return uses.reshape(raw.shape)[:-1]


def _forward(index: PieceIndex, n: int, hits: tuple, state: np.ndarray, chance) -> np.ndarray:
    """(position and word, language): probability of all segmentations up to each place of a segment and shortly after.

    ``state`` holds what segmentations from before the segment bring to its first positions, for ``n`` words.
    """
    source, target, piece, bounds = hits
    alpha = np.zeros(((index.segment + index.longest) * n, state.shape[1]))
    alpha[: len(state)] = state
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a < b:
            alpha[target[a:b]] += alpha[source[a:b]] * chance(source[a:b], piece[a:b])
    return alpha


class Scorer:
    """Sums of word scores for texts; remembers the scores of words seen, up to ``KEPT_WORDS`` and ``KEPT_BYTES``."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.most = min(KEPT_WORDS, max(120_000, KEPT_BYTES // (8 * max(1, len(model.languages)))))
        self.table = np.zeros((1 << 13, len(model.languages)))

    def _learn(self, words: set[str]) -> None:
        for some in chunks(list(words), 20_000):
            if len(self.known) + len(some) > self.most:
                raise OverflowError
            while len(self.known) + len(some) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            parts = [(i, p) for i, w in enumerate(some) if (p := marked(w))]
            total = np.zeros((len(some), self.table.shape[1]))
            if parts:
                total[[i for i, _ in parts]] = self.model.score([p for _, p in parts])
            first = len(self.known)
            self.table[first : first + len(some)] = total
            self.known.update(zip(some, range(first, first + len(some)), strict=True))

    def total(self, words: list[str]) -> np.ndarray:
        """Log probability of the words in each language."""
        sums = np.zeros(self.table.shape[1])
        for some in chunks(words, 100_000):
            try:
                self._learn(set(some).difference(self.known))
            except OverflowError:
                self.known.clear()
                self._learn(set(some))
            sums += self.table[np.fromiter(map(self.known.__getitem__, some), np.int64, len(some))].sum(axis=0)
        return sums

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [RUN.findall(t.lower()) if t else [] for t in texts]
        every = set().union(*words).difference(self.known)
        if len(every) + len(self.known) <= self.most:
            self._learn(every)
        tags, scores = [], []
        for some in words:
            if not self.model.languages or not any(any(map(str.isalpha, w)) for w in some):
                tags.append(UNDETERMINED)
                scores.append(0.0)
                continue
            sums = self.total(some)
            best = int(np.argmax(sums))
            tags.append(self.model.languages[best])
            scores.append(float(1 / np.exp(sums - sums[best]).sum()))
        return tags, scores


def _normalised(uses: np.ndarray) -> np.ndarray:
    uses = uses + 0.05
    return uses / uses.sum(axis=0)


def fit(docs: DataFrame, vocabulary_path: str, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """A model from the ``text`` and ``lang`` of ``docs``; rows where either is null teach nothing.

    Each language with more than ``train_docs`` documents gives a sample of about so many, drawn by a hash of the
    doc_id (of the text, if there is none); that bound is the only one. Word counts are made by Spark, and each round of expectation-maximisation is
    a job over them whose result is at most one row for each piece and language. Without a row the model knows no
    language and finds every text undetermined.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id" if "doc_id" in docs.columns else "text"), F.lit(1 << 20)).alias("draw")).filter("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    pieces = vocabulary(vocabulary_path)
    model = Model(pieces, languages, np.full((len(pieces), len(languages)), 1 / len(pieces)))
    if not languages:
        return model
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, int((1 << 20) * min(1, train_docs / sizes[lang])) + 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: Counter[tuple[str, str]] = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tally.update((lang, w) for w in RUN.findall(text.lower()))
            keys = list(tally)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([tally[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    words = rows.filter(F.col("draw") < share[F.col("lang")]).select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    place = {lang: i for i, lang in enumerate(languages)}

    def expect(batches: Iterator[pa.RecordBatch], now: Model) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(now.chance.shape)
        for batch in batches:
            parts = [(p, place[lang], n) for lang, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (p := marked(w))]
            if parts:
                uses += now.expected([p for p, _, _ in parts], np.array([g for _, g, _ in parts]), np.array([n for _, _, n in parts], float))
        piece, lang = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(uses[piece, lang])], names=["piece", "lang", "uses"])

    for _ in range(rounds):
        step = words.mapInArrow(lambda batches, now=model: expect(batches, now), "piece long, lang long, uses double")
        uses = np.zeros(model.chance.shape)
        for r in step.groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toLocalIterator():
            uses[r.piece, r.lang] = r.uses
        model = Model(pieces, languages, _normalised(uses))
    discard(words)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; ``score`` is the language's posterior under even priors.

    A null text or one without a letter is ``und`` with score 0. Ties go to the first language in order. Repeated rows
    come back repeated, further columns are ignored, and an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(low, TOGETHER)
                tags, scores = scorer.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tags, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.35) -> DataFrame:
    """``docs`` without texts that are undetermined or whose language is less sure than ``least``; all columns as they were.

    Null and empty texts and those without a letter go; every other row is judged alone by its whole text, so repeated
    rows and null doc_ids stay or go alike. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge_of():
        scorer = Scorer(shared.value)
        return lambda texts: [tag != UNDETERMINED and score >= least for tag, score in zip(*scorer.predict(texts), strict=True)]

    return keep_rows(docs, judge_of, TOGETHER)
