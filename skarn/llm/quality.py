"""Quality rules by weak supervision: rules vote or abstain, and expectation-maximisation weighs them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
ASCII_LETTERS = bytes([*range(65, 91), *range(97, 123)])
UPPER = bytes(range(65, 91))
ABOVE_ASCII = bytes(range(128, 256))
#: Frequent function words of some languages.
FUNCTION_WORDS = frozenset(
    b"a an and are as at be by for from in is it of on or that the this to was with "
    b"au avec ce dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    b"auf aus das dem den der die ein eine ich im ist mit nicht sich sie und von zu "
    b"al como con del el lo los las mi no para por se su una y".split()
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_letters", "n_ascii_letters", "n_upper", "n_function_words")
WINDOW = 3
#: Posterior probability of good quality from which a document is kept.
LEAST = 0.5


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of so many words that the text holds twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    code = ids[:n]
    for k in range(1, window):
        if (int(code.max()) + 1) * len(place) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(place) + ids[k : k + n]
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    twice, inside = count[at] > 1, np.zeros(len(words), bool)
    for k in range(window):
        inside[k : k + n] |= twice
    return int(inside.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The numbers named in ``COUNTS``; all zero for a null or empty text."""
    if not text:
        return (0,) * len(COUNTS)
    coded = text.encode()
    words = coded.split()
    lines = [s for s in text.split("\n") if s.strip(SPACE)]
    letters = len(coded) - len(coded.translate(None, ASCII_LETTERS))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
        sum(s.rstrip(SPACE + "\"')»”").endswith((".", "!", "?", "…", ":", ";")) for s in lines),
        letters + len(text) - len(coded.translate(None, ABOVE_ASCII)),
        letters,
        len(coded) - len(coded.translate(None, UPPER)),
        sum(map(FUNCTION_WORDS.__contains__, coded.lower().split())),
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, good where ``good`` does, and abstains elsewhere; both are SQL over the counts."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "n_words > 0 and word_chars between 3 * n_words and 9 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words and n_words > 0"),
    Rule("repeated_lines", "5 * n_dup_lines > n_lines", "n_dup_lines = 0 and n_lines >= 3"),
    Rule("repeated_words", "5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words and n_words >= 20"),
    Rule("function_words", "n_words >= 20 and 50 * n_function_words < n_words", "10 * n_function_words > n_words"),
    Rule("letters", "10 * n_letters < 7 * word_chars", "100 * n_letters > 90 * word_chars and n_words > 0"),
    Rule("closed_lines", "n_lines >= 3 and 10 * n_closed_lines < 2 * n_lines", "10 * n_closed_lines >= 7 * n_lines and n_lines > 0"),
    Rule("capitals", "n_ascii_letters >= 20 and 10 * n_upper > 4 * n_ascii_letters", "10 * n_upper < 2 * n_ascii_letters"),
)


def count_words(docs: DataFrame) -> DataFrame:
    """doc_id and the numbers named in ``COUNTS`` for every whole text."""
    names = ["doc_id", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([counts(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in made.T)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def estimate(votes: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Accuracies (2, rule), share of good documents, and posterior of each row of ``votes`` (1, -1, or 0: abstains).

    A rule that votes is right on good documents with its first accuracy and on bad ones with its second, given the
    document's unseen quality; rules err independently, and abstaining tells nothing. A rule that hardly ever votes bad
    so carries little weight when it votes good. Each rule is held to be better than chance, and good documents to be
    the majority, so that the classes keep their meaning.
    """
    accuracy, good = np.tile([[0.9], [0.6]], votes.shape[1]), 0.8
    posterior = np.zeros(len(votes))
    plus, minus = votes > 0, votes < 0
    for _ in range(rounds):
        for_good = plus @ np.log(accuracy[0] / (1 - accuracy[1])) + minus @ np.log((1 - accuracy[0]) / accuracy[1])
        posterior = 1 / (1 + np.exp(-(for_good + np.log(good / (1 - good)))))
        new = np.empty_like(accuracy)
        for i, (mass, right) in enumerate(((posterior, plus), ((1 - posterior), minus))):
            mass = (mass * weights)[:, None]
            new[i] = ((mass * right).sum(axis=0) + 3) / ((mass * (plus | minus)).sum(axis=0) + 5)
        new[0] = np.clip(new[0], 0.5, 0.99)
        new[1] = np.clip(new[1], np.maximum(1.02 - new[0], 0.02), 0.99)
        good = float(np.clip((posterior * weights).sum() / max(weights.sum(), 1), 0.5, 0.95))
        if np.abs(new - accuracy).max() < 1e-9:
            break
        accuracy = new
    return accuracy, good, posterior


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = LEAST) -> DataFrame:
    """doc_id, the counts, ``votes`` (a sign for each rule: +, - or 0), ``posterior`` and ``kept`` for every whole text.

    Counts are made once and written. What the estimation gathers is one row for each pattern of votes, at most
    3 to the number of rules at any input size; the same table goes back by a broadcast join. A null or empty text has
    zero counts, and rules that divide by them abstain or vote bad as their SQL says. Repeated rows come back repeated,
    further columns are ignored, and an empty table gives an empty table.
    """
    sign = [F.when(F.expr(r.bad), "-").when(F.expr(r.good), "+").otherwise("0") for r in rules]
    counted = written(count_words(docs).withColumn("votes", F.concat(*sign)), "counts")
    patterns = counted.groupBy("votes").count().collect()
    votes = np.array([[{"+": 1, "-": -1}.get(c, 0) for c in r[0]] for r in patterns], float).reshape(-1, len(rules))
    _, _, posterior = estimate(votes, np.array([r[1] for r in patterns], float))
    rows = [(r[0], float(p)) for r, p in zip(patterns, posterior, strict=True)]
    found = F.broadcast(docs.sparkSession.createDataFrame(rows, "votes string, posterior double"))
    return counted.join(found, "votes").withColumn("kept", F.col("posterior") >= least)
