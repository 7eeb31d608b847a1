"""A linear-chain conditional random field over the words of sentences, in numpy.

A word's features are its affixes, its character bigrams and trigrams, the word itself, and for each label whether a learned
lexicon gives the word to it; they are hashed into a table of fixed size. Transitions between the labels of neighbours
are learned with the feature weights, by Adam on the likelihood of the training sentences; some of these are joined from
two sentences of different labels, so that moves from label to label are seen too. Forward-backward gives each word's label
probabilities. Sentences of a batch go through it side by side, longest first. Learning works on a part of the sentences at
a time, and keeps the truth as label numbers, so its memory is some arrays of FEATURES x labels and no more.
"""

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np

FEATURES = 1 << 16
ROUNDS = 40
RATE = 0.15
DECAY = 1e-4
#: Of so many sentences one is joined with its successor, in hashed order, if that has another label.
SWITCH_EVERY = 5
#: Tokens x labels that learning works on at a time, and rows of weights that are updated at a time.
CELLS = 1 << 19
ROWS = 4096
#: A word enters the lexicon of a label that has this share of at least two occurrences.
LEXICON_SHARE = 0.8

#: Words are runs of letters; sentences end at these marks.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = frozenset(".!?\n")


def features(word: str) -> list[int]:
    """The hashed features of a lower-case word."""
    marked = f"^{word}$"
    found = [f"w{word}", *(f"p{word[:n]}" for n in (1, 2, 3)), *(f"s{word[-n:]}" for n in (1, 2, 3))]
    found += [marked[at : at + 2] for at in range(len(marked) - 1)]
    found += [marked[at : at + 3] for at in range(len(marked) - 2)]
    return [zlib.crc32(name.encode()) % FEATURES for name in found]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (FEATURES, labels)
    lexical: np.ndarray  # (labels, labels): what being in a label's lexicon adds
    moves: np.ndarray  # (labels, labels): scores of label to next label
    lexicon: dict[str, int]

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of label scores for each word."""
        if not words:
            return np.zeros((0, len(self.labels)))
        hashed = [features(word) for word in words]
        starts = np.cumsum([0, *map(len, hashed[:-1])])
        out = np.add.reduceat(self.weights[np.fromiter((x for row in hashed for x in row), np.int64)], starts, axis=0)
        listed = np.array([self.lexicon.get(word, -1) for word in words])
        out[listed >= 0] += self.lexical[listed[listed >= 0]]
        return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word, and the expected number of each move, for sentences laid end to end."""
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max())
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    ranked = lengths[order]
    reach = np.searchsorted(-ranked, -np.arange(1, ranked[0] + 1), side="right") if len(ranked) else []  # sentences with a word at t
    ahead, behind = np.empty_like(local), np.ones_like(local)
    for t, n in enumerate(reach):
        at = starts[:n] + t
        now = local[at] if t == 0 else local[at] * (now[:n] @ step)
        now = now / now.sum(axis=1, keepdims=True)
        ahead[at] = now
    expected = np.zeros_like(step)
    for t in range(len(reach) - 2, -1, -1):
        n = reach[t + 1]
        at = starts[:n] + t
        later = local[at + 1] * behind[at + 1]
        now = later @ step.T
        size = now.sum(axis=1, keepdims=True)
        behind[at] = now / size
        norm = (ahead[at] * now).sum(axis=1, keepdims=True)
        expected += (ahead[at] / norm).T @ later * step
    joint = ahead * behind
    return joint / joint.sum(axis=1, keepdims=True), expected


def fit(samples: list[tuple[str, str]]) -> Model:
    """Learns from (text, label) pairs: every word of a text is taken to have its label. The order of the samples does
    not matter, and equal samples give equal models."""
    samples = sorted(samples)
    labels = sorted({label for _, label in samples})
    count = len(labels)
    sentences: list[tuple[list[str], int]] = []
    seen: dict[str, Counter] = defaultdict(Counter)
    for text, label in samples:
        number, words = labels.index(label), []
        for token in [*TOKEN.findall(text.lower()), "."]:
            if token not in ENDS:
                words.append(token)
                seen[token][number] += 1
            elif words:
                sentences.append((words, number))
                words = []
    lexicon = {word: best for word, counts in seen.items() for best, most in [counts.most_common(1)[0]] if most >= 2 and most >= LEXICON_SHARE * counts.total()}
    model = Model(labels, np.zeros((FEATURES, count)), np.zeros((count, count)), np.zeros((count, count)), lexicon)
    if not sentences:
        return model
    joined = _switched(sentences)
    chains = [(own, [number] * len(own)) for own, number in sentences] + joined
    row_of = {word: row for row, word in enumerate(sorted(seen))}
    hashed = [features(word) for word in row_of]
    listed = np.array([lexicon.get(word, -1) for word in row_of])
    parts, held, size = [], [], 0
    for chain in chains:
        held.append(chain)
        size += len(chain[0])
        if size * count >= CELLS:
            parts.append(_Part(held, row_of, hashed, listed))
            held, size = [], 0
    if held:
        parts.append(_Part(held, row_of, hashed, listed))
    total = sum(len(own) for own, _ in chains)
    moved = np.zeros((count, count))
    for _, truth in chains:
        labelled = np.array(truth, np.int64)
        np.add.at(moved, (labelled[:-1], labelled[1:]), 1)
    params = [model.weights, model.lexical, model.moves]
    first, second = ([np.zeros(p.shape, np.float32) for p in params] for _ in range(2))
    for turn in range(1, ROUNDS + 1):
        grads = [np.zeros_like(model.weights), np.zeros_like(model.lexical), moved.copy()]
        for part in parts:
            part.add_gradients(model, grads)
        for at, (value, grad) in enumerate(zip(params, grads)):
            for low in range(0, len(value), ROWS):
                rows = slice(low, low + ROWS)
                step = grad[rows] / total - DECAY * value[rows]
                first[at][rows] += 0.1 * (step - first[at][rows])
                second[at][rows] += 0.01 * (step**2 - second[at][rows])
                value[rows] += RATE * (first[at][rows] / (1 - 0.9**turn)) / (np.sqrt(second[at][rows] / (1 - 0.99**turn)) + 1e-8)
    return model


def _switched(sentences: list[tuple[list[str], int]]) -> list[tuple[list[str], list[int]]]:
    """Sentences that begin in one label and end in another: (words, label of each), the same for the same sentences."""
    order = sorted(range(len(sentences)), key=lambda at: (zlib.crc32(" ".join(sentences[at][0]).encode()), at))
    joined = []
    for one, other in zip(order[::SWITCH_EVERY], order[1::SWITCH_EVERY]):
        (words, label), (more, next_label) = sentences[one], sentences[other]
        if label != next_label:
            head, tail = words[: -(-len(words) // 2)], more[len(more) // 2 :]
            joined.append((head + tail, [label] * len(head) + [next_label] * len(tail)))
    return joined


class _Part:
    """Some of the training sentences, laid out for adding up their gradients."""

    def __init__(self, chains: list[tuple[list[str], list[int]]], row_of: dict[str, int], hashed: list[list[int]], listed: np.ndarray):
        tokens = np.fromiter((row_of[word] for own, _ in chains for word in own), np.int64)
        self.truth = np.fromiter((label for _, labels in chains for label in labels), np.int64)
        self.lengths = np.array([len(own) for own, _ in chains])
        rows, self.word = np.unique(tokens, return_inverse=True)
        self.sizes = np.array([len(hashed[row]) for row in rows])
        self.flat = np.fromiter((x for row in rows for x in hashed[row]), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.listed = listed[rows]
        self.by_word = np.argsort(self.word, kind="stable")
        self.word_starts = np.searchsorted(self.word[self.by_word], np.arange(len(rows)))
        self.by_feature = np.argsort(self.flat, kind="stable")
        self.used, self.feature_starts = np.unique(self.flat[self.by_feature], return_index=True)

    def add_gradients(self, model: Model, grads: list[np.ndarray]) -> None:
        scores = np.add.reduceat(model.weights[self.flat], self.starts, axis=0)
        known = self.listed >= 0
        scores[known] += model.lexical[self.listed[known]]
        off, expected = forward_backward(scores[self.word], self.lengths, model.moves)
        off *= -1
        off[np.arange(len(off)), self.truth] += 1
        word_off = np.add.reduceat(off[self.by_word], self.word_starts, axis=0)
        spread = np.repeat(word_off, self.sizes, axis=0)[self.by_feature]
        grads[0][self.used] += np.add.reduceat(spread, self.feature_starts, axis=0)
        np.add.at(grads[1], self.listed[known], word_off[known])
        grads[2] -= expected


class Labeler:
    """Sums label probabilities over the words of texts; remembers the scores of words up to a bound."""

    MOST_WORDS = 300_000
    #: Tokens that go through forward-backward together; a longer text goes in parts.
    GROUP = 200_000

    def __init__(self, model: Model):
        self.model = model
        self._restart()

    def _restart(self) -> None:
        self.row_of: dict[str, int] = {mark: -1 for mark in ENDS}
        self.table = np.zeros((0, len(self.model.labels)))

    def _rows(self, tokens: list[str]) -> np.ndarray:
        """Rows of the tokens in the table; -1 at sentence ends, -2 for numerals and the like, which are no words."""
        new = {token for token in tokens if token not in self.row_of}
        if new:
            if len(self.row_of) + len(new) > self.MOST_WORDS:
                self._restart()
                new = set(tokens) - ENDS
            words = [token for token in new if any(map(str.isalpha, token))]
            self.row_of.update((token, -2) for token in new)
            self.row_of.update(zip(words, range(len(self.table), len(self.table) + len(words))))
            self.table = np.concatenate([self.table, self.model.scores(words)])
        return np.fromiter(map(self.row_of.__getitem__, tokens), np.int64, len(tokens))

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the summed label probabilities of its words, and their number."""
        totals, numbers = np.zeros((len(texts), len(self.model.labels))), np.zeros(len(texts))
        if not self.model.labels:
            return totals, numbers
        held: list[str] = []
        owners: list[tuple[int, int]] = []
        for owner, text in enumerate(texts):
            text = text.lower()
            if len(text) <= self.GROUP:
                parts = [TOKEN.findall(text)]
            else:
                parts = _parts((match.group() for match in TOKEN.finditer(text)), self.GROUP)
            for tokens in parts:
                held += tokens
                held.append(".")
                owners.append((owner, len(tokens) + 1))
                if len(held) >= self.GROUP:
                    self._add(held, owners, totals, numbers)
                    held, owners = [], []
        if held:
            self._add(held, owners, totals, numbers)
        return totals, numbers

    def _add(self, tokens: list[str], owners: list[tuple[int, int]], totals: np.ndarray, numbers: np.ndarray) -> None:
        real, chance = self._chances(tokens)
        if not real.any():
            return
        owner = np.repeat([at for at, _ in owners], [size for _, size in owners])
        for label in range(chance.shape[1]):
            totals[:, label] += np.bincount(owner[real], chance[:, label], len(totals))
        numbers += np.bincount(owner[real], minlength=len(numbers))

    def _chances(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are words, and the label probabilities of each word."""
        rows = self._rows(tokens)
        sentence = np.cumsum(rows == -1)
        real = rows >= 0
        if not real.any():
            return real, np.zeros((0, len(self.model.labels)))
        lengths = np.bincount(sentence[real])
        return real, forward_backward(self.table[rows[real]], lengths[lengths > 0], self.model.moves)[0]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, label) of each run of words of one label, in code points of the text; a word has its likeliest label."""
        if not self.model.labels:
            return []
        lower = text.lower()
        if len(lower) != len(text):  # some capitals have longer lower forms
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found: list[tuple[int, int, str]] = []
        part: list[re.Match] = []
        for match in chain(TOKEN.finditer(lower), [None]):
            if match is not None:
                part.append(match)
            if part and (match is None or len(part) >= self.GROUP or len(part) >= self.GROUP // 2 and match.group() in ENDS):
                real, chance = self._chances([each.group() for each in part])
                for each, label in zip((each for each, is_word in zip(part, real) if is_word), chance.argmax(axis=1)):
                    name = self.model.labels[label]
                    if found and found[-1][2] == name:
                        found[-1] = (found[-1][0], each.end(), name)
                    else:
                        found.append((each.start(), each.end(), name))
                part = []
        return found


def _parts(tokens, size: int):
    part: list[str] = []
    for token in tokens:
        part.append(token)
        if len(part) >= size or len(part) >= size // 2 and token in ENDS:
            yield part
            part = []
    if part:
        yield part
