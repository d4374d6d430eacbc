"""Toxicity from a learned lexicon: Levenshtein automata intersected with the lexicon's trie catch misspelled
terms, and the words around a hit tell quotation from abuse."""

from __future__ import annotations

import bisect
import math
import os
import re
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, words_of

#: Labelled rows that the lexicon and the weights are fitted on, at most (about: rows are dealt by hash).
FIT_ROWS = 10_000
#: Marks a term as a whole word; letters of a stem at least; up to so many letters every beginning of a word is
#: counted, beyond them only where words part; log-odds that need no more letters.
END = "\x01"
SHORTEST, DENSE = 3, 24
SURE = 4.0
#: Words that make up a hit's context, before and after it.
CONTEXT = 6
THRESHOLD = 0.3
#: Distinct words whose match a worker remembers; then it starts afresh.
MEMO = 400_000
#: A misspelled or quoted term counts this much where the labelled rows don't tell.
FUZZY, QUOTED = 0.7, 0.3
MIN_SUPPORT = 10

# a run at the end is looked at from its start only
_EDGE = re.compile(r"^[^\w@$]++|(?<!\W)\W++$|(?<!_)_++$")
_NO_LETTERS = "^\\P{L}++|(?<=\\p{L})\\P{L}++$"
_LOOKALIKE = str.maketrans("013457@$!|", "oieastasii")
_OPENING = tuple("\"'“‘«„")
_CLOSING = re.compile(r"[\"'”’»“][.,;:!?)]*$")
_REPORTING = frozenset(
    "said says say called calls wrote writes quoted quote quotes word term insult phrase cited "
    "dit appelle mot sagte nannte wort dijo llama palabra".split()
)


class LevenshteinAutomaton:
    """Accepts what is within ``edits`` insertions, deletions and substitutions of ``word``.

    A state is one bit set per number of edits, a bit per place in the word (Wu and Manber's form of the
    nondeterministic automaton).
    """

    def __init__(self, word: str, edits: int):
        self.edits, self.final = edits, 1 << len(word)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(word):
            self.masks[c] = self.masks.get(c, 0) | 1 << (i + 1)
        self.start = tuple((1 << (e + 1)) - 1 for e in range(edits + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...]:
        mask = self.masks.get(char, 0)
        out = [(state[0] << 1) & mask]
        for e in range(1, self.edits + 1):
            stay, before, now = state[e], state[e - 1], out[e - 1]
            out.append((stay << 1) & mask | before | before << 1 | now << 1)
        return tuple(out)

    def distance(self, state: tuple[int, ...]) -> int | None:
        return next((e for e, bits in enumerate(state) if bits & self.final), None)


class Lexicon:
    """A trie of terms that words, misspelled or not, are looked up in.

    A term is a whole word if it ends in ``END``, else a stem that any ending may follow.
    """

    def __init__(self, terms: list[str], weights: list[float]):
        self.sure = {t for t, w in zip(terms, weights, strict=True) if w >= SURE}
        self.trie: dict = {}
        self.heads: set[str] = set()
        self.ends: set[str] = set()
        self.middles: set[tuple[int, str]] = set()
        for i, t in enumerate(terms):
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = i
            if self.forgiving(t):  # one edit leaves one half of a term as it is
                word = t.rstrip(END)
                half = len(word) // 2
                self.heads.add(word[:half])
                if t.endswith(END):
                    self.ends.add(word[half:])
                else:  # after a stem anything may follow, so its second half stands where the first one ends
                    self.middles.update((at, word[half:]) for at in (half - 1, half, half + 1))
        self.longest = max((len(t.rstrip(END)) for t in terms), default=0)
        self.head_sizes = sorted({len(x) for x in self.heads})
        self.end_sizes = sorted({len(x) for x in self.ends})
        self.middle_sizes = sorted({(at, len(x)) for at, x in self.middles})

    def near(self, word: str) -> bool:
        """Whether half of some term is in its place; no word within one edit fails this."""
        return (
            any(word[:n] in self.heads for n in self.head_sizes)
            or any(word[-n:] in self.ends for n in self.end_sizes)
            or any((at, word[at : at + n]) in self.middles for at, n in self.middle_sizes)
        )

    def forgiving(self, term: str) -> bool:
        """Short terms, and stems more so, have too many neighbours; weak ones tell too little."""
        return len(term) >= 6 and term in self.sure

    def exact(self, word: str) -> int | None:
        """The longest term that the word is or begins with."""
        node, found = self.trie, None
        for c in word + END:
            if (node := node.get(c)) is None:
                break
            found = node.get("", found)
        return found

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term."""
        if (term := self.exact(word)) is not None:
            return term, 0
        if len(word) < 4 or not self.near(word):
            return None
        # what follows the longest term and two letters can't change whether some term is one edit away
        automaton, best = LevenshteinAutomaton(word[: self.longest + 2], 1), None
        stack = [(self.trie, automaton.start, "")]
        while stack:
            node, state, path = stack.pop()
            if "" in node and self.forgiving(path) and any(state):  # a stem: some beginning of the word is read
                best = min(filter(None, (best, (1, node[""]))))
            for char, below in node.items():
                if char == END:
                    if self.forgiving(path + END) and automaton.distance(state) is not None:
                        best = min(filter(None, (best, (1, below[""]))))
                elif char and any(after := automaton.step(state, char)):
                    stack.append((below, after, path + char))
        return (best[1], best[0]) if best else None


class _Memo(dict):
    """Word as it stands in the text, lower-cased -> (term, edits) or None."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, raw: str):
        if len(self) >= MEMO:
            self.clear()
        word = _EDGE.sub("", raw)
        found = self.lexicon.find(word)
        if found is None and word and not word.isalpha():
            plain = _EDGE.sub("", word.translate(_LOOKALIKE))
            if (again := self.lexicon.find(plain)) is not None:
                found = again[0], again[1] + 1
        self[raw] = found
        return found


class Finder:
    """Finds the lexicon's terms in a text."""

    def __init__(self, terms: list[str], weights: list[float]):
        self.memo = _Memo(Lexicon(terms, weights))

    def hits(self, text: str | None) -> tuple[list[tuple[int, int, int, int]], int]:
        """(term, edits, in quotation, other hits in its context) of every hit, and the number of words."""
        words = text.lower().split() if text else []
        found = list(map(self.memo.__getitem__, words))
        at = [i for i, x in enumerate(found) if x is not None]
        out = []
        for k, i in enumerate(at):
            near, j = 0, k - 1
            while j >= 0 and i - at[j] <= CONTEXT:
                near, j = near + 1, j - 1
            j = k + 1
            while j < len(at) and at[j] - i <= CONTEXT:
                near, j = near + 1, j + 1
            out.append((*found[i], int(self._quoted(words, i)), near))
        return out, len(words)

    @staticmethod
    def _quoted(words: list[str], at: int) -> bool:
        """In quotation marks that open and close within the context, or right after a reporting word."""
        lo, hi = max(0, at - CONTEXT), at + CONTEXT + 1
        opened = next((i for i in range(at, lo - 1, -1) if words[i].startswith(_OPENING)), None)
        if opened is not None and not any(_CLOSING.search(w) for w in words[opened:at]):
            if any(_CLOSING.search(w) for w in words[at:hi]):
                return True
        return any(w.strip(".,:;") in _REPORTING for w in words[max(0, at - 3) : at])


_LAST_FINDER: dict = {}


def _finder(terms: list[str], weights: list[float]) -> Finder:
    """The worker's finder for a lexicon: what it remembers of words serves all tasks of the worker."""
    key = (tuple(terms), tuple(weights))
    if key not in _LAST_FINDER:
        _LAST_FINDER.clear()
        _LAST_FINDER[key] = Finder(terms, weights)
    return _LAST_FINDER[key]


class Model:
    """Term weights and a logistic curve over the strongest hit, all hits, and all hits for the text's length."""

    def __init__(self, terms: list[str], weights: list[float], fuzzy: float, quoted: float, curve: list[float]):
        self.terms, self.weights, self.fuzzy, self.quoted, self.curve = terms, weights, fuzzy, quoted, curve

    def features(self, hits: list[tuple[int, int, int, int]], n_words: int) -> tuple[float, float, float]:
        strongest = total = 0.0
        for term, edits, in_quotes, near in hits:
            part = self.weights[term] * self.fuzzy**edits * (self.quoted if in_quotes else 1.0) * (1 + 0.1 * min(near, 3))
            strongest, total = max(strongest, part), total + part
        return strongest, math.log1p(total), math.log1p(100 * total / (n_words + 10))

    def score(self, hits: list[tuple[int, int, int, int]], n_words: int) -> float:
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], self.features(hits, n_words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _descend(prefix: str, count: dict[str, tuple[int, int]], below: dict[str, list[str]], odds) -> Iterator[str]:
    """The terms under a prefix: as long as nearly all its documents agree, or else as long as it must be."""
    while True:
        children = below.get(prefix, [])
        same = next((c for c in children if count[c][0] >= 0.9 * count[prefix][0]), None)
        if same is None:
            break
        prefix = same
    yield prefix
    if odds(prefix) < SURE:  # a weak stem: longer ones may tell more
        for c in children:
            yield from _descend(c, count, below, odds)


def _long_stems(words):
    """Texts of either label under the longer stems of words that share their first ``DENSE`` letters.

    Counts only change where sorted words part or end, so these places stand for all lengths between: as
    many stems as words at most, whatever the words' lengths.
    """
    import pandas as pd

    texts: dict[str, set] = {}
    for row, label, word in zip(words["row"], words["label"], words["word"], strict=True):
        texts.setdefault(word, set()).add((row, label))
    order = sorted(texts)
    stems = {*order, *(os.path.commonprefix(pair) for pair in zip(order, order[1:], strict=False))}
    found = []
    for stem in stems:
        if len(stem) > DENSE:
            first = bisect.bisect_left(order, stem)
            under = takewhile(lambda w: w.startswith(stem), islice(order, first, None))  # noqa: B023  used at once
            held = set().union(*(texts[w] for w in under))
            found.append((stem, sum(label for _, label in held), sum(1 - label for _, label in held)))
    return pd.DataFrame(found, columns=["term", "n1", "n0"])


def learn_lexicon(train: DataFrame, text_col: str, label_col: str) -> tuple[list, list]:
    """Words and stems far likelier in texts labelled 1: (terms, log-odds).

    Spark counts, for every beginning of a word and for whole words, the texts of either label; the
    trie of those that tell the labels apart is cut where its branches stop agreeing. How many terms that
    leaves follows from the support and the odds that a term needs, and from the rows.
    """
    n1, n0 = train.agg(
        F.coalesce(F.sum(F.col(label_col)), F.lit(0)), F.coalesce(F.sum(1 - F.col(label_col)), F.lit(0))
    ).first()
    if not n1 or not n0:
        return [], []
    bare = F.array_distinct(F.transform(words_of(F.lower(text_col)), lambda w: F.regexp_replace(w, _NO_LETTERS, "")))
    terms = F.transform(
        F.filter(bare, lambda w: F.char_length(w) >= SHORTEST),
        lambda w: F.array_append(
            F.transform(F.sequence(F.lit(SHORTEST), F.least(F.char_length(w), F.lit(DENSE))), lambda k: F.substring(w, F.lit(1), k)),
            F.concat(w, F.lit(END)),
        ),
    )
    counts = (
        train.select(label_col, F.explode(F.array_distinct(F.flatten(terms))).alias("term"))
        .groupBy("term")
        .agg(F.sum(label_col).alias("n1"), F.sum(1 - F.col(label_col)).alias("n0"))
    )
    long = (
        train.select(F.monotonically_increasing_id().alias("row"), F.col(label_col).cast("int").alias("label"), F.explode(bare).alias("word"))
        .where(F.char_length("word") > DENSE)
        .groupBy(F.substring("word", 1, DENSE).alias("head"))
        .applyInPandas(_long_stems, "term string, n1 long, n0 long")
    )
    counts = counts.unionByName(long)
    log_odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    told = (
        counts.withColumn("odds", log_odds)
        .where((F.col("n1") >= max(4, n1 * 0.01)) & (F.col("odds") >= 1) & (F.col("odds") * F.col("n1") >= 15))
        .collect()  # terms of a bounded number of rows
    )
    count = {r["term"]: (r["n1"], r["n0"]) for r in told}
    below: dict[str, list[str]] = {}
    roots, above = [], []  # above: the terms that the last one begins with, and itself
    for t in sorted(count):
        while above and not t.startswith(above[-1]):
            above.pop()
        below.setdefault(above[-1], []).append(t) if above else roots.append(t)
        above.append(t)

    def odds(term: str) -> float:
        a, b = count[term]
        return math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))

    terms = sorted((t for r in roots for t in _descend(r, count, below, odds)), key=lambda t: (-odds(t) * count[t][0], t))
    return terms, [odds(t) for t in terms]


def fit(train: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows; their number must be bounded, see ``sample_labelled``.

    Each text with its label counts once, so copies and repeated rows lend a term no support; null and
    empty texts are texts without hits. Without rows of both labels there is no lexicon and every score is
    the label's share. Other columns, whatever their names, aren't looked at.
    """
    train = materialize(train.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).distinct(), "labelled")
    terms, weights = learn_lexicon(train, "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(terms, weights)
        for batch in batches:
            found = [finder.hits(t) for t in batch.column(0).to_pylist()]
            hits = pa.array([[list(h) for h in x] for x, _ in found], pa.list_(pa.list_(pa.int32())))
            sizes = pa.array([n for _, n in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), hits, sizes], ["label", "hits", "n_words"])

    rows = train.mapInArrow(run, "label int, hits array<array<int>>, n_words int").collect()  # bounded, as the sample is
    label = np.array([r["label"] for r in rows], dtype=float)
    hits = [[tuple(h) for h in r["hits"]] for r in rows]

    def factor(which, default: float) -> float:
        """How far hits of this kind tell the labels apart, beside plain ones."""

        def told(choose) -> tuple[float, float]:
            there = np.array([any(choose(h) for h in x) for x in hits], dtype=float)
            odds = math.log((there @ label + 0.5) / (label.sum() + 1)) - math.log(
                (there @ (1 - label) + 0.5) / ((1 - label).sum() + 1)
            )
            return odds, there.sum()

        odds, support = told(which)
        plain, _ = told(lambda h: not h[1] and not h[2])
        return default if support < MIN_SUPPORT or plain <= 0 else min(1.0, max(0.0, odds / plain))

    if not terms:
        share = (label.sum() + 0.5) / (len(label) + 1) if len(label) and label.sum() else 0.05
        return Model([], [], FUZZY, QUOTED, [math.log(share / (1 - share)), 0.0, 0.0, 0.0])
    model = Model(terms, weights, factor(lambda h: h[1] and not h[2], FUZZY), factor(lambda h: h[2], QUOTED), [0.0] * 4)
    x = np.array([(1.0, *model.features(h, r["n_words"])) for h, r in zip(hits, rows, strict=True)])
    curve = np.zeros(4)
    for _ in range(30):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (label - p) - 0.1 * curve * [0, 1, 1, 1]
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.1, 0.1, 0.1])
        curve = curve + np.linalg.solve(bend, slope)
    model.curve = curve.tolist()
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", *, rows: int = FIT_ROWS) -> DataFrame:
    """About ``rows`` labelled documents that aren't held out, dealt by a hash of the id; all if there are fewer."""
    usable = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(
        id_col, F.col(label_col).cast("int").alias(label_col)
    )
    part = min(1.0, rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(part * 1_000_000))
    # at most about ``rows`` ids of a few bytes: bounded whatever the tables' size
    return docs.drop(label_col).join(F.broadcast(chosen), id_col)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``n_terms`` (long; hits of the lexicon) to every row.

    Only the text is looked at, whole. Null and empty texts have no hits and the lowest score. Rows are
    independent, nothing is shuffled; columns of the added names are replaced; an empty table stays empty.
    """
    plain = docs.drop("score", "n_terms")
    names = plain.columns
    schema = plain.select("*", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_terms")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(model.terms, model.weights)
        for batch in batches:
            hits = [finder.hits(t) for t in batch.column(names.index(text_col)).to_pylist()]
            scores = pa.array([model.score(h, n) for h, n in hits], pa.float64())
            counts = pa.array([len(h) for h, _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores, counts], [*names, "score", "n_terms"])

    return plain.mapInArrow(run, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(sample_labelled(docs, labels))
    return score_toxicity(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
