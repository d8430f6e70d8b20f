"""Toxicity by weak supervision.

Voters, each a lexicon or a pattern, say toxic, clean or nothing of a document. A
generative label model explains their votes by a hidden label: each voter has
an accuracy and a coverage of its own, and voters that agree more than
their accuracies explain hang together in a tree, in which each depends on the one above it beside the label: however many
voters repeat one opinion, it counts once. Expectation-maximisation fits it to the counts of vote patterns
over all documents, of which there are a few hundred at most, so the driver gets
counts and no documents. Where a table of labels is given, two voters more use a lexicon
induced from all labelled documents: words
of several unlike toxic documents that clean ones lack. That reaches languages
that no lexicon here covers. A linear classifier over words and votes is then trained on the posterior labels
of a bounded sample (``sample_docs`` distinct documents, by hash, half of them likely toxic), and
scores every document whole. Labels reach neither the label model nor the classifier but through that lexicon.

A document is toxic if the classifier's log odds are above ``threshold``.

Passes over the texts: one for the words of documents (with labels), one for the votes, of which
only counts by pattern are kept, one that reads the sample, chosen by hash before its
texts leave the JVM, and one for scores. With labels, the words of each document that may have one, as hashes, are shuffled once by id to meet them;
which may is told by a bit map of hashed ids of fixed size, so that hardly any other's are moved, and none that has a label is missed.

Defined cases: null and blank texts get no votes; they score null and aren't
toxic. If no voter ever says toxic, or all documents are alike, there is no
classifier and the posterior alone decides. Rows are judged one by one; repeated rows count as often in the
patterns and once in the sample. A document labelled both ways counts as toxic, labels other than 0 and 1 are ignored. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.shared import cut, scratch
from batchloom.llm.textarrays import SLICE_BYTES, U64, _cache, _cuts, flat, sliced, word_hashes, words

LEXICONS: dict[str, tuple[str, ...]] = {
    "insults": ("idiot", "moron", "loser", "clown", "imbecile", "dumbass"),
    "degrading": ("scum", "trash", "worthless", "pathetic", "disgusting", "vermin", "garbage"),
    "belittling": ("stupid", "idiot", "pathetic", "loser", "dumb", "worthless"),
    "abuse": ("idiot", "moron", "stupid", "scum", "trash", "clown", "loser", "disgusting", "worthless", "pathetic", "kill", "hate", "shut"),
    "german": ("idiot", "dummkopf", "abschaum", "arschloch", "versager", "widerlich", "trottel"),
    "french": ("idiot", "crétin", "imbécile", "ordure", "débile", "connard", "minable"),
    "spanish": ("idiota", "imbécil", "escoria", "estúpido", "basura", "inútil", "payaso"),
}
#: Voters by their numbers: the lexicons, the induced one (any hit, several hits), then density (one hit in fifty words or fewer), address ("you" beside a hit), and the one that says clean where nothing was hit, or just one induced word, which is the weakest sign.
VOTERS = (*LEXICONS, "induced", "induced_several", "dense", "addressed", "few_hits")
FEATURES = 1 << 18
WEIGHTS = FEATURES + 2 * len(VOTERS)
#: Marks of ids, a bit each (8 MB): with 6 million labelled documents 9 % of the others share a mark with one, and are dropped by the join.
MARKS = 1 << 26


@dataclass(frozen=True)
class LabelModel:
    """log P(vote | label) of each voter, log P(vote | vote above it, label) of each pair of the trees, and the prior log odds."""

    pairs: tuple[tuple[int, int], ...]  # (above, below); a voter is below one other at most
    single: np.ndarray  # voter, label, vote
    joint: np.ndarray  # pair, label, vote above, vote below
    prior: float

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Of the label toxic, for rows of votes (0 nothing, 1 clean, 2 toxic)."""
        below = {b for _, b in self.pairs}
        out = np.full(len(votes), self.prior)
        for v in range(votes.shape[1]):
            if v not in below:
                out += self.single[v, 1, votes[:, v]] - self.single[v, 0, votes[:, v]]
        for k, (a, b) in enumerate(self.pairs):
            out += self.joint[k, 1, votes[:, a], votes[:, b]] - self.joint[k, 0, votes[:, a], votes[:, b]]
        return out


def fit_tables(votes: np.ndarray, counts: np.ndarray, q: np.ndarray, pairs: tuple, prior: float) -> LabelModel:
    """The tables that explain the patterns best if each is toxic with probability ``q``; half a document more in every cell."""
    weight = np.stack([counts * (1 - q), counts * q])
    single = np.array([[np.bincount(votes[:, v], weight[y], 3) for y in (0, 1)] for v in range(votes.shape[1])])
    joint = np.array([[np.bincount(votes[:, a] * 3 + votes[:, b], weight[y], 9).reshape(3, 3) for y in (0, 1)] for a, b in pairs]).reshape(-1, 2, 3, 3)
    norm = lambda x: np.log((x + 0.5) / (x + 0.5).sum(axis=-1, keepdims=True))
    share = np.clip((weight[1].sum() + 1) / (counts.sum() + 1 / prior), 1e-4, 0.9)
    return LabelModel(pairs, norm(single), norm(joint), float(np.log(share / (1 - share))))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, *, prior: float = 0.1, excess: float = 0.1, rounds: int = 60) -> LabelModel:
    """The model of the given vote patterns and their counts.

    Voters whose agreement, label known, exceeds independence by ``excess`` in
    mutual information (bits) are tied by a spanning forest of the strongest ties: once under the labels of a
    majority vote and anew under those of the first fit. A voter starts as better than chance, which
    decides what label is which.
    """
    # posterior of each pattern, from a majority of the votes
    balance = (votes == 2).sum(axis=1) - (votes == 1).sum(axis=1)
    q = np.where(balance > 0, 0.9, 0.02)
    for _ in range(2):  # before any fit too: copies of one voter would pull it over to their side
        pairs = forest(votes, counts, q, excess)
        for _ in range(rounds):
            new = 1 / (1 + np.exp(-np.clip(fit_tables(votes, counts, q, pairs, prior).log_odds(votes), -40, 40)))
            done = np.abs(new - q).max(initial=0) < 1e-6
            q = new
            if done:
                break
    return fit_tables(votes, counts, q, pairs, prior)


def forest(votes: np.ndarray, counts: np.ndarray, q: np.ndarray, excess: float) -> tuple[tuple[int, int], ...]:
    """(above, below) of a spanning forest of the strongest ties beyond ``excess``; the least voter of a tree is on top."""
    n = votes.shape[1]
    ties = sorted(((_information(votes[:, a], votes[:, b], counts, q), a, b) for a in range(n) for b in range(a + 1, n)), reverse=True)
    tree = list(range(n))
    near: list[list[int]] = [[] for _ in range(n)]
    for strength, a, b in ties:
        if strength > excess and tree[a] != tree[b]:
            near[a].append(b)
            near[b].append(a)
            tree = [tree[a] if t == tree[b] else t for t in tree]
    pairs: list[tuple[int, int]] = []
    seen: set[int] = set()
    for top in range(n):
        waiting = [] if top in seen else [top]
        seen.add(top)
        while waiting:
            a = waiting.pop(0)
            for b in sorted(near[a]):
                if b not in seen:
                    seen.add(b)
                    pairs.append((a, b))
                    waiting.append(b)
    return tuple(pairs)


def _information(a: np.ndarray, b: np.ndarray, counts: np.ndarray, q: np.ndarray) -> float:
    """Mutual information of two voters under the label that ties them more, in bits; a label of few documents tells little."""
    most = 0.0
    for weight in (counts * (1 - q), counts * q):
        p = np.bincount(a * 3 + b, weight, 9).reshape(3, 3)
        n = p.sum()
        if n <= 0:
            continue
        p = p / n
        expected = p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)
        some = p > 0
        most = max(most, float((p[some] * np.log2(p[some] / expected[some])).sum()) * n / (n + 50))
    return most


def _lexicon() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all terms, with the lexicons of each as bits; the last bit stands for "you"."""
    known = _cache()
    if "lexicon" not in known:
        bits: dict[str, int] = {}
        for k, terms in enumerate(LEXICONS.values()):
            for t in terms:
                bits[t] = bits.get(t, 0) | 1 << k
        for t in ("you", "your", "du", "vous", "tu", "usted"):
            bits[t] = bits.get(t, 0) | 1 << len(LEXICONS)
        raw = [t.encode() for t in bits]
        data = np.frombuffer(b"".join(raw), np.uint8)
        edge = np.cumsum([0, *map(len, raw)])
        hashes = word_hashes(data, edge[:-1], edge[1:])
        order = np.argsort(hashes)
        known["lexicon"] = hashes[order], np.array(list(bits.values()), np.int64)[order]
    return known["lexicon"]


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in lower case without the signs around them, their rows, and the number of words of each row."""
    data, off = flat(pc.utf8_lower(part.column("text")))
    table = np.arange(256, dtype=np.uint8)
    sign = np.ones(256, bool)
    sign[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
    table[sign] = 32
    if part.num_rows == 1 and len(data) > 2 * SLICE_BYTES:  # a long text, in pieces
        found = [np.zeros(0, U64)]
        for low, high, _ in _cuts(data, 0, SLICE_BYTES):
            piece = table[data[low:high]]
            found.append(word_hashes(piece, *words(piece, np.array([0, len(piece)]))[:2]))
        hashes = np.concatenate(found)
        return hashes, np.zeros(len(hashes), np.int64), np.array([len(hashes)])
    starts, ends, word_off = words(table[data], off)
    counts = np.diff(word_off)
    return word_hashes(table[data], starts, ends), np.repeat(np.arange(len(counts)), counts), counts


def cast_votes(part: pa.RecordBatch, induced: np.ndarray) -> np.ndarray:
    """A row of votes for each row: 0 nothing, 1 clean, 2 toxic. ``induced``: sorted hashes of words."""
    hashes, row, counts = _tokens(part)
    terms, bits = _lexicon()
    slot = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    bit = np.where(terms[slot] == hashes, bits[slot], 0)
    n, k = part.num_rows, len(LEXICONS)
    votes = np.zeros((n, len(VOTERS)), np.int64)
    low = bit & ((1 << k) - 1)
    for v in range(k):
        votes[np.unique(row[(low >> v & 1) > 0]), v] = 2
    hit = low > 0
    weight = np.bincount(row[hit], minlength=n) * 2
    if len(induced):
        slot = np.minimum(np.searchsorted(induced, hashes), len(induced) - 1)
        own = induced[slot] == hashes
        votes[:, k] = np.where(np.bincount(row[own], minlength=n) > 0, 2, 0)
        votes[:, k + 1] = np.where(np.bincount(row[own], minlength=n) > 1, 2, 0)
        hit |= own
        weight = np.maximum(weight, np.bincount(row[own], minlength=n))
    hits = np.bincount(row[hit], minlength=n)
    votes[:, k + 2] = np.where((hits > 0) & (hits * 50 >= counts), 2, 0)
    you = np.flatnonzero(bit >> k & 1)
    for step in (-2, -1, 1, 2):
        near = you[(you + step >= 0) & (you + step < len(row))]
        near = near[(row[near + step] == row[near]) & hit[near + step]]
        votes[row[near], k + 3] = 2
    votes[:, k + 4] = np.where((weight < 2) & (counts > 0), 1, np.where(weight > 2, 2, 0))
    return votes


def _mark(ids: str) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(MARKS))


def _marks(known: DataFrame) -> np.ndarray:
    """A bit for each mark: whether a labelled document has it. Others may share it; none that is labelled lacks it."""
    mark = known.select(_mark("doc_id").alias("mark"))
    bits = mark.groupBy(F.shiftright("mark", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(mark & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros((MARKS + 63) // 64, np.int64)
    out[bits.column("place").to_numpy()] = bits.column("bits").to_numpy()
    return out


def _words_of(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """(doc_id, words): the sorted hashes of the distinct words of every document whose mark is set."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark = batch.column("mark").to_numpy()
            batch = batch.select(["doc_id", "text"]).filter(pa.array(shared.value[mark >> 6] >> (mark & 63) & 1 == 1))
            for part in sliced(batch):
                hashes, row, _ = _tokens(part)
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                edge = np.searchsorted(row[new], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(edge, pa.array(hashes[new].view(np.int64)))], ["doc_id", "words"])

    return docs.select("doc_id", "text", _mark("doc_id").alias("mark")).mapInArrow(distinct_words, "doc_id bigint, words array<bigint>")


def induce(docs: DataFrame, labels: DataFrame, *, support: int = 4, ratio: float = 20.0, unlike: float = 0.2, most_words: int = 1 << 20) -> np.ndarray:
    """Sorted hashes of the words that set toxic documents apart.

    A word needs ``support`` toxic documents that are unlike (by the least of
    their word hashes, which copies share), these being a share of ``unlike`` of
    the toxic documents with it, and a rate among toxic documents ``ratio`` times that among
    clean ones. The lexicon travels with the tasks, so it holds ``most_words`` (8 MB) at most, those of the most documents.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    mine = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())

    # labels grow with the corpus, so they are joined by shuffle at every size: to the words of those documents that may have one
    chosen = _words_of(mine, _marks(known)).join(known.hint("shuffle_hash"), "doc_id")
    found = chosen.select(F.explode("words").alias("word"), F.get("words", F.lit(0)).alias("least"), F.col("toxic").cast("int").alias("toxic"))  # the first of a row is its least
    totals = {r.toxic: r.n for r in mine.select("doc_id").join(known.hint("shuffle_hash"), "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return np.zeros(0, U64)
    n_toxic, n_clean = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    kinds = F.count_distinct(F.when(F.col("toxic") == 1, F.col("least")))
    counted = found.groupBy("word").agg(n_toxic.alias("t"), n_clean.alias("c"), kinds.alias("k"))
    good = counted.where((F.col("k") >= support) & (F.col("k") >= unlike * F.col("t")) & (F.col("t") * totals[0] >= ratio * (F.col("c") + 0.5) * totals[1]))
    return np.sort(good.orderBy(F.desc("k"), "word").limit(most_words).select("word").toArrow().column("word").to_numpy().view(U64))


def _features(part: pa.RecordBatch, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every distinct word and every vote of each row."""
    hashes, row, _ = _tokens(part)
    feature = (hashes >> U64(46)).astype(np.int64)
    voted, voter = np.nonzero(votes)
    row, feature = np.append(row, voted), np.append(feature, FEATURES + voter * 2 + votes[voted, voter] - 1)
    cell = np.unique(row * WEIGHTS + feature)
    return cell // WEIGHTS, cell % WEIGHTS


def train_classifier(row: np.ndarray, feature: np.ndarray, target: np.ndarray, *, epochs: int = 200, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on probabilistic labels, by full-batch adaptive steps."""
    used, place = np.unique(feature, return_inverse=True)
    w, bias, n = np.zeros(len(used)), 0.0, len(target)
    squares = np.full(len(used) + 1, 1e-8)
    for _ in range(epochs):
        margin = np.bincount(row, w[place], n) + bias
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target
        gradient = np.append(np.bincount(place, error[row], len(used)) / n + decay * w, error.mean())
        squares += gradient**2
        step = rate * gradient / np.sqrt(squares)
        w -= step[:-1]
        bias -= step[-1]
    out = np.zeros(WEIGHTS, np.float32)
    out[used] = w
    return out, float(bias)


def _code(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def _votes(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(VOTERS)) % 3


def voted(docs: DataFrame, induced: np.ndarray) -> DataFrame:
    """(chance, doc_id, text, votes) of every row that isn't blank, the votes as one number; chance is a hash of the row below 1 << 30."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_code(cast_votes(part, induced)))], ["chance", "doc_id", "text", "votes"])

    doc_id = F.col("doc_id").cast("bigint")
    chance = F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(0)), F.xxhash64("text")), F.lit(1 << 30))
    mine = docs.where(F.col("text").isNotNull()).select(chance.alias("chance"), doc_id.alias("doc_id"), "text")
    return mine.mapInArrow(vote, "chance bigint, doc_id bigint, text string, votes bigint").where("votes > 0")


def sample(docs: DataFrame, induced: np.ndarray, likely: list[int], n_likely: float, n_rest: float, most: int) -> DataFrame:
    """(text, votes, chance) of at most ``most`` distinct documents, half of them of the vote patterns in ``likely``, by the least hash."""
    half = most // 2
    # twice as many as wanted by a threshold of the hash, before the votes, so that few texts leave the JVM; then exactly
    upto = lambda n: F.lit(int(min(1.0, (2 * half + 50) / max(n, 1)) * (1 << 30)))
    toxic = F.col("votes").isin(likely)
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.xxhash64("text")), F.lit(1 << 30))
    near = voted(docs.where(chance < F.greatest(upto(n_likely), upto(n_rest))), induced).where(F.col("chance") < F.when(toxic, upto(n_likely)).otherwise(upto(n_rest)))
    # repeated rows are one; the aggregate combines before its shuffle
    once = cut(near.groupBy("chance", "votes", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")))
    parts = [once.where(toxic if k else ~toxic).orderBy("chance", "h").limit(half) for k in (0, 1)]
    return parts[0].unionAll(parts[1]).select("text", "votes", "chance")


def train(docs: DataFrame, induced: np.ndarray, model: LabelModel, votes: np.ndarray, counts: np.ndarray, sample_docs: int) -> tuple[np.ndarray, float] | None:
    """The classifier, or None where all documents are alike to the label model."""
    toxic = model.log_odds(votes) > 0
    if not counts[toxic].sum() or not counts[~toxic].sum():
        return None

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature = _features(batch, _votes(batch.column("votes").to_numpy()))
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            found = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("chance"), batch.column("votes"), pa.array(found, pa.binary())], ["chance", "votes", "found"])

    with scratch(docs.sparkSession):
        chosen = sample(docs, induced, [int(x) for x in _code(votes[toxic])], counts[toxic].sum(), counts[~toxic].sum(), sample_docs)
        got = chosen.mapInArrow(extract, "chance bigint, votes bigint, found binary").toArrow().sort_by([("chance", "ascending"), ("votes", "ascending"), ("found", "ascending")])
    found = [np.frombuffer(x, np.int32) for x in got.column("found").to_pylist()]
    if not found:
        return None
    target = 1 / (1 + np.exp(-np.clip(model.log_odds(_votes(got.column("votes").to_numpy())), -30, 30)))
    return train_classifier(np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found).astype(np.int64), target)


def judge(docs: DataFrame, labels: DataFrame | None = None, *, sample_docs: int = 4000, threshold: float = 0.0) -> DataFrame:
    """(doc_id, posterior, score, toxic): the label model's probability, the classifier's, and the verdict on every row."""
    induced = induce(docs, labels) if labels is not None else np.zeros(0, U64)
    patterns = voted(docs, induced).groupBy("votes").count().orderBy("votes").toArrow()
    votes, counts = _votes(patterns.column("votes").to_numpy()), patterns.column("count").to_numpy().astype(float)
    model = fit_label_model(votes, counts) if len(votes) else None
    classifier = train(docs, induced, model, votes, counts, sample_docs) if model is not None else None
    shared = docs.sparkSession.sparkContext.broadcast((model, classifier, induced))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, classifier, induced = shared.value
        for batch in batches:
            for part in sliced(batch):
                found = cast_votes(part, induced)
                blank = (found == 0).all(axis=1)
                odds = model.log_odds(found) if model is not None else np.zeros(part.num_rows)
                margin = odds
                if classifier is not None:
                    row, feature = _features(part, found)
                    margin = np.bincount(row, classifier[0][feature], part.num_rows) + classifier[1]
                sigmoid = [pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))), mask=blank) for x in (odds, margin)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *sigmoid, pa.array((margin > threshold) & ~blank)], ["doc_id", "posterior", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, posterior double, score double, toxic boolean")
