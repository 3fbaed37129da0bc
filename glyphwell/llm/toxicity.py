"""Toxicity by weak supervision.

Voters, each a lexicon of words or phrases or a pattern of a text's shape, vote
on every document or abstain. Besides hand-written lexicons there are induced
ones, for languages and slang that no one wrote down: the words, and beginnings
of words, of documents that at most ``LABELLED_ROWS`` label rows name (the first
by a hash of the id), if the lower end of the 95 % interval of their lift on a
toxic label is at least ``LEAST_LIFT``. That is a test of proportions, alike for
label tables of every size.

A generative label model with one hidden class estimates how often each voter
fires on toxic and on other documents, by expectation maximisation over the
counts of all vote patterns of the corpus. Correlations are parameters of it: a
voter that is correlated with others given the class depends on the class and on
the vote of one of them, its parent in the forest of greatest conditional mutual
information, so what two voters both say isn't counted twice. Forest and
parameters are estimated in turn. Its posteriors are soft labels for a linear
classifier on hashed words, which decides: a document is toxic if its probability
is at least ``DECIDE``.

The model takes no label as true; induced voters are weighed like the others.
The classifier's features are hashed words and beginnings of words. It is fitted
on a sample of about ``TRAIN_ROWS`` distinct texts of either side of the
posterior, chosen by a hash of the text; votes, pattern counts and decisions
cover all documents and whole texts. All texts are read word by word twice, for
their votes and for the decision; the sample is picked by hash before that.
There are at most ``2 ** len(VOTERS)`` patterns.

Defined results: null and empty texts are never toxic, nor is anything if no
document draws a vote for toxicity, so of an empty table there is nothing. Equal
texts are decided alike; each row of a repeated document is reported; a row
without ``doc_id`` is reported without it. A very long text is one slice of its
own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphwell.llm import kernels
from glyphwell.llm.arrow import map_batches
from glyphwell.session import cut

TRAIN_ROWS = 5_000
DECIDE = 0.5
BUCKET_BITS = 18
RIDGE = 2e-4

#: Words and phrases of each lexicon voter; all vote for toxicity.
LEXICONS = {
    "stupidity": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile imbeciles fool fools foolish dimwit halfwit nitwit dunce brainless clueless cretin cretins simpleton blockhead ignoramus",
    "worth": "loser losers worthless pathetic useless good-for-nothing waste-of-space lowlife lowlifes deadbeat wretch wretched",
    "dehumanising": "scum scumbag scumbags trash garbage vermin filth filthy parasite parasites subhuman subhumans maggot maggots rat rats pig pigs swine cockroach cockroaches savage savages",
    "ridicule": "clown clowns laughingstock crybaby snowflake snowflakes buffoon buffoons freak freaks weirdo weirdos creep creeps creepy wimp wimps",
    "disgust": "disgusting disgust disgusts revolting repulsive gross vile nasty sickening hideous ugly stinking stinks repugnant loathsome abhorrent despicable",
    "profanity": "fuck fucks fucked fucker fuckers fucking motherfucker motherfuckers shit shits shitty bullshit asshole assholes bastard bastards bitch bitches dick dickhead prick pricks cunt cunts crap damn piss pissed wanker wankers twat bollocks douche douchebag jackass",
    "hatred": "hate hates hated hatred despise despises detest loathe loathes racist racists bigot bigots nazi nazis fascist fascists traitor traitors liar liars coward cowards",
    "threat": "kill-you kill-yourself hurt-you beat-you find-you hunt-you-down shoot-you burn-in-hell drop-dead watch-your-back you-will-die you-should-die go-die hope-you-die deserve-to-die rot-in-hell",
    "command": "shut-up get-lost go-to-hell go-away screw-you fuck-you fuck-off piss-off get-out shut-your-mouth nobody-likes-you nobody-cares eat-shit",
    "address": "you-idiot you-moron you-fool you-loser you-clown you-scum you-trash you-are-stupid you-are-pathetic you-are-worthless you-are-disgusting you-are-an-idiot you-are-a-loser you-are-a-moron you-are-trash you-are-scum you-re-an-idiot you-re-pathetic you-re-stupid your-stupid such-a-loser such-an-idiot what-a-moron what-a-loser what-an-idiot",
    "french": "connard connards connasse salaud salauds salope salopes imbécile imbéciles idiote idiots débile débiles crétin crétins ordure ordures merde enculé enculés ferme-la ta-gueule va-te-faire abruti abrutis",
    "german": "arschloch arschlöcher idiotin idioten dummkopf dummköpfe trottel schwachkopf abschaum dreckskerl scheiße scheisse wichser hurensohn halt-die-fresse halts-maul missgeburt versager vollidiot",
    "spanish": "idiotas estúpido estúpida estúpidos imbécil imbéciles cabrón cabrones pendejo pendejos basura hijo-de-puta gilipollas mierda cállate maldito maldita asqueroso asquerosa inútil",
}
#: Voters whose words, or beginnings of words of so many bytes, are found in labelled documents.
INDUCED = ("induced_words", "induced_4", "induced_5", "induced_6")
PREFIXES = (4, 5, 6)
#: Patterns of shape; the last one votes for "not toxic".
SHAPES = ("several_insults", "dense_insults", "shouting", "sparse_insults")
VOTERS = (*LEXICONS, *INDUCED, *SHAPES)
FOR = np.array([n != "sparse_insults" for n in VOTERS])
_SPARSE = 120
#: How much likelier an induced entry must make the label, at the lower end of its interval.
LEAST_LIFT = 10.0
LABELLED_ROWS = 20_000


def _phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    h = words[0]
    for w in words[1:]:
        h = kernels.mix64(h * np.uint64(3) + w)
    return h


def _fold_latin(raw: np.ndarray) -> np.ndarray:
    low = kernels.LOWER[raw]
    at = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    low[at] += 0x20
    return low


def _lexicon_tables() -> list[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 1, 2, .. words: their sorted hashes and the bits of their voters."""
    by_length: dict[int, dict[int, int]] = {}
    for bit, entries in enumerate(LEXICONS.values()):
        for entry in entries.split():
            parts = []
            for word in entry.split("-"):
                raw = np.frombuffer(word.encode(), np.uint8)
                parts.append(kernels.span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)])))
            own = by_length.setdefault(len(parts), {})
            h = int(_phrase_hash(parts)[0])
            own[h] = own.get(h, 0) | 1 << bit
    out = []
    for n in range(1, max(by_length) + 1):
        hashes = np.array(sorted(by_length.get(n, {})), np.uint64)
        out.append((hashes, np.array([by_length[n][int(h)] for h in hashes], np.int64)))
    return out


_tables: list = []


class Slice:
    """Some rows' words: hashes, rows, hashes of their beginnings (0 for words too short), letters and capitals of rows."""

    def __init__(self, part: np.ndarray, at: np.ndarray) -> None:
        low = _fold_latin(part)
        begin, end, self.row = kernels.word_spans(low, at)
        hasher = kernels.span_hasher(low)
        self.n, self.words = len(at) - 1, hasher(begin, end)
        self.beginnings = [np.where(end - begin >= n + 2, hasher(begin, np.minimum(begin + n, end)), np.uint64(0)) for n in PREFIXES]
        self.capitals = np.diff(np.append(0, np.cumsum((part >= 65) & (part <= 90)))[at])
        self.letters = np.diff(np.append(0, np.cumsum((low >= 97) & (low <= 122)))[at])

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct buckets of words and beginnings of each row: rows and buckets."""
        all_ = np.concatenate([(self.row.astype(np.int64) << BUCKET_BITS) | (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) for h in (self.words, *self.beginnings)])
        both = np.unique(all_[np.concatenate([np.ones(len(self.row), bool), *(h != 0 for h in self.beginnings)])])
        return both >> BUCKET_BITS, both & ((1 << BUCKET_BITS) - 1)


def word_rows(column: pa.Array) -> Iterator[tuple[int, int, Slice]]:
    """For each slice: first and last row, and their words."""
    raw, starts = kernels.string_buffer(column)
    for first, last in kernels.slices(starts):
        yield first, last, Slice(raw[starts[first] : starts[last]], starts[first : last + 1] - starts[first])


Induced = tuple[np.ndarray, ...]
NOTHING: Induced = tuple(np.zeros(0, np.uint64) for _ in INDUCED)


def _votes(s: Slice, induced: Induced) -> np.ndarray:
    if not _tables:
        _tables.extend(_lexicon_tables())
    row, n = s.row, s.n
    out, hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
    phrase = s.words
    for k, (known, bits) in enumerate(_tables):
        if k:
            phrase = kernels.mix64(phrase[:-1] * np.uint64(3) + s.words[k:])
            whole = row[k:] == row[: len(row) - k]
        if not len(phrase):
            break
        if not len(known):
            continue
        at = np.searchsorted(known, phrase)
        at[at == len(known)] = 0
        found = known[at] == phrase
        if k:
            found &= whole
        found = np.flatnonzero(found)
        np.bitwise_or.at(out, row[found], bits[at[found]])
        np.add.at(hits, row[found], 1)
    for k, (known, h) in enumerate(zip(induced, (s.words, *s.beginnings))):
        if not len(known) or not len(h):
            continue
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        found = np.bincount(row[known[at] == h], minlength=n)
        out |= (found > 0).astype(np.int64) << (len(LEXICONS) + k)
        hits = np.maximum(hits, found)
    words = np.bincount(row, minlength=n)
    base = len(LEXICONS) + len(INDUCED)
    for k, fires in enumerate((hits >= 3, (hits >= 2) & (hits * 50 >= words), (s.letters >= 40) & (s.capitals * 2 > s.letters) & (hits > 0), hits * _SPARSE <= words)):
        out |= fires.astype(np.int64) << (base + k)
    return out


def votes(column: pa.Array, induced: Induced = NOTHING) -> np.ndarray:
    """A bit for each voter that fires, of every text."""
    out = np.zeros(len(column), np.int64)
    for first, last, s in word_rows(column):
        out[first:last] = _votes(s, induced)
    return out


def induce(docs: DataFrame, labels: DataFrame | None, rows: int = LABELLED_ROWS) -> Induced:
    """Sorted hashes of words, and of beginnings of words, that go with toxic labels."""
    if labels is None:
        return NOTHING
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    # At most ``rows`` short rows: small enough to broadcast whatever the corpus.
    few = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where(F.length("text") > 0).join(few, "doc_id").select("text", "toxic")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        out = []
        for first, last, s in word_rows(batch.column(0)):
            for k, h in enumerate((s.words, *s.beginnings)):
                one = h != 0
                order = np.lexsort((h[one], s.row[one]))
                r, h = s.row[one][order], h[one][order]
                fresh = np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]))[: len(h)]
                out.append((np.full(int(fresh.sum()), k, np.int32), h[fresh].view(np.int64), label[first + r[fresh]].astype(np.int64)))
            for label_now in (0, 1):  # how many documents there are
                out.append((np.array([-1], np.int32), np.array([label_now]), np.array([(label[first:last] == label_now).sum()])))
        kind, h, y = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(h, pa.int64()), pa.array(y, pa.int64())], ["kind", "h", "y"])

    counts = map_batches(found, run, "kind int, h bigint, y bigint").groupBy("kind", "h").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    size = {r.h: r.bad for r in counts.where("kind = -1").collect()}
    good_docs, bad_docs = (int(size.get(v) or 0) for v in (0, 1))
    if not good_docs or not bad_docs:
        return NOTHING
    # The log of the lift, with half a document of either kind added, less 1.96 standard errors.
    good = F.col("n") - F.col("bad")
    log_lift = F.log((F.col("bad") + 0.5) / (bad_docs + 1)) - F.log((good + 0.5) / (good_docs + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) - 1 / (bad_docs + 1) + 1 / (good + 0.5) - 1 / (good_docs + 1))
    table = counts.where((F.col("kind") >= 0) & (F.col("bad") > 0) & (log_lift - 1.96 * error >= float(np.log(LEAST_LIFT)))).select("kind", "h").toArrow()
    kind, h = (table.column(c).to_numpy() for c in ("kind", "h"))
    return tuple(np.sort(h[kind == k].view(np.uint64)) for k in range(len(INDUCED)))


def forest(weight: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The parent of each vertex (-1: none) in the forest of greatest weight over the allowed edges."""
    n, parent = len(weight), np.full(len(weight), -1)
    free = set(range(n))
    while free:
        tree = [min(free)]
        free.discard(tree[0])
        while True:
            edges = [(weight[a, b], -a, -b) for a in tree for b in free if allowed[a, b]]
            if not edges:
                break
            _, a, b = max(edges)
            parent[-b] = -a
            tree.append(-b)
            free.discard(-b)
    return parent


class LabelModel:
    """Rates of the voters in either class given their parents' votes, and the posterior of a pattern."""

    #: Correlation given the class from which on a voter may depend on another.
    CORRELATED = 0.1

    def __init__(self, patterns: np.ndarray, counts: np.ndarray) -> None:
        x, n, v = self._bits(patterns), counts.astype(float), len(VOTERS)
        self.parent, self.prior = np.full(v, -1), 0.05
        # By class (0: other documents), voter and the parent's vote; without a parent both are equal.
        self.given = np.repeat(np.where(FOR, [[0.01], [0.3]], [[0.9], [0.1]])[:, :, None], 2, axis=2)
        for _ in range(3):
            for _ in range(200):
                p = self._posterior(x)
                moved = self._fit(x, n, p)
                if moved < 1e-7:
                    break
            p = self._posterior(x)
            information = np.zeros((v, v))
            covariance = np.zeros((v, v))
            for q in (1 - p, p):
                w = n * q / n.sum()
                one = w @ x
                both = {(1, 1): (x * w[:, None]).T @ x}
                both[1, 0], both[0, 1] = one[:, None] - both[1, 1], one[None, :] - both[1, 1]
                both[0, 0] = w.sum() - one[:, None] - one[None, :] + both[1, 1]
                marginal = {1: one, 0: w.sum() - one}
                for (a, b), joint in both.items():
                    product = np.outer(marginal[a], marginal[b]) / max(w.sum(), 1e-300)
                    information += np.where((joint > 1e-12) & (product > 1e-300), joint * np.log(np.maximum(joint, 1e-12) / np.maximum(product, 1e-300)), 0)
                covariance += both[1, 1] - np.outer(one, one) / max(w.sum(), 1e-300)
            spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
            self.correlation = covariance / np.outer(spread, spread)
            before = self.parent
            self.parent = forest(information, (np.abs(self.correlation) > self.CORRELATED) & ~np.eye(v, dtype=bool))
            if (before == self.parent).all():
                break
            self._fit(x, n, p)

    @property
    def rates(self) -> np.ndarray:
        """How often each voter fires in either class, whatever its parent says."""
        return self.marginal

    def _bits(self, patterns: np.ndarray) -> np.ndarray:
        return ((patterns[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)

    def _fit(self, x: np.ndarray, n: np.ndarray, p: np.ndarray) -> float:
        """Parameters from posteriors; how far the largest one moved."""
        given, has = np.empty_like(self.given), self.parent >= 0
        self.marginal = np.empty((2, x.shape[1]))
        above = np.where(has, x[:, self.parent], 0)
        for c, q in enumerate((1 - p, p)):
            w = n * q
            self.marginal[c] = (w @ x + 0.1) / (w.sum() + 0.2)
            for vote in (0, 1):
                chosen = np.where(has, above == vote, True) * w[:, None]
                given[c, :, vote] = ((chosen * x).sum(axis=0) + 0.1) / (chosen.sum(axis=0) + 0.2)
        given, prior = np.clip(given, 1e-6, 1 - 1e-6), ((n * p).sum() + 0.1) / (n.sum() + 0.2)
        moved = np.abs(given - self.given).max() + abs(prior - self.prior)
        self.given, self.prior = given, prior
        return moved

    def _posterior(self, x: np.ndarray) -> np.ndarray:
        above = np.where(self.parent >= 0, x[:, self.parent], 0).astype(int)
        rate = self.given[:, np.arange(x.shape[1]), above]
        odds = np.log(self.prior / (1 - self.prior)) + np.where(x > 0, np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))).sum(axis=1)
        # A document for which no voter speaks isn't toxic, whatever the rest says.
        return np.where(x[:, FOR].any(axis=1), 1 / (1 + np.exp(-np.clip(odds, -500, 500))), 0.0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(self._bits(patterns))


def voted(texts: DataFrame, induced: Induced = NOTHING) -> DataFrame:
    """``draw`` and ``pattern`` of every text of ``texts`` (``text``, ``draw``)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes(batch.column(0), induced))], ["draw", "pattern"])

    return map_batches(texts.select("text", "draw"), run, "draw bigint, pattern bigint")


def minimise(f, x: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """The minimum of a smooth convex function by L-BFGS; ``f`` gives value and gradient."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, used = g.copy(), []
        for s, y, rho in reversed(steps):
            used.append(rho * (s @ q))
            q -= used[-1] * y
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(np.abs(g).sum(), 1e-12)
        for (s, y, rho), alpha in zip(steps, reversed(used)):
            q += (alpha - rho * (y @ q)) * s
        t, slope = 1.0, -(g @ q)
        while True:
            after, h = f(x - t * q)
            if after <= value + 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        s, y = -t * q, h - g
        x, done, value, g = x + s, value - after < 1e-9 * max(1.0, abs(value)), after, h
        if s @ y > 1e-18:
            steps = [*steps[1 - memory :], (s, y, 1 / (s @ y))]
        if done:
            break
    return x


def fit(row: np.ndarray, bucket: np.ndarray, target: np.ndarray, sample_weight: np.ndarray, ridge: float = RIDGE, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights of the buckets and a bias: logistic regression with soft targets."""
    used, column = np.unique(bucket, return_inverse=True)
    column, row = column.astype(np.int32), row.astype(np.int32)
    n, d = len(target), len(used)
    weight = sample_weight / sample_weight.sum()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        odds = np.bincount(row, weights=x[column], minlength=n) + x[d]
        error = weight * (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - target)
        value = (weight * (np.logaddexp(0, odds) - target * odds)).sum() + ridge / 2 * (x[:d] @ x[:d])
        return value, np.append(np.bincount(column, weights=error[row], minlength=d) + ridge * x[:d], error.sum())

    x = minimise(loss, np.zeros(d + 1), rounds)
    out = np.zeros(1 << BUCKET_BITS, np.float32)
    out[used] = x[:d]
    return out, float(x[d])


class Classifier:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def probability(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first, last, s in word_rows(column):
            r, b = s.buckets()
            odds = np.bincount(r, weights=self.weights[b], minlength=s.n) + self.bias
            out[first:last] = np.where(np.bincount(s.row, minlength=s.n) > 0, 1 / (1 + np.exp(-np.clip(odds, -500, 500))), 0.0)
        return out


def train(docs: DataFrame, labels: DataFrame | None = None, rows: int = TRAIN_ROWS) -> Classifier | None:
    """The classifier for the texts of ``docs``, or None if nothing is voted toxic."""
    texts = docs.where(F.length("text") > 0).select("text", F.xxhash64("text").alias("draw"))
    seen = cut(voted(texts, induce(docs, labels)))
    found = seen.groupBy("pattern").agg(F.count("*").alias("n")).toArrow().sort_by("pattern")
    patterns, counts = found.column("pattern").to_numpy(), found.column("n").to_numpy()
    if not len(patterns) or not ((patterns & int((FOR << np.arange(len(VOTERS))).sum())) > 0).any():
        return None
    p = LabelModel(patterns, counts).posterior(patterns)
    toxic = p >= 0.5
    # A text is drawn if its hash, as a number from 0 to 1, is below its side's share.
    share = {side: min(1.0, rows / max(int(counts[toxic == side].sum()), 1)) for side in (False, True)}
    kinds = texts.sparkSession.createDataFrame([(int(a), float(b), share[b >= 0.5]) for a, b in zip(patterns, p)], "pattern bigint, target double, share double")
    lot = (F.shiftrightunsigned("draw", 11) / float(1 << 53)).alias("lot")
    # About ``rows`` hashes of either side: small enough to broadcast whatever the corpus, as patterns are.
    drawn = seen.join(F.broadcast(kinds), "pattern").where(lot < F.col("share")).groupBy("draw").agg(F.max("target").alias("target"))
    sample = texts.join(F.broadcast(drawn), "draw").groupBy("draw").agg(F.first("text").alias("text"), F.first("target").alias("target")).select("text", "draw", "target")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, _, s in word_rows(batch.column(0)):
            r, b = s.buckets()
            edge = np.searchsorted(r, np.arange(s.n + 1))
            out += [b[x:y].astype(np.int32) for x, y in zip(edge, edge[1:])]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int32())), batch.column(2)], ["draw", "buckets", "target"])

    table = map_batches(sample, run, "draw bigint, buckets array<int>, target double").toArrow().combine_chunks().sort_by("draw")
    lists = table.column("buckets").combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    target = table.column("target").to_numpy()
    # Each side counts as much as it does in the corpus, but neither less than a fifth.
    bad = target >= 0.5
    weight = np.where(bad, 1 / max(bad.sum(), 1), 1 / max((~bad).sum(), 1))
    mass = np.clip(counts[toxic].sum() / counts.sum(), 0.2, 0.8)
    weight *= np.where(bad, mass, 1 - mass)
    return Classifier(*fit(row, lists.flatten().to_numpy(zero_copy_only=False), target, weight))


def toxic(docs: DataFrame, labels: DataFrame | None = None, rows: int = TRAIN_ROWS, decide: float = DECIDE) -> DataFrame:
    """``doc_id`` and ``toxicity`` of the toxic documents."""
    slim = docs.where(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = train(docs, labels, rows)
    if model is None:
        return slim.select("doc_id", F.lit(0.0).alias("toxicity")).where("false")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.probability(batch.column(1))
        hit = p >= decide
        return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit)), pa.array(p[hit])], ["doc_id", "toxicity"])

    return map_batches(slim, run, "doc_id bigint, toxicity double")


def query(spark, sf_dir: str) -> DataFrame:
    return toxic(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
