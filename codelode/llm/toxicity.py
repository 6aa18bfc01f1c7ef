"""Toxicity by class-conditional Kneser-Ney models.

Two models of the next byte within a word, one learned from toxic and one from ordinary texts, share all their lower
orders: only the highest order counts by class, and both back off to the same interpolated Kneser-Ney model of
continuation counts over all texts, labelled or not. An expression that at most ``DISCOUNT`` labelled texts of a class
hold is rare: its whole count goes to the shared backoff, so it says no more than its context does.

The comparison is a sum over the words of a text, divided by their number. A toxic text is ordinary in most of its words,
which a plain difference of the two log-likelihoods does not know: it adds up the noise of hundreds of ordinary words (on
sf0.1 it ranks held-out texts with an area of 0.75, this form with 0.98). So each word counts with the log of
``1 - SHARE + SHARE * p_toxic / p_ordinary``. A logistic curve turns the number into a score.

All labelled texts are counted, the lower orders over all documents. The curve is fitted on texts scored by models that
have not counted them: ``FOLDS`` folds of the labels by a seeded digest, at most ``MAX_LABELLED`` texts a class, weighted
back to the labels' share, so that neither the curve nor a score follows the cap. All texts are scored whole.

Counts, backoff probabilities and ratios are joins and groups in Spark; what the driver collects and broadcasts is one row
for each n-gram that more than ``DISCOUNT`` labelled texts of a class hold (8 bytes and a float a fold). Its number follows
the different words of the labelled texts, not their length: a text counts each of its words once.

Nulls and empty texts have no evidence (difference 0) and get the score of that. Null labels are not learned from; of
repeated labels the lowest counts. Without labelled rows of both classes every score is 0. Equal texts get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, seeded_digest, tidy

ORDER = 8
MAX_LABELLED = 3_000
FOLDS = 3
#: Texts of a class that an expression must be in to say something; the lower orders' discount.
DISCOUNT, LOWER_DISCOUNT = 3, 0.75
#: Share of a toxic text's words that the toxic model accounts for; the others are ordinary.
SHARE = 0.005
#: Words without evidence added to each text, so that one odd word doesn't decide a very short one.
FEW = 6
#: Words scored at once.
CHUNK = 1 << 13
#: Texts counted at once, and the different n-grams at which a task hands its counts on.
TEXTS, HELD = 256, 1 << 18
#: Labels are broadcast up to this many (a long and an int each), else joined by a shuffle of the texts.
MAX_BROADCAST_LABELS = 2_000_000


def grams(data: bytes, order: int = ORDER) -> np.ndarray:
    """Every ``order`` bytes as one integer, first byte highest."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(x) - order + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(order):
        out = (out << np.uint64(8)) | x[k : n + k] if n > 0 else out
    return out


WORD = re.compile(r"\w+")
PAD = b" " * (ORDER - 1)


def padded(words: list[str]) -> bytes:
    """Each word after a full context of blanks, so that no context reaches into the word before."""
    return PAD + PAD.join(w.encode("utf-8", "surrogatepass") for w in words) + b" " if words else b""


def document_words(text: str) -> bytes:
    """The different words of a text: its repeated lines don't weigh more in the counts."""
    return padded(list(dict.fromkeys(WORD.findall(text.lower()))))


def informative(g: np.ndarray) -> np.ndarray:
    """Without the blanks between words: n-grams that end in two blanks say nothing."""
    return g[(g & np.uint64(0xFFFF)) != np.uint64(0x2020)]


@dataclass
class Model:
    """Sorted n-grams and contexts, and the log of p_toxic / p_ordinary for each, a row a model: all labels, then all but a fold."""

    seen: np.ndarray
    seen_llr: np.ndarray
    contexts: np.ndarray
    contexts_llr: np.ndarray
    slope: float = 0.0
    intercept: float = -50.0

    def only(self, k: int) -> Model:
        return Model(self.seen, self.seen_llr[k : k + 1], self.contexts, self.contexts_llr[k : k + 1], self.slope, self.intercept)

    def word_ratios(self, words: list[str], k: int = 0) -> np.ndarray:
        """The log of p_toxic / p_ordinary of each word."""
        g = informative(grams(padded(words)))
        llr = np.zeros(len(g))
        if len(self.seen):
            place = np.minimum(np.searchsorted(self.seen, g), len(self.seen) - 1)
            hit = self.seen[place] == g
            llr[hit] = self.seen_llr[k, place[hit]]
            lost = np.flatnonzero(~hit)
            h = g[lost] >> np.uint64(8)
            place = np.minimum(np.searchsorted(self.contexts, h), len(self.contexts) - 1)
            llr[lost] = np.where(self.contexts[place] == h, self.contexts_llr[k, place], np.float32(0))
        ends = np.flatnonzero((g & np.uint64(0xFF)) == np.uint64(0x20))
        return np.add.reduceat(llr, np.concatenate([[0], ends[:-1] + 1]))

    def evidence(self, text: str, k: int = 0) -> float:
        """Mean over the words of the log-likelihood ratio, toxic texts being ordinary in most words."""
        words = WORD.findall(text.lower()) if text else []
        if not words or not len(self.seen):
            return 0.0
        total = 0.0
        for at in range(0, len(words), CHUNK):
            ratios = self.word_ratios(words[at : at + CHUNK], k)
            total += float(np.log1p(SHARE * np.expm1(np.minimum(ratios, 30.0))).sum())
        return total / (len(words) + FEW)

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + float(np.exp(np.clip(-(self.slope * evidence + self.intercept), -500, 500))))


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, rounds: int = 60, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton's method, slightly regularised; ``weight`` is how many rows each stands for."""
    if not toxic.any() or toxic.all():
        return 0.0, -50.0
    weight = np.ones(len(evidence)) if weight is None else weight
    scale = float(np.sqrt(np.average((evidence - np.average(evidence, weights=weight)) ** 2, weights=weight))) or 1.0
    x = np.stack([evidence / scale, np.ones(len(evidence))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (weight * (p - toxic)) + np.array([0.02, 0.0]) * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.02, 1e-6])
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, float(np.abs(step).max()) / 4)
    return float(w[0]) / scale, float(w[1])


#: Counts of a fold: toxic texts in the upper 32 bits, ordinary ones in the lower, so that both are one sum.
_FOLDS = [f"fold{k}" for k in range(FOLDS)]
_COUNTS = "gram long, " + ", ".join(f"{c} long" for c in _FOLDS)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and the sums of their rows."""
    g, n = np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(g, kind="stable")
    g = g[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.array([], np.int64)
    return g[first], np.add.reduceat(n[order], first, axis=0) if len(g) else n


@tidy
def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of (text, kind) by ``_FOLDS``, a kind being twice the fold and 1 for toxic; a null kind is counted in none."""

    def rows(own: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *[pa.array(n[:, k].copy()) for k in range(n.shape[1])]], ["gram", *_FOLDS])

    held = np.array([], np.uint64), np.zeros((0, FOLDS), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            texts: dict[int | None, list[bytes]] = {}
            for text, kind in zip(*(batch.column(k).slice(at, TEXTS) for k in (0, 1)), strict=True):
                texts.setdefault(kind.as_py(), []).append(document_words(text.as_py() or ""))
            parts = [held]
            for kind, some in texts.items():
                own, count = np.unique(informative(grams(b"".join(some))), return_counts=True)
                n = np.zeros((len(own), FOLDS), np.int64)
                if kind is not None:
                    n[:, kind // 2] = count << 32 if kind % 2 else count
                parts.append((own, n))
            held = _merged(parts)
            if len(held[0]) > HELD:
                yield rows(*held)
                held = held[0][:0], held[1][:0]
    yield rows(*held)


def _suffix(gram: Column, order: Column) -> Column:
    """The last ``order`` bytes."""
    bits = F.lit(64) - 8 * order.cast("int")
    return F.call_function("shiftrightunsigned", F.call_function("shiftleft", gram, bits), bits)


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 8)


def shared_probability(grams_: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p): the interpolated Kneser-Ney probability of each wanted ``order``-gram's last byte after the ``order - 2`` before.

    ``grams_`` has the distinct ``order``-grams of all texts (gram), ``wanted`` some of them. A lower order counts in how
    many different n-grams of the next order it is; the lowest is smoothed over all bytes.
    """
    orders = F.explode(F.sequence(F.lit(1), F.lit(order - 1))).alias("order")
    parts = grams_.select("gram", F.explode(F.sequence(F.lit(2), F.lit(order - 1))).alias("order"))
    parts = parts.select("order", _suffix(F.col("gram"), F.col("order")).alias("gram")).distinct()
    parts = parts.unionByName(grams_.select(F.lit(order).alias("order"), "gram"))
    counts = parts.select((F.col("order") - 1).alias("order"), "gram").select("order", _suffix(F.col("gram"), F.col("order")).alias("gram")).groupBy("order", "gram").agg(F.count("*").alias("count"))
    contexts = counts.groupBy("order", _context(F.col("gram")).alias("context")).agg(F.sum("count").alias("total"), F.count("*").alias("kinds"))
    rows = wanted.select("gram", orders).withColumn("part", _suffix(F.col("gram"), F.col("order")))
    levels = (
        rows.join(counts.withColumnRenamed("gram", "part"), ["order", "part"]).withColumn("context", _context(F.col("part")))
        .join(contexts, ["order", "context"]).groupBy("gram")
        .agg(F.array_sort(F.collect_list(F.struct("order", F.col("count").cast("double").alias("count"), F.col("total").cast("double").alias("total"), F.col("kinds").cast("double").alias("kinds")))).alias("levels"))
    )
    step = lambda p, x: F.when(x["order"] == 1, (x["count"] + 0.5) / (x["total"] + 128)).otherwise(
        (F.greatest(x["count"] - LOWER_DISCOUNT, F.lit(0.0)) + LOWER_DISCOUNT * x["kinds"] * p) / x["total"]
    )
    return levels.select("gram", F.aggregate("levels", F.lit(0.0), step).alias("p"))


def _ratios(of: list[tuple[Column, Column]]) -> list[Column]:
    """Columns llr0 (all labels), llr1 ... (all but a fold) of pairs of expressions per model."""
    return [(F.ln(toxic) - F.ln(ordinary)).cast("float").alias(f"llr{k}") for k, (ordinary, toxic) in enumerate(of)]


def build(counted: DataFrame) -> Model:
    """The models of ``counted`` (gram and its counts by ``_FOLDS``)."""

    counted = counted.select(
        "gram", *[F.shiftright(c, 32).alias(f"toxic{k}") for k, c in enumerate(_FOLDS)], *[F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"ordinary{k}") for k, c in enumerate(_FOLDS)]
    )

    def by_model(column) -> list[tuple[Column, Column]]:
        """What ``column`` makes of the counts (ordinary, toxic) of each model."""
        count = lambda kind, k: sum((F.col(f"{kind}{f}") for f in range(FOLDS) if f != k - 1), F.lit(0))
        return [(column("ordinary", count("ordinary", k), k), column("toxic", count("toxic", k), k)) for k in range(FOLDS + 1)]

    frequent = counted.filter(F.greatest(*by_model(lambda _kind, n, _k: n)[0]) > DISCOUNT)
    sums = [x for pair in by_model(lambda kind, n, k: F.struct(F.sum(n).alias("all"), F.sum(F.least(n, F.lit(DISCOUNT))).alias("rare")).alias(f"{kind}_{k}")) for x in pair]
    wanted = frequent.select(_context(F.col("gram")).alias("context")).distinct()
    contexts = counted.withColumn("context", _context(F.col("gram"))).join(wanted, "context", "left_semi").groupBy("context").agg(*sums)
    backed = lambda kind, k: F.when(F.col(f"{kind}_{k}.all") > 0, F.col(f"{kind}_{k}.rare") / F.col(f"{kind}_{k}.all")).otherwise(1.0)
    p = lambda kind, n, k: F.when(
        F.col(f"{kind}_{k}.all") > 0, F.greatest(n - DISCOUNT, F.lit(0)) / F.col(f"{kind}_{k}.all")).otherwise(0.0) + backed(kind, k) * F.col("p")
    scratch = Scratch(counted.sparkSession)
    contexts = scratch.write(contexts, "contexts")
    probable = shared_probability(counted.select("gram"), frequent.select("gram"))
    grams_ = frequent.join(probable, "gram").withColumn("context", _context(F.col("gram"))).join(contexts, "context").select("gram", *_ratios(by_model(p)))
    # What no class has after a context says as much as the classes' backoff weights, and nothing where one class lacks the context.
    both = lambda k: (F.col(f"ordinary_{k}.all") > 0) & (F.col(f"toxic_{k}.all") > 0)
    unseen = lambda kind, _n, k: F.when(both(k), F.greatest(backed(kind, k), F.lit(1e-3))).otherwise(1.0)
    found = [x.toArrow() for x in (grams_, contexts.select("context", *_ratios(by_model(unseen))))]
    scratch.drop_all_but()
    out = []
    for table in found:
        keys = table.column(0).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        out += [keys[order], np.stack([table.column(k + 1).to_numpy()[order] for k in range(FOLDS + 1)])]
    return Model(*out)


def learn_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 5) -> Model:
    """The model of ``labels`` (doc_id, toxic 0 or 1) over the texts of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    digest = seeded_digest(seed, F.col("doc_id"))
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"))
    known = scratch.write(known.withColumn("fold", (F.conv(F.substring(digest, 9, 4), 16, 10).cast("int") % FOLDS)), "known")
    numbers = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_known = sum(numbers.values())
    kinds = known.select("doc_id", (2 * F.col("fold") + F.col("toxic")).alias("kind"))
    texts = docs.select("doc_id", "text").join(F.broadcast(kinds) if n_known <= MAX_BROADCAST_LABELS else kinds, "doc_id", "left").select("text", "kind")
    counted = texts.mapInArrow(_count_grams, _COUNTS).groupBy("gram").agg(*[F.sum(c).alias(c) for c in _FOLDS])
    if set(numbers) != {0, 1}:
        return Model(*(np.zeros(0, np.uint64), np.zeros((FOLDS + 1, 0), np.float32)) * 2)
    model = build(scratch.write(counted, "counted"))
    # At most 2 * max_labelled rows of three numbers are broadcast; what they stand for is two counts.
    ours = [known.filter(F.col("toxic") == kind).orderBy(digest, "doc_id").limit(max_labelled) for kind in (0, 1)]
    some = F.broadcast(ours[0].unionByName(ours[1]))
    seen = docs.select("doc_id", "text").join(some, "doc_id").select("toxic", evidence(model, F.col("text"), F.col("fold") + 1).alias("x")).toArrow()
    scratch.drop_all_but()
    toxic = seen.column("toxic").to_numpy().astype(float)
    weight = np.where(toxic > 0, *(numbers[kind] / min(numbers[kind], max_labelled) for kind in (1, 0)))
    model = model.only(0)
    model.slope, model.intercept = fit_curve(seen.column("x").to_numpy(), toxic, weight=weight)
    return model


def evidence(model: Model, text: Column, which: Column | None = None) -> Column:
    """The evidence of each text by the model that ``which`` numbers."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @tidy
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = shared.value
        for texts, kinds in batches:
            yield pa.array([own.evidence(t.as_py() or "", k) for t, k in zip(texts, kinds.to_pylist(), strict=True)], pa.float64())

    return of(text, F.lit(0) if which is None else which)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The input with ``evidence``, ``score`` and ``predicted``."""
    x = F.col("evidence") * model.slope + model.intercept
    score = 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))
    return (
        docs.withColumn("evidence", evidence(model, F.col(text_col)))
        .withColumn("score", score)
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
