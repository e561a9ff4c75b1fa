"""Subject areas of documents.

The model is a bag of embeddings: a statement (sentence or line) is the average of its words, a word
the average of hashed embeddings of itself and its 3- to 5-letter parts, and each subject has a
logistic output of its own. Training is synchronous: every partition of the labelled sample returns
the gradient of its statements, the driver adds them up and takes an Adam step.

Labels are given for documents but wanted for statements. In the first rounds every statement has its
document's labels; statements that say nothing of a subject are seen under all of them and sink to
its base rate. In the later rounds a statement keeps a label only as far as the model sees it there,
so that it is scored near 0 or 1. Averages make the model linear in its words: what a word adds to
each output is computed once a word, and a document is scored by one scan of its text.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir

#: Most labelled documents that are fitted on; embeddings and their width; partitions of the sample.
MAX_LABELLED, BUCKETS, WIDTH, PARTS = 5_000, 1 << 14, 16, 4
#: Rounds with document labels, rounds with statement labels, step of Adam.
ROUNDS, LATER, STEP = 36, 44, 0.1
#: How far a statement must score above the base rate, on the way to 1, to keep a label in the later rounds.
LIFT = 0.06
#: Lowest score of a statement that deals with a subject; share of the topical statements that makes it the document's.
SCORE, SHARE = 0.4, 0.25

#: A tag, a word, or what ends a statement: a line end, or a full stop before a blank.
_TOKEN = re.compile(r"<[^<>\r\n]*>|[^\W\d_]+|[\r\n]|[.!?](?=\s)")


class Vocabulary(dict):
    """Token to number: words count from 1, everything that ends a statement is 0."""

    def __init__(self):
        super().__init__()
        self.words: list[str] = [""]

    def __missing__(self, token: str) -> int:
        if token[0].isalpha():
            self[token] = n = len(self.words)
            self.words.append(token)
            return n
        if len(token) == 1:
            self[token] = 0
        return 0


def tokens(text: str) -> list[str]:
    """Words and ends of statements, in lower case and composed form."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _TOKEN.findall(text.lower())


def statements(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offsets, document) of the statements with a word, over all texts."""
    flat: list[int] = []
    ends: list[int] = []
    number = vocabulary.__getitem__
    for t in texts:
        flat.extend(map(number, tokens(t)))
        flat.append(0)
        ends.append(len(flat))
    w = np.array(flat, np.int32)
    if not len(w):
        return w, np.zeros(1, np.int64), np.zeros(0, np.int64)
    is_word = w > 0
    first = is_word & np.r_[True, ~is_word[:-1]]
    starts = np.nonzero(first)[0]
    document = np.searchsorted(np.array(ends), starts, "right")
    words_before = np.cumsum(is_word) - is_word
    return w[is_word], np.r_[words_before[starts], is_word.sum()].astype(np.int64), document


def parts_of(word: str) -> list[int]:
    """Buckets of a word and its parts."""
    x = f"<{word}>"
    found = [x, *(x[i : i + n] for n in (3, 4, 5) for i in range(len(x) - n + 1))]
    return [zlib.crc32(p.encode()) % BUCKETS for p in found]


def word_parts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets) of the words."""
    p = [parts_of(w) for w in words]
    return np.fromiter((b for x in p for b in x), np.int32), np.cumsum([0, *map(len, p)])


def _sum_by(keys: np.ndarray, rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values[rows] by key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(k):
        starts = np.r_[0, np.nonzero(np.diff(k))[0] + 1]
        out[k[starts]] = np.add.reduceat(values[rows[order]], starts, axis=0)
    return out


def _segments(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, offsets[:-1], axis=0) / np.diff(offsets)[:, None].astype(np.float32)


class Sample:
    """Statements of labelled documents, equal ones once, with how often they came and their mean labels."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        vocabulary = Vocabulary()
        words, offsets, document = statements(texts, vocabulary)
        seen: dict[bytes, int] = {}
        group = np.fromiter((seen.setdefault(words[a:b].tobytes(), len(seen)) for a, b in zip(offsets, offsets[1:])), np.int64, len(document))
        first = np.full(len(seen), -1, np.int64)
        first[group[::-1]] = np.arange(len(group))[::-1]
        self.weight = np.bincount(group, minlength=len(seen)).astype(np.float32)
        self.target = np.stack([np.bincount(group, labels[document, k], len(seen)) for k in range(labels.shape[1])], 1).astype(np.float32) / self.weight[:, None] if len(seen) else np.zeros((0, labels.shape[1]), np.float32)
        n = np.diff(offsets)[first] if len(seen) else np.zeros(0, np.int64)
        self.words = np.concatenate([words[offsets[i] : offsets[i + 1]] for i in first]) - 1 if len(seen) else words
        self.offsets = np.cumsum(np.r_[0, n])
        self.buckets, self.parts = word_parts(vocabulary.words[1:])

    def to_bytes(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **vars(self))
        return f.getvalue()

    @classmethod
    def from_bytes(cls, b: bytes) -> Sample:
        s = cls.__new__(cls)
        s.__dict__.update(np.load(io.BytesIO(b)))
        return s

    def gradient(self, model: Model, later: bool) -> dict[str, np.ndarray]:
        """Sums over the statements, not yet divided by their number."""
        if not len(self.weight):
            return {}
        words = _segments(model.embedding[self.buckets], self.parts)
        hidden = _segments(words[self.words], self.offsets)
        score = 1 / (1 + np.exp(-(hidden @ model.output + model.bias)))
        target = self.target
        if later:  # a statement keeps the label that fits it best, if it fits at all
            fit = score * (target > 0)
            base = (self.weight @ target) / self.weight.sum()  # what a statement about nothing scores
            target = target * ((score > base + LIFT * (1 - base)) & (fit >= 0.999 * fit.max(1, keepdims=True)))
        off = ((score - target) * self.weight[:, None]).astype(np.float32)
        per_word = (off @ model.output.T) / np.diff(self.offsets)[:, None].astype(np.float32)
        at_word = _sum_by(self.words, np.repeat(np.arange(len(self.weight)), np.diff(self.offsets)), per_word, len(words))
        at_word /= np.diff(self.parts)[:, None].astype(np.float32)
        embedding = _sum_by(self.buckets, np.repeat(np.arange(len(words)), np.diff(self.parts)), at_word, len(model.embedding))
        return {"embedding": embedding, "output": hidden.T @ off, "bias": off.sum(0)}


class Model:
    """Embeddings and logistic outputs."""

    def __init__(self, subjects: list[str], seed: int = 5):
        r = np.random.default_rng(seed)
        self.subjects = subjects
        self.embedding = (r.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
        self.output = (r.standard_normal((WIDTH, len(subjects))) * 0.5).astype(np.float32)
        self.bias = np.full(len(subjects), -2, np.float32)

    def word_outputs(self, words: list[str]) -> np.ndarray:
        """What each word adds to the outputs of a statement of one word, without the bias."""
        buckets, offsets = word_parts(words)
        return _segments(self.embedding[buckets], offsets) @ self.output


def labelled_sample(documents: DataFrame, labels: DataFrame, subjects: list[str], most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, subjects): labelled documents with text, at most ``most`` of them, chosen by a hash of their id."""
    name = F.lower(F.trim("subject"))
    known = labels.where(name.isin(subjects) & F.col("doc_id").isNotNull()).select("doc_id", name.alias("subject"))
    per = known.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    n = per.count()
    if n > most:  # a threshold of the hash instead of a sort of all; 1.1 times as many as wanted, of which the first count
        drawn = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 40))
        per = per.where(drawn < int(1.1 * most / n * (1 << 40))).orderBy(drawn, "doc_id").limit(most)
    # at most ``most`` rows of an id and some names
    return documents.where(F.col("text").rlike(r"\S")).select("doc_id", "text").join(F.broadcast(per), "doc_id")


def train(sample: DataFrame, subjects: list[str], *, rounds: int = ROUNDS, later: int = LATER, parts: int = PARTS) -> Model:
    """Fit the model on (text, subjects) rows; an empty sample leaves it as it starts, which finds nothing."""
    spark = sample.sparkSession
    shared_dir(spark)
    place = {s: i for i, s in enumerate(subjects)}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            rows = pd.concat(held)
            y = np.zeros((len(rows), len(place)), np.float32)
            for i, names in enumerate(rows["subjects"]):
                y[i, [place[s] for s in names]] = 1
            yield pd.DataFrame({"statements": [Sample(list(rows["text"]), y).to_bytes()]})

    data = sample.select("text", "subjects").repartition(parts, F.xxhash64("text")).mapInPandas(read, "statements binary").checkpoint()
    model = Model(subjects)
    first = {k: np.zeros_like(getattr(model, k)) for k in ("embedding", "output", "bias")}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    for n in range(1, rounds + later + 1):
        shared = spark.sparkContext.broadcast(model)

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for raw in b["statements"]:
                    s = Sample.from_bytes(raw)
                    g = s.gradient(shared.value, n > rounds)
                    if g:
                        touched = np.nonzero(np.abs(g["embedding"]).max(1))[0].astype(np.int32)
                        yield pd.DataFrame(
                            {"n": [float(s.weight.sum())], "rows": [touched.tobytes()], "embedding": [g["embedding"][touched].tobytes()], "output": [g["output"].tobytes()], "bias": [g["bias"].tobytes()]}
                        )

        # one row a partition of the bounded sample
        got = data.mapInPandas(step, "n double, rows binary, embedding binary, output binary, bias binary").collect()
        total = sum(r.n for r in got)
        if not total:
            break
        sums = {k: np.zeros_like(v) for k, v in first.items()}
        for r in got:
            sums["embedding"][np.frombuffer(r.rows, np.int32)] += np.frombuffer(r.embedding, np.float32).reshape(-1, WIDTH)
            sums["output"] += np.frombuffer(r.output, np.float32).reshape(WIDTH, -1)
            sums["bias"] += np.frombuffer(r.bias, np.float32)
        rate = STEP * (1 if n <= rounds + 0.7 * later else 0.5)
        for k, g in sums.items():
            g *= 10 / total
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            move = rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-6)
            setattr(model, k, (getattr(model, k) - move).astype(np.float32))
        shared.destroy()
    return model


def score(documents: DataFrame, model: Model, *, threshold: float = SCORE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject, statements, topical): per document and subject the statements that deal with it, and all topical ones.

    A statement deals with each subject that its own output scores at least ``threshold``; it may be several. Documents of
    null, empty or blank text, those without an id and those without a topical statement give no rows. Texts are scored
    whole; repeated rows come out repeatedly.
    """
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    subjects = np.array(model.subjects, object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        vocabulary, outputs = Vocabulary(), np.zeros((1, len(m.subjects)), np.float32)
        for b in batches:
            if len(vocabulary.words) > 300_000:  # typing errors have no end
                vocabulary, outputs = Vocabulary(), outputs[:1]
            words, offsets, document = statements(list(b["text"]), vocabulary)
            if len(vocabulary.words) > len(outputs):
                outputs = np.concatenate([outputs, m.word_outputs(vocabulary.words[len(outputs) :])])
            if not len(document):
                continue
            z = _segments(outputs[words], offsets) + m.bias
            deals = z >= np.log(threshold / (1 - threshold))  # each output on its own
            counts = np.zeros((len(b), len(m.subjects)), np.int32)
            row, k = np.nonzero(deals)
            np.add.at(counts, (document[row], k), 1)
            topical = np.bincount(document[deals.any(1)], minlength=len(b)).astype(np.int32)
            d, k = np.nonzero(counts)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[d], "subject": subjects[k], "statements": counts[d, k], "topical": topical[d]})

    rows = documents.where(F.col(text).rlike(r"\S") & F.col(id).isNotNull()).select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, subject string, statements int, topical int")


def subject_names(subjects: DataFrame) -> list[str]:
    """The subjects' names in order (a table of some dozens of rows)."""
    return sorted(r[0] for r in subjects.select(F.lower(F.trim("subject"))).distinct().collect() if r[0])


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, *, share: float = SHARE) -> DataFrame:
    """(doc_id, subject): the subjects that at least ``share`` of a document's topical statements deal with.

    Trained on ``labelled_sample``. Labels that are null, unknown or repeated count as none or once;
    letter case does not matter. Null and blank texts have no subject.
    """
    names = subject_names(subjects)
    if not names:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string")
    model = train(labelled_sample(documents, labels, names), names)
    return score(documents, model).where(F.col("statements") >= F.lit(share) * F.col("topical")).select("doc_id", "subject").distinct()


def composition(found: DataFrame, documents: DataFrame, size: Column) -> DataFrame:
    """(subject, documents, tokens, share): the corpus by subject; documents without a subject under 'none'.

    A document of several subjects counts in full for each; share is of all documents' tokens.
    """
    sized = documents.select("doc_id", size.alias("tokens"))
    rows = sized.join(found, "doc_id", "left").select(F.coalesce("subject", F.lit("none")).alias("subject"), "tokens")
    total = sized.agg(F.sum("tokens").alias("total"))
    r = rows.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    return r.join(F.broadcast(total)).select("subject", "documents", "tokens", F.round(F.try_divide("tokens", "total"), 6).alias("share"))
