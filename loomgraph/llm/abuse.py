"""Abusive, hateful and sexual content: a classifier chain over text segments, trained from document labels.

No word list takes part: every weight, and the lexicon by which hidden spellings are read, comes from the labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of the chain: each model sees the probabilities of those before it; the last is the verdict.
CHAIN = ("insult", "hate", "threat", "sexual", "abusive")
HASH_BITS = 18
SIZE = 1 << HASH_BITS
#: Behind the hashed words, pairs and letters: hidden spellings, words in capitals, the bias, the earlier models.
_ODD, _CAPS, _BIAS, _CHAIN_AT = SIZE, SIZE + 1, SIZE + 2, SIZE + 3
DIM = _CHAIN_AT + len(CHAIN)
#: Values of the features of word pairs and of four letters in a row; a word itself has 1.
PAIR, LETTERS = 0.8, 0.15
BIAS = -3.0
#: Share of labels, and of harmless documents with an abusive segment, that may be wrong.
WRONG = 0.05

_LEET = str.maketrans("013457@$!8", "oieastasib")
_SPLIT = re.compile(r"(?<=[.!?…])[\"”»'’)\]]*\s+|[\r\n]+")
#: Words spelled with a dot or a space after every letter, spaces between the words included.
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]\.(?:[ ]\.)?){3,}[^\W_](?![^\W_])|(?<![^\W_])(?:[^\W\d_][ ]){3,}[^\W\d_](?![^\W_])")
_WORD = re.compile(r"\u2051\w+|[^\W_](?:[.·*_-][^\W_]|[.·*_-](?=[*]))+(?![^\W_])|[\w@$*!’'·-]+|[“”\"«»]")
_DOTTED = re.compile(r"[^\W_](?:[.·_-][^\W_]){3,}")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_NUMBER = re.compile(r"[a-z]\d+|\d+[a-z]{1,3}|v?\d[\d.,:]*[a-z]?")
_HIDDEN = re.compile(r"[a-zà-ÿ][013457@$!8]|[013457@$][a-zà-ÿ]")


def segments(text: str, most_words: int = 48) -> list[str]:
    """Sentences and lines of the whole text; longer ones in overlapping windows of ``most_words`` words."""
    out = []
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: " ".join("\u2051" + w for w in re.sub(r"[.]|(?<=\w) (?=\w)", "", m.group().replace(". .", "\x00")).split("\x00")), text)
    for s in _SPLIT.split(text):
        if not s or s.isspace():
            continue
        if len(s) > 6 * most_words:
            w = s.split()
            if len(w) > most_words:
                out += [" ".join(w[i : i + most_words]) for i in range(0, len(w), most_words * 3 // 4)]
                continue
        out.append(s)
    return out


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & (SIZE - 1)


class Reader:
    """Tokens to words: lower case, with dots, digits, masks and repeats between letters undone by a lexicon."""

    def __init__(self, lexicon: frozenset[str] = frozenset()) -> None:
        self.lexicon = lexicon
        self.by_len: dict[int, list[str]] = {}
        for w in sorted(lexicon):
            self.by_len.setdefault(len(w), []).append(w)
        self.cache: dict[str, tuple[tuple[str, ...], int, int]] = {}

    def _masked(self, w: str) -> str:
        """The word of the lexicon that a word with masked letters stands for, or the word without its stars."""
        rx = re.compile(re.sub(r"\\\*|\d", r"\\w", re.escape(w)))
        return next((x for x in self.by_len.get(len(w), ()) if rx.fullmatch(x)), w.replace("*", ""))

    def token(self, raw: str) -> tuple[tuple[str, ...], int, int]:
        """(words, whether the spelling hides the word, whether it is in capitals)."""
        got = self.cache.get(raw)
        if got is None:
            if len(self.cache) > 400_000:
                self.cache.clear()
            got = self.cache[raw] = self._token(raw)
        return got

    def _token(self, raw: str) -> tuple[tuple[str, ...], int, int]:
        if raw in "“”\"«»":
            return ('"',), 0, 0
        if not re.search(r"\w", raw):
            return (), 0, 0
        known, odd = self.lexicon, 0
        w = raw.strip("-'*!.").lower() if raw[-1] not in "@$" else raw.lower()
        caps = int(len(raw) > 3 and raw.isupper())
        if raw[0] == "\u2051":
            w, odd = w[1:], 1
        elif _DOTTED.fullmatch(w):
            w, odd = re.sub(r"[.·_-]", "", w), 1
        elif "*" in w and re.search(r"\w\*+\w", w):
            w, odd = self._masked(w), 1
        elif _HIDDEN.search(w) and not _NUMBER.fullmatch(w):
            t = w.translate(_LEET)
            t = next((x for x in (t, t.replace("i", "l")) if x in known), t)
            if t not in known and t.isalpha():
                u = self._masked(w)
                t = u if u in known else t
            if t.isalpha() and len(t) > 3:
                w, odd = t, 1
        if re.search(r"([^\W\d_])\1\1", w):
            one, two = re.sub(r"([^\W\d_])\1\1+", r"\1", w), re.sub(r"([^\W\d_])\1\1+", r"\1\1", w)
            w, odd = (two if two in known else one), 1
        if w not in known and not w.isascii():
            t = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
            if t in known:
                w = t
        if "'" in w and w not in known:
            return tuple(x for x in w.split("'") if x), odd, caps
        return ("0" if w[:1].isdigit() else w,) if w else (), odd, caps

    def read(self, segment: str) -> tuple[list[str], int, int]:
        """(words, hidden spellings, words in capitals) of a segment."""
        if not segment.isascii():
            segment = _INVISIBLE.sub("", unicodedata.normalize("NFKC", segment)).replace("’", "'")
        words: list[str] = []
        odd = caps = 0
        for raw in _WORD.findall(segment):
            w, o, c = self.token(raw)
            words += w
            odd += o
            caps += c
        return words, odd, caps


def _letters(word: str) -> list[int]:
    w = f"^{word}$"
    return [_hash("#" + w[i : i + 4]) for i in range(max(0, len(w) - 3))] if len(w) > 5 else []


class Rows:
    """Rows of features: words, pairs of neighbouring words, letters of words; each counts as often as it occurs.

    Letters belong to the distinct words, so that a product visits them once a word and not once an occurrence.
    """

    def __init__(self, read: list[tuple[list[str], int, int]]) -> None:
        self.n = len(read)
        ids: dict[str, int] = {}
        self.wid = np.array([ids.setdefault(w, len(ids)) for words, _, _ in read for w in words], dtype=np.int64)
        long = np.array([len(w) for w, _, _ in read], dtype=np.int64)
        self.row = np.repeat(np.arange(self.n), long)
        self.word = np.array([_hash(w) for w in ids], dtype=np.int64)
        self.pair = _pair(self.word[self.wid], np.cumsum(long) - long)
        grams = [_letters(w) for w in ids]
        self.of = np.repeat(np.arange(len(ids)), [len(g) for g in grams])
        self.gram = np.array([x for g in grams for x in g], dtype=np.int64)
        self.odd, self.caps = (np.array([f(x) for x in read], dtype=float) for f in (lambda x: min(x[1], 1), lambda x: x[2] > 2))
        used = np.unique(np.concatenate([self.word, self.pair, self.gram, [_ODD, _CAPS, _BIAS]]))
        self.used, self.at = used, [np.searchsorted(used, x) for x in (self.word, self.pair, self.gram, np.array([_ODD, _CAPS, _BIAS]))]

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Products with weights of the used features."""
        word, pair, gram, (odd, caps, bias) = self.at
        u = w[word] + LETTERS * np.bincount(self.of, w[gram], len(word))
        return np.bincount(self.row, u[self.wid] + PAIR * w[pair], self.n) + w[odd] * self.odd + w[caps] * self.caps + w[bias]

    def back(self, e: np.ndarray) -> np.ndarray:
        word, pair, gram, (odd, caps, bias) = self.at
        n, er = len(self.used), e[self.row]
        u = np.bincount(self.wid, er, len(word))
        g = np.bincount(word, u, n) + PAIR * np.bincount(pair, er, n) + LETTERS * np.bincount(gram, u[self.of], n)
        g[odd] += e @ self.odd
        g[caps] += e @ self.caps
        g[bias] += e.sum()
        return g


def _pair(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it; ``first``: where rows begin."""
    before = np.roll(word, 1)
    before[first[first < len(word)]] = 1
    return ((before * 0x9E3779B1 + word * 0x85EBCA6B) >> 7) & (SIZE - 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p) - np.log(1 - p)


def _fit(rows: Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 60) -> np.ndarray:
    """Logistic regression with a Gaussian prior around zero (around BIAS for the bias), by Adam steps."""
    k, n = extra.shape[1], len(rows.used)
    centre = np.zeros(n + k)
    centre[rows.at[3][2]] = BIAS
    w, m, v = centre.copy(), np.zeros(n + k), np.zeros(n + k)
    for t in range(1, steps + 1):
        p = _sigmoid(rows.dot(w) + extra @ w[n:])
        e = (p - y) * weight
        g = np.append(rows.back(e), extra.T @ e) + l2 * (w - centre)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.12 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class Chain:
    """A fitted chain: the lexicon that reads hidden spellings, and the weights (features x models)."""

    lexicon: frozenset[str]
    weights: np.ndarray

    @classmethod
    def none(cls) -> Chain:
        w = np.zeros((DIM, len(CHAIN)), np.float32)
        w[_BIAS] = -20.0
        return cls(frozenset(), w)


class Scorer:
    """Scores of segments by a chain; the weights of a word with its letters are added up once."""

    def __init__(self, chain: Chain) -> None:
        self.reader, self.w = Reader(chain.lexicon), chain.weights
        self.ids: dict[str, int] = {}
        self.hash: list[int] = []
        self.sums: list[np.ndarray] = []

    def _id(self, word: str) -> int:
        i = self.ids.get(word)
        if i is None:
            i = self.ids[word] = len(self.sums)
            h = _hash(word)
            self.hash.append(h)
            g = _letters(word)
            self.sums.append(self.w[h] + LETTERS * self.w[g].sum(axis=0) if g else self.w[h])
        return i

    def __call__(self, segs: list[str]) -> np.ndarray:
        if len(self.ids) > 300_000:
            self.ids, self.hash, self.sums = {}, [], []
        read = [self.reader.read(s) for s in segs]
        z = np.repeat(self.w[_BIAS][None, :].astype(np.float64), len(segs), axis=0)
        wid = np.array([self._id(w) for words, _, _ in read for w in words], dtype=np.int64)
        if len(wid):
            long = np.array([len(w) for w, _, _ in read])
            first = (np.cumsum(long) - long)[long > 0]
            own, back = np.unique(wid, return_inverse=True)
            pair = _pair(np.array([self.hash[i] for i in own], dtype=np.int64)[back], first)
            z[long > 0] += np.add.reduceat(np.array([self.sums[i] for i in own])[back] + PAIR * self.w[pair], first, axis=0)
        z += np.array([min(o, 1) for _, o, _ in read])[:, None] * self.w[_ODD] + np.array([c > 2 for _, _, c in read])[:, None] * self.w[_CAPS]
        out = np.zeros_like(z)
        for k in range(len(CHAIN)):
            out[:, k] = _sigmoid(z[:, k] + out[:, :k] @ self.w[_CHAIN_AT : _CHAIN_AT + k, k])
        return out


def _plain_key(s: str) -> str:
    return re.sub(r"\b\d+\b", "0", s.strip())


def _lifts(words: list[set[str]], abusive: np.ndarray) -> dict[str, float]:
    """Log ratio of the shares of abusive and of harmless documents that hold a word, for words of two documents or more."""
    bad, fine = Counter(), Counter()
    for ws, a in zip(words, abusive, strict=True):
        (bad if a else fine).update(ws)
    nb, nf = abusive.sum() + 1.0, (1 - abusive).sum() + 1.0
    return {w: float(np.log((bad[w] + 0.3) / nb) - np.log((fine[w] + 0.3) / nf)) for w in set(bad) | set(fine) if bad[w] + fine[w] > 1}


def train_chain(texts: list[str], abusive: list[int], category: list[str | None], l2: float = 1.0, rounds: int = 3) -> Chain:
    """The chain from document labels.

    A document is a bag of segments: an abusive one holds at least one abusive segment, a harmless one none. At first
    segments are ranked by the words that abusive documents have and harmless ones lack; in each round the likeliest
    segments of abusive documents become the positives of every model, judged by models that haven't seen them, so
    that a wrongly labelled document teaches nothing. Later models are trained with predictions that the earlier
    ones make for folds they haven't seen. Without any abusive text every score is about zero.
    """
    if not any(abusive):
        return Chain.none()
    seg: dict[str, int] = {}
    bag = [sorted({seg.setdefault(_plain_key(s), len(seg)) for s in segments(t)}) for t in texts]
    if not seg:
        return Chain.none()
    keys = list(seg)
    label = np.array(abusive, dtype=float)
    plain = Reader()
    first = [plain.read(s) for s in keys]
    of_doc = [{w for i in b for w in first[i][0]} for b in bag]
    lift = _lifts(of_doc, label)
    reader = Reader(frozenset(w for w, x in lift.items() if x > 1.0 and len(w) > 3 and w.isalpha()))
    read = [reader.read(s) for s in keys]
    lift = _lifts([{w for i in b for w in read[i][0]} for b in bag], label)
    rows = Rows(read)
    clean, held = np.zeros(rows.n), np.zeros(rows.n)
    for b, a in zip(bag, abusive, strict=True):
        (held if a else clean)[b] += 1
    # words of two documents or more speak for or against a segment; capitalised ones inside it are names
    naive = np.array([sum(min(max(lift.get(w, 0.0), -1.5), 2.5) for w in set(ws)) for ws, _, _ in read]) + 1.5 * np.array([min(o, 1) for _, o, _ in read])
    rank = naive + np.log((held + 0.3) / (clean + 1.0))
    fold = np.array([zlib.crc32(s.encode("utf-8", "surrogatepass")) % 3 for s in keys])
    # in how many abusive and harmless documents a segment stands speaks for it beside what the model says of its words
    share = min(max(label.mean(), 0.02), 0.5)
    seen = held * np.log((1 - WRONG) / share) + clean * np.log(WRONG / (1 - share))
    rank = 0.7 * naive - 3.0 + seen
    full = np.zeros((DIM, len(CHAIN)), np.float32)
    for r in range(rounds):
        pos = {c: np.zeros(rows.n) for c in CHAIN}
        for b, a, c in zip(bag, abusive, category, strict=True):
            if a and b:
                for i in b:
                    if rank[i] > 0:
                        pos["abusive"][i] = 1
                        if c in pos and c != "abusive":
                            pos[c][i] = 1
        known = pos["abusive"] > 0
        weight = np.where(known, np.clip(held, 1, 4), np.clip(clean, 0.2, 4))
        weight[~known & (clean == 0) & (held > 0)] = 0.3
        extra = np.zeros((rows.n, 0))
        last = r == rounds - 1
        # before the last round only the verdict is needed
        for k, c in enumerate(CHAIN if last else CHAIN[-1:]):
            y = pos[c]
            # abusive segments of another or unknown category are no examples against this one
            w = weight * np.where(known & (y == 0), 0.0 if c == "abusive" else 0.15, 1.0)
            oof, n = np.zeros(rows.n), len(rows.used)
            for h in range(3):
                part = _fit(rows, extra, y, w * (fold != h), l2)
                oof = np.where(fold == h, _sigmoid(rows.dot(part) + extra @ part[n:]), oof)
            if last:
                fit = _fit(rows, extra, y, w, l2)
                full[rows.used, k], full[_CHAIN_AT : _CHAIN_AT + k, k] = fit[:n], fit[n:]
            extra = np.column_stack([extra, oof])
        rank = _logit(extra[:, -1]) + seen
    return Chain(reader.lexicon, full)


def score_texts(texts: list[str | None], scorer: Scorer) -> np.ndarray:
    """One row per text: the highest probability of each model over the text's segments; zeros for null and blank."""
    todo: dict[str, int] = {}
    bags = [[todo.setdefault(_plain_key(s), len(todo)) for s in segments(t)] if t else [] for t in texts]
    out = np.zeros((len(texts), len(CHAIN)))
    full = [i for i, b in enumerate(bags) if b]
    if full:
        p = scorer(list(todo))
        at = np.cumsum([0] + [len(bags[i]) for i in full])[:-1]
        out[full] = np.maximum.reduceat(p[np.concatenate([bags[i] for i in full])], at, axis=0)
    return out


def train_from_tables(documents: DataFrame, labels: DataFrame, most_labels: int = 8_000) -> Chain:
    """Fit the chain on at most ``most_labels`` labelled documents, taken in the order of a hash of doc_id.

    Several labels of a document: the majority decides, ties are abusive. Labels of unknown documents and of null
    texts are not used.
    """
    lab = labels.where("doc_id IS NOT NULL AND abusive IS NOT NULL").groupBy("doc_id").agg(
        F.when(F.avg("abusive") >= 0.5, 1).otherwise(0).alias("abusive"), F.max("category").alias("category")
    )
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    rows = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(lab), "doc_id").orderBy("doc_id").toPandas()
    return train_chain(list(rows["text"]), [int(x) for x in rows["abusive"]], [c if isinstance(c, str) else None for c in rows["category"]])


def score_documents(documents: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, source, insult, hate, threat, sexual, abusive): scores of every row, whole texts."""
    sc = documents.sparkSession.sparkContext
    # size fixed by HASH_BITS and CHAIN; the lexicon is bounded by the labelled sample
    shared = sc.broadcast(chain)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in parts:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at : at + 500]
                p = score_texts([t if isinstance(t, str) else None for t in some["text"]], scorer)
                yield pd.DataFrame({"doc_id": some["doc_id"], "source": some["source"], **{c: p[:, i] for i, c in enumerate(CHAIN)}})

    schema = "doc_id long, source string, " + ", ".join(f"{c} double" for c in CHAIN)
    return documents.select("doc_id", "source", "text").mapInPandas(run, schema)


def rates_by_source(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, n_docs, n_abusive, rate): share of documents at or over the threshold."""
    hit = (F.col("abusive") >= threshold).cast("long")
    return scores.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(hit).alias("n_abusive"), F.avg(hit).alias("rate"))
