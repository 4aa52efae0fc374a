"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over the subsequences of three symbols that both
hold and that span at most SPAN symbols, LAMBDA to the number of symbols each
occurrence spans, so letters may be skipped at a price; a run of foreign
characters between letters costs FOREIGN, however long. The start of a word
counts as a symbol. Letters that stand alone, SPELLED or more in a row, are one
word. The machine learns from labelled texts: its positive words are those
over-represented in toxic texts, and spellings of the stronger ones with characters
put in, and then, round by round, the best-scoring word of every toxic text; its negative
words come from clean texts, the hardest ones included. In the Nyström space of
the landmarks it is linear, hence its decision is one weight for each
three-symbol code, which makes scoring a table lookup. A text's score is a
logistic function of how far its best word is from the margin of clean words, and
of how many of its words are beyond the other one and how far.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Decay a spanned symbol and a run of foreign characters; the symbols that three may span at most, and the pairs of steps between them.
LAMBDA, FOREIGN, SPAN = 0.6, 0.9, 11
STEPS = [(a, s - a) for s in range(2, SPAN) for a in range(1, s)]
_FOREIGN = (FOREIGN ** np.arange(64)).astype(np.float32)
#: So many letters in a row, each standing alone, are one word.
SPELLED = 3
LANDMARKS = 128
#: Labelled texts of each label that the fit takes at most (those with the smallest hash).
FIT_ROWS = 2500
NEGATIVES, HARD, ROUNDS = 20_000, 4_000, 3
#: A word counts as toxic from this score; a word is over-represented if it is so many times as frequent among toxic texts.
SURE, RATIO = 0.5, 8.0
_CHUNK = 256


def _symbols() -> np.ndarray:
    """Byte -> symbol below 64: 1 white space, 2..27 letters, 28..59 second bytes of accented letters (either case), 60 other letters, 0 the rest."""
    out = np.zeros(256, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 1
    out[97:123] = out[65:91] = np.arange(2, 28)
    out[0x80:0xA0] = out[0xA0:0xC0] = np.arange(28, 60)
    out[0xE0:] = 60
    return out


SYMBOL = _symbols()
_LEADS = np.zeros(256, bool)
_LEADS[0xC2:0xE0] = True


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each preceded by white space, and where each text begins. White space inside spelled-out words is foreign."""
    raw = [np.frombuffer(f" {t}".encode(), np.uint8) for t in texts]
    flat = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
    kept = ~_LEADS[flat]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[np.concatenate([[0], ends[:-1]]).astype(np.int64)] if raw else np.zeros(0, np.int64)
    return _joined(SYMBOL[flat[kept]], begins), begins


def _joined(sym: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """`sym` with the white space between SPELLED or more letters that stand alone made foreign; tokens without a letter don't part them."""
    at = np.flatnonzero(sym == 1)
    if not len(at):
        return sym
    letters = np.add.reduceat((sym > 1).astype(np.int32), at)
    some = np.flatnonzero(letters)
    text = np.searchsorted(begins, at[some], side="right")
    fresh = np.ones(len(some), bool)
    fresh[1:] = (letters[some[1:]] != 1) | (letters[some[:-1]] != 1) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, len(some)))
    long = sizes >= SPELLED
    # from the second letter's white space back to the first letter's, over all tokens between
    inner = np.zeros(len(at) + 1, np.int32)
    np.add.at(inner, some[first[long]] + 1, 1)
    np.add.at(inner, some[first[long] + sizes[long] - 1] + 1, -1)
    sym = sym.copy()
    sym[at[np.cumsum(inner[:-1]) > 0]] = 0
    return sym


def triples(sym: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair of steps: the place of the first symbol, the code, and the decay of the triples inside one word. Steps pass over foreign characters."""
    place = np.flatnonzero(sym)
    wide = sym[place].astype(np.int32)
    runs = np.cumsum(np.diff(place, prepend=-1) > 1, dtype=np.int32)
    ends = np.append(np.flatnonzero(wide == 1), len(wide))
    i = np.arange(len(wide), dtype=np.int32)
    rest = (ends[np.searchsorted(ends, i, side="right").clip(max=len(ends) - 1)] - i).astype(np.int32) if len(i) else i
    for span in range(2, SPAN):
        i = i[rest[i] > span]
        if not len(i):
            return
        outer, at = (wide[i] << 12) | wide[i + span], place[i]
        decay = np.float32(LAMBDA ** (span + 1)) * _FOREIGN[np.minimum(runs[i + span] - runs[i], 63)]
        for a in range(1, span):
            yield at, outer | (wide[i + a] << 6), decay


def _norms(length: int) -> np.ndarray:
    """Norm of a word of n symbols (its start included), repeated codes aside; words of under four letters count as having four."""
    n = np.maximum(np.arange(length), 5)
    return np.sqrt(np.maximum(sum(np.maximum(n - a - b, 0) * LAMBDA ** (2 * (a + b + 1)) for a, b in STEPS), 1e-12))


_NORM = _norms(4096)


def _norm(sym: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of each word, by the number of its symbols; foreign characters between them don't count."""
    lengths = np.add.reduceat((sym > 0).astype(np.int32), begins) if len(begins) else np.zeros(0, np.int32)
    return _NORM[np.minimum(lengths, len(_NORM) - 1)]


def word_scores(sym: np.ndarray, table: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Score of each word, and where it begins. Words are runs between white space."""
    begins = np.flatnonzero(sym == 1)
    total = np.zeros(len(sym), np.float32)
    for at, code, decay in triples(sym):
        total[at] += decay * table[code]
    score = np.add.reduceat(total, begins) if len(begins) else np.zeros(0, np.float32)
    return score / _norm(sym, begins) + bias, begins


def summary(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """Of each text: highest word score from the margin of clean words on, log of the sum of the positive ones, log of the number above SURE, their sum a word. A text whose words are all clean by the margin is the same whatever its length."""
    sym, begins = encode(texts)
    score, at = word_scores(sym, table, bias)
    own = np.searchsorted(at, begins)
    n = np.diff(np.append(own, len(at)))
    pos = np.maximum(score, 0)
    most, total, count = np.maximum.reduceat(score, own), np.add.reduceat(pos, own), np.add.reduceat((score > SURE).astype(np.float64), own)
    return np.column_stack([np.clip(most, -1, 3), np.log1p(total), np.log1p(count), 10 * total / np.maximum(n, 10)])


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of words and landmarks."""
    marks, first = encode(landmarks)
    norm, entries = _norm(marks, first), list(triples(marks))
    used = np.unique(np.concatenate([code for _, code, _ in entries])) if entries else np.zeros(0, np.int32)
    column = np.full(1 << 18, -1, np.int32)
    column[used] = np.arange(len(used))
    phi = np.zeros((len(used), len(landmarks)))
    for at, code, decay in entries:
        j = np.searchsorted(first, at, side="right") - 1
        np.add.at(phi, (column[code], j), decay / norm[j])
    out = []
    for lo in range(0, len(words), 500):
        sym, begins = encode(words[lo : lo + 500])
        own = np.searchsorted(begins, np.arange(len(sym)), side="right") - 1
        acc = np.zeros(len(begins) * len(used))
        for at, code, decay in triples(sym):
            hit = column[code] >= 0
            np.add.at(acc, own[at[hit]] * len(used) + column[code[hit]], decay[hit])
        out.append(acc.reshape(len(begins), len(used)) @ phi / _norm(sym, begins)[:, None])
    return np.vstack(out) if out else np.zeros((0, len(landmarks)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; the last coefficient is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = y * (x @ beta) < 1
        a, w = x[active], weight[active]
        new = np.linalg.solve(a.T @ (a * w[:, None]) + ridge * np.eye(x.shape[1]), a.T @ (w * y[active]))
        if np.allclose(new, beta, atol=1e-8):
            break
        beta = new
    return beta


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (bias last), means and scales of a logistic regression of weighted rows by Newton steps."""
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight))
    scale[scale == 0] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    beta = np.zeros(z.shape[1])
    keep = np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + np.diag(keep), z.T @ (weight * (y - p)) - keep * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta, mean, scale


_WORD = re.compile(r"\S+")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def _words(text: str) -> set[str]:
    """Distinct lower-case words of a text without the punctuation around them."""
    return {w for w in (_EDGE.sub("", t) for t in _WORD.findall(text.lower())) if len(w) > 1 and len(w) < 40}


def _spellings(word: str) -> list[str]:
    """Of a word of four letters or more: parted once, and every letter parted."""
    return [f"{word[0]}.{word[1:]}", "-".join(word)] if len(word) > 3 else []


def train(texts: list[str], labels: np.ndarray, stands: np.ndarray | None = None) -> dict:
    """Fit on a bounded list of texts (0/1 labels). With one label only, or toxic texts without any word, every text scores the rate of label 1.

    `stands` says how many labelled rows each text stands for (1 if not given), so
    that scores keep to the rate of the labels where they were sampled apart.
    """
    stands = np.ones(len(texts)) if stands is None else stands
    rate = float(labels.mean()) if len(labels) else 0.0
    bags = [_words(t) for t in texts]
    if not 0 < rate < 1 or not any(bag for bag, label in zip(bags, labels, strict=True) if label):
        return {"table": np.zeros(1 << 18, np.float32), "bias": -1.0, "beta": np.array([0, 0, 0, 0, np.log((rate + 1e-3) / (1 - rate + 1e-3))]), "mean": np.zeros(4), "scale": np.ones(4)}
    toxic, clean = Counter(), Counter()
    for bag, label in zip(bags, labels, strict=True):
        (toxic if label else clean).update(bag)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    odds = {w: c * (np.log((c + 0.1) / (n1 + 0.2)) - np.log((clean[w] + 0.1) / (n0 + 0.2))) for w, c in toxic.items() if c >= 3 and c * n0 > RATIO * (clean[w] + 1) * n1}
    positive = sorted(odds, key=lambda w: (-odds[w], w))[:600] or sorted(toxic, key=lambda w: (clean[w] - toxic[w], w))[:20]
    strong = float(np.mean(list(odds.values()))) if odds else 0.0
    rng = np.random.default_rng(11)
    pool = sorted(w for w in clean if w not in odds)
    negative = [pool[i] for i in sorted(rng.choice(len(pool), min(NEGATIVES, len(pool)), replace=False))]
    table, bias = np.zeros(1 << 18, np.float32), 0.0
    half = LANDMARKS // 2
    for round_ in range(ROUNDS):
        marks = positive[: LANDMARKS - half] + [negative[i] for i in sorted(rng.choice(len(negative), min(half, len(negative)), replace=False))]
        k = _kernel(marks, marks)
        values, basis = np.linalg.eigh((k + k.T) / 2)
        used = values > 1e-6
        root = basis[:, used] / np.sqrt(values[used])
        # of the weak positive words, many of them chance, no spellings
        spelt = [(v, w) for w in positive if odds.get(w, 0.0) >= strong for v in _spellings(w)]
        x = _kernel(positive + [v for v, _ in spelt] + negative, marks) @ root
        y = np.concatenate([np.ones(len(positive) + len(spelt)), -np.ones(len(negative))])
        strength = np.array([odds.get(w, 0.0) for w in positive + [w for _, w in spelt]])
        weight = np.concatenate([np.clip(strength / max(strength.mean(), 1e-9), 0.5, 20), np.full(len(negative), len(strength) / max(1, len(negative)))])
        beta = _machine(x, y, weight)
        alpha, bias = root @ beta[:-1], float(beta[-1])
        table = np.zeros(1 << 18, np.float32)
        for w, a in zip(marks, alpha, strict=True):
            sym, begins = encode([w])
            for _, code, decay in triples(sym):
                np.add.at(table, code, np.float32(a) * decay / np.float32(_norm(sym, begins)[0]))
        if round_ == ROUNDS - 1:
            break
        # the best word of each toxic text becomes positive, the highest-scoring clean words negative

        def score(words: list[str]) -> np.ndarray:
            return np.concatenate([word_scores(encode(words[a : a + 5000])[0], table, bias)[0] for a in range(0, len(words), 5000)]) if words else np.zeros(0)

        more = set()
        for bag, label in zip(bags, labels, strict=True):
            if label and not bag & set(positive):
                words = sorted(bag)
                if words:
                    more.add(words[int(score(words).argmax())])
        positive += sorted(w for w in more if toxic[w] > 1 and toxic[w] * n0 > RATIO * (clean[w] + 1) * n1)
        s = score(pool)
        hard = [pool[i] for i in np.argsort(-s, kind="stable")[:HARD]]
        negative = sorted((set(negative) | set(hard)) - set(positive))
    x = np.vstack([summary(texts[a : a + _CHUNK], table, bias) for a in range(0, len(texts), _CHUNK)])
    beta, mean, scale = _logistic(x, labels.astype(float), stands)
    return {"table": table, "bias": bias, "beta": beta, "mean": mean, "scale": scale}


def probabilities(texts: list[str | None], model: dict) -> np.ndarray:
    x = (summary([t or "" for t in texts], model["table"], model["bias"]) - model["mean"]) / model["scale"]
    return 1 / (1 + np.exp(-np.clip(x @ model["beta"][:-1] + model["beta"][-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, toxic: 0 or 1, others and nulls teach nothing).

    About `fit_rows` labels of each kind at most, chosen by hash, are broadcast
    to the documents, and their texts gathered in one task. There each stands for
    as many as its label was thinned by.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = {label: min(1.0, fit_rows / n) for label, n in sizes.items()}
    share = F.lit(0.0)
    for label, part in sorted(shares.items()):
        share = F.when(F.col("toxic") == label, F.lit(part)).otherwise(share)
    chosen = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known.where(hashed < share)), "doc_id")
    schema = pa.schema([("name", pa.string()), ("value", pa.list_(pa.float64()))])

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["toxic"].to_numpy(), table["doc_id"].fill_null(-1).to_numpy()))
        table = table.take(pa.array(order))
        labels = table["toxic"].to_numpy()
        model = train([t.as_py() for t in table["text"]], labels, np.array([1 / shares[label] for label in labels.tolist()]))
        return pa.table([pa.array(list(model)), pa.array([np.atleast_1d(np.asarray(v, np.float64)) for v in model.values()], pa.list_(pa.float64()))], schema=schema)

    rows = chosen.groupBy(F.lit(0).alias("g")).applyInArrow(run, "name string, value array<double>").collect()
    if not rows:
        return train([], np.zeros(0))
    got = {r["name"]: np.array(r["value"]) for r in rows}
    return {**got, "bias": float(got["bias"][0]), "table": got["table"].astype(np.float32)}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, score, predicted for every row.

    Whole texts, very long ones too. A null text is scored as the empty text.
    Rows are independent: repeated rows get equal scores, null ids are kept, an
    empty table gives none. A model of no labelled rows scores near 0. Of `docs`
    only the id, the text and `keep` are read; a column of `keep` may not have a
    name of the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(lo, _CHUNK)
                p = probabilities([t.as_py() for t in part.column(0)], shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=names)

    chosen = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *keep)
    names = [*chosen.columns[1:], "score", "predicted"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(run, f"{fields}, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import held_out, read

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
