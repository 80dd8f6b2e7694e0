"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes that cover it whole. A passage is described
by how often byte classes follow each other and by how its words repeat, and is
encoded by a tanh layer. Gated attention, w . (tanh(V h) * sigmoid(U h)) with a softmax over
the passages of the document, weights the passages, and a logistic unit scores the weighted
mean of their encodings. All weights are learned together, from labels of documents alone.

It is fitted by Adam in numpy on a bounded sample: at most SAMPLE_DOCS labelled documents,
drawn by a hash of the id with equal shares for both labels, and at most SAMPLE_PASSAGES
passages of each, drawn by a fixed permutation. Scoring reads every passage of every text.

Defined cases: null and empty texts are one empty passage and get a score; texts of any
length are read to their end; without labels to learn from every score is 0.5; rows whose
id is null are held out; labels of ids that no document has are not drawn, and an id with both labels counts as 1; repeated rows are judged one by one, and of rows that share an id one is
learned from; an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc_rest, map_column, text_bytes

PASSAGE = 512
SAMPLE_DOCS, SAMPLE_PASSAGES = 3000, 16
CODE, GATE, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 30, 64, 0.005, 1e-4, 11
THRESHOLD = 0.3

#: The bytes of each class. All others below 128 are one more class, and
#: first and further bytes of longer UTF-8 sequences are two.
CLASSES = [b" ", b"\n\r", b"\t\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"#*$%&", b"|<>", b"\"'()[]{}", b"-_/\\@=+~^`"]
N = len(CLASSES) + 3
WORD_FEATURES = 6
FEATURES = N * N + WORD_FEATURES


def class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    table[0x80:0xC0] = N - 1
    table[0xC0:] = N - 2
    for k, members in enumerate(CLASSES):
        table[list(members)] = k
    return table


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features (passage, FEATURES), and the number of passages of each text.

    Each text ends in a line end of its own, so nothing crosses from one text to the next.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    counts = -(-sizes // PASSAGE)
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    offset = np.arange(len(data)) - np.repeat(starts, sizes)
    where = np.repeat(np.cumsum(counts) - counts, sizes) + offset // PASSAGE
    n = int(counts.sum())
    kind = class_table()[data]
    last = np.cumsum(sizes) - 1
    follower = np.append(kind[1:], 1)
    follower[last] = 1
    pairs = np.bincount((where * N + kind) * N + follower, minlength=n * N * N).reshape(n, N * N).astype(np.float32)
    length = np.bincount(where, minlength=n).astype(np.float32)[:, None]
    out = np.empty((n, FEATURES), np.float32)
    out[:, : N * N] = np.sqrt(pairs / length)

    # Words by a hash of their bytes and places, each in the passage of its first byte.
    space = kind <= 2
    first = np.flatnonzero(~space & np.append(True, space[:-1]))
    out[:, N * N :] = 0
    if len(first):
        weight = np.random.default_rng(SEED).integers(1, 2**62, 32) | 1
        within = np.arange(len(data)) - np.repeat(np.append(0, first), np.diff(np.append(np.append(0, first), len(data))))
        value = np.where(space, 0, (data.astype(np.int64) + 1) * weight[within & 31])
        word = np.add.reduceat(value, first)
        letters = np.add.reduceat((~space).astype(np.int64), first)
        owner, document = where[first], np.searchsorted(starts, first, "right")
        words = np.bincount(owner, minlength=n)
        count = np.maximum(words, 1)
        for k, lag in enumerate((1, 2, 3)):
            same = np.zeros(len(word), bool)
            same[lag:] = (word[lag:] == word[:-lag]) & (document[lag:] == document[:-lag])
            out[:, N * N + k] = np.bincount(owner, same, n) / count
        new = np.ones(len(word), bool)
        order = np.lexsort((word, owner))
        new[order[1:]] = (word[order[1:]] != word[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
        out[:, N * N + 3] = np.bincount(owner, new, n) / count
        out[:, N * N + 4] = np.bincount(owner, letters, n) / count / 10
        out[:, N * N + 5] = np.log1p(words) / 5
    return out, counts


def start_values() -> dict[str, np.ndarray]:
    random = np.random.default_rng(SEED)
    made = {
        "e": random.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, CODE)),
        "d": np.zeros(CODE),
        "v": random.normal(0, 1 / np.sqrt(CODE), (CODE, GATE)),
        "u": random.normal(0, 1 / np.sqrt(CODE), (CODE, GATE)),
        "w": random.normal(0, 1 / np.sqrt(GATE), GATE),
        "o": random.normal(0, 1 / np.sqrt(CODE), CODE),
        "b": np.zeros(1),
    }
    return {k: v.astype(np.float32) for k, v in made.items()}


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def forward(model, features, counts):
    """Document scores, and what the way back needs."""
    first = np.cumsum(counts) - counts
    code = np.tanh(features @ model["e"] + model["d"])
    tall, gate = np.tanh(code @ model["v"]), sigmoid(code @ model["u"])
    attention = (tall * gate) @ model["w"]
    attention = np.exp(attention - np.repeat(np.maximum.reduceat(attention, first), counts))
    attention /= np.repeat(np.add.reduceat(attention, first), counts)
    bag = np.add.reduceat(code * attention[:, None], first, axis=0)
    return sigmoid(bag @ model["o"] + model["b"]), (code, tall, gate, attention, bag, first)


def gradients(model, features, counts, labels):
    score, (code, tall, gate, attention, bag, first) = forward(model, features, counts)
    error = ((score - labels) / len(labels)).astype(np.float32)
    on_bag = np.repeat(error[:, None] * model["o"], counts, axis=0)
    along = (on_bag * code).sum(1)
    on_attention = attention * (along - np.repeat(np.add.reduceat(attention * along, first), counts))
    product = on_attention[:, None] * model["w"]
    on_tall, on_gate = product * gate * (1 - tall**2), product * tall * gate * (1 - gate)
    on_code = (on_bag * attention[:, None] + on_tall @ model["v"].T + on_gate @ model["u"].T) * (1 - code**2)
    return {"e": features.T @ on_code, "d": on_code.sum(0), "v": code.T @ on_tall, "u": code.T @ on_gate, "w": on_attention @ (tall * gate), "o": bag.T @ error, "b": error.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: list[int]) -> dict[str, np.ndarray]:
    """The fitted weights, with the mean and deviation that scale the features."""
    whole = np.concatenate(bags)
    mean, spread = whole.mean(0), np.maximum(whole.std(0), 0.02)
    bags, truth = [(b - mean) / spread for b in bags], np.array(labels, np.float32)
    model, random = start_values(), np.random.default_rng(SEED)
    first, second, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = random.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            grads = gradients(model, np.concatenate([bags[i] for i in at]), np.array([len(bags[i]) for i in at]), truth[at])
            step += 1
            for name, g in grads.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                model[name] -= (rate * ((first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8) + DECAY * model[name])).astype(np.float32)
    return model | {"mean": mean, "spread": spread}


def bag_scores(model, texts: list[bytes]) -> np.ndarray:
    features, counts = passages(texts)
    features -= model["mean"]
    features /= model["spread"]
    return forward(model, features, counts)[0]


def held_out(id_col: str):
    return F.coalesce(crc_rest(id_col, 5) == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """The model, from documents with labels 0 or 1 that are not held out; None without both labels."""
    there = docs.select(F.col(id_col).alias("t_id")).distinct()
    # Only labels of documents that there are: others would use up the sample.
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("s_id")).agg(F.max(label_col).cast("int").alias("y"))
    known = checkpointed(known.join(there, F.col("s_id") == F.col("t_id"), "left_semi"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    weight = F.when(F.col("y") == 1, float(counts[1])).otherwise(float(counts[0]))
    rank = F.pmod(F.xxhash64("s_id"), F.lit(1 << 30)) * weight
    # About three times the sample passes, whatever the number of labels, and only it is sorted.
    drawn = known.withColumn("rank", rank).where(F.col("rank") < 1.5 * SAMPLE_DOCS * (1 << 30)).orderBy("rank", "s_id").limit(SAMPLE_DOCS).drop("rank")

    def start():
        def describe(batch):
            out = []
            for text in batch.to_pylist():
                found, _ = passages([text or b""])
                if len(found) > SAMPLE_PASSAGES:
                    found = found[np.random.default_rng([SEED, len(found)]).permutation(len(found))[:SAMPLE_PASSAGES]]
                out.append(found.astype("<f2").tobytes())
            return [out]

        return describe

    # At most SAMPLE_DOCS rows are broadcast. Of rows that share an id one is learned from, the one of the
    # least hash of its text, so that a repeated id weighs no more than others.
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).cast("string").alias("d_text")).join(F.broadcast(drawn), F.col("d_id") == F.col("s_id"))
    one = rows.groupBy("s_id", "y").agg(F.min_by("d_text", F.xxhash64("d_text")).alias("s_text"))
    held = map_column(one, text_bytes("s_text"), ["s_id", "y"], {"bag": "binary"}, start).collect()
    if len({r["y"] for r in held}) < 2:
        return None
    held.sort(key=lambda r: str(r["s_id"]))
    bags = [np.frombuffer(r["bag"], "<f2").reshape(-1, FEATURES).astype(np.float32) for r in held]
    return train(bags, [r["y"] for r in held])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col))

    def start():
        model = shared.value

        def score(batch):
            texts = [x or b"" for x in batch.to_pylist()]
            if not texts:
                return [[], []]
            found = bag_scores(model, texts).astype(np.float64) if model else np.full(len(texts), 0.5)
            return [found.tolist(), (found >= THRESHOLD).astype(int).tolist()]

        return score

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    return map_column(rows, text_bytes(text_col), [id_col, "held_out"], {"score": "double", "predicted": "int"}, start)
