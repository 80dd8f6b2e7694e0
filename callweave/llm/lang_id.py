"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of WINDOW bytes that cover it whole. In every window a gated
recurrent layer reads forwards and another backwards; at every position both states give
the probabilities of the languages, and a document's probabilities are the mean over all its
positions. Gates and states use the softsign x / (1 + |x|), which costs a tenth of tanh.

The network is trained in numpy by backpropagation through time on a bounded sample:
SAMPLE_DOCS documents, or LANG_DOCS for each language where that is more, and WINDOWS_PER_DOC
windows of each, drawn by a hash of the id with equal shares for the languages. Every
language that has a text is learned, by one document at least.

Defined cases: a text that is null or has no letter is `und` with score 0; texts of any
length are read to their end; with nothing to learn from every text is `und`; rows
whose id is null are held out; repeated rows are judged one by one, and of rows that share an id
and a language one is learned from; of languages of equal probability the first by name is taken; an empty
table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, map_column, text_bytes

HIDDEN, WINDOW, PAD = 8, 64, 256
SAMPLE_DOCS, WINDOWS_PER_DOC, LANG_DOCS = 2000, 3, 16
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.01, 7
#: Windows that are read side by side when documents are scored, for up to WIDTH_LANGS languages.
WIDTH, WIDTH_LANGS = 1024, 64


def softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def start_values(n_labels: int, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """For each direction: rows of the bytes (x) and turns of the state (u) of the update gate,
    the reset gate and the fresh state, and the output (v); and the output's bias (c)."""
    random = np.random.default_rng(SEED)
    made = {}
    for side in "fb":
        made["x" + side] = random.normal(0, 0.5, (3, PAD + 1, hidden))
        made["u" + side] = random.normal(0, 1 / np.sqrt(hidden), (3, hidden, hidden))
        made["v" + side] = random.normal(0, 1 / np.sqrt(hidden), (n_labels, hidden))
    made["c"] = np.zeros((n_labels, 1))
    return {k: v.astype(np.float32) for k, v in made.items()}


def layer(table, turn, bytes_in, valid, order, keep=None):
    """States (time, window, hidden) of one direction; keep collects what the way back needs.

    The three parts of the network lie one after the other in memory, so that every
    operation runs over whole arrays.
    """
    steps, width = bytes_in.shape
    hidden = turn.shape[1]
    states = np.empty((steps, width, hidden), np.float32)
    state = np.zeros((width, hidden), np.float32)
    x, u, size = np.empty((3, width, hidden), np.float32), np.empty((3, width, hidden), np.float32), np.empty((2, width, hidden), np.float32)
    gates, fresh, magnitude = x[:2], x[2], size[0]
    for t in order:
        for k in range(3):
            table[k].take(bytes_in[t], axis=0, out=x[k], mode="clip")
        np.matmul(state, turn, out=u)
        gates += u[:2]
        np.abs(gates, out=size)
        size += 1
        gates /= size
        gates *= 0.5
        gates += 0.5
        if keep is not None:
            keep[t] = (state, gates.copy(), u[2].copy(), None)
        u[2] *= gates[1]
        fresh += u[2]
        np.abs(fresh, out=magnitude)
        magnitude += 1
        fresh /= magnitude
        after = states[t]
        np.subtract(state, fresh, out=after)
        after *= gates[0]
        after += fresh
        if valid is not None:
            after *= valid[t]
        if keep is not None:
            keep[t] = (*keep[t][:3], fresh.copy())
        state = after
    return states


def softmax(states: dict, model) -> np.ndarray:
    """(label, time, window)"""
    steps, width, hidden = states["f"].shape
    logits = model["vf"] @ states["f"].reshape(-1, hidden).T
    logits += model["vb"] @ states["b"].reshape(-1, hidden).T
    logits += model["c"]
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits.reshape(-1, steps, width)


def both_layers(model, bytes_in, valid, kept=None) -> dict[str, np.ndarray]:
    steps = len(bytes_in)
    orders = {"f": range(steps), "b": range(steps - 1, -1, -1)}
    return {s: layer(model["x" + s], model["u" + s], bytes_in, valid, orders[s], kept and kept[s]) for s in "fb"}


def gradients(model, bytes_in, valid, labels):
    """The loss over all positions, and its gradient by backpropagation through time."""
    steps, width = bytes_in.shape
    hidden, n_labels = model["uf"].shape[1], len(model["c"])
    kept = {s: [None] * steps for s in "fb"}
    states = both_layers(model, bytes_in, valid, kept)
    probs = softmax(states, model)
    total, mask = valid.sum(), valid[:, :, 0]
    at = np.arange(width)
    loss = -(np.log(probs[labels, :, at].T + 1e-9) * mask).sum() / total
    error = probs
    error[labels, :, at] -= 1
    error *= mask / total
    flat = error.reshape(n_labels, -1)
    grads = {"c": flat.sum(1, keepdims=True)}
    for s in "fb":
        grads["v" + s] = flat @ states[s].reshape(-1, hidden)
        from_output = (flat.T @ model["v" + s]).reshape(steps, width, hidden)
        turn, back = model["u" + s], np.zeros((width, hidden), np.float32)
        on_input, on_turn = np.empty((steps, 3, width, hidden), np.float32), np.zeros_like(turn)
        for t in range(steps - 1, -1, -1) if s == "f" else range(steps):
            before, gates, u, fresh = kept[s][t]
            back = (back + from_output[t]) * valid[t]
            slope = 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
            d_fresh = back * (1 - gates[0]) * (1 - np.abs(fresh)) ** 2
            on_input[t] = back * (before - fresh) * slope[0], d_fresh * u * slope[1], d_fresh
            through = on_input[t].copy()
            through[2] *= gates[1]
            on_turn += before.T @ through
            back = back * gates[0] + (through @ turn.transpose(0, 2, 1)).sum(0)
        ids = bytes_in.ravel()
        columns = on_input.transpose(1, 3, 0, 2).reshape(3, hidden, -1)
        grads["x" + s] = np.stack([np.stack([np.bincount(ids, c, PAD + 1) for c in part], 1) for part in columns])
        grads["u" + s] = on_turn
    return loss, grads


def as_windows(pieces: list[bytes]) -> np.ndarray:
    """Rows of WINDOW byte values that cover the pieces one after the other, filled up with PAD."""
    counts = [-(-len(p) // WINDOW) for p in pieces]
    flat = np.full(sum(counts) * WINDOW, PAD, np.intp)
    at = 0
    for piece, n in zip(pieces, counts):
        flat[at : at + len(piece)] = np.frombuffer(piece, np.uint8)
        at += n * WINDOW
    return flat.reshape(-1, WINDOW)


def train(pieces: list[bytes], labels: list[int], n_labels: int) -> dict[str, np.ndarray]:
    """Adam over shuffled windows; each piece is at most one window."""
    model, random = start_values(n_labels), np.random.default_rng(SEED)
    windows, truth = as_windows(pieces), np.array(labels)
    mean, square, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = random.permutation(len(windows))
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            bytes_in = np.ascontiguousarray(windows[at].T)
            _, grads = gradients(model, bytes_in, (bytes_in != PAD)[:, :, None].astype(np.float32), truth[at])
            step += 1
            for name, g in grads.items():
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.01 * (g * g - square[name])
                model[name] -= (rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def document_probabilities(model, texts: list[bytes]) -> np.ndarray:
    """(document, label): the mean over every position of each text; no text is empty."""
    windows, n_labels = as_windows(texts), len(model["c"])
    width = max(1, WIDTH * WIDTH_LANGS // max(WIDTH_LANGS, n_labels))
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), -(-sizes // WINDOW))
    sums = np.zeros((len(texts), n_labels))
    padded = windows[:, -1] == PAD
    for short in (False, True):
        rows = np.flatnonzero(padded == short)
        for k in range(0, len(rows), width):
            at = rows[k : k + width]
            bytes_in = np.ascontiguousarray(windows[at].T)
            valid = (bytes_in != PAD)[:, :, None].astype(np.float32) if short else None
            probs = softmax(both_layers(model, bytes_in, valid), model)
            if short:
                probs *= valid[:, :, 0]
            first = np.flatnonzero(np.diff(owner[at], prepend=-1))
            sums[owner[at][first]] += np.add.reduceat(probs.sum(1).T.astype(np.float64), first, axis=0)
    return sums / sizes[:, None]


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, list[bytes]]]:
    """(language, windows) of the documents to learn from, the same for the same table."""
    raw = text_bytes(text_col)
    # A language weighs by its ids and not by its rows, so that an id that repeats takes no share of the others.
    langs = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(raw) > 0)).groupBy(F.col(lang_col).alias("c_lang")).agg(F.approx_count_distinct(id_col).cast("double").alias("weight"))
    counts = {r["c_lang"]: r["weight"] for r in langs.collect()}
    if not counts:
        return []
    size = max(SAMPLE_DOCS, LANG_DOCS * len(counts))
    # One row for each language, as the network has.
    weights = docs.sparkSession.createDataFrame(sorted(counts.items()), f"c_lang {langs.schema['c_lang'].dataType.simpleString()}, weight double")
    room = F.greatest(F.lit(1), F.octet_length(raw) - WINDOW + 1)
    cut = lambda k: F.substring(F.col("raw"), F.pmod(F.xxhash64("s_id", F.lit(k)), F.col("room")).cast("int") + 1, F.lit(WINDOW))
    rows = docs.select(F.col(id_col).alias("s_id"), F.col(lang_col).alias("s_lang"), raw.alias("raw"), room.cast("int").alias("room")).where(F.length("raw") > 0)
    ranked = rows.join(F.broadcast(weights), F.col("s_lang") == F.col("c_lang")).withColumn("rank", F.pmod(F.xxhash64("s_id", F.lit("draw")), F.lit(1 << 30)) * F.col("weight"))
    cuts = F.array(*[cut(k) for k in range(WINDOWS_PER_DOC)]).alias("cuts")
    drawn = (
        # About three times the sample passes, whatever the number of rows, and only it is sorted.
        ranked.where(F.col("rank") < 3.0 * size / len(counts) * (1 << 30))
        .groupBy("s_lang", "rank", "s_id")
        .agg(F.min(F.struct(F.xxhash64("raw").alias("hash"), cuts)).alias("first"))
        .select("s_lang", "first.cuts", "rank", "s_id")
        .orderBy("rank", "s_id")
        .limit(size)
        .collect()
    )
    missing = sorted(set(counts) - {r["s_lang"] for r in drawn})
    if missing:  # by chance a language may have no document among the least ranks
        of = ranked.join(F.broadcast(weights.where(F.col("c_lang").isin(missing)).select(F.col("c_lang").alias("m_lang"))), F.col("s_lang") == F.col("m_lang"))
        drawn += of.groupBy("s_lang").agg(F.min(F.struct("rank", "s_id", cuts)).alias("first")).select("s_lang", "first.cuts").collect()
    return [(r["s_lang"], list({bytes(c): None for c in r["cuts"]})) for r in drawn]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], dict[str, np.ndarray] | None]:
    """The languages and the network, from rows that the caller lets it learn from."""
    drawn = sorted(sample(docs, id_col, text_col, lang_col))
    langs = sorted({lang for lang, _ in drawn})
    if not langs:
        return [], None
    pieces = [(c, langs.index(lang)) for lang, cuts in drawn for c in cuts]
    return langs, train([p for p, _ in pieces], [x for _, x in pieces], len(langs))


def label_languages(docs: DataFrame, langs: list[str], model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns with lang_pred and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    def start():
        names, network = shared.value
        letter = regex.compile(r"\p{L}").search

        def label(batch):
            texts = batch.to_pylist()
            at = [k for k, x in enumerate(texts) if network is not None and x and letter(x.decode("utf-8", "replace"))]
            preds, scores = ["und"] * len(texts), [0.0] * len(texts)
            if at:
                probs = document_probabilities(network, [texts[k] for k in at])
                for k, best, p in zip(at, probs.argmax(1), probs.max(1)):
                    preds[k], scores[k] = names[best], float(min(1.0, p))
            return [preds, scores]

        return label

    return map_column(docs, text_bytes(text_col), keep, {"lang_pred": "string", "score": "double"}, start)


def held_out(id_col: str):
    return F.coalesce(crc_rest(id_col, 3) == 1, F.lit(True))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of every row, learned from rows that are not held out."""
    langs, model = learn(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    return label_languages(rows, langs, model, [id_col, "held_out"], text_col)


def filter_languages(docs: DataFrame, min_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs in a learned language with at least min_score, with their columns."""
    langs, model = learn(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    own = [f"own_{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[docs[f"`{c}`"].alias(o) for c, o in zip(docs.columns, own)], docs[text_col].alias("l_text"))
    labelled = label_languages(rows, langs, model, own, "l_text")
    return labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)])
