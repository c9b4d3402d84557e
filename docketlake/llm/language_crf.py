"""Language of each word in code-switched text, by a linear-chain conditional random field.

A word's potential comes from its affixes, its character n-grams and lexicons of frequent words; learned
transitions tie neighbours; the forward-backward algorithm gives each word's posterior.

Training reads a sample bounded by ``sample_docs`` labelled documents per language (column ``lang``), joined
into mixed sequences whose words carry their document's language. Labelling covers every word of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import hash_words, segment_ids, slices, split_words, sum_segments, texts_of, word_bytes

SCHEMA = (
    "doc_id long, lang string, confidence double, shares map<string,double>, n_words long, n_switches long, "
    "segments array<struct<lang:string,first_word:int,words:int>>, keep boolean"
)
BITS = 17
BLOCK = 32


def features(words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of 1 to 4 bytes of each word between boundary marks (those with a mark are affixes): ids and offsets for each n."""
    mark = [pa.scalar(x, pa.large_string()) for x in ("\x02", "\x03", "")]
    data, offsets = word_bytes(pc.binary_join_element_wise(mark[0], words.cast(pa.large_string()), mark[1], mark[2]))
    data = data.astype(np.uint64)
    size = np.diff(offsets)
    left = np.repeat(offsets[1:], size) - np.arange(len(data))
    key, found = data, []
    for n in range(1, 5):
        if n > 1:
            key = (key[:-1] << np.uint64(8)) | data[n - 1 :] if len(data) >= n else key[:0]
        gram = key if n == 1 else key[left[: len(key)] >= n]
        with np.errstate(over="ignore"):
            ids = (gram + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
        found.append((ids.astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(size - n + 1, 0))])))
    return found


class Model:
    """Weights of the field: ``emit`` (feature x language), ``lexicon`` (language-set code x language), ``move`` (language x language)."""

    def __init__(self, langs: list[str], known: np.ndarray, sets: np.ndarray):
        n = len(langs)
        self.langs, self.known, self.sets = langs, known, sets
        self.emit = np.zeros((1 << BITS, n), np.float32)
        self.lexicon = np.zeros((n + 1, n), np.float32)
        self.move = np.zeros((n, n), np.float32)

    def lexicon_flags(self, words: pa.Array) -> np.ndarray:
        """For each word, which languages' lexicons hold it; the last column says that none does."""
        flags = np.zeros((len(words), len(self.langs) + 1), np.float32)
        if len(self.known):
            h = hash_words(words)
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[at] == h
            flags[hit, :-1] = self.sets[at[hit]]
        flags[:, -1] = flags.sum(1) == 0
        return flags

    def scores(self, words: pa.Array) -> np.ndarray:
        """Log potentials of each distinct word. An n-gram's weight counts by the word's number of n-grams."""
        if not len(words):
            return np.zeros((0, len(self.langs)), np.float32)
        grams = features(words)
        total = np.stack([sum(sum_segments(weight[ids], at) for ids, at in grams) for weight in self.emit.T.copy()], 1)
        norm = np.sqrt(sum(np.diff(at) for _, at in grams))
        return total / norm[:, None].astype(np.float32) + self.lexicon_flags(words) @ self.lexicon


def posteriors(scores: np.ndarray, offsets: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Exact forward-backward posteriors of every word of every sequence.

    Sequences are cut into blocks of BLOCK words. The product of each block's transfer matrices is formed for
    all blocks at once, states at block borders follow from those products, and the words within from the
    borders; a long sequence so costs a step per block, not per word.
    """
    n_lang = move.shape[0]
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return np.zeros((0, n_lang), np.float32)
    blocks = -(-size[order] // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    n = int(first[-1])
    doc = np.repeat(np.arange(len(order)), blocks)
    start = offsets[order][doc] + (np.arange(n) - first[doc]) * BLOCK
    length = np.minimum(BLOCK, offsets[order + 1][doc] - start)
    by_length = np.argsort(-length, kind="stable")  # so that the blocks with a word at place t come first
    start, live = start[by_length], np.searchsorted(-length[by_length], -np.arange(BLOCK), "left")
    a = np.ascontiguousarray(np.exp(move - move.max()).T.astype(np.float64))
    top = scores[:, 0]
    for k in range(1, n_lang):
        top = np.maximum(top, scores[:, k])
    e = np.exp((scores - top[:, None]).T.astype(np.float64)) + 1e-12
    ones = np.ones(n_lang)

    product = np.repeat(np.eye(n_lang)[:, :, None], n, 2)  # [to, from, block]
    for t in range(BLOCK):
        m = live[t]
        if not m:
            break
        step = (a @ product[:, :, :m].reshape(n_lang, -1)).reshape(n_lang, n_lang, m)
        step *= e[:, None, start[:m] + t]
        if t % 8 == 7:
            step /= np.ones(n_lang * n_lang) @ step.reshape(-1, m)
        product[:, :, :m] = step
    chain = np.empty((n, n_lang, n_lang))  # [block, from, to], in reading order
    chain[by_length] = product.transpose(2, 1, 0)
    chain /= (chain.reshape(n, -1) @ np.ones(n_lang * n_lang))[:, None, None]

    forward, backward = np.full((n, n_lang), 1 / n_lang), np.full((n, n_lang), 1 / n_lang)
    having = np.searchsorted(-blocks, -np.arange(int(blocks[0]) + 1), "right")  # documents of at least so many blocks
    for j in range(1, int(blocks[0])):
        b = first[: having[j + 1]] + j
        state = (forward[b - 1, None, :] @ chain[b - 1])[:, 0]
        forward[b] = state / (state @ ones)[:, None]
    for j in range(int(blocks[0]) - 2, -1, -1):
        b = first[: having[j + 2]] + j
        state = (chain[b + 1] @ backward[b + 1, :, None])[:, :, 0]
        backward[b] = state / (state @ ones)[:, None]

    ahead = []
    state = forward[by_length].T.copy()
    for t in range(BLOCK):
        m = live[t]
        if not m:
            break
        state = (a @ state[:, :m]) * e[:, start[:m] + t]
        state /= ones @ state
        ahead.append(state)
    result = np.empty(e.shape, np.float32)
    state = backward[by_length].T.copy()
    for t in range(len(ahead) - 1, -1, -1):
        m = live[t]
        both = ahead[t] * state[:, :m]
        result[:, start[:m] + t] = both / (ones @ both)
        step = a.T @ (e[:, start[:m] + t] * state[:, :m])
        state[:, :m] = step / (ones @ step)
    return result.T


def train(rows: list[tuple[str, str]], lexicon_words: int = 2000, epochs: int = 3, rate: float = 0.3, seed: int = 0) -> Model:
    """Fits the field to (language, text) rows by AdaGrad on its conditional log likelihood.

    The texts are cut into spans of 3 to 40 words, shuffled into sequences, so that languages alternate as in
    code-switched text. The same rows give the same model, in whatever order they come. Without rows the model has one
    language, ``und``.
    """
    rows = sorted((lang, text) for lang, text in rows if lang and text)
    langs = sorted({lang for lang, _ in rows}) or ["und"]
    words, codes, offsets = split_words(pa.array([t for _, t in rows], pa.large_string()))
    label = np.array([langs.index(lang) for lang, _ in rows], np.int64)
    y_all = label[segment_ids(offsets)] if len(rows) else np.zeros(0, np.int64)
    counts = np.zeros((len(words), len(langs)))
    np.add.at(counts, (codes, y_all), 1)
    share = counts / np.maximum(counts.sum(0, keepdims=True), 1)
    held: set[int] = set()
    sets = np.zeros(counts.shape, np.float32)
    for k in range(len(langs)):
        best = np.argsort(-share[:, k], kind="stable")[:lexicon_words]
        best = best[(counts[best, k] > 2) & (share[best, k] >= 0.5 * share[best].max(1))]
        sets[best, k] = 1
        held.update(best.tolist())
    pick = np.array(sorted(held), np.int64)
    hashes = hash_words(words.take(pa.array(pick))) if len(pick) else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    model = Model(langs, hashes[order], sets[pick][order])
    if len(langs) < 2:
        return model

    rng = np.random.default_rng(seed)
    spans = []
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        while lo < hi:
            end = min(hi, lo + int(rng.integers(3, 41)))
            spans.append((lo, end))
            lo = end
    flags = model.lexicon_flags(words)
    grams = features(words)
    ids = np.concatenate([x for x, _ in grams])[np.argsort(np.concatenate([segment_ids(o) for _, o in grams]), kind="stable")]
    at = sum(o for _, o in grams)
    norm = 1 / np.sqrt(np.diff(at))
    g_emit, g_lex, g_move = np.full_like(model.emit, 1e-2), np.full_like(model.lexicon, 1e-2), np.full_like(model.move, 1e-2)
    for _ in range(epochs):
        rng.shuffle(spans)
        for i in range(0, len(spans), 256):
            part = spans[i : i + 256]
            where = np.concatenate([np.arange(lo, hi) for lo, hi in part])
            cut = np.arange(0, len(where), 64)
            bounds = np.append(cut, len(where))
            x, y = codes[where], y_all[where]
            used, local = np.unique(x, return_inverse=True)
            lens = at[used + 1] - at[used]
            pos = np.repeat(at[used] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            f = ids[pos]
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            score = np.add.reduceat(model.emit[f], starts) * norm[used][:, None] + flags[used] @ model.lexicon
            score = score[local]
            post = posteriors(score, bounds, model.move)
            diff = -post
            diff[np.arange(len(y)), y] += 1
            by_word = np.zeros((len(used), len(langs)), np.float32)
            np.add.at(by_word, local, diff)
            d_lex = flags[used].T @ by_word
            spread = np.repeat(by_word * norm[used][:, None], lens, axis=0)
            d_emit = np.stack([np.bincount(f, spread[:, k], 1 << BITS) for k in range(len(langs))], 1)
            touched = np.flatnonzero(np.bincount(f, minlength=1 << BITS))
            d_emit = d_emit[touched]
            inner = np.ones(len(y), bool)
            inner[bounds[:-1]] = False
            now = np.flatnonzero(inner)
            pair = _pair_posteriors(score, post, bounds, model.move, now)
            d_move = -pair
            np.add.at(d_move, (y[now - 1], y[now]), 1)
            for w, g, d, rows_ in ((model.emit, g_emit, d_emit, touched), (model.lexicon, g_lex, d_lex, slice(None)), (model.move, g_move, d_move, slice(None))):
                d = np.asarray(d, np.float32) / len(part)
                g[rows_] += d * d
                w[rows_] += rate * d / np.sqrt(g[rows_])
    return model


def _pair_posteriors(scores: np.ndarray, post: np.ndarray, bounds: np.ndarray, move: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Expected transitions, summed: forward messages by the recurrence over all (equally long) sequences at once."""
    n_lang, steps = move.shape[0], int(np.diff(bounds).max())
    a = np.exp(move - move.max())
    e = np.exp(scores - scores.max(1, keepdims=True)) + 1e-12
    alpha = np.empty_like(e)
    state = np.full((len(bounds) - 1, n_lang), 1 / n_lang)
    size = np.diff(bounds)
    for t in range(steps):
        live = size > t
        nxt = (state[live] @ a) * e[bounds[:-1][live] + t]
        nxt /= nxt.sum(1, keepdims=True)
        state[live] = nxt
        alpha[bounds[:-1][live] + t] = nxt
    before = alpha[now - 1]
    joint = before[:, :, None] * a[None]
    return np.einsum("nij,nj->ij", joint / np.maximum(joint.sum(1, keepdims=True), 1e-30), post[now])


def training_rows(docs: DataFrame, sample_docs: int) -> list[tuple[str, str]]:
    """Up to ``sample_docs`` labelled documents per language, picked by a hash of the key."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").where("lang is not null and doc_id is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = keys.withColumn("__rank", rank).where(F.col("__rank") <= sample_docs).select("doc_id", "lang")
    ids = [r.doc_id for r in picked.select("doc_id").collect()]
    if not ids:
        return []
    chosen = texts_of(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null")
    wanted = docs.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "wanted long")
    found = chosen.join(F.broadcast(wanted), F.col("doc_id") == F.col("wanted"), "left_semi").collect()
    return sorted((r.lang, r.text) for r in found)


def label_languages(
    docs: DataFrame, languages: tuple[str, ...] | None = None, min_confidence: float = 0.5, sample_docs: int = 100, model: Model | None = None
) -> DataFrame:
    """One row per document: its language, the languages' shares, and runs of words of one language.

    ``docs`` has doc_id, text and, unless a model is given, lang. ``confidence`` is the mean posterior of the
    document's chief language. ``keep`` is false where that is under ``min_confidence``, where the language isn't one
    of ``languages`` (None: all), or where the text has no word with a letter. ``shares`` names every language that some
    word is labelled with or that has more than 0.0005 of the posterior. Ties go to the first language by name.

    Null, empty or wordless text: lang null, confidence 0, empty shares and segments, keep false. Null doc_id: a row
    with a null key. Repeated rows give repeated rows. Other columns are neither read nor returned. An empty table
    gives no rows; without labelled rows the only language is ``und``.
    """
    if model is None:
        model = train(training_rows(docs, sample_docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2^BITS x languages

    def label(batches):
        m = shared.value
        for part in slices(batches):
            yield _label_slice(part, m, languages, min_confidence)

    return texts_of(docs).mapInArrow(label, SCHEMA)


def _label_slice(part: pa.RecordBatch, model: Model, languages: tuple[str, ...] | None, min_confidence: float) -> pa.RecordBatch:
    words, codes, offsets = split_words(part.column("text"))
    lettered = pc.match_substring_regex(words, r"\pL").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
    post = posteriors(model.scores(words)[codes], offsets, model.move)
    n_docs, n_lang = part.num_rows, len(model.langs)
    size = np.diff(offsets)
    doc = segment_ids(offsets)
    total = np.stack([np.bincount(doc, post[:, k], n_docs) for k in range(n_lang)], 1)
    letters = np.bincount(doc, lettered[codes], n_docs) if len(codes) else np.zeros(n_docs)
    share = total / np.maximum(size, 1)[:, None]
    real = letters > 0
    best = np.argmax(np.round(share, 6), 1)
    sure = np.where(real, share[np.arange(n_docs), best], 0.0)
    names = np.array(model.langs, object)
    tag = post.argmax(1)
    starts = np.ones(len(tag), bool)
    starts[1:] = tag[1:] != tag[:-1]
    starts[offsets[:-1][size > 0]] = True
    starts &= real[doc]
    begin = np.flatnonzero(starts)
    runs = np.bincount(doc[begin], minlength=n_docs)
    stop = np.append(begin[1:], len(tag))
    stop = np.minimum(stop, offsets[doc[begin] + 1])
    segment = pa.StructArray.from_arrays(
        [pa.array(names[tag[begin]], pa.string()), pa.array((begin - offsets[doc[begin]]).astype(np.int32)), pa.array((stop - begin).astype(np.int32))],
        ["lang", "first_word", "words"],
    )
    segments = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs)]).astype(np.int32)), segment)
    tagged = np.stack([np.bincount(doc, tag == k, n_docs) for k in range(n_lang)], 1)
    shown = real[:, None] & ((share > 0.0005) | (tagged > 0))
    at = np.nonzero(shown)
    shares = pa.MapArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(shown.sum(1))]).astype(np.int32)), pa.array(names[at[1]], pa.string()), pa.array(np.round(share[at].astype(float), 6))
    )
    allowed = np.ones(n_lang, bool) if languages is None else np.isin(model.langs, languages)
    keep = real & (np.round(sure, 6) >= min_confidence) & allowed[best]
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            pa.array(np.where(real, names[best], None), pa.string()),
            pa.array(np.round(sure.astype(float), 4)),
            shares,
            pa.array(size.astype(np.int64)),
            pa.array(np.maximum(runs - 1, 0).astype(np.int64)),
            segments,
            pa.array(keep),
        ],
        ["doc_id", "lang", "confidence", "shares", "n_words", "n_switches", "segments", "keep"],
    )


def drop_unrecognised(docs: DataFrame, languages: tuple[str, ...] | None = None, min_confidence: float = 0.5, sample_docs: int = 100, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that label_languages() would keep. No row moves; columns may bear any names."""
    if model is None:
        model = train(training_rows(docs, sample_docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches):
        m = shared.value
        for batch in batches:
            text = batch.column("text").cast(pa.string()).fill_null("")
            bare = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), text], ["doc_id", "text"])
            keep = [_label_slice(part, m, languages, min_confidence).column("keep") for part in slices(iter([bare]))]
            if keep:
                yield batch.filter(pa.concat_arrays(keep))

    return docs.mapInArrow(choose, docs.schema)
