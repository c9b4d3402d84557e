"""Personal identifiers by bootstrapped contextual extraction.

Seed entities (identifiers that a strict rule recognises, or given ones) induce lexical patterns: the shape of the
identifier, and its shape with the word before or after it. Patterns and instances form a graph; rounds score a pattern by
the believed instances it matches against those believed to be something else, and an instance by the noisy-or of
its patterns. Patterns of high confidence so discover identifiers that no rule knows, such as card numbers without a
valid check digit, or names where known names stand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import Scratch, hash_words, segment_ids, slices, split_words, texts_of

WORDS = "w: "
CANDIDATES = "doc_id long, text_no long, word int, n int, instance string, seed string, patterns array<string>"
NOISE = "!#$%&*"
ENDS = ",.;:?"
EDGES = NOISE + ENDS + "'\"()[]{}<>"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IPV4 = re.compile(r"\d{1,3}(\.\d{1,3}){3}")
PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)?[ .-]\d{2,4}(?:[ .-]\d{2,4}){1,3}|\+\d{8,15}")
SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
CARD = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
HEX = re.compile(r"(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{16,}")
SECRET_WORDS = {"token", "key", "secret", "password", "apikey", "api_key"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    bare = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def is_phone(instance: str) -> bool:
    """Groups of digits as telephone numbers are written: with a plus, an area code in brackets, or three groups and more that end in four digits."""
    n = sum(c.isdigit() for c in instance)
    return 8 <= n <= 15 and bool(PHONE.fullmatch(instance)) and (instance[0] == "+" or "(" in instance or bool(re.fullmatch(r"\d{3}([ .-])\d{3}\1\d{4}", instance)))


def seed_type(instance: str, before: list[str]) -> str | None:
    """What a strict rule says: a type, ``none`` for what surely is no identifier, or nothing."""
    if EMAIL.fullmatch(instance):
        return "email"
    if IPV4.fullmatch(instance):
        return "ip" if all(int(x) < 256 for x in instance.split(".")) else None
    if is_phone(instance):
        return "phone"
    if SSN.fullmatch(instance):
        return "ssn"
    if CARD.fullmatch(instance):
        return "card" if luhn(re.sub("[ -]", "", instance)) else None
    if IBAN.fullmatch(instance):
        return "iban" if mod97(instance) else None
    if HEX.fullmatch(instance):
        return "secret" if len(instance) >= 32 and any(w.strip("=:\"'").lower() in SECRET_WORDS for w in before) else None
    if "@" not in instance and sum(c.isdigit() for c in instance) < 7:
        return "none"
    return None


def shape(instance: str, exact: bool) -> str:
    """Letters and digits by class: with their counts, or (not exact) digits by a scale of counts alone."""
    if HEX.fullmatch(instance):
        return f"x{len(instance)}" if exact else "x"

    def group(m: re.Match) -> str:
        run = m.group()
        if run[0].isdigit():
            return f"d{len(run)}" if exact else "dDEFG"[(len(run) > 4) + (len(run) > 8) + (len(run) > 12) + (len(run) > 19)]
        return f"a{len(run)}" if exact else "a"

    return re.sub(r"\d+|[^\W\d_]+", group, instance)


MAX_WORDS = 6
BITS = 20


def windows(words: list[str], most: int = MAX_WORDS) -> list[tuple[int, int, str]]:
    """Candidates in a run of adjacent words: first word, number of words (up to ``most``) and string.

    Noise marks between words are dropped; no candidate reaches over a word that ends in punctuation.
    """
    clean = [w.rstrip(NOISE).lstrip(NOISE) for w in words]
    found = []
    for i in range(len(words)):
        for n in range(1, most + 1):
            if i + n > len(words) or any(c and c[-1] in ENDS for c in clean[i : i + n - 1]):
                break
            instance = " ".join(clean[i : i + n]).strip(EDGES)
            if instance:
                found.append((i, n, instance))
    return found


def side_of(word: str) -> str:
    """A word as patterns name it: lower-case, bare, with numbers alike."""
    return re.sub(r"\d+", "0", word.lower().strip(EDGES))


def case_shape(instance: str) -> str:
    """Letters by case alone: runs of capitals, of small letters, and capitalised words."""
    return re.sub(r"[^\W\d_]+", lambda m: "C" if m[0].isupper() and len(m[0]) > 1 else "Cc" if m[0][0].isupper() else "c", instance)


def _places(words: list[str]) -> np.ndarray:
    return (hash_words(pa.array(words, pa.string())) >> np.uint64(64 - BITS)).astype(np.int64)


def _marks(words: list[str]) -> np.ndarray:
    """A set of words as a table of bits by hash, of fixed size: it may hold more, never less."""
    found = np.zeros(1 << BITS, bool)
    if words:
        found[_places(words)] = True
    return found


def _candidates(part: pa.RecordBatch, firsts: np.ndarray | None = None, before: np.ndarray | None = None, after: np.ndarray | None = None) -> pa.RecordBatch:
    """Windows of words with a digit or @; with tables of marks also lettered ones that begin with a marked word, follow one or precede one."""
    words, codes, offsets = split_words(part.column("text"), lower=False)
    rows = {c: [] for c in ("doc", "word", "n", "instance", "seed", "patterns")}
    if len(words):
        text_of = lambda a, b: [words[int(c)].as_py() for c in codes[a:b]]

        def add(doc, lo, hi, at, n, instance, seed, name):
            prior, rest = text_of(max(lo, at - 2), at), text_of(at + n, min(hi, at + n + 1))
            left, right = side_of((prior or [""])[-1]), side_of((rest or [""])[0])
            for key, value in (("doc", doc), ("word", at - lo), ("n", n), ("instance", instance), ("seed", seed(prior)), ("patterns", name(left, right))):
                rows[key].append(value)

        marked = pc.match_substring_regex(words, r"[0-9@]").to_numpy(zero_copy_only=False)
        hits = np.flatnonzero(marked[codes])
        doc_of = segment_ids(offsets)[hits]
        cut = np.flatnonzero((np.diff(hits) > 1) | (np.diff(doc_of) > 0)) + 1
        for run in np.split(hits, cut) if len(hits) else []:
            doc = int(np.searchsorted(offsets, run[0], "right")) - 1
            lo, hi = int(offsets[doc]), int(offsets[doc + 1])
            for i, n, instance in windows(text_of(run[0], run[-1] + 1)):
                kind = shape(instance, False)
                exact = shape(instance, True)
                add(doc, lo, hi, int(run[0]) + i, n, instance, lambda prior, x=instance: seed_type(x, prior), lambda a, b, k=kind, e=exact: [f"exact {e}", f"shape {k}", f"after {a} {k}", f"before {b} {k}"])
        if firsts is not None:
            every = words.to_pylist()
            bare, sides = [w.strip(EDGES) for w in every], [side_of(w) for w in every]
            lettered = ~marked & np.array([bool(x) for x in bare])
            at_first, at_before, at_after = (t[_places(x)][codes] for t, x in ((firsts, bare), (before, sides), (after, sides)))
            start = at_first.copy()
            start[1:] |= at_before[:-1]
            good = lettered[codes]
            for n in (1, 2, 3):
                ok = good[: len(codes) - n + 1].copy()
                for k in range(1, n):
                    ok &= good[k : len(codes) - n + 1 + k]
                last = np.zeros(len(ok), bool)
                last[:-1] = at_after[n : n + len(ok) - 1]
                doc_at = segment_ids(offsets)
                ok &= (start[: len(ok)] | last) & (doc_at[: len(ok)] == doc_at[n - 1 : n - 1 + len(ok)])
                for at in np.flatnonzero(ok):
                    doc = int(doc_at[at])
                    found = [w for w in windows(text_of(at, at + n), n) if w[:2] == (0, n)]
                    if found:
                        kind = case_shape(found[0][2])
                        add(doc, int(offsets[doc]), int(offsets[doc + 1]), int(at), n, found[0][2], lambda prior: None, lambda a, b, k=kind: [f"{WORDS}after {a} {k}", f"{WORDS}before {b} {k}", f"{WORDS}between {a} {b} {k}"])
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id").take(pa.array(rows["doc"], pa.int64())),
            part.column("text_no").take(pa.array(rows["doc"], pa.int64())),
            pa.array(rows["word"], pa.int32()),
            pa.array(rows["n"], pa.int32()),
            pa.array(rows["instance"], pa.string()),
            pa.array(rows["seed"], pa.string()),
            pa.array(rows["patterns"], pa.list_(pa.string())),
        ],
        ["doc_id", "text_no", "word", "n", "instance", "seed", "patterns"],
    )


def _lettered_marks(texts: DataFrame, seeds: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Tables of marks for lettered seeds: their first words, and the words that stand before and after them in the texts.

    What comes to the driver are places in tables of fixed size.
    """
    spark = texts.sparkSession
    wanted = seeds.where(~F.col("entity").rlike("[0-9@]")).select(F.trim(F.col("entity")).alias("instance")).where("instance <> ''").distinct()

    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_places([w.split()[0].strip(EDGES) for w in batch.column("instance").to_pylist()])))], ["place"])

    firsts = np.zeros(1 << BITS, bool)
    firsts[[r.place for r in wanted.mapInArrow(places, "place long").distinct().collect()]] = True
    if not firsts.any():
        return None
    none = np.zeros(1 << BITS, bool)
    shared = spark.sparkContext.broadcast(firsts)

    def around(batches):
        for part in slices(batches):
            yield _candidates(part, shared.value, none, none)

    side = F.regexp_extract(F.get("patterns", 2), r"between (\S*) (\S*) ", 1), F.regexp_extract(F.get("patterns", 2), r"between (\S*) (\S*) ", 2)
    found = texts.mapInArrow(around, CANDIDATES).where(F.get("patterns", 0).startswith(WORDS)).join(wanted, "instance", "left_semi").select(side[0].alias("b"), side[1].alias("a"))

    def anchors(batches):
        for batch in batches:
            for kind in ("b", "a"):
                at = np.unique(_places(batch.column(kind).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at)), pa.array(at)], ["kind", "place"])

    tables = {"b": none.copy(), "a": none.copy()}
    for r in found.mapInArrow(anchors, "kind string, place long").distinct().collect():
        tables[r.kind][r.place] = True
    return firsts, tables["b"], tables["a"]


def find_identifiers(docs: DataFrame, seeds: DataFrame | None = None, min_confidence: float = 0.8, min_support: float = 3.0, word_confidence: float = 0.5) -> DataFrame:
    """Rows (doc_id, first_word, n_words, entity, type, score, is_seed) for every identifier in every text.

    ``seeds`` may add entities (entity, type; type ``none`` for what is no identifier). Words with a digit or @ are always
    candidates. Lettered ones (up to three words) are where ``seeds`` has lettered entities: those that stand where such
    an entity stands somewhere, after or before the same word.

    A pattern counts when its believed instances of one type weigh at least ``min_support`` and are ``min_confidence`` of all its
    believed instances; as most words are neither believed nor disbelieved, a pattern of lettered ones counts when they are
    ``word_confidence`` of all its instances. An instance is believed when its patterns' noisy-or reaches ``min_confidence``
    (lettered: ``word_confidence``). Rounds go on until what is believed comes again. A seed keeps its type and score 1. Of overlapping
    mentions of a text the longest stays, of equally long ones the first. Words count from 0.

    Null, empty or clean texts have no rows; mentions of a null key have a null key, and each text is its own, whatever
    its key. Repeated rows give repeated rows. Ties between types go to the first by name. Other columns aren't read. An
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    texts = texts_of(docs, F.monotonically_increasing_id().alias("text_no"))
    marks = _lettered_marks(texts, seeds) if seeds is not None else None
    shared = docs.sparkSession.sparkContext.broadcast(marks or ())  # of fixed size
    found = texts.mapInArrow(lambda batches: (_candidates(part, *shared.value) for part in slices(batches)), CANDIDATES)
    found = scratch.save(found.withColumn("mention", F.monotonically_increasing_id()), "candidates")
    edges = scratch.save(found.select("instance", F.explode("patterns").alias("pattern")).distinct(), "edges")
    lettered = F.col("pattern").startswith(WORDS)
    whole = edges.where(lettered).groupBy("pattern").agg(F.count("*").alias("instances"))
    known = found.where("seed is not null").groupBy("instance").agg(F.min(F.when(F.col("seed") != "none", F.col("seed"))).alias("some"), F.min("seed").alias("any"))
    known = known.select("instance", F.coalesce("some", "any").alias("type"))
    if seeds is not None:
        given = seeds.select(F.trim(F.col("entity")).alias("instance"), "type").groupBy("instance").agg(F.min("type").alias("type"))
        known = given.union(known.join(given, "instance", "left_anti"))
    known = scratch.save(known.withColumn("score", F.lit(1.0)).withColumn("is_seed", F.lit(True)), "known")
    mark = F.sum(F.xxhash64("instance", "type", "score").cast("decimal(38,0)"))
    believed, seen, i = known, set(), 0
    while (state := tuple(believed.agg(F.count("*"), mark).first())) not in seen:
        seen.add(state)
        weight = edges.join(believed, "instance").groupBy("pattern", "type").agg(F.sum("score").alias("weight"))
        weight = weight.withColumn("all", F.sum("weight").over(Window.partitionBy("pattern")))
        if marks is not None:
            weight = weight.join(whole, "pattern", "left").withColumn("all", F.coalesce(F.col("instances").cast("double"), "all"))
        weight = weight.withColumn("share", F.col("weight") / F.col("all")).withColumn("least", F.when(lettered, word_confidence).otherwise(min_confidence))
        good = weight.where((F.col("type") != "none") & (F.col("weight") >= min_support) & (F.col("share") >= F.col("least")))
        good = good.groupBy("pattern").agg(F.min_by(F.struct("type", "share", "least"), F.struct(-F.col("share"), "type")).alias("g")).select("pattern", "g.*")
        doubt = F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(0.01))))
        scored = edges.join(good, "pattern").groupBy("instance", "type").agg(F.round(1 - F.exp(doubt), 6).alias("score"), F.max("least").alias("least")).where(F.col("score") >= F.col("least"))
        best = scored.groupBy("instance").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("type"))).alias("b")).select("instance", F.col("b.type").alias("type"), (-F.col("b.less")).alias("score"))
        best = best.join(known, "instance", "left_anti").withColumn("is_seed", F.lit(False))
        i += 1
        believed = scratch.save(known.union(best), f"round{i}")
    mentions = found.join(believed.where("type <> 'none'"), "instance").select("mention", "text_no", "doc_id", "word", "n", "instance", "type", "score", "is_seed")
    mentions = scratch.save(mentions, "mentions")
    # a mention stays if it is the strongest at each word that it covers
    covered = mentions.select("mention", "text_no", F.struct("n", (-F.col("word")).alias("w")).alias("rank"), F.explode(F.sequence(F.col("word"), F.col("word") + F.col("n") - 1)).alias("at"))
    best = covered.withColumn("best", F.max("rank").over(Window.partitionBy("text_no", "at")))
    beaten = best.where("best > rank").select("mention").distinct()
    kept = mentions.join(beaten, "mention", "left_anti")
    return kept.select("doc_id", F.col("word").alias("first_word"), F.col("n").alias("n_words"), F.col("instance").alias("entity"), "type", "score", "is_seed")
