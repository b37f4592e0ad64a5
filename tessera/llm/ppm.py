"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to ORDER bytes deep with the counts of what follows. A byte costs
-log2 of its frequency in the longest context that knows it, plus -log2 of the escape probability (method C: distinct
followers / (followers + distinct followers)) of each longer known context that doesn't; order -1 is uniform over 256
bytes. Statistics are frozen after training, so a text's code length is a sum over its bytes that doesn't depend on what
was read before, and whole batches of texts are scored by table lookups. The language with the shortest code wins.

Trees are whole, none of their contexts being pruned; every label of the training rows has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as B

#: Depth of contexts in bytes.
ORDER = 4
#: Bounds of the training sample: documents of a language, bytes of one of them, and bytes in all (each language has an
#: equal share of these, and at least FEWEST documents).
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TOTAL, FEWEST = 300, 20_000, 32 << 20, 8
#: Languages whose trees share a table.
GROUP = 16
#: Bytes of text that are scored at once; rows that go on together. What a task holds besides its input follows from these.
SLICE_BYTES, PART_ROWS = 1 << 16, 1024
#: A text is none of a language's if its code is longer than usual by more than so many standard deviations of the
#: language's own texts and so many bits a byte, START bits for its first bytes apart.
DEVIATIONS, EXCESS, START = 6.0, 1.5, 64.0
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """Frozen context trees of all languages, flattened for lookups.

    langs: names in order; costs[k]: code lengths in bits of the known (k+1)-byte strings' last byte, by row and
    language; keys[k], rows[k]: the hash table of their codes, with a row of -1 in free slots; escapes[k]: costs of
    leaving a k-byte context, by its row among the k-byte strings.
    """

    langs: list[str]
    uniform: float = 8.0
    keys: list[np.ndarray] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)
    costs: list[np.ndarray] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)


def _slots(codes: np.ndarray, size: int) -> np.ndarray:
    """First slots in a table whose size is a power of two."""
    return (((codes + np.uint64(1)) * _MULTIPLIER) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _table(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash table of distinct codes, with two to four slots for each: keys, and their numbers. A code whose slot is
    taken goes to the next one, and so on."""
    size = 1 << max(4, (2 * len(codes)).bit_length())
    keys, rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
    left, at = np.arange(len(codes)), _slots(codes, size)
    while len(left):
        free = rows[at] < 0
        slot, first = np.unique(at[free], return_index=True)
        placed = np.flatnonzero(free)[first]
        keys[slot], rows[slot] = codes[left[placed]], left[placed]
        rest = np.ones(len(left), bool)
        rest[placed] = False
        left, at = left[rest], (at[rest] + 1) % size
    return keys, rows


def _grams(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the strings of ``length`` bytes that end at each byte, and whether they lie within one text."""
    code = np.zeros(len(data), np.uint64)
    for back in range(length):
        code[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    room = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    return code, room >= length - 1


def fit(samples: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """Context trees of the languages' texts, unpruned. Needs one language or more."""
    model = Model(sorted(samples))
    counted = []  # for each order and language: known strings and their counts
    for k in range(order + 1):
        per = []
        for lang in model.langs:
            texts = samples[lang]
            data = np.frombuffer(b"".join(texts), np.uint8)
            at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
            code, inside = _grams(data, at, k + 1)
            per.append(np.unique(code[inside], return_counts=True))
        counted.append(per)
    langs = len(model.langs)
    for k in range(order + 1):
        known = np.unique(np.concatenate([codes for codes, _ in counted[k]]))
        often = np.zeros((len(known), langs), np.int64)
        for j, (codes, n) in enumerate(counted[k]):
            often[np.searchsorted(known, codes), j] = n
        keys, rows = _table(known)
        # Followers of each context in each language.
        context = known >> np.uint64(8)
        heads, of = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(heads), langs)), np.zeros((len(heads), langs))
        np.add.at(total, of, often)
        np.add.at(kinds, of, often > 0)
        escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
        below = np.full((len(known), langs), model.uniform)
        if k:
            below = model.costs[k - 1][_find(model, k - 1, known & np.uint64((1 << (8 * k)) - 1))].astype(np.float64)
        seen = -np.log2(np.maximum(often, 1) / np.maximum(total + kinds, 1)[of])
        cost = np.where(often > 0, seen, escape[of] + below)
        leave = np.zeros((len(model.costs[k - 1]) if k else 1, langs), np.float32)
        leave[_find(model, k - 1, heads) if k else 0] = escape
        model.escapes.append(leave)
        model.keys.append(keys)
        model.rows.append(rows)
        model.costs.append(cost.astype(np.float32))
    return model


def _find(model: Model, k: int, codes: np.ndarray) -> np.ndarray:
    """Row of each (k+1)-byte string, or -1."""
    keys, rows = model.keys[k], model.rows[k]
    slot = _slots(codes, len(keys))
    out = rows[slot]
    other = np.flatnonzero((out >= 0) & (keys[slot] != codes))
    slot = slot[other]
    while len(other):
        slot = (slot + 1) % len(keys)
        out[other] = rows[slot]
        more = (out[other] >= 0) & (keys[slot] != codes[other])
        other, slot = other[more], slot[more]
    return out


def byte_costs(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code length in bits of every byte in every language, by byte and language."""
    langs = len(model.langs)
    out = np.zeros((len(data), langs), np.float32)
    top = len(model.costs) - 1
    code, _ = _grams(data, at, top + 1)
    room = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    left = np.arange(len(data))
    for k in range(top, -1, -1):
        able = room[left] >= k
        spots, later = left[able], left[~able]
        codes = code[spots] & np.uint64((1 << (8 * (k + 1))) - 1)
        row = _find(model, k, codes)
        hit = row >= 0
        out[spots[hit]] += model.costs[k][row[hit]]
        missed = spots[~hit]
        head = _find(model, k - 1, codes[~hit] >> np.uint64(8)) if k else np.zeros(len(missed), np.int32)
        known = head >= 0
        out[missed[known]] += model.escapes[k][head[known]]
        left = np.concatenate([missed, later])
    out[left] += model.uniform
    return out


def code_lengths(model: Model, texts: pa.Array) -> np.ndarray:
    """Code length in bits of each whole text in each language."""
    data, at = B.buffers(texts)
    out = np.zeros((len(at) - 1, len(model.langs)))
    # Work runs over slices of texts; a text longer than a slice is cut, with its last bytes before the cut as context.
    step = max(len(model.costs), SLICE_BYTES * 4 // max(4, len(model.langs)))  # bounds the matrix of bytes and languages
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, "right")) - 1)
        if j == i + 1:
            depth = len(model.costs) - 1
            for s in range(int(at[i]), int(at[j]), step):
                lead = min(depth, s - int(at[i]))
                part = data[s - lead : min(s + step, int(at[j]))]
                out[i] += byte_costs(model, part, np.array([0, len(part)]))[lead:].sum(0, dtype=np.float64)
        else:
            costs = byte_costs(model, data[at[i] : at[j]], at[i : j + 1] - at[i]).astype(np.float64)
            sums = np.vstack([np.zeros(len(model.langs)), np.cumsum(costs, 0)])
            out[i:j] = sums[at[i + 1 : j + 1] - at[i]] - sums[at[i:j] - at[i]]
        i = j
    return out


@dataclass
class Languages:
    """Models of groups of languages, and what a byte usually costs in each: mean and deviation by language."""

    models: list[Model]
    usual: dict[str, tuple[float, float]]

    @property
    def langs(self) -> list[str]:
        return [x for m in self.models for x in m.langs]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        return np.concatenate([code_lengths(m, texts) for m in self.models], axis=1)

    def longest(self, lang: str, size: np.ndarray) -> np.ndarray:
        """The longest code, in bits, that a text of so many bytes may have and be the language's."""
        mean, deviation = self.usual[lang]
        return START + size * (mean + max(EXCESS, DEVIATIONS * deviation))


def learn(samples: dict[str, list[bytes]], order: int = ORDER) -> Languages:
    """Models of all languages. What a byte usually costs is measured on every third text by a model of the others."""
    names = sorted(samples)
    parts = [names[k : k + GROUP] for k in range(0, len(names), GROUP)]
    usual = {}
    for part in parts:
        shown = {x: [t for k, t in enumerate(samples[x]) if k % 3 or len(samples[x]) < 3] for x in part}
        model = fit(shown, order)
        for j, x in enumerate(part):
            texts = [t for k, t in enumerate(samples[x]) if not k % 3] or samples[x]
            # What a window cuts through is replaced, as in no text that is scored.
            bits = code_lengths(model, pa.array([t.decode("utf-8", "replace") for t in texts]))[:, j]
            each = np.maximum(bits - START, 0) / np.array([max(1, len(t)) for t in texts])
            usual[x] = float(np.average(each, weights=[len(t) + 1 for t in texts])), float(each.std())
    return Languages([fit({x: samples[x] for x in part}, order) for part in parts], usual)


def training_sample(df: DataFrame, lang_col: str, text_col: str, key: Column, docs: int = SAMPLE_DOCS, most: int = SAMPLE_BYTES, total: int = SAMPLE_TOTAL) -> dict[str, list[bytes]]:
    """Texts of every language: ``docs`` at most, or fewer (FEWEST at least) where ``total`` bytes don't hold as many of
    each; of a text of more than ``most`` bytes a window of that size, the place following from its hash.

    Texts are taken by the hash of ``key``, so the sample doesn't depend on the order or layout of rows. Labels are
    counted first, so what reaches the driver is about ``total`` bytes, or FEWEST texts of each language.
    """
    good = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(key).alias("h")).where("lang is not null and text <> ''")
    sizes = good.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.avg(F.least(F.octet_length("text"), F.lit(most))).alias("bytes")).collect()
    docs_of = {r["lang"]: max(FEWEST, min(docs, int(total / len(sizes) / r["bytes"]))) for r in sizes}
    span = 2**63
    # Hashes are uniform: this share of a language's texts holds more than are wanted nearly always.
    top = [(r["lang"], -span + min(2 * span - 1, int(2 * span * min(1.0, (1.3 * docs_of[r["lang"]] + 50) / r["count"])))) for r in sizes]
    if not top:
        return {}
    limits = df.sparkSession.createDataFrame(top, "lang string, below long")
    room = F.greatest(F.length("text") - most, F.lit(0)) + 1
    window = F.substring("text", F.when(F.octet_length("text") > most, F.pmod("h", room) + 1).otherwise(1).cast("int"), F.lit(most))
    rows = good.join(F.broadcast(limits), "lang").where("h <= below").select("lang", "h", window.alias("text")).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        if len(out.setdefault(r["lang"], [])) < docs_of[r["lang"]]:
            out[r["lang"]].append(r["text"].encode()[:most])
    return out


_ADDED = ("lang_pred", "score", "bits_per_byte", "is_usual")


def predict(df: DataFrame, languages: Languages, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score (the posterior of the predicted language under equal priors, 0 to 1), bits_per_byte, and
    is_usual: whether the text's code isn't much longer than those of the language's own texts.

    lang_pred is ``und`` with score 0 and is_usual false where the text is null or has no letter, and ties go to the
    first language by name. Whole texts are scored. Columns of df with these names are replaced; others stay. An empty
    df gives an empty result; every row is scored on its own.
    """
    base = df.drop(*_ADDED)
    shared = df.sparkSession.sparkContext.broadcast(languages)  # its size is bounded by the sample
    names = base.columns
    schema = base.schema.add("__letter", "boolean").add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double").add("is_usual", "boolean")
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.give_back()  # what an earlier stage's task left in this worker
        m = shared.value
        langs = m.langs
        order = np.argsort(np.array(langs, object), kind="stable")
        for batch in (b.slice(k, PART_ROWS) for b in batches for k in range(0, len(b), PART_ROWS)):
            texts = batch.column(where)
            bits = m.lengths(texts)
            best = order[bits[:, order].argmin(1)]
            low = bits[np.arange(len(best)), best]
            score = 1.0 / np.exp2(np.maximum(low[:, None] - bits, -1000.0)).sum(1)
            size = np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1)
            letter = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            usual = low <= np.array([m.longest(langs[k], n) for k, n in zip(best, size, strict=True)])
            pred = [langs[k] if x else "und" for k, x in zip(best, letter, strict=True)]
            new = [batch.column(k) for k in range(len(names) + 1)] + [pa.array(pred, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(low / size), pa.array(usual & letter)]
            yield pa.RecordBatch.from_arrays(new, [*names, "__letter", *_ADDED])
        B.give_back()

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return base.withColumn("__letter", letter).mapInArrow(run, schema).drop("__letter")


def identify_languages(df: DataFrame, train: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> DataFrame:
    """predict() with models learnt from training_sample(train). Without any labelled text every row is ``und``."""
    samples = training_sample(train, lang_col, text_col, F.col(key_col))
    if not samples:
        return df.drop(*_ADDED).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "bits_per_byte": F.lit(0.0), "is_usual": F.lit(False)})
    return predict(df, learn(samples), text_col)


def _held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_ppm_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify_languages(docs.select("doc_id", "text"), docs.where(~_held_out()))
    return out.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")
