"""Language identification by prediction by partial matching (PPM) over UTF-8 bytes.

Every language has a byte context tree of orders 0 to 3 with counts frozen after training. A byte that a
context has seen costs ``-log2(c / (n + q))``, one that it has not costs the escape ``-log2(q / (n + q))``
plus its cost one order lower (method C, without exclusion); below order 0 every byte costs 8 bits.
The code length of a text is the sum over all its bytes, contexts starting from three zero bytes.

Because the statistics are frozen, the cost of a byte depends only on the longest context that any tree
knows and on the byte, so all escapes are worked out once, into one table with a row per (context, byte)
and a column per language. Scoring a text is two array lookups per byte; sums are integers
(1/2048 bit), so results do not depend on the order of work.

NULL texts and texts without a letter are ``und`` with score 0. An empty table gives an empty result; a
table without any usable training row makes every text ``und``. Repeated rows are scored one by one.
Input columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from regulus.llm.textops import n_letters_missing, pieces, thin, unused
from regulus.session import cut, lookup_join

UNDETERMINED = "und"
ORDER = 3
UNIT = 2048
# Bounds of the training sample: texts per language, and characters taken of a text. Texts of 50 to 6,000 characters
# are preferred; a language short of them is learned from its shorter texts and the beginnings of its longer ones.
SAMPLE_TEXTS = 150
SAMPLE_CHARS = 6000
SAMPLE_LEAST = 50
DRAWN = 4


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    symbol: np.ndarray     # byte -> column within a context's rows
    contexts: np.ndarray   # (order << 24 | bytes), sorted; a row block of the table each
    costs: np.ndarray      # (contexts x symbols, languages), 1/UNIT bit


def training_texts(docs: DataFrame, keep: Column, text: str = "text", lang: str = "lang", key: str = "doc_id",
                   per_lang: int = SAMPLE_TEXTS, max_chars: int = SAMPLE_CHARS,
                   min_chars: int = SAMPLE_LEAST) -> list[tuple[str, str]]:
    """At most ``per_lang`` different rows of every language with a non-empty text, by hash of key and text.

    Texts of ``min_chars`` to ``max_chars`` characters come first, others only where a language has too few of
    these; of any text at most its first ``max_chars`` characters are taken. Rows are ranked by a uniform hash, so a bound
    on the hash, from the language's number of rows, leaves about DRAWN times ``per_lang`` of them before any are sent to the
    task that ranks a language, however many rows and tasks there are. Only hashes travel.
    """
    fit = (docs.where(keep & F.col(lang).isNotNull() & (F.length(text) > 0))
           .select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(lang), F.col(key), F.col(text)).alias("row")))
    there = cut(fit.groupBy("lang", "row").agg(F.min(~F.length("text").between(min_chars, max_chars)).alias("outside")))
    sizes = there.groupBy("lang").agg(F.count_if(~F.col("outside")).alias("_in"), F.count_if("outside").alias("_out"))
    uniform = F.col("row") / F.lit(2.0 ** 64) + 0.5
    near = F.when(~F.col("outside"), uniform * F.col("_in") <= DRAWN * per_lang).otherwise(
        (F.col("_in") < per_lang) & (uniform * F.col("_out") <= DRAWN * per_lang))
    rank = Window.partitionBy("lang").orderBy("outside", "row")
    chosen = lookup_join(there, sizes, ["lang"], "inner").where(near).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= per_lang)
    own = [r[0] for r in chosen.select("row").collect()]
    rows = (fit.where(F.col("row").isin(own)).select("lang", F.substring("text", 1, max_chars).alias("text"), "row")
            .distinct().orderBy("lang", "row").collect())
    return [(r[0], r[1]) for r in rows]


def _grams(data: bytes, order: int) -> np.ndarray:
    a = np.frombuffer(bytes(ORDER) + data, np.uint8).astype(np.int64)
    g = a[ORDER:].copy()
    for i in range(1, order + 1):
        g |= a[ORDER - i:len(a) - i] << (8 * i)
    return g


def train(texts: list[tuple[str, str]]) -> Model:
    """Frozen context trees of every language in ``texts`` and the cost table made from them."""
    languages = tuple(sorted({lang for lang, _ in texts}))
    data = {lang: [t.encode() for la, t in texts if la == lang] for lang in languages}
    seen = np.unique(np.concatenate([np.frombuffer(b"".join(v), np.uint8) for v in data.values()]))
    symbol = np.full(256, len(seen), np.int64)
    symbol[seen] = np.arange(len(seen))
    bytes_of = np.append(seen, next((b for b in range(256) if b not in set(seen.tolist())), 255)).astype(np.int64)
    width = len(bytes_of)
    counts = {(la, o): np.unique(np.concatenate([_grams(t, o) for t in data[la]]), return_counts=True)
              for la in languages for o in range(ORDER + 1)}
    known = np.unique(np.concatenate([(o << 24) | (counts[la, o][0] >> 8) for la in languages for o in range(ORDER + 1)]))
    order, ctx = known >> 24, known & 0xFFFFFF
    costs = np.empty((len(known) * width, len(languages)), np.uint16)
    for li, la in enumerate(languages):
        lower = np.full((1, width), 8.0)
        lower_ctx = np.zeros(1, np.int64)
        for o in range(ORDER + 1):
            here = np.flatnonzero(order == o)
            c = ctx[here]
            back = np.searchsorted(lower_ctx, c & ((1 << (8 * max(o - 1, 0))) - 1))
            cost = lower[np.minimum(back, len(lower_ctx) - 1)]
            grams, n = counts[la, o]
            row = np.searchsorted(c, grams >> 8)
            total = np.bincount(row, n, minlength=len(c))
            kinds = np.bincount(row, minlength=len(c))
            has = total > 0
            cost[has] += np.log2((total + kinds)[has] / kinds[has])[:, None]
            cost[row, symbol[grams & 0xFF]] = np.log2((total + kinds)[row] / n)
            costs.reshape(len(known), width, -1)[here, :, li] = np.minimum(np.rint(cost * UNIT), 65535)
            lower, lower_ctx = cost, c
    return Model(languages, symbol, known, costs)


@dataclass(frozen=True)
class Contexts:
    """Rows of a model's cost table by the last three bytes, each byte coded among those that any known context holds."""

    code: np.ndarray    # byte -> code; bytes in no known context share the last one
    width: int
    rows: np.ndarray    # row of the longest known suffix


def context_rows(model: Model) -> Contexts:
    """The lookup table of a task; its size is the cube of the number of different bytes in known contexts."""
    order, ctx = model.contexts >> 24, model.contexts & 0xFFFFFF
    used = np.zeros(256, bool)
    used[0] = True
    for o in (1, 2, 3):
        for i in range(o):
            used[(ctx[order == o] >> (8 * i)) & 0xFF] = True
    width = int(used.sum()) + 1
    code = np.where(used, np.cumsum(used) - 1, width - 1).astype(np.int64)
    rows = np.zeros(width ** 3, np.uint16 if len(model.contexts) < 1 << 16 else np.int32)
    for o in (1, 2, 3):
        at = np.flatnonzero(order == o)
        c = sum(code[(ctx[at] >> (8 * i)) & 0xFF] * width ** i for i in range(o))
        rows.reshape(-1, width ** o)[:, c] = at.astype(rows.dtype)
    return Contexts(code, width, rows)


def score_rows(model: Model, column: pa.Array, rows: Contexts | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: index of the language with the shortest code, its posterior, its bits per byte."""
    rows = context_rows(model) if rows is None else rows
    width = len(model.costs) // len(model.contexts)
    best, post, rate = [], [], []
    for p in pieces(column, 1 << 18):
        n = len(p.data)
        a = rows.code.astype(np.int32)[p.data]
        start = int(rows.code[0])
        ctx = np.full(n, start * (1 + rows.width + rows.width ** 2), np.int32)
        inside = np.arange(n, dtype=np.int64) - np.repeat(p.at[:-1], np.diff(p.at))
        for i in (1, 2, 3):
            if n > i:
                ctx[i:] += np.where(inside[i:] >= i, a[:-i] - start, 0) * np.int32(rows.width ** (i - 1))
        at = rows.rows[ctx].astype(np.int64) * width + model.symbol[p.data]
        total = np.zeros((n + 1, len(model.languages)), np.int64)
        np.cumsum(model.costs[at], axis=0, dtype=np.int64, out=total[1:])
        bits = (total[p.at[1:]] - total[p.at[:-1]]) / UNIT
        b = np.argmin(bits, axis=1)
        gap = bits - bits.min(axis=1, keepdims=True)
        best.append(b)
        post.append(1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1))
        rate.append(bits.min(axis=1) / np.maximum(np.diff(p.at), 1))
    empty = [np.zeros(0)]
    return np.concatenate(best or empty).astype(int), np.concatenate(post or empty), np.concatenate(rate or empty)


def predict(docs: DataFrame, model: Model | None, text: str = "text", carry: tuple[str, ...] = ("doc_id",),
            names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """Columns ``carry`` of every row with the language, its score (0 to 1) and bits per byte, called ``names``.

    ``carry`` may include the text, which is sent to Python once either way. A carried column called as one of
    ``names`` is an error; choose other names then. One pass over the table, without a shuffle.
    """
    if set(carry) & set(names):
        raise ValueError(f"columns {sorted(set(carry) & set(names))} are carried and made: give other names")
    spark: SparkSession = docs.sparkSession
    sent = [*carry] if text in carry else [*carry, text]
    at = sent.index(text)
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sent)])
    fields = ", ".join(f"c{i} {src.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry)))
    held = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        rows = context_rows(m) if m is not None else None
        for b in thin(batches):
            t = b.column(at)
            missing = np.array([n_letters_missing(x) for x in t.to_pylist()], bool)
            if m is None:
                best, post, rate = np.zeros(len(t), int), np.zeros(len(t)), np.zeros(len(t))
                missing[:] = True
                known = np.array([UNDETERMINED], object)
            else:
                best, post, rate = score_rows(m, t, rows)
                known = np.array(m.languages, object)
            lang = np.where(missing, UNDETERMINED, known[best]) if len(t) else known[:0]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(carry)], pa.array(list(lang), pa.string()), pa.array(np.where(missing, 0.0, post)),
                 pa.array(np.where(missing, 0.0, rate))],
                names=[*[f"c{i}" for i in range(len(carry))], "lang", "score", "rate"])

    out = src.mapInArrow(score, f"{fields}, lang string, score double, rate double")
    return out.toDF(*carry, *names)


def fitted(docs: DataFrame, keep: Column, **sample) -> Model | None:
    """The model trained on the bounded sample of ``docs`` where ``keep`` holds; None without any row."""
    texts = training_texts(docs, keep, **sample)
    return train(texts) if texts else None


def accepted(scored: DataFrame, lang: str = "lang_pred", rate: str = "bits_per_byte") -> DataFrame:
    """Rows in a known language: not ``und``, and coded in fewer bits than the bytes themselves have."""
    return scored.where((F.col(f"`{lang}`") != UNDETERMINED) & (F.col(f"`{rate}`") < 8))


def kept(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in a known language, in its columns, whatever they are called."""
    names = tuple(unused(docs, n) for n in ("lang_pred", "score", "bits_per_byte"))
    scored = predict(docs, model, text, tuple(docs.columns), names)
    return accepted(scored, names[0], names[2]).select(*[f"`{c}`" for c in docs.columns])


def held_out(key: str = "doc_id") -> Column:
    """Rows whose crc32 of the key as text leaves 2 when divided by 4; a NULL key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
