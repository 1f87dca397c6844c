"""Weight matrices and motif scanning over (region_id, seq) tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.functions.sequence import BACKGROUND
from regulus.plans.tiling import depth_segments
from regulus.session import cut, lookup_join
from regulus.sources.genome import with_halo

_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _b in enumerate(b"ACGT"):
    # soft-masked (lower-case) bases count like others
    _CODE[_b] = _CODE[_b + 32] = _i
# a partition's sequences are scanned in stretches of about this many bases
STRETCH = 4_000_000


@dataclass(frozen=True)
class Motif:
    """Log-odds weights (4 x length) with the least and greatest attainable score."""

    name: str
    weights: np.ndarray

    @property
    def length(self) -> int:
        return self.weights.shape[1]

    @property
    def low(self) -> float:
        return float(self.weights.min(axis=0).sum())

    @property
    def high(self) -> float:
        return float(self.weights.max(axis=0).sum())


def motif_from_counts(name: str, counts: Sequence[Sequence[float]]) -> Motif:
    """Counts (rows A, C, G, T) + 0.25, normalised per position, log2 against the background."""
    c = np.asarray(counts, float) + 0.25
    background = np.array(list(BACKGROUND.values()))[:, None]
    return Motif(name, np.log2(c / c.sum(axis=0) / background))


def motif_from_word(name: str, word: str, major: float = 17.0, minor: float = 1.0) -> Motif:
    return motif_from_counts(name, [[major if b == base else minor for b in word] for base in "ACGT"])


def weights_from_counts(counts: DataFrame) -> DataFrame:
    """Long (motif, pos, base, n) to (motif, pos, base, w); the table form of ``motif_from_counts``."""
    col = counts.groupBy("motif", "pos").agg(F.sum(F.col("n") + 0.25).alias("_total"))
    bg = F.create_map(*[F.lit(x) for kv in BACKGROUND.items() for x in kv])
    return (counts.join(col, ["motif", "pos"])
            .select("motif", "pos", "base", F.log2((F.col("n") + 0.25) / F.col("_total") / F.element_at(bg, F.col("base"))).alias("w")))


def _stretches(pdf: pd.DataFrame, pad: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, codes): sequences laid end to end with ``pad`` unusable letters between them."""
    seqs = pdf["seq"].fillna("").to_numpy()
    size = np.fromiter((len(s) for s in seqs), dtype=np.int64, count=len(seqs))
    group = np.cumsum(size) // STRETCH
    for g in np.unique(group):
        pick = np.flatnonzero(group == g)
        text = ("N" * pad).join(seqs[i] for i in pick) + "N" * pad
        starts = np.concatenate([[0], np.cumsum(size[pick] + pad)[:-1]])
        yield pick, starts, _CODE[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)]


def _relative(codes: np.ndarray, m: Motif, reverse: bool) -> np.ndarray:
    """Relative score of every window; -1 where it holds an unknown base. A reverse-strand window
    is scored in place with the reverse-complemented weights, so starts are on the forward strand."""
    w = m.weights[::-1, ::-1] if reverse else m.weights
    table = np.vstack([w, np.full(m.length, np.nan)])
    n = len(codes) - m.length + 1
    score = np.zeros(max(n, 0))
    for j in range(m.length):
        score += table[codes[j:j + n], j]
    rel = (score - m.low) / (m.high - m.low)
    return np.where(np.isnan(rel), -1.0, rel)


def scan_hits(seqs: DataFrame, ident: str | Sequence[str], motifs: Sequence[Motif], cutoff: float) -> DataFrame:
    """Every window on either strand with relative score >= cutoff; ``ident`` names the columns that go along."""
    pad = max(m.length for m in motifs)
    keys = [ident] if isinstance(ident, str) else list(ident)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for rows, starts, codes in _stretches(pdf, pad):
                for m in motifs:
                    for strand, rev in (("+", False), ("-", True)):
                        rel = _relative(codes, m, rev)
                        at = np.flatnonzero(rel >= cutoff)
                        owner = np.searchsorted(starts, at, side="right") - 1
                        out = pdf[keys].iloc[rows[owner]].reset_index(drop=True)
                        yield out.assign(motif=m.name, start=at - starts[owner], strand=strand, rel=rel[at])

    ddl = ", ".join(f"`{k}` {seqs.schema[k].dataType.simpleString()}" for k in keys)
    return seqs.select(*keys, "seq").where("seq is not null").mapInPandas(
        scan, f"{ddl}, motif string, start long, strand string, rel double")


def scan_chunks(chunks: DataFrame, keys: Sequence[str], chunk: int, motifs: Sequence[Motif], cutoff: float) -> DataFrame:
    """Sites of contigs stored in chunks (``keys``, chunk_id, seq) of ``chunk`` bases: keys, motif, start, strand, rel.

    ``start`` counts from the contig's first base. A site belongs to the chunk that holds its first base; the bases it
    needs beyond that come from the chunks after it as a halo of (longest motif - 1) bases, so a site across borders
    is found once. Missing chunks, NULL sequences and the rest of a short chunk are unknown bases. NULL keys are
    contigs of their own; (keys, chunk_id) is unique.
    """
    keys = list(keys)
    parts = with_halo(chunks, keys, chunk, max(m.length for m in motifs) - 1)
    hits = scan_hits(parts, [*keys, "chunk_id"], motifs, cutoff).where(F.col("start") < chunk)
    return hits.select(*keys, "motif", (F.col("chunk_id") * chunk + F.col("start")).cast("long").alias("start"), "strand", "rel")


def scan_best(seqs: DataFrame, ident: str, motifs: Sequence[Motif], cutoffs: Sequence[float]) -> DataFrame:
    """Per region and motif: best score over both strands, its first position, counts per cutoff.

    The better strand counts at each position, so a palindromic site is one site. A region without a
    usable window (also one with NULL or empty sequence) has NULL score and zero counts.
    """
    pad = max(m.length for m in motifs)
    names = [f"n_{int(round(c * 100))}" for c in cutoffs]

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for rows, starts, codes in _stretches(pdf, pad):
                for m in motifs:
                    fwd, rev = _relative(codes, m, False), _relative(codes, m, True)
                    both = np.maximum(fwd, rev)
                    # every sequence, an empty one too, begins at least one window of its own: that of the letters after it
                    best = np.maximum.reduceat(both, starts)
                    owner = np.searchsorted(starts, np.arange(len(both)), side="right") - 1
                    where = np.flatnonzero(both == best[owner])
                    _, first = np.unique(owner[where], return_index=True)
                    out = pd.DataFrame({ident: pdf[ident].to_numpy()[rows], "motif": m.name, "best_rel": np.where(best >= 0, best, np.nan),
                                        "best_pos": pd.array(where[first] - starts, dtype="Int64")})
                    out.loc[best < 0, ["best_rel", "best_pos"]] = None
                    for c, name in zip(cutoffs, names):
                        out[name] = np.add.reduceat((both >= c).astype(np.int64), starts)
                    yield out

    kind = seqs.schema[ident].dataType.simpleString()
    ddl = f"{ident} {kind}, motif string, best_rel double, best_pos long, " + ", ".join(f"{n} long" for n in names)
    return seqs.select(ident, "seq").mapInPandas(scan, ddl)


def hit_rates(hits: DataFrame, regions: DataFrame, ident: str, motifs: Sequence[str],
              cutoffs: Sequence[float]) -> DataFrame:
    """Per motif and cutoff: regions with a hit, their fraction and the mean hits over all regions.

    A position counts once, with its better strand.
    """
    sites = hits.groupBy(ident, "motif", "start").agg(F.max("rel").alias("rel"))
    per = (sites.withColumn("cutoff", F.explode(F.filter(F.array(*[F.lit(float(c)) for c in cutoffs]), lambda c: F.col("rel") >= c)))
           .groupBy("motif", "cutoff").agg(F.count_distinct(ident).alias("n_regions"), F.count(F.lit(1)).alias("n_hits")))
    total = regions.agg(F.count(F.lit(1)).alias("total"))
    grid = total.select("total", F.explode(F.array(*[F.lit(m) for m in motifs])).alias("motif")).select(
        "total", "motif", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])).alias("cutoff"))
    j = grid.join(per, ["motif", "cutoff"], "left").fillna(0, ["n_regions", "n_hits"])
    return j.select("motif", "cutoff", "n_regions", (F.col("n_regions") / F.col("total")).alias("fraction"),
                    (F.col("n_hits") / F.col("total")).alias("mean_hits"))


def free_runs(sites: DataFrame, regions: DataFrame, keys: Sequence[str], start: str, end: str, size: str, length: int) -> DataFrame:
    """Runs [free_start, free_end) of positions p in [0, size - length) at which ``length`` bases touch no site [start, end).

    A site bars the positions from start - length + 1 to end - 1; barred stretches are merged by a depth sweep and
    the runs are the gaps between them, so the cost is that of the sites, however long a region is. ``regions`` has
    one row per ``keys``; regions without a size or too short have no run. NULL keys are keys of their own.
    """
    keys = list(keys)
    limit = F.col(size).cast("long") - length
    open_ = regions.select(*keys, limit.alias("_limit")).where(F.col("_limit") > 0)
    barred = lookup_join(sites.select(*keys, start, end).where(F.col(start) < F.col(end)), open_, keys, "inner").select(
        *keys, F.greatest(F.col(start).cast("long") - length + 1, F.lit(0).cast("long")).alias("s"), F.least(F.col(end).cast("long"), F.col("_limit")).alias("e"))
    merged = cut(depth_segments(barred, keys, "s", "e", touching=True))
    last = merged.groupBy(*keys).agg(F.max("seg").alias("_n"))
    # gap k runs from the end of stretch k to the start of stretch k + 1; gap 0 starts at 0 and the last one ends at the limit
    none = F.lit(None).cast("long")
    ends = lookup_join(open_, last, keys)
    parts = [open_.select(*keys, F.lit(0).cast("long").alias("seg"), F.lit(0).cast("long").alias("s"), none.alias("e")),
             ends.select(*keys, F.coalesce("_n", F.lit(0)).cast("long").alias("seg"), none.alias("s"), F.col("_limit").alias("e")),
             merged.select(*keys, "seg", F.col("end").alias("s"), none.alias("e")),
             merged.select(*keys, (F.col("seg") - 1).alias("seg"), none.alias("s"), F.col("start").alias("e"))]
    gaps = reduce(DataFrame.unionByName, parts).groupBy(*keys, "seg").agg(F.max("s").alias("free_start"), F.max("e").alias("free_end"))
    return gaps.where("free_start < free_end").drop("seg")


def nearest_free(runs: DataFrame, keys: Sequence[str], centre: float) -> DataFrame:
    """The free position nearest to ``centre`` per ``keys``; the lower one of two equally near."""
    def held(x: int) -> Column:
        return F.greatest(F.col("free_start"), F.least(F.col("free_end") - 1, F.lit(x).cast("long")))

    best = F.least(*[F.struct(F.abs(held(x) - centre).alias("d"), held(x).alias("p")) for x in (math.floor(centre), math.ceil(centre))])
    return runs.groupBy(*keys).agg(F.min(best).alias("_b")).select(*keys, F.col("_b.p").alias("position"))
