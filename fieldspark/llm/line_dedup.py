"""Removal of boilerplate lines by the number of distinct sites they are spread over.

Texts are split and hashed once, and the lines' hashes written.  Lines are counted by
hash, combined map-side; a line seen fewer times than ``min_sites`` cannot reach that
many sites.  The others get a HyperLogLog sketch of their sites, again a merging
aggregate.  Where the estimate lies within ``band`` of the threshold the sites are
counted exactly.  Lines on ``min_sites`` sites or more are removed from every document
but the first that has them (or from all).

A line that fills more than its share of a partition is dealt over as many slots as it
fills shares, in every join that has it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import ROW, dealt_join, discard, row_key, share_of, struct_of, written

#: The white space that is stripped from the ends of a line.
BLANKS = " \t\r\x0b\x0c"


@dataclass(frozen=True)
class LineParams:
    """Least distinct sites of a boilerplate line, sketch size (lgK), relative half-width of the exact band, first copy kept or not."""

    min_sites: int = 10
    lg_k: int = 12
    band: float = 0.25
    keep_first: bool = True


def _lines(docs: DataFrame) -> DataFrame:
    """(hashes of the row, ord, site, pos, h1, h2) of every line that is not blank."""
    exploded = docs.select(*ROW, "ord", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANKS))
    return exploded.withColumn("key", key).where("key <> ''").select(*ROW, "ord", "site", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


def boilerplate_places(docs: DataFrame, p: LineParams) -> DataFrame:
    """(hashes of the row, pos) of every line to remove."""
    lines = written(_lines(docs), "op6")
    share = share_of(docs.sparkSession, lines.count())
    count = lines.groupBy("h1", "h2").agg(F.count("*").alias("rows"), F.count("site").alias("sited"), F.min(F.struct("ord", "pos", *ROW)).alias("first"))
    often = written(count.where(F.col("sited") >= p.min_sites).drop("sited"), "op6")
    seen = written(dealt_join(lines, often, ["h1", "h2"], F.xxhash64(*ROW, "pos"), share), "op6")
    # one row per line and site first: copies on a hot site never meet in one place
    spread = written(seen.where("site is not null").groupBy("h1", "h2", "site").agg(F.first("rows").alias("rows")), "op6")
    sketch = spread.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(p.lg_k))).alias("sites"), F.first("rows").alias("rows"))
    sure = sketch.where(F.col("sites") > p.min_sites * (1 + p.band)).select("h1", "h2", "rows")
    near = sketch.where(F.col("sites").between(p.min_sites * (1 - p.band), p.min_sites * (1 + p.band))).select("h1", "h2")
    exact = spread.join(near, ["h1", "h2"]).groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"), F.first("rows").alias("rows"))
    bad = written(sure.unionByName(exact.where(F.col("sites") >= p.min_sites).select("h1", "h2", "rows")), "op6")
    found = dealt_join(seen.drop("rows"), bad, ["h1", "h2"], F.xxhash64(*ROW, "pos"), share)
    if p.keep_first:
        found = found.where(F.struct("ord", "pos", *ROW) != F.col("first"))
    found = written(found.select(*ROW, "pos"), "op6")
    discard(lines, often, seen, spread, bad)
    return found


def remove_boilerplate(docs: DataFrame, params: LineParams | None = None, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` without boilerplate lines in ``text``, and the long columns ``n_lines`` and ``n_removed_lines``.

    Lines are compared without blanks at their ends; blank lines are never removed.  A null text stays null (no lines);
    an empty one is one blank line.  A line's null sites count for nothing.  Copies inside one document count as one
    site; with ``keep_first`` the very first copy (least id, null ids before all, then position) stays.  Rows that repeat
    an id and a text are treated alike.  Other columns stay as they are, whatever their names, but for columns named
    ``n_lines`` or ``n_removed_lines``, which these replace; an empty table gives an empty result.
    """
    p = params or LineParams()
    narrow = docs.select(*row_key(id_col, text_col), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("ord"), F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("text"))
    drop = boilerplate_places(narrow, p).groupBy(*ROW).agg(F.collect_set("pos").alias("_drop"))
    keyed = docs.select(struct_of(docs), *row_key(id_col, text_col)).join(drop.hint("shuffle_hash"), list(ROW), "left").select("_row", "_drop")
    text = F.col(f"_row.`{text_col}`")
    split = F.split(text, "\n")
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains(F.col("_drop"), i)), "\n")
    removed = F.coalesce(F.size("_drop"), F.lit(0)).cast("long")
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    return keyed.select(
        *[(F.when(F.col("_drop").isNull(), text).otherwise(kept) if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in own],
        F.coalesce(F.size(split).cast("long"), F.lit(0).cast("long")).alias("n_lines"),
        removed.alias("n_removed_lines"),
    )
