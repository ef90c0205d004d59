"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, fold_ascii, forget, park, scratch

#: Batches in which lines are taken in, and the number of runs of a level that are merged into one of the next.
BATCHES = 4
FAN_IN = 3
#: Ids from which the bounds of the batches are taken, at most.
CUT_SAMPLE = 1_024


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return fold_ascii(F.btrim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levels of sorted runs. A run has one row for each line hash: h, n (documents that hold it), last (largest id).

    Batches must come in falling order of ids. Then `last` of a hash is known from the first batch that holds it, and a
    hash that has been counted `min_docs` times is settled: the next batches drop it by merge anti-joins with the runs
    before they add their own, so a line in a third of all documents adds a few rows to the runs and no more. Counts go on
    from run to run, so the newest run that has a hash knows its whole count, and a settled hash is settled in one run only.

    Runs are tables bucketed and sorted by h, in as many buckets as the session has shuffle partitions. A batch is counted
    by one exchange, whose partitions match the buckets; neither its joins nor a compaction exchange any run. A compaction
    keeps the newest row of each hash.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 3, fan_in: int = FAN_IN):
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[DataFrame]:
        """All runs, the newest first."""
        return [self.spark.table(run) for level in self.levels for run in reversed(level)]

    def _add(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        path = scratch(self.spark, f"lines-l{level}")
        name = "tessella_" + path.rpartition("/")[2].replace("-", "_")
        run.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan_in:  # compaction
            old, self.levels[level] = self.levels[level], []
            runs = [self.spark.table(t) for t in reversed(old)]
            merged = runs[0]
            for k, run in enumerate(runs[1:], 1):
                for newer in runs[:k]:
                    run = run.join(newer.select("h").hint("merge"), "h", "left_anti")
                merged = merged.unionByName(run)
            self._add(level + 1, merged)
            self._drop(old)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            forget(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        """Deletes all runs."""
        self._drop([run for level in self.levels for run in level])
        self.levels = [[]]

    def counted(self, batch: DataFrame) -> DataFrame:
        """The run that a batch of (h, doc_id) makes: its hashes that aren't settled, with their counts so far."""
        own = batch.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        runs = self.runs()
        for run in runs:
            own = own.join(run.filter(F.col("n") >= self.min_docs).select("h").hint("merge"), "h", "left_anti")
        own = own.withColumn("before", F.lit(0).cast("bigint"))
        for run in runs:
            known = run.filter(F.col("n") < self.min_docs).select("h", F.col("n").alias("n_known"), F.col("last").alias("last_known"))
            own = own.join(known.hint("merge"), "h", "left")
            own = own.select("h", "n", F.greatest("last", "last_known").alias("last"), F.greatest("before", "n_known").alias("before"))
        return own.select("h", (F.col("n") + F.col("before")).alias("n"), "last")

    def add(self, batch: DataFrame) -> None:
        """Takes in a batch of (h, doc_id), one row for each document and hash."""
        self._add(0, self.counted(batch))

    def settled(self) -> DataFrame:
        """Hashes that at least min_docs documents hold, with the largest id among these."""
        out = None
        for run in self.runs():
            own = run.filter(F.col("n") >= self.min_docs).select("h", "last")
            out = own if out is None else out.unionByName(own)
        return out


def _falling_batches(lines: DataFrame, batches: int) -> list[Column]:
    """Conditions that split ids of any type that has an order into ranges of about equal size, the largest ids first; null ids are in the last.

    The cuts come from CUT_SAMPLE ids at most, chosen by a hash; where they are only tells how even the batches are.
    """
    cuts = []
    if batches > 1:
        some = lines.filter("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id")).limit(CUT_SAMPLE)
        ids = [r["doc_id"] for r in some.orderBy("doc_id").collect()]
        cuts = sorted({ids[len(ids) * i // batches] for i in range(1, batches)}, reverse=True) if ids else []
    doc = F.col("doc_id")
    bounds = [None, *cuts, None]
    out = []
    for high, low in zip(bounds, bounds[1:]):
        below = doc <= F.lit(high) if high is not None else F.lit(True)
        out.append(below & (doc > F.lit(low)) if low is not None else (below | doc.isNull()))
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES) -> DataFrame:
    """Drops lines whose key is in at least min_docs documents, except in the document of the largest doc_id.

    Keys are compared by their 128-bit MD5; keys of fewer than min_chars code points stay. Returns docs with text replaced
    by its other lines, n_lines (before dropping) and n_dropped; columns of these names are replaced, others stay.

    A row is a document: rows with equal doc_id each count, and all rows of the largest doc_id keep the line. A null doc_id
    counts as the smallest; where all holders have none, all keep the line. Null and empty texts are one empty line, so
    text is never null in the result. An empty table gives no rows. Ids may have any type that has an order. Texts of any
    length are taken whole, as one array of lines.

    Texts are read twice: once for the hashes of their lines, once to rebuild them. A line in very many documents is
    counted map-side; the join that finds lines to drop moves hashes only, and adaptive execution splits its hot keys.
    """
    trimmed = F.transform(lines_of(F.col("text")), lambda x: F.when(F.length(x) >= min_chars, F.btrim(x, F.lit(SPACE))))
    hashes = F.transform(trimmed, lambda x: F.when(F.length(x) >= min_chars, F.md5(F.encode(fold_ascii(x), "UTF-8"))))
    ident = F.xxhash64("text").alias("text_hash")
    hashed = park(docs.select("doc_id", ident, hashes.alias("hs")).filter(F.exists("hs", lambda h: h.isNotNull())), "lines")

    runs = LineRuns(docs.sparkSession, min_docs)
    for condition in _falling_batches(hashed, batches):
        once = hashed.filter(condition).select("doc_id", F.explode(F.array_distinct("hs")).alias("h")).filter("h IS NOT NULL")
        runs.add(once)

    settled = park(runs.settled(), "lines-settled")  # a table, so that the join may split a hot line
    runs.close()
    held = hashed.select("doc_id", "text_hash", F.posexplode("hs").alias("pos", "h")).filter("h IS NOT NULL")
    dropped = (
        held.join(settled.hint("merge"), "h")
        .filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy(F.col("doc_id").alias("dropped_id"), F.col("text_hash").alias("dropped_hash"))
        .agg(F.collect_set("pos").alias("dropped_at"))
    )
    # The lines are split before the join, so that they are there as an array when lines are taken by position. Own columns travel in a struct, whatever their names are.
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*kept).alias("own"), F.col("doc_id").alias("own_id"), ident.alias("own_hash"), lines_of(F.col("text")).alias("own_lines"))
    rows = rows.join(dropped, F.col("own_id").eqNullSafe(F.col("dropped_id")) & (F.col("own_hash") == F.col("dropped_hash")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("own_lines") - 1), F.col("dropped_at"))
    text = F.when(F.col("dropped_at").isNull(), F.array_join("own_lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("own_lines", i)), "\n"))
    return rows.select(
        *[text.alias("text") if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size("own_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("dropped_at"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
