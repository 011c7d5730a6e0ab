"""Substring dedup with a log-structured fingerprint index.

A word is removed if a window of ``window`` words around it also starts earlier
(smaller id, or same document and earlier start).  The index is a list of
immutable runs.  Each run is a table of the fingerprints of one batch of
documents, bucketed and sorted by fingerprint:

* ``route`` is the least hash of the ``gram``-word strings of a window (all
  windows in a row that share it are one segment, ``place``),
* ``content`` is the hash of the segment's words.

``add`` sorts a new batch into a run and merge-joins it with each older run
(all are bucketed and sorted alike, so history is neither shuffled nor sorted
again).  Segments whose fingerprint an older run or an earlier document of the
batch has, and windows of segments of which only the route is known, are copies
by hash; each is then verified: the words at the place of the first copy are
fetched and compared with the document's own, and only equal ones are removed.
When there are more than ``max_runs`` runs, the next ``add`` first merges them
into one, which keeps the earliest place of each fingerprint.

The index lives in a folder: runs, packed texts and a manifest with a version
for each ``add``, so ``FingerprintIndex.open`` goes on where another session
stopped.  A batch's ids must be above those of the batches before.

Null id: after all others.  Null or empty text, or fewer words than a window:
nothing to remove.  Texts of any length are whole.  Rows that repeat an id are
told apart by text; rows that repeat both have one result each.  An empty table
gives no rows.  Other columns, of whatever name, are not read;
``without_repeats`` passes them on.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, free_names, in_slices, lean, materialise, own_folder, quoted, setting
from .repeats import DOC, MARKED, covered, cut, fetch, id_of, later_windows, marked, only, packed, rows_of, runs_of, tie_of, unpack, windows_of

#: Bytes of text for each bucket of the runs, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 50_000
KEPT = "id long, tie long, kept string, kept_words string, n_words long, removed array<struct<start: long, end: long>>"


def _by_bucket(spark: SparkSession):
    """Joins on (route, content) use the buckets of ``route`` and the order within them."""
    return setting(spark, spark__sql__requireAllClusterKeysForCoPartition="false", spark__sql__legacy__bucketedTableScan__outputOrdering="true")


def buckets_for(n_bytes: int) -> int:
    return min(max(1, math.ceil(n_bytes / BUCKET_BYTES)), MOST_BUCKETS)


class FingerprintIndex:
    """Sorted runs of window fingerprints of the documents seen so far."""

    def __init__(self, spark: SparkSession, state: dict):
        self.spark, self.state = spark, state

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, window: int = 20, gram: int = 5, n_buckets: int = 16, max_runs: int = 4) -> FingerprintIndex:
        """An empty index in a new folder (by default one in the shared folder)."""
        if not 0 < gram <= window:
            raise ValueError("gram must lie between 1 and window")
        path = path or f"{own_folder(spark)}/fingerprints-{uuid.uuid4().hex}"
        index = cls(spark, {"path": path, "window": window, "gram": gram, "n_buckets": n_buckets, "max_runs": max_runs, "runs": [], "texts": [], "last": None, "version": 0})
        index._save()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index as its newest manifest tells."""
        states = [json.loads(r["value"]) for r in spark.read.text(f"{path}/manifest/*").collect()]  # one row for each add
        return cls(spark, max(states, key=lambda s: s["version"]))

    def _save(self) -> None:
        self.state["version"] += 1
        line = self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1)
        line.write.text(f"{self.state['path']}/manifest/{self.state['version']:09d}")

    def _table(self, run: str) -> DataFrame:
        """A run as a bucketed table of this session's catalog."""
        name = f"fingerprints_{run}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({MARKED}) USING parquet CLUSTERED BY (route) SORTED BY (route, content) INTO {self.state['n_buckets']} BUCKETS LOCATION '{self.state['path']}/run-{run}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        run = uuid.uuid4().hex
        rows.write.bucketBy(self.state["n_buckets"], "route").sortBy("route", "content").option("compression", "zstd").option("path", f"{self.state['path']}/run-{run}").saveAsTable(f"fingerprints_{run}")
        return run

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS fingerprints_{run}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state['path']}/run-{run}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def drop_runs(self) -> None:
        """Deletes the runs of an index that gets no further batch."""
        runs, self.state["runs"] = self.state["runs"], []
        self._save()
        self._drop(runs)

    def compact(self) -> None:
        """Merges all runs into one; the earliest place of each fingerprint stays."""
        old = self.state["runs"]
        if len(old) < 2:
            return
        with _by_bucket(self.spark):
            merged = self._firsts(old[0]).select("route", "content", F.struct("id", "tie", "place").alias("first"))
            for run in old[1:]:  # older runs hold earlier documents
                later = self._firsts(run).select("route", "content", F.struct("id", "tie", "place").alias("later"))
                merged = merged.join(later, ["route", "content"], "full").select("route", "content", F.coalesce("first", "later").alias("first"))
            none = F.lit(0).cast("long")
            merged = merged.select("route", "content", "first.*", F.lit(False).alias("copy"), none.alias("first_id"), none.alias("first_tie"), none.alias("first_place"), F.lit(False).alias("open"))
            self.state["runs"] = [self._write(merged)]
        self._save()
        self._drop(old)

    def _firsts(self, run: str) -> DataFrame:
        return self._table(run).where("NOT copy")

    def add(self, rows: DataFrame, wanted: tuple = ("kept", "kept_words")) -> DataFrame:
        """Index a batch (from ``rows_of``); returns its documents without the words of later copies.

        Columns: see ``substring_dedup``; ``wanted`` names the texts to give, others are null.
        """
        state, window = self.state, self.state["window"]
        ends = rows.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
        if ends["low"] is not None and state["last"] is not None and ends["low"] <= state["last"]:
            raise ValueError("ids of a batch must be above those of the batches before")
        if len(state["runs"]) > state["max_runs"]:
            self.compact()
        texts = unique = self._store(packed(rows))
        if texts.groupBy("id", "tie").count().where("count > 1").limit(1).count():  # rows that repeat id and text are one document
            unique = self._store(texts.groupBy("id", "tie").agg(F.first("packed").alias("packed")))
        with setting(self.spark, spark__sql__execution__arrow__maxRecordsPerBatch="8192"):
            run = self._write(marked(cut(unique, "word", window, state["gram"]), state["n_buckets"]))
        known = self._known(run)
        spans = materialise(_merged(self._copies(run, known).unionByName(self._later(unique, known))), "spans", 8192)
        state["runs"].append(run)
        state["texts"].append(unique.shared_path)
        state["last"] = ends["high"] if ends["high"] is not None else state["last"]
        self._save()
        pieces = _pieces(self._texts(), spans, window)
        told = spans.join(pieces, ["of_id", "of_tie", "of_start", "n"]).groupBy("id", "tie").agg(F.collect_list(F.struct("start", "n", "piece")).alias("spans"))
        told = materialise(told, "told", 512)
        return texts.join(told, ["id", "tie"], "left").mapInPandas(lean(_keep(window, wanted)), KEPT)

    def _store(self, docs: DataFrame) -> DataFrame:
        path = f"{self.state['path']}/texts-{uuid.uuid4().hex}"
        with setting(self.spark, spark__sql__execution__arrow__maxRecordsPerBatch="2048"):
            docs.write.option("compression", "uncompressed").parquet(path)  # packed already
        out = self.spark.read.schema(DOC).parquet(path)
        out.shared_path = path
        return out

    def _texts(self) -> DataFrame:
        """The packed documents of all batches."""
        return self.spark.read.schema(DOC).parquet(*self.state["texts"])

    def _known(self, run: str) -> DataFrame:
        """The run's firsts that need a look: ``hit`` is the earliest place of the fingerprint in older runs."""
        with _by_bucket(self.spark):
            firsts = self._firsts(run).select("route", "content", F.struct("id", "tie", "place").alias("own"), "open")
            hits, check = [F.lit(None).cast("struct<id: long, tie: long, place: long>")], F.col("open")
            for k, name in enumerate(self.state["runs"]):
                old = self._firsts(name)
                firsts = firsts.join(old.select("route", "content", F.struct("id", "tie", "place").alias(f"hit{k}")), ["route", "content"], "left")
                firsts = firsts.join(old.groupBy("route").agg(F.lit(True).alias(f"known{k}")), "route", "left")
                hits.append(F.col(f"hit{k}"))
                check = check | F.coalesce(F.col(f"known{k}"), F.lit(False))
            found = firsts.select("route", "own.*", F.coalesce(*hits).alias("hit"), check.alias("check"))
            return materialise(found.where("hit IS NOT NULL OR check"), "known", 8192)

    def _copies(self, run: str, known: DataFrame) -> DataFrame:
        """Spans of segments that an earlier segment equals by hash."""
        whole = lambda c: F.shiftright(c, 32).cast("int")
        n = F.shiftright("place", 1).bitwiseAND(0x7FFFFFFF).cast("int").alias("n")
        own = ["id", "tie", whole("place").alias("start"), n]
        inside = self._table(run).where("copy").select(*own, F.col("first_id").alias("of_id"), F.col("first_tie").alias("of_tie"), whole("first_place").alias("of_start"))
        before = known.where("hit IS NOT NULL").select(*own, F.col("hit.id").alias("of_id"), F.col("hit.tie").alias("of_tie"), whole("hit.place").alias("of_start"))
        return inside.unionByName(before)

    def _later(self, docs: DataFrame, known: DataFrame) -> DataFrame:
        """Spans of single windows, of segments whose route alone is shared, that an earlier window equals by hash."""
        window, unsure = self.state["window"], known.where("hit IS NULL").select("route", "id", "tie", "place")
        found = windows_of(fetch(docs, unsure), "word", window)
        if self.state["runs"]:
            routes = materialise(unsure.select("route").distinct(), "routes", 8192)
            with _by_bucket(self.spark):
                older = [self._firsts(name).join(routes, "route", "left_semi").select("route", "id", "tie", "place") for name in self.state["runs"]]
                older = materialise(reduce(DataFrame.unionByName, older), "older", 8192)
            found = found.unionByName(windows_of(fetch(self._texts(), older), "word", window))
        later = later_windows(found)
        if self.state["last"] is not None:  # those of older documents were told when these came
            later = later.where(F.col("id") > self.state["last"])
        return later.select("id", "tie", "start", F.lit(1).alias("n"), F.col("first_id").alias("of_id"), F.col("first_tie").alias("of_tie"), F.col("first_start").alias("of_start"))


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of one document and one source that overlap or touch, in step, as one."""
    shift = F.col("of_start") - F.col("start")
    keys = ["id", "tie", "of_id", "of_tie", "shift"]
    w = Window.partitionBy(*keys).orderBy("start")
    before = F.max(F.col("start") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("shift", shift).withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    return ends.select("id", "tie", "start", (F.col("end") - F.col("start")).alias("n"), "of_id", "of_tie", (F.col("start") + F.col("shift")).alias("of_start"))


def _pieces(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """The words, joined by a space, of each source that spans name in these packed documents."""

    def each(pdf):
        for i, tie, z, wanted in zip(pdf["id"], pdf["tie"], pdf["packed"], pdf["wanted"], strict=True):
            words = unpack(z).split()
            for w in wanted:
                yield i, tie, w["of_start"], w["n"], b" ".join(words[w["of_start"] : w["of_start"] + w["n"] + window - 1])

    def run(frames):
        for pdf in frames:
            yield from in_slices(each(pdf), ["of_id", "of_tie", "of_start", "n", "piece"], lambda row: len(row[4]) + 100)

    sources = spans.select("of_id", "of_tie", "of_start", "n").distinct().groupBy(F.col("of_id").alias("id"), F.col("of_tie").alias("tie")).agg(F.collect_list(F.struct("of_start", "n")).alias("wanted"))
    sources = materialise(sources, "sources", 8192)
    return only(docs, sources).join(sources, ["id", "tie"]).mapInPandas(lean(run), "of_id long, of_tie long, of_start int, n int, piece binary")


def _keep(window: int, wanted: tuple):
    """What stays of each document: spans count whose words equal those of their source."""

    def one(raw: bytes, spans):
        words = raw.split()
        sound = [s for s in (spans if spans is not None else ()) if b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1]) == s["piece"]]
        mask = covered(sound, window, len(words))
        removed, stay = runs_of(mask), runs_of(~mask)
        kept = kept_words = None
        if "kept_words" in wanted:
            kept_words = b" ".join(b" ".join(words[a:b]) for a, b in stay).decode()
        if "kept" in wanted and not len(removed):
            kept = raw.decode()
        elif "kept" in wanted:
            ends, at = [], 0  # byte places of the words, for the white space between them
            for w in words:
                at = raw.index(w, at)
                ends.append((at, at + len(w)))
                at += len(w)
            kept = b" ".join(raw[ends[a][0] : ends[b - 1][1]] for a, b in stay).decode()
        return kept, kept_words, len(words), [{"start": int(a), "end": int(b)} for a, b in removed]

    def told(pdf):
        for i, tie, z, spans in zip(pdf["id"], pdf["tie"], pdf["packed"], pdf["spans"], strict=True):
            yield i, tie, *one(unpack(z), spans)

    def run(frames):
        for pdf in frames:
            yield from in_slices(told(pdf), ["id", "tie", "kept", "kept_words", "n_words", "removed"], lambda row: 100 + len(row[2] or "") + len(row[3] or ""))

    return run


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 5, n_batches: int = 3, max_runs: int = 1, wanted: tuple = ("kept", "kept_words"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the words of later copies, by an index fed in batches of ids.

    Returns per row: the id column, ``tie`` (see ``repeats.tie_of``), ``kept`` (the words that stay, each run with
    its own white space, runs joined by a space), ``kept_words`` (the same,
    joined by one space), ``n_words`` and ``removed``, an array of [start, end)
    word ranges.  With three batches and ``max_runs`` 1, the first two runs are
    compacted before the third batch comes.
    """
    spark = docs.sparkSession
    rows = rows_of(docs, id_col, text_col)
    known = F.when(F.col("id") != NO_ID, F.col("id"))
    cuts = F.percentile_approx(known, [k / n_batches for k in range(1, n_batches)] or [0.5], 1000)
    total = rows.agg(cuts.alias("cuts"), F.sum(F.octet_length("text")).alias("n_bytes")).first()
    bounds = [None, *(sorted(set(total["cuts"] or [])) if n_batches > 1 else []), None]
    index = FingerprintIndex.create(spark, window=window, gram=gram, n_buckets=buckets_for(total["n_bytes"] or 0), max_runs=max_runs)
    out = None
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        inside = (F.col("id") > low if low is not None else F.lit(True)) & (F.col("id") <= high if high is not None else F.lit(True))
        kept = index.add(rows.where(inside), wanted)
        out = kept if out is None else out.unionByName(kept)
    index.drop_runs()
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "tie", "kept", "kept_words", "n_words", "removed")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with what stays of each text; rows of which no word stays are dropped.

    Columns of any name pass through; a null text stays null.
    """
    ident, tie, is_null, kept_text = free_names(docs, "row_id", "row_tie", "no_text", "kept_text")
    kept = substring_dedup(docs, id_col=id_col, text_col=text_col, wanted=("kept",), **options)
    gone = (F.col("n_words") > 0) & (F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]) == F.col("n_words"))
    kept = kept.where(~gone).select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias(ident), F.col("tie").alias(tie), F.col("kept").alias(kept_text)).dropDuplicates([ident, tie])
    rest = quoted(*(c for c in docs.columns if c != text_col))
    keyed = docs.select(*rest, id_of(id_col).alias(ident), tie_of(docs, id_col, text_col).alias(tie), F.col(*quoted(text_col)).isNull().alias(is_null))
    text = F.when(~F.col(is_null), F.col(kept_text)).alias(text_col)
    return keyed.join(kept, [ident, tie]).select(*[text if c == text_col else q for c, q in zip(docs.columns, quoted(*docs.columns), strict=True)])
