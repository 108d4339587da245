"""An inverted index of documents: posting blocks of words, character grams and metadata, in segments.

A segment is two Parquet tables. ``docs`` holds the documents in the order of
their ids, each with a number that rises with them; ``postings`` holds, for a
term and a run of 65,536 numbers, the sorted places of the documents in it.
Postings are sorted by term, so a search reads the row groups of its terms, and
their places are delta-coded by the format. A change set adds a segment and a
list of dead documents; segments are merged when there are many.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold, fold_text, query_tokens, words

#: Documents that one posting block can hold.
RUN = 1 << 16
#: Kinds of terms: a word; one to three characters in a row; a name of metadata with its value; a name that has one.
WORD, GRAM, PAIR, NAME = "w", "g", "p", "n"
#: Grams of a phrase, the rarest ones, that propose documents; the text decides.
PROBES = 3
#: Segments of an index beyond which a change set merges them.
SEGMENTS = 8
#: Characters of text whose grams are listed at once in a task (a longer text is a slice of its own).
SLICE = 1 << 20


def _grams(text: str) -> set[str]:
    """What a text of these characters surely holds: its grams of three, or the whole of a shorter one."""
    return {text[i : i + 3] for i in range(len(text) - 2)} if len(text) >= 3 else {text}


def _gram_blocks(docs: DataFrame) -> DataFrame:
    """(term, run, places): the grams of one to three characters of each folded text; several rows for a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
                yield from told(number[at:to], texts.slice(at, to - at).to_pylist())
                at = to

    def told(number: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        of = np.repeat(np.arange(len(texts)), np.diff(off))
        grams, owner = [], []
        code = np.zeros(len(codes), np.uint64)
        for k in range(3):
            # one character more to the right, within one text; 21 bits each, none is 0
            n = len(codes) - k
            if n <= 0:
                break
            code = code[:n] | codes[k:] << np.uint64(21 * k)
            inside = of[:n] == of[k:]
            grams.append(code[inside])
            owner.append(of[:n][inside])
        if not grams:
            return
        gram, place = np.concatenate(grams), number[np.concatenate(owner)]
        # one of each (gram, document), by gram
        order = np.lexsort((place, gram))
        gram, place = gram[order], place[order]
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (place[1:] != place[:-1])])
        gram, place = gram[new], place[new]
        run_ = place // RUN
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (run_[1:] != run_[:-1])]))
        spelled = gram[first]
        chars = np.stack([(spelled >> np.uint64(21 * k)) & np.uint64((1 << 21) - 1) for k in range(3)], 1)
        terms = ["".join(chr(int(c) - 1) for c in row if c) for row in chars]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(gram)]]), pa.int32()), pa.array((place % RUN).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(run_[first], pa.int64()), lists], names=["term", "run", "places"])

    return docs.select("number", fold("content").alias("text")).where("text is not null").mapInArrow(run, "term string, run long, places array<int>")


@dataclass(frozen=True)
class Segment:
    """One part of an index; ``dead`` names the table of numbers of documents that later parts changed, if any did."""

    path: str
    dead: str | None = None

    def docs(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/docs")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings")

    def alive(self, rows: DataFrame) -> DataFrame:
        return rows if self.dead is None else rows.join(rows.sparkSession.read.parquet(self.dead), "number", "left_anti")


def _segment(docs: DataFrame, folder: str) -> Segment:
    """Write the index of (document_id, content, metadata)."""
    spark, path = docs.sparkSession, f"{folder.rstrip('/')}/segment-{uuid.uuid4().hex}"
    ordered = docs.select("document_id", "content", "metadata").repartitionByRange("document_id").sortWithinPartitions("document_id")
    # the number's upper bits are the partition, which are ranges of ids: numbers rise with ids
    ordered.withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{path}/docs")
    stored = spark.read.parquet(f"{path}/docs")
    term = lambda kind, each, of: of.select(F.lit(kind).alias("kind"), each.alias("term"), F.expr(f"number div {RUN}").alias("run"), F.expr(f"cast(number % {RUN} as int)").alias("place"))
    pair = stored.select("number", F.explode("metadata").alias("key", "value")).where("value is not null")
    single = term(WORD, F.explode(words("content")), stored).unionByName(term(PAIR, F.concat_ws("\x1f", "key", "value"), pair)).unionByName(term(NAME, F.col("key"), pair))
    blocks = single.groupBy("kind", "term", "run").agg(F.collect_set("place").alias("places"))
    grams = _gram_blocks(stored).groupBy(F.lit(GRAM).alias("kind"), "term", "run").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    both = blocks.unionByName(grams).select("kind", "term", "run", F.size("places").alias("n"), F.array_sort("places").alias("places"))
    both.repartitionByRange("kind", "term", "run").sortWithinPartitions("kind", "term", "run").write.option("parquet.writer.version", "v2").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
    return Segment(path)


class Postings:
    """Segments that together index one version of a collection."""

    def __init__(self, spark: SparkSession, folder: str, segments: tuple[Segment, ...]):
        self.spark, self.folder, self.segments = spark, folder, segments

    @classmethod
    def build(cls, docs: DataFrame, folder: str) -> Postings:
        """Index (document_id, content, metadata): ids are not null and distinct; a null content has no words."""
        return cls(docs.sparkSession, folder, (_segment(docs, folder),))

    def docs(self) -> DataFrame:
        """All documents of the version."""
        each = [s.alive(s.docs(self.spark)).select("document_id", "content", "metadata") for s in self.segments]
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out

    def extended(self, changes: DataFrame) -> Postings:
        """The index after a change set (kind, document_id, content, metadata): what changed is a segment of its own, what it replaces is dead.

        Only the changes and the ids of the documents are read, unless there
        are so many segments that they are merged.
        """
        if len(self.segments) >= SEGMENTS:
            from .document import apply_changes

            return Postings.build(apply_changes(self.docs(), changes), self.folder)
        gone, parts = changes.where("kind <> 'add'").select("document_id"), []
        for s in self.segments:
            lost = s.alive(s.docs(self.spark).select("document_id", "number")).join(gone, "document_id", "left_semi").select("number")
            if s.dead is not None:
                lost = lost.unionByName(self.spark.read.parquet(s.dead))
            dead = f"{self.folder.rstrip('/')}/dead-{uuid.uuid4().hex}"
            lost.write.parquet(dead)
            parts.append(Segment(s.path, dead))
        return Postings(self.spark, self.folder, (*parts, _segment(changes.where("kind <> 'delete'"), self.folder)))

    def _hits(self, s: Segment, queries: list[tuple[str, dict]]) -> DataFrame:
        """(query, number, score) of a segment's documents that score, for several queries at once, from postings alone but for phrases to be confirmed."""
        spark, postings = self.spark, s.postings(self.spark)
        asked = [(q, t) for q, (text, _) in enumerate(queries) for t in query_tokens(text)]
        wanted = spark.createDataFrame(asked or [(-1, "")], "query int, term string")
        numbers = lambda rows, *more: rows.select(*more, F.explode(F.expr(f"transform(places, x -> run * {RUN} + x)")).alias("number"))
        found = lambda kind, terms: postings.where((F.col("kind") == kind) & F.col("term").isin(sorted(terms)))
        total = F.element_at(F.array(*[F.lit(float(max(1, len(query_tokens(t))))) for t, _ in queries]), F.col("query") + 1)
        words_ = numbers(found(WORD, {t for _, t in asked}).join(F.broadcast(wanted), "term"), "query")
        shares = words_.groupBy("query", "number").agg((F.count("*") / total).alias("share"))
        # phrases: the rarest of the grams that one surely holds propose documents
        phrases = [(q, fold_text(text)) for q, (text, _) in enumerate(queries)]
        grams = {g for _, p in phrases for g in _grams(p)}
        sizes = {r["term"]: r["n"] for r in found(GRAM, grams).groupBy("term").agg(F.sum("n").alias("n")).collect()}
        probes = [(q, g, min(PROBES, len(_grams(p)))) for q, p in phrases for g in sorted(_grams(p), key=lambda g: (sizes.get(g, 0), g))[:PROBES]]
        asked_grams = spark.createDataFrame(probes, "query int, term string, all int")
        held = numbers(found(GRAM, {g for _, g, _ in probes}).join(F.broadcast(asked_grams), "term"), "query", "all")
        may = held.groupBy("query", "number", "all").agg(F.count("*").alias("n")).where("n = all").select("query", "number")
        short = [q for q, p in phrases if len(p) <= 3]
        sure = may.where(F.col("query").isin(short))
        # documents with all words score as much as the phrase gives
        open_ = may.where(~F.col("query").isin(short)).join(shares.where("share = 1"), ["query", "number"], "left_anti")
        phrase = F.element_at(F.array(*[F.lit(p) for _, p in phrases]), F.col("query") + 1)
        confirmed = open_.join(s.docs(spark).select("number", "content"), "number").where(F.contains(fold("content"), phrase)).select("query", "number")
        whole = sure.unionByName(confirmed).withColumn("phrase", F.lit(1.0))
        scored = shares.join(whole, ["query", "number"], "full_outer").select("query", "number", F.round(F.greatest(F.coalesce("share", F.lit(0.0)), F.coalesce("phrase", F.lit(0.0))), 8).alias("score"))
        for q, (_, filters) in enumerate(queries):
            mine = F.col("query") == q
            for key, value in sorted((filters or {}).items()):
                kind, term = (NAME, key) if value is None else (PAIR, f"{key}\x1f{value}")
                has = numbers(found(kind, {term})).withColumn("has", F.lit(True))
                scored = scored.join(has, "number", "left").where(~mine | (F.col("has").isNull() if value is None else F.col("has"))).drop("has")
        return s.alive(scored)

    def search_many(self, queries: list[tuple[str, int, dict | None]]) -> DataFrame:
        """(query, document_id, content, metadata, score): for each (text, limit, filters) what scanning would give, in no order.

        Each segment hands on its best ``limit`` of each query by score and
        number, which rises with the id; the best of these are the result.
        """
        limit = F.element_at(F.array(*[F.lit(n) for _, n, _ in queries]), F.col("query") + 1)
        place = lambda by: F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), by))
        most = max(n for _, n, _ in queries)
        out = None
        for s in self.segments:
            best = self._hits(s, [(t, f or {}) for t, _, f in queries]).where("score > 0").withColumn("place", place("number")).where(F.col("place") <= most)
            told = s.docs(self.spark).join(best.drop("place"), "number").select("query", "document_id", "content", "metadata", "score")
            out = told if out is None else out.unionByName(told)
        return out.withColumn("place", place("document_id")).where((F.col("place") <= most) & (F.col("place") <= limit)).drop("place")

    def search(self, query: str, limit: int, filters: dict | None = None) -> DataFrame:
        """(document_id, content, metadata, score), best first, ties by id: the rows of ``search_frame`` over all documents. The query isn't blank."""
        return self.search_many([(query, limit, filters)]).drop("query").orderBy(F.desc("score"), "document_id")
