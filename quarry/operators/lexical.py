"""BM25 and keyword search.

An inverted index is three tables: ``postings`` (term, chunk_id, acl_class, tf, dl), ``frequency``
(term, acl_class, df) and ``lengths`` (acl_class, chunks, tokens). Statistics are kept per access
class, so N, average length and document frequency of the corpus one caller can see are sums over
that caller's classes; no (caller, chunk) pairs are needed to get them.

A kept index (``write_index``, ``append_index``, ``read_index``) is read by the buckets of a batch's
terms. It grows by segments: postings of the chunks that are new, and the state of the chunks that are
new, gone or opened to others. Reading takes each chunk's newest state, and ``current`` that of the
chunks as they are now, with the postings of those that no segment has. Frequencies and lengths are
counted from what is left, so a search over a kept index gives what one over the chunks gives.

Without an index the chunks are scored where they are: a chunk's counts are complete in its row, so
the weights of a block of queries go to the tasks, and k rows per query and task are all that is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions.text import keyword_terms, snippet, tokenize
from quarry.operators.access import (class_tokens, opened_classes, permission_signature, principal_tokens,
                                     visible_classes, with_acl_class)
from quarry.operators.blocks import CELLS_PER_STEP, QUERY_BLOCK, Best, by_blocks
from quarry.operators.skew import SALTS, topk
from quarry.session import bounded, cut

VISIBLE, GLOBAL = "visible", "global"


#: Term buckets of a kept index at most, and postings that one file of it holds.
INDEX_BUCKETS, FILE_POSTINGS = 256, 1 << 20


@dataclass(frozen=True)
class InvertedIndex:
    """``buckets`` is the number of term buckets of a kept index, 0 for one that is not stored. A kept
    index has ``state`` (chunk_id, home: the segment of its postings, acl_class, dl) in place of
    frequencies and lengths."""

    postings: DataFrame
    frequency: DataFrame | None = None
    lengths: DataFrame | None = None
    buckets: int = 0
    state: DataFrame | None = None

    def of_terms(self, terms: DataFrame) -> InvertedIndex:
        """The part of a kept index that holds ``terms`` (a column, term). The driver sees bucket
        numbers only, at most ``buckets`` of them."""
        if not self.buckets:
            return self
        numbers = terms.select(_bucket(self.buckets).alias("bucket")).distinct().collect()
        mine = F.col("bucket").isin([r["bucket"] for r in numbers])
        return replace(self, postings=self.postings.filter(mine).drop("bucket"))

    def merged(self, terms: DataFrame) -> InvertedIndex:
        """Postings of ``terms`` under the chunks' state, and the statistics that follow from them."""
        if self.state is None:
            return self
        asked = self.postings.drop("acl_class").join(terms.select("term").distinct(), "term", "left_semi")
        postings = asked.join(self.state.select("chunk_id", "home", "acl_class"), ["chunk_id", "home"])
        lengths = self.state.groupBy("acl_class").agg(
            F.count(F.lit(1)).alias("chunks"), F.sum("dl").cast("long").alias("tokens"))
        postings = postings.select("term", "chunk_id", "acl_class", "tf", "dl")
        return InvertedIndex(postings, _frequency(postings, "term", "acl_class"), lengths)

    def current(self, chunks: DataFrame) -> InvertedIndex:
        """The index of ``chunks`` as they are: those that are gone leave it, access classes are
        today's, and chunks that no segment has are counted now. A chunk id stands for its text, as
        ``with_chunk_identity`` makes it."""
        if self.state is None:
            return self
        now = _classed(chunks).withColumn("chunk_id", F.col("chunk_id").cast("string"))
        known = now.select("chunk_id", "acl_class").join(self.state.select("chunk_id", "home", "dl"), "chunk_id")
        counted = _counted(now.join(self.state.select("chunk_id"), "chunk_id", "left_anti"))
        counted = cut(counted, "unindexed").withColumn("home", F.lit(_UNSTORED))
        fresh = counted.filter("term <> ''").withColumn("bucket", _bucket(self.buckets))
        state = known.unionByName(counted.filter("term = ''").select("chunk_id", "acl_class", "home", "dl"))
        return replace(self, postings=self.postings.unionByName(fresh), state=state)


#: In place of a segment number.
_UNSTORED = -1


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _classed(chunks: DataFrame) -> DataFrame:
    if "acl_class" in chunks.columns:
        return chunks
    return (with_acl_class(chunks) if "visibility" in chunks.columns
            else chunks.withColumn("acl_class", F.lit("*")))


def _counted(chunks: DataFrame) -> DataFrame:
    """Postings of the chunks, and a row with an empty term for each chunk."""
    tokens = _classed(chunks).select(F.col("chunk_id").cast("string").alias("chunk_id"), "acl_class",
                                     tokenize("content").alias("__tokens"))
    return bounded(tokens).mapInArrow(_count_terms, _POSTINGS)


def build_inverted_index(chunks: DataFrame, stored: bool = False) -> InvertedIndex:
    """Index of chunk_id, content and, when present, the access columns.

    ``stored`` writes the counts to the work folder, so that the text is read only once for all
    tables.
    """
    counted = _counted(chunks)
    if stored:
        counted = cut(counted, "postings")
    lengths = counted.filter("term = ''").groupBy("acl_class").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("dl").cast("long").alias("tokens"))
    postings = counted.filter("term <> ''")
    return InvertedIndex(postings, _frequency(postings, "term", "acl_class"), lengths)


def write_index(chunks: DataFrame, path: str, buckets: int | None = None) -> None:
    """Keep the index of ``chunks`` below ``path``, which must be new: postings in one folder per
    segment and term bucket, sorted by term. The number of buckets follows that of the postings."""
    counted = cut(_counted(chunks), "postings")
    if buckets is None:
        buckets = min(INDEX_BUCKETS, max(8, counted.count() // FILE_POSTINGS))
    chunks.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/meta")
    _write_segment(counted, None, path, 0, buckets)


def append_index(chunks: DataFrame, path: str) -> None:
    """Bring a kept index up to ``chunks`` by one more segment: postings of new chunks, tombstones of
    those that are gone, and the access classes of those whose class changed. If it fails it can be
    called again; readers see a segment when its state is there, which is written last."""
    spark = chunks.sparkSession
    index, segments = read_index(spark, path), _states(spark, path)
    number = segments.agg(F.coalesce(F.max("segment"), F.lit(-1))).first()[0] + 1
    now = _classed(chunks).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    counted = cut(_counted(now.join(index.state.select("chunk_id"), "chunk_id", "left_anti")), "postings")
    classes = now.select("chunk_id", F.col("acl_class").alias("__class"), F.lit(True).alias("__here"))
    changed = (index.state.join(classes, "chunk_id", "left")
               .filter(F.col("__here").isNull() | ~F.col("acl_class").eqNullSafe(F.col("__class")))
               .select("chunk_id", F.col("__here").isNotNull().alias("alive"), "home",
                       F.col("__class").alias("acl_class"), "dl"))
    _write_segment(counted, cut(changed, "changed"), path, number, index.buckets)


def _write_segment(counted: DataFrame, changed: DataFrame | None, path: str, number: int, buckets: int) -> None:
    """A very common term is in a large part of all chunks, so the postings of a bucket are dealt out
    by chunk, to as many files as its measured size asks for."""
    postings = counted.filter("term <> ''").withColumn("bucket", _bucket(buckets)).withColumn("home", F.lit(number))
    files = [1] * buckets
    for r in postings.groupBy("bucket").count().collect():  # at most one row a bucket
        files[r["bucket"]] = 1 + r["count"] // FILE_POSTINGS
    deal = F.pmod(F.xxhash64("chunk_id"), F.get(F.array(*map(F.lit, files)), F.col("bucket")))
    (postings.repartition(sum(files), "bucket", deal).sortWithinPartitions("bucket", "term")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/segment={number}"))
    state = counted.filter("term = ''").select(
        "chunk_id", F.lit(True).alias("alive"), F.lit(number).alias("home"), "acl_class", "dl")
    state = state if changed is None else state.unionByName(changed)
    state.write.mode("overwrite").parquet(f"{path}/state/segment={number}")


def _states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_STATE}, segment int").parquet(f"{path}/state")


def read_index(spark: SparkSession, path: str) -> InvertedIndex:
    """A kept index, each chunk in its newest state. A segment of no postings has no folders of
    buckets, so the columns are named here."""
    postings = spark.read.schema(f"{_POSTINGS}, home int, segment int, bucket int").parquet(f"{path}/postings")
    newest = _states(spark, path).groupBy("chunk_id").agg(
        F.max_by(F.struct("alive", "home", "acl_class", "dl"), "segment").alias("last"))
    state = newest.filter("last.alive").select("chunk_id", "last.home", "last.acl_class", "last.dl")
    buckets = spark.read.parquet(f"{path}/meta").first()["buckets"]
    return InvertedIndex(postings.drop("segment"), buckets=buckets, state=state)


_STATE = "chunk_id string, alive boolean, home int, acl_class string, dl int"
_POSTINGS = "term string, chunk_id string, acl_class string, tf int, dl int"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts of each row of a batch, and a row with an empty term that carries its length. A
    chunk is one row, so counting needs no shuffle."""
    for batch in batches:
        lists = batch.column("__tokens")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten().dictionary_encode()
        width = max(len(flat.dictionary), 1)
        places = np.repeat(np.arange(batch.num_rows, dtype=np.int64), sizes)
        pairs, tf = np.unique(places * width + flat.indices.to_numpy(zero_copy_only=False),
                              return_counts=True)
        rows, codes = pairs // width, pairs % width
        every = np.arange(batch.num_rows, dtype=np.int64)
        rows = pa.array(np.concatenate((rows, every)))
        names = pa.concat_arrays([flat.dictionary.take(pa.array(codes)), pa.array(
            [""] * batch.num_rows, flat.dictionary.type)])
        tf = np.concatenate((tf, np.zeros_like(every)))
        yield pa.RecordBatch.from_arrays(
            [names, batch.column("chunk_id").take(rows), batch.column("acl_class").take(rows),
             pa.array(tf.astype(np.int32)), pa.array(sizes.astype(np.int32)).take(rows)],
            names=["term", "chunk_id", "acl_class", "tf", "dl"])


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct term of each query."""
    rest = [c for c in queries.columns if c != text]
    return queries.select(*rest, F.explode(F.array_distinct(tokenize(text))).alias("term"))


def bm25_topk(queries: DataFrame, chunks: DataFrame | InvertedIndex, k: int,
              principals: DataFrame | None = None, scope: str = VISIBLE) -> DataFrame:
    """Best ``max(k, 1)`` chunks per query: query_id, chunk_id, score, rank.

    ``queries``: query_id, text and, with ``principals``, the caller's permission signature
    (``signature``). With scope "visible" the statistics come from what the caller may see, with
    "global" from all chunks; the results never leave what the caller may see. The weights of one
    batch of queries against an index are small and AQE broadcasts them when measured so; otherwise it
    splits the postings of a very common term (skew join). Salting would repeat the weights and lose
    the first case.
    """
    if scope not in (VISIBLE, GLOBAL):
        raise ValueError(f"unknown scope {scope}")
    if not isinstance(chunks, InvertedIndex):
        return _score_in_place(queries, _classed(chunks), max(k, 1), principals, scope)
    terms = query_terms(queries)
    index = chunks.of_terms(terms).merged(terms)
    postings, lengths = index.postings, index.lengths

    if principals is None:
        weighted = _with_totals(terms.join(_total(index.frequency), "term"), lengths)
        matches = postings.join(weighted, "term")
    else:
        # per query: the classes its caller may see and in which a term occurs
        reach = visible_classes(lengths, principals)
        seen = terms.join(index.frequency, "term").join(reach, ["signature", "acl_class"])
        if scope == VISIBLE:
            sizes = _reached(lengths, reach)
            per_term = Window.partitionBy("query_id", "term")
            weighted = _weights(seen.withColumn("df", F.sum("df").over(per_term))
                                .join(sizes, "signature"))
        else:
            weighted = _with_totals(seen.drop("df").join(_total(index.frequency), "term"), lengths)
        matches = postings.join(weighted.drop("signature"), ["term", "acl_class"])
    length = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(0.0)
    scaled = F.col("tf") + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * length)
    part = F.col("idf") * (F.col("tf") * (C.BM25_K1 + 1)) / scaled
    scores = (matches.groupBy("query_id", "chunk_id")
              .agg(F.round(F.sum(part), 9).alias("score")).filter("score > 0"))
    return topk(scores, ["query_id"], [F.desc("score"), F.asc("chunk_id")], max(k, 1),
                spread_on="chunk_id")


def _frequency(postings: DataFrame, *keys: str) -> DataFrame:
    return postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("df"))


def _total(frequency: DataFrame, term: str = "term") -> DataFrame:
    return frequency.groupBy(term).agg(F.sum("df").alias("df"))


def _reached(lengths: DataFrame, reach: DataFrame) -> DataFrame:
    """Number of chunks and tokens each caller may see."""
    return lengths.join(reach, "acl_class").groupBy("signature").agg(
        F.sum("chunks").alias("n"), F.sum("tokens").alias("tokens"))


_FORWARD = "chunk_id string, acl_class string, dl int, codes array<int>, tfs array<int>"
_HITS = "query_id string, chunk_id string, score double"
_CHUNK = -1  # the code that every chunk has: its frequency is the number of chunks


def _score_in_place(queries: DataFrame, chunks: DataFrame, k: int, principals: DataFrame | None,
                    scope: str) -> DataFrame:
    """BM25 without an index. Per block of queries the text is read once, into counts of the block's
    terms, which are stored; frequencies, lengths and scores come from those."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), *(
        ["signature"] if principals is not None else []),
        F.array_distinct(tokenize("text")).alias("terms"))
    if principals is not None:
        held = principals.select(permission_signature().alias("signature"),
                                 principal_tokens().alias("tokens")).dropDuplicates(["signature"])
        asked = asked.join(held, "signature")
    tokens = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "acl_class",
                           tokenize("content").alias("__tokens"))

    def run(rows: list) -> DataFrame:
        vocabulary = sorted({term for r in rows for term in r["terms"] or ()})
        known = cut(bounded(tokens).mapInArrow(_count_known(vocabulary), _FORWARD), "counts")
        every = F.explode(F.concat("codes", F.array(F.lit(_CHUNK)))).alias("code")
        counts = known.select("acl_class", "dl", every).groupBy("acl_class", "code").agg(
            F.count(F.lit(1)).alias("df"), F.sum("dl").cast("long").alias("tokens"))
        place = {term: code for code, term in enumerate(vocabulary)}
        codes = [np.array(sorted(place[t] for t in r["terms"] or ()), dtype=np.int32) for r in rows]
        weights = _block_weights(rows, codes, counts, principals is not None, scope)
        seen = [frozenset(r["tokens"]) for r in rows] if principals is not None else None
        found = bounded(known).filter(F.size("codes") > 0).mapInArrow(
            _score_counts([r["query_id"] for r in rows], weights, seen, k), _HITS)
        return topk(found, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k,
                    spread_on="chunk_id")

    return by_blocks(asked, QUERY_BLOCK, run, "bm25")


def _count_known(vocabulary: list[str]):
    """Function over Arrow batches: length of each row and counts of the known terms in it."""
    known = pa.array(vocabulary, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__tokens")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().dictionary_encode()
            code_of = pc.fill_null(pc.index_in(flat.dictionary, value_set=known), -1)
            codes = code_of.to_numpy(zero_copy_only=False).astype(np.int64)[
                flat.indices.to_numpy(zero_copy_only=False)]
            places = np.repeat(np.arange(batch.num_rows, dtype=np.int64), sizes)
            width = max(len(known), 1)
            pairs, tf = np.unique((places * width + codes)[codes >= 0], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1, dtype=np.int64) * width)
            offsets = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), batch.column("acl_class"),
                 pa.array(sizes.astype(np.int32)),
                 pa.ListArray.from_arrays(offsets, pa.array((pairs % width).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))],
                names=["chunk_id", "acl_class", "dl", "codes", "tfs"])

    return count


def _block_weights(rows: list, codes: list[np.ndarray], counts: DataFrame, restricted: bool,
                   scope: str) -> list[tuple]:
    """(codes, idf, average length) per query of a block: as many numbers as the block has terms."""
    callers = [r["signature"] if restricted and scope == VISIBLE else None for r in rows]
    sums = [F.sum("df").alias("df"), F.sum("tokens").alias("tokens")]
    if restricted and scope == VISIBLE:
        spark = counts.sparkSession
        asked = {(s, int(c)) for s, own in zip(callers, codes) for c in (*own, _CHUNK)}
        held = {(r["signature"], token) for r in rows for token in r["tokens"]}
        wanted = spark.createDataFrame(sorted(asked), "signature string, code int")
        tokens = spark.createDataFrame(sorted(held), "signature string, token string")
        reach = opened_classes(counts.filter(F.col("code") == _CHUNK), tokens)
        found = (counts.join(wanted, "code").join(reach, ["signature", "acl_class"])
                 .groupBy("signature", "code").agg(*sums))
    else:
        found = counts.groupBy("code").agg(*sums).withColumn("signature", F.lit(None).cast("string"))
    of = {(r["signature"], r["code"]): r for r in found.collect()}
    weights = []
    for caller, own in zip(callers, codes):
        total = of.get((caller, _CHUNK))
        own = np.array([c for c in own if (caller, int(c)) in of], dtype=np.int32)
        df = np.array([of[caller, int(c)]["df"] for c in own], dtype=np.float64)
        n, tokens = (total["df"], total["tokens"]) if total else (0, 0)
        weights.append((own, np.log(1 + (n - df + 0.5) / (df + 0.5)), tokens / n if n else 0.0))
    return weights


def _score_counts(ids: list[str], weights: list[tuple], tokens: list[frozenset] | None, k: int):
    """Function over Arrow batches of counts: best k chunks per query of one task."""
    step = max(1, CELLS_PER_STEP // max(len(ids), 1))

    def part(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("codes")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        places = np.repeat(np.arange(batch.num_rows), sizes)[order]
        tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)[order].astype(np.float64)
        dl = batch.column("dl").to_numpy(zero_copy_only=False)[places]
        scores = np.zeros((batch.num_rows, len(ids)))
        for query, (own, idf, average) in enumerate(weights):
            starts, ends = np.searchsorted(codes, own), np.searchsorted(codes, own, side="right")
            at = [np.arange(a, b) for a, b in zip(starts, ends)]
            at = np.concatenate(at) if at else np.empty(0, dtype=np.int64)
            length = dl[at] / average if average > 0 else np.zeros(len(at))
            scaled = tf[at] + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * length)
            worth = np.repeat(idf, ends - starts) * (tf[at] * (C.BM25_K1 + 1)) / scaled
            scores[:, query] = np.bincount(places[at], worth, minlength=batch.num_rows)
        scores = np.round(scores, 9)
        scores[scores <= 0] = -np.inf
        return scores

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        best = Best(len(ids), k)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                scores = part(rows)
                if tokens is not None:
                    classes = rows.column("acl_class").dictionary_encode()
                    opened = [class_tokens(c) for c in classes.dictionary.to_pylist()]
                    of_set = {held: np.array([not held.isdisjoint(c) for c in opened], dtype=bool)[
                        classes.indices.to_numpy(zero_copy_only=False)] for held in set(tokens)}
                    for query, held in enumerate(tokens):
                        scores[~of_set[held], query] = -np.inf
                best.offer(scores, np.array(rows.column("chunk_id").to_pylist(), dtype=object))
        yield best.to_batch(ids)

    return score


def _with_totals(counted: DataFrame, lengths: DataFrame) -> DataFrame:
    """Weights from the totals of the whole corpus, which are a single row."""
    totals = lengths.agg(F.sum("chunks").alias("n"), F.sum("tokens").alias("tokens"))
    one = F.lit(1).alias("one")
    joined = counted.withColumn("one", one).join(F.broadcast(totals.withColumn("one", one)), "one")
    return _weights(joined.drop("one"))


def _weights(counted: DataFrame) -> DataFrame:
    """idf and average length from n, tokens and df."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (counted.withColumn("idf", idf).withColumn("avgdl", F.col("tokens") / F.col("n"))
            .drop("n", "tokens", "df"))


def keyword_title_topk(queries: DataFrame, docs: DataFrame, k: int = C.TOP_K,
                       query_block: int = QUERY_BLOCK) -> DataFrame:
    """Substring search: 3 for a term found in the title, 1 for the content; newest first on ties.

    ``queries``: query_id, text; ``docs``: document_id, title, content, created_at. Any term can
    occur anywhere in a text, so there is no key to join on: the terms of a block of queries go to
    the tasks, each document is searched once for all of them, and k documents per query leave an
    Arrow batch.
    """
    asked = queries.select("query_id", keyword_terms("text").alias("terms"))
    texts = docs.select(
        F.col("document_id").cast("string").alias("document_id"),
        F.coalesce(F.lower("title"), F.lit("")).alias("title"),
        F.coalesce(F.lower("content"), F.lit("")).alias("content"),
        F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)).alias("at"))
    order = [F.desc("score"), F.desc("at"), F.asc("document_id")]

    def run(rows: list) -> DataFrame:
        search = _keyword_search([(str(r["query_id"]), r["terms"]) for r in rows], k)
        found = bounded(texts).mapInPandas(search, _KEYWORD_HITS)
        return topk(found, ["query_id"], order, k, spread_on="document_id").drop("at")

    best = by_blocks(asked, query_block, run, "keyword")
    return best.join(docs.select("document_id", "title", "created_at",
                                 snippet("content").alias("snippet")), "document_id")


_KEYWORD_HITS = "query_id string, document_id string, score bigint, at bigint"


def _keyword_search(queries: list[tuple[str, list[str]]], k: int):
    """Function over pandas batches: best k documents per query of each batch."""
    ids = np.array([query_id for query_id, _ in queries], dtype=object)
    asking: dict[str, list[int]] = {}
    for place, (_, terms) in enumerate(queries):
        for term in terms:
            asking.setdefault(term, []).append(place)
    places = {term: np.array(found) for term, found in asking.items()}

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not places:
            return
        terms_in = _term_finder(list(places))
        step = max(1, CELLS_PER_STEP // len(ids))
        for batch in batches:
            for start in range(0, len(batch), step):
                yield best_of(batch.iloc[start:start + step], terms_in)

    def points(text: str, terms_in) -> np.ndarray:
        hits = [places[term] for term in terms_in(text)]
        return np.bincount(np.concatenate(hits), minlength=len(ids)) if hits else 0

    def best_of(batch: pd.DataFrame, terms_in) -> pd.DataFrame:
        scores = np.zeros((len(batch), len(ids)), dtype=np.int64)
        for row, (title, content) in enumerate(zip(batch["title"], batch["content"])):
            scores[row] = 3 * points(title, terms_in) + points(content, terms_in)
        documents, at = batch["document_id"].to_numpy(dtype=str), batch["at"].to_numpy()
        parts = []
        for query in range(len(ids)):
            column = scores[:, query]
            rows = np.flatnonzero(column)
            if len(rows) > k:
                floor = np.partition(column[rows], len(rows) - k)[len(rows) - k]
                rows = rows[column[rows] >= floor]
            order = np.lexsort((documents[rows], -at[rows], -column[rows]))[:k]
            kept = rows[order]
            parts.append(pd.DataFrame({
                "query_id": ids[query], "document_id": documents[kept].astype(object),
                "score": column[kept], "at": at[kept]}))
        return pd.concat(parts, ignore_index=True)

    return search


def _term_finder(terms: list[str]):
    """Function from a text to the distinct terms it contains."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [term for term in terms if term in text]
    automaton = ahocorasick.Automaton()
    for term in terms:
        automaton.add_word(term, term)
    automaton.make_automaton()
    return lambda text: {term for _, term in automaton.iter(text)}
