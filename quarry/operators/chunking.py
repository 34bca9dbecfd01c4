"""Text to chunk rows. Everything here is row-local: no shuffle before the caller writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions.text import has_text, sentences, sha256_hex, strip
from quarry.functions.vectors import cosine_or_zero

FIXED, MARKDOWN, SEMANTIC = "FIXED", "MARKDOWN", "SEMANTIC"
HEADING_LEVELS = 6


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("size must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of the sliding windows of a text; the last one ends with the text.

    The text is cut once, into runs of ``size - overlap`` characters; a window is made of the runs that
    it covers. A substring of the text would walk from its begin for each window.
    """
    step = size - overlap
    last = F.greatest(F.lit(0).cast("long"), F.ceil((F.length(text) - size) / step))
    starts = F.sequence(F.lit(0).cast("long"), last)
    covered = -(-size // step)

    def window(runs, i):
        # get, as slice would copy the whole array
        parts = (F.coalesce(F.get(runs, (i + k).cast("int")), F.lit("")) for k in range(covered))
        return F.substring(F.concat(*parts), 1, size)

    # the runs get a name, so that they are made once
    runs = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    cut = F.get(F.transform(runs, lambda r: F.transform(starts, lambda i: window(r, i))), 0)
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def _rows_of(df: DataFrame, rest: Sequence[str], items: Column, position: str,
             value: str) -> DataFrame:
    """One row per item of an array. The explode is an outer one with a filter after it: before an
    inner one Spark puts a filter on the array's size, which makes the array twice more."""
    return (df.select(*rest, F.posexplode_outer(items).alias(position, value))
            .filter(F.col(position).isNotNull()))


def chunk_fixed(df: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
                text: str = "content") -> DataFrame:
    """One row per window of the trimmed text; blank text gives no row."""
    check_window(size, overlap)
    rest = [c for c in df.columns if c != text]
    trimmed = strip(F.coalesce(F.col(text), F.lit("")))
    return _rows_of(df.select(*rest, trimmed.alias("__text")), rest,
                    windows(F.col("__text"), size, overlap), "chunk_index", "content")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` on a value that is made once and then has a name."""
    return F.get(F.transform(F.array(value), use), 0)


def _latest(marks: Column, level: int) -> Column:
    """For each heading the place of the last one of ``level`` up to it, -1 before the first.

    A heading holds until the next one of its level, so the array is a row of runs.
    """
    size = F.size(marks)
    places = F.filter(F.transform(marks, lambda m, i: F.when(m["level"] == level, i)),
                      lambda i: i.isNotNull())

    def runs(found):
        before = F.array_repeat(F.lit(-1), F.coalesce(F.get(found, 0), size))
        return F.concat(before, F.flatten(F.transform(found, lambda place, n: F.array_repeat(
            place, F.coalesce(F.get(found, n + 1), size) - place))))

    return _let(places, runs)


def _headings(marks: Column, latest: Column, i: Column) -> Column:
    """Titles of the headings open after heading ``i``: a level is open if its last heading comes
    after the last ones of all levels above it."""
    titles, above = [], F.lit(-1)
    for level in range(1, HEADING_LEVELS + 1):
        place = F.get(latest[f"level{level}"], i)
        titles.append(F.when(place > above, F.get(marks, place)["title"]))
        above = F.greatest(above, place)
    return F.filter(F.array(*titles), lambda t: t.isNotNull())


def _sections(lines: Column) -> Column:
    """Array of (headings, body) for the sections of an array of lines, blank bodies left out.

    Heading lines are picked out first and find their ancestors by the last heading of each level,
    in time linear in lines and headings. A section is read line by line, as slice would copy the
    whole array for each.
    """
    heading = "^(#{1,6})\\s+(.*)\\z"

    def as_mark(line, index):
        level = F.when(line.startswith("#"), F.length(F.regexp_extract(line, heading, 1)))
        return F.struct(F.coalesce(level, F.lit(0)).alias("level"), line.alias("line"),
                        (index + 1).alias("at"))

    def with_title(mark):
        return F.struct(mark["level"].alias("level"), mark["at"].alias("at"),
                        strip(F.regexp_extract(mark["line"], heading, 2)).alias("title"))

    def section(headings, first, last):
        return F.struct(headings.alias("headings"), first.alias("from"), last.alias("to"))

    def all_sections(marks):
        def end(i):
            return F.coalesce(F.get(marks, i)["at"] - 1, F.size(lines))

        latest = F.struct(*(_latest(marks, n).alias(f"level{n}")
                            for n in range(1, HEADING_LEVELS + 1)))
        under = _let(latest, lambda found: F.transform(marks, lambda m, i: section(
            _headings(marks, found, i), m["at"] + 1, end(i + 1))))
        top = section(F.array().cast("array<string>"), F.lit(1), end(F.lit(0)))
        return F.concat(F.array(top), under)

    def with_body(found):
        body = F.transform(F.sequence(found["from"], found["to"]), lambda n: F.get(lines, n - 1))
        return F.struct(found["headings"].alias("headings"),
                        strip(F.array_join(body, "\n")).alias("body"))

    marks = F.transform(F.filter(F.transform(lines, as_mark), lambda m: m["level"] > 0), with_title)
    filled = F.filter(_let(marks, all_sections), lambda s: s["to"] >= s["from"])
    return F.filter(F.transform(filled, with_body), lambda s: s["body"] != "")


def _with_sections(df: DataFrame, text: str) -> DataFrame:
    rest = [c for c in df.columns if c != text]
    # the lines are named by _let: a column of them would be put back as split into pushed filters
    return df.filter(has_text(text)).select(
        *rest, _let(F.split(text, "\n", -1), _sections).alias("__sections"))


def markdown_sections(df: DataFrame, text: str = "content") -> DataFrame:
    """One row per section with a body: heading path (array) and trimmed body, split inside the
    document's own row."""
    rest = [c for c in df.columns if c != text]
    return (_rows_of(_with_sections(df, text), rest, F.col("__sections"), "section_index", "__section")
            .select(*rest, "section_index", F.col("__section.headings").alias("headings"),
                    F.col("__section.body").alias("body")))


def with_parent_id(sections: DataFrame, document_id: str = "document_id",
                   version: str = "version") -> DataFrame:
    """Stable parent id of each section."""
    return sections.withColumn("parent_id", F.concat(
        F.col(document_id), F.lit("-v"), F.col(version).cast("string"), F.lit("-p"),
        F.col("section_index").cast("string")))


def chunk_markdown(df: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
                   text: str = "content", label: str = C.HEADING_LABEL) -> DataFrame:
    """Window every section body; children carry their heading path and their section index, and
    are numbered across the document, all inside the document's own row."""
    check_window(size, overlap)
    rest = [c for c in df.columns if c != text]

    def children(section, index):
        path = F.array_join(section["headings"], C.HEADING_SEPARATOR)
        crumb = F.when(F.size(section["headings"]) > 0, F.concat(
            F.lit(label), path, F.lit("\n"))).otherwise(F.lit(""))
        return F.transform(windows(section["body"], size, overlap), lambda w: F.struct(
            index.alias("section_index"), F.concat(crumb, w).alias("content")))

    cut = F.flatten(F.transform("__sections", children))
    return (_rows_of(_with_sections(df, text), rest, cut, "chunk_index", "__child")
            .select(*rest, "chunk_index", F.col("__child.section_index").alias("section_index"),
                    F.col("__child.content").alias("content")))


def split_sentences(df: DataFrame, text: str = "content") -> DataFrame:
    """One row per sentence, numbered from 0 within its document."""
    rest = [c for c in df.columns if c != text]
    return _rows_of(df, rest, sentences(text), "sentence_index", "sentence")


def chunk_semantic(sents: DataFrame, threshold: float = C.SEMANTIC_THRESHOLD,
                   keys: Sequence[str] | None = None, vector: str = "embedding") -> DataFrame:
    """Join neighbouring sentences of a document, starting a new chunk where the cosine to the
    sentence before falls under the threshold. A document is its id and, where there is one, its
    version; its sentences come from one row, which bounds the windows."""
    keys = keys or [k for k in ("document_id", "version") if k in sents.columns]
    order = Window.partitionBy(*keys).orderBy("sentence_index")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    similar = cosine_or_zero(F.lag(vector).over(order), F.col(vector))
    starts = F.when((F.col("sentence_index") > 0) & (similar < threshold), 1).otherwise(0)
    parts = (sents.withColumn("__starts", starts)
             .withColumn("chunk_index", F.sum("__starts").over(so_far).cast("int")))
    ordered = F.array_sort(F.collect_list(F.struct("sentence_index", "sentence")))
    return (parts.groupBy(*keys, "chunk_index")
            .agg(F.array_join(F.transform(ordered, lambda s: s["sentence"]), "").alias("content"),
                 F.count(F.lit(1)).alias("sentences")))


def with_chunk_identity(df: DataFrame, document_id: str = "document_id", version: str = "version",
                        content: str = "content") -> DataFrame:
    """content_hash and a chunk id that is the same for the same text, version and index."""
    hashed = df.withColumn("content_hash", sha256_hex(content))
    return hashed.withColumn("chunk_id", F.concat(
        F.col(document_id), F.lit("-v"), F.col(version).cast("string"), F.lit("-c"),
        F.col("chunk_index").cast("string"), F.lit("-"), F.substring("content_hash", 1, 16)))


def chunk_documents(docs: DataFrame, strategy: str = "strategy", size: int = C.CHUNK_SIZE,
                    overlap: int = C.CHUNK_OVERLAP, threshold: float = C.SEMANTIC_THRESHOLD,
                    embed=None) -> tuple[DataFrame, DataFrame]:
    """(children, parents) of documents with the strategy each row names; unknown means FIXED.

    ``docs`` has document_id, version, content and any metadata, which is copied to children and
    parents. ``embed`` adds an ``embedding`` column to a sentence DataFrame (document_id, version, a
    hash of the row's content, sentence_index, sentence); without it a SEMANTIC document is an error
    when it is read. Rows that share document_id and version are chunked each on its own.
    """
    meta = [c for c in docs.columns if c not in ("content", strategy)]
    name = F.upper(F.coalesce(F.col(strategy), F.lit(FIXED)))
    docs = docs.withColumn("__strategy", name)
    by_section = docs.filter(F.col("__strategy") == MARKDOWN).select(*meta, "content")
    semantic = docs.filter(F.col("__strategy") == SEMANTIC).select(*meta, "content")
    fixed = docs.filter(~F.col("__strategy").isin(MARKDOWN, SEMANTIC)).select(*meta, "content")

    no_parent = F.lit(None).cast("string").alias("parent_id")
    out = [*meta, "chunk_index", "content"]
    children = chunk_fixed(fixed, size, overlap).select(*out, no_parent)
    sectioned = with_parent_id(chunk_markdown(by_section, size, overlap))
    children = children.unionByName(sectioned.select(*out, "parent_id"))
    if embed is None:
        unread = F.raise_error(F.lit("SEMANTIC documents need an embedder"))
        parted = semantic.withColumn("content", unread.cast("string")).withColumn("chunk_index", F.lit(0))
    else:
        keys = ["document_id", "version", "__content"]
        semantic = semantic.withColumn("__content", sha256_hex("content"))
        sents = embed(split_sentences(semantic).select(*keys, "sentence_index", "sentence"))
        # equal rows give each sentence again; the window is partitioned as those of chunk_semantic
        order = Window.partitionBy(*keys).orderBy("sentence_index")
        again = F.lag("sentence_index").over(order) == F.col("sentence_index")
        once = sents.withColumn("__again", F.coalesce(again, F.lit(False))).filter(~F.col("__again")).drop("__again")
        cut = chunk_semantic(once, threshold, keys)
        parted = semantic.drop("content").join(cut, keys)
    children = children.unionByName(parted.select(*out, no_parent))

    parents = with_parent_id(markdown_sections(by_section))
    parents = parents.select("parent_id", *meta, F.col("body").alias("content"))
    return with_chunk_identity(children), parents


def embedding_text(chunks: DataFrame, parents: DataFrame, docs: DataFrame, prefix_fn) -> DataFrame:
    """Adds ``embedding_text``: a generated context prefix, a newline and the content.

    The prefix is made from the parent body when there is one, else from the whole document, cut to
    the model's limit before it is joined; without a usable prefix the text is the content alone. The
    stored content never changes. ``docs``: document_id, version, content.
    """
    from quarry.operators.models import generate_or_fallback

    head = F.substring("content", 1, C.MAX_CONTEXT_SOURCE_CHARS)
    bodies = parents.select("parent_id", head.alias("__body"))
    full = docs.select("document_id", "version", head.alias("__full"))
    joined = (chunks.join(bodies, "parent_id", "left").join(full, ["document_id", "version"], "left")
              .withColumn("__source", F.coalesce("__body", "__full")).drop("__body", "__full"))
    asked = has_text("content") & has_text("__source")
    prompt = F.when(asked, F.concat("__source", F.lit("\n"), "content"))
    generated = generate_or_fallback(joined.withColumn("__prompt", prompt), prefix_fn,
                                     prompt_col="__prompt", out_col="__prefix")
    text = F.when(has_text("__prefix") & asked, F.concat("__prefix", F.lit("\n"), "content"))
    return (generated.withColumn("embedding_text", F.coalesce(text, F.col("content")))
            .drop("__source", "__prompt", "__prefix"))
