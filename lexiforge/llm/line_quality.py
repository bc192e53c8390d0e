"""Quality rules by cross-document line frequency.

Every normalised line (white space runs as one blank, ASCII lower case) is hashed; for each host the distinct
documents with the line are counted, where exact copies are one document. A line above the host's limit goes from
all documents but the first that holds it (smallest doc_id), so that no content is lost altogether. A document
that loses most of its words is rejected, as is one that fails the base rules.

Defined results: a null text has no words and fails; null hosts are one host; rows are judged each for itself, equal
ones alike; an empty input gives no rows; extra columns are left out (apply_quality() keeps all of them).
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, split_words, spread_join, unused, written

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is boilerplate beyond so many documents of its host, and beyond this share of them.
LINE_DOCS, LINE_PERCENT = 20, 1.0
#: A document is depleted if less than this share of its words is left.
LEFT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
METRICS = "ordinal long, doc_id long, host string, content binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>"


def host_of(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column), F.lit("-"))


def content_of(column: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(column, F.lit("")), 256))


def line_key(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    once, twice = set(), set()
    for w in windows:
        (twice if w in once else once).add(w)
    count = end = 0
    for k, w in enumerate(windows):
        if w in twice:
            count += k + 3 - max(k, end)
            end = k + 3
    return count


def measures(text: str) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words of each distinct normalised line."""
    words, duplicates, seen, lines = split_words(text), 0, set(), {}
    for line in text.split("\n"):
        own = split_words(lower_ascii(line))
        if own:
            duplicates += line in seen
            seen.add(line)
            key = line_key(own)
            lines[key] = lines.get(key, 0) + len(own)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicates, repeated_words(words), lines


def measure(docs: DataFrame) -> DataFrame:
    """A row of METRICS for each row of docs, written: the texts are read once."""

    def run(batches):
        ordinal = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = [measures(t or "") for t in b.column(3).to_pylist()]
            own = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            lines = pa.array([[{"line": k, "words": n} for k, n in r[5].items()] for r in rows], pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(range(ordinal, ordinal + len(rows)), pa.int64()), b.column(0), b.column(1), b.column(2), *own, lines], ["ordinal", "doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])
            ordinal += len(rows)

    rows = docs.select("doc_id", host_of(F.col("source")).alias("host"), content_of(F.col("text")).alias("content"), "text")
    return written(rows.mapInArrow(run, METRICS), "quality")


def frequent_lines(metrics: DataFrame, line_docs: int = LINE_DOCS, line_percent: float = LINE_PERCENT) -> DataFrame:
    """host, line, docs, copies (rows with the line) and the first document's content of the lines above their host's limit, written."""
    lines = metrics.select("host", "content", "doc_id", F.explode("lines.line").alias("line"))
    # One row for each distinct document that holds a line, then one for each line: hot lines are summed before they meet.
    each = lines.groupBy("host", "line", "content").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    lines = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "content")).alias("first")).filter(F.col("docs") > line_docs)
    hosts = metrics.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return written(lines.join(hosts, "host").filter(F.col("docs") * 100 > F.col("host_docs") * line_percent).select("host", "line", "docs", "copies", F.col("first.content").alias("first_content")), "frequent-lines")


def judged(metrics: DataFrame, **limits) -> DataFrame:
    """metrics with removed (keys of the lines that go), removed_words, base_failed and kept."""
    lines = metrics.select("ordinal", "host", "content", F.explode("lines").alias("x")).select("ordinal", "host", "content", "x.line", "x.words")
    gone = spread_join(lines, frequent_lines(metrics, **limits), ["host", "line"], "copies", F.col("ordinal")).filter(F.col("content") != F.col("first_content"))
    gone = gone.groupBy("ordinal").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = metrics.join(gone, "ordinal", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long"))).withColumn("base_failed", failed)
    depleted = 100 * (F.col("n_words") - F.col("removed_words")) < LEFT_PERCENT * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """The measures and the verdict of each row of docs."""
    return judged(measure(docs), **limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


def apply_quality(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that are kept, without the lines that go (n_chars follows the text); all columns stay, whatever their names."""
    # A verdict hangs on host and content alone, so equal rows share one.
    columns, at = docs.columns, docs.columns.index("text")
    host, content, removed = (unused(columns, x) for x in ("host", "content", "removed"))
    verdicts = judged(measure(docs), **limits).filter("kept").groupBy("host", "content").agg(F.first("removed").alias(removed), F.count(F.lit(1)).alias(unused(columns, "copies")))
    verdicts = written(verdicts.withColumnsRenamed({"host": host, "content": content}), "verdicts")
    rows = docs.withColumns({host: host_of(F.col("source")), content: content_of(F.col("text"))})
    kept = spread_join(rows, verdicts, [host, content], unused(columns, "copies"), F.col("doc_id"))
    size = columns.index("n_chars") if "n_chars" in columns else None

    def strip(batches):
        for b in batches:
            arrays = [b.column(k) for k in range(len(columns))]
            gone = b.column(len(columns)).to_pylist()
            if any(gone):
                texts = [remove_lines(t, set(r)) if r else t for t, r in zip(arrays[at].to_pylist(), gone)]
                if size is not None:
                    arrays[size] = pa.array([len(t) if r else n for t, r, n in zip(texts, gone, arrays[size].to_pylist())], arrays[size].type)
                arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return kept.select(*columns, removed).mapInArrow(strip, docs.schema)


def remove_lines(text: str, keys: set[int]) -> str:
    out = []
    for line in text.split("\n"):
        own = split_words(lower_ascii(line))
        if not own or line_key(own) not in keys:
            out.append(line)
    return "\n".join(out)
