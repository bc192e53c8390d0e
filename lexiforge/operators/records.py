"""Row search, field grabbing, usage quotas, registries and JSON replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.functions.analysis import strip


def cell(cells: Column, k: int) -> Column:
    return F.coalesce(F.get(cells, F.lit(k)), F.lit(""))


def has_status(cells: Column, word: str, at: int = 5) -> Column:
    """P1/P2."""
    return F.contains(F.lower(cell(cells, at)), F.lit(word.lower()))


def any_keyword(cells: Column, query: str) -> Column:
    """Any word of the query inside any cell."""
    words = [w.lower() for w in query.split()]
    return F.exists(cells, lambda c: reduce(lambda x, y: x | y, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w)) for w in words])) if words else F.lit(False)


def formatted(cells: Column, labels: list[str], skip: int = 3) -> Column:
    """Labelled lines of the filled cells; cells of links alone are left out, dates are put in one form."""

    def line(c: Column, k: Column) -> Column:
        value = strip(F.coalesce(c, F.lit("")))
        links = T.urls(value)
        alone = (F.size(links) > 0) & ((value == F.array_join(links, " ")) | (value == F.array_join(links, ",")))
        shown = F.when(value.rlike(r"^\d{1,4}[-./]\d{1,2}[-./]\d{1,4}$"), T.date_text(value)).otherwise(value)
        label = F.coalesce(F.get(F.array(*map(F.lit, labels)), k), F.lit(""))
        return F.when((k == skip) | (value == "") | alone, F.lit(None)).when(label == "", T.html_escaped(shown)).otherwise(F.concat(F.lit("<b>"), T.html_escaped(label), F.lit(":</b> "), T.html_escaped(shown)))

    return F.array_join(F.transform(cells, line), "\n")


def images(cells: Column) -> Column:
    """Distinct image links of all cells but the skipped one."""
    every = F.flatten(F.transform(cells, lambda c, k: F.when(k == 3, F.array().cast("array<string>")).otherwise(T.urls(F.coalesce(c, F.lit(""))))))
    return F.array_distinct(F.filter(F.transform(every, T.direct_image_url), T.is_image_url))


def checklist(df: DataFrame, text: Column, checks: list[tuple[str, str, list[str]]]) -> DataFrame:
    """P10: a row for each check (name, 'all' or 'any', words) of each document."""
    t = F.lower(text)

    def ok(kind: str, words: list[str]) -> Column:
        return reduce((lambda x, y: x & y) if kind == "all" else (lambda x, y: x | y), [F.contains(t, F.lit(w)) for w in words])

    rows = F.array(*[F.struct(F.lit(n).alias("check"), ok(kind, words).alias("ok")) for n, kind, words in checks])
    return df.select("doc_id", F.inline(rows))


def grabbed(text: Column, labels: list[str]) -> Column:
    """The first label variant found, with up to 200 characters of its line."""
    return F.coalesce(*[F.nullif(strip(F.regexp_extract(text, rf"(?iu){label}[^\n\r]{{0,200}}", 0)), F.lit("")) for label in labels], F.lit(""))


def usage_daily(events: DataFrame) -> DataFrame:
    """G7."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def quota_left(daily: DataFrame, free: int, admins: DataFrame) -> DataFrame:
    """What is left of the day's quota; null without limit."""
    known = admins.select("user_id", F.lit(True).alias("admin"))
    return daily.join(known, "user_id", "left").select("user_id", "day", F.when(~F.coalesce("admin", F.lit(False)), F.greatest(F.lit(0).cast("long"), free - F.col("n"))).alias("left"))


def usage_running(events: DataFrame) -> DataFrame:
    """W8."""
    order = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return events.withColumn("n", F.row_number().over(order))


def ttl_accepted(events: DataFrame, key: str, ttl_seconds: float) -> DataFrame:
    """M8: which events of each key start a job: those more than the time to live after the last accepted one.

    An event so long after the one before it is accepted whatever came earlier, so each such gap begins a stretch of its own; only
    within a stretch events are folded, in order. A busy key so is many small groups."""
    order = Window.partitionBy(key).orderBy("t", "event_id")
    rows = events.select(key, F.col("ts").cast("timestamp").cast("double").alias("t"), "event_id")
    rows = rows.withColumn("first", F.coalesce((F.col("t") - F.lag("t").over(order) > ttl_seconds).cast("int"), F.lit(1))).withColumn("stretch", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    times = rows.groupBy(key, "stretch").agg(F.array_sort(F.collect_list(F.struct("t", "event_id"))).alias("x"))
    id_type = dict(events.dtypes)["event_id"]
    state = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(f"array<struct<event_id:{id_type},accepted:boolean>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        ok = s["last"].isNull() | (e["t"] - s["last"] > ttl_seconds)
        return F.struct(F.when(ok, e["t"]).otherwise(s["last"]).alias("last"), F.concat(s["out"], F.array(F.struct(e["event_id"].alias("event_id"), ok.alias("accepted")))).alias("out"))

    return times.select(key, F.inline(F.aggregate("x", state, step)["out"]))


def finished(starts: DataFrame, ends: DataFrame, key: str, ttl_seconds: float) -> DataFrame:
    """M8 with ends: starts (key, ts, event_id) with accepted; a job that has ended (key, ts of ends) suppresses no more."""
    both = starts.select(key, F.col("ts").cast("timestamp").cast("double").alias("t"), "event_id").unionByName(ends.select(key, F.col("ts").cast("timestamp").cast("double").alias("t"), F.lit(None).cast("long").alias("event_id")))

    def accept(group, frame):
        last, kept = None, []
        frame = frame.assign(end=frame["event_id"].isna()).sort_values(["t", "end", "event_id"], ascending=[True, False, True])
        for t, end in zip(frame["t"].tolist(), frame["end"].tolist()):
            ok = not end and (last is None or t - last > ttl_seconds)
            last = None if end else t if ok else last
            kept.append(ok)
        return frame.assign(accepted=kept)[~frame["end"]].astype({"event_id": "int64"})[[key, "event_id", "accepted"]]

    return both.groupBy(key).applyInPandas(lambda group, frame: accept(group, frame), f"{key} {dict(starts.dtypes)[key]}, event_id long, accepted boolean")


def sessions(actions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """M9: the mode of each key (its last 'mode' action's value; null before the first), and the documents of its session: those added after
    its last 'clear', in order, each by its last adding. actions: key, at (a number or time that orders them), action ('mode', 'add' or 'clear'), value.

    At equal times a clear comes first. Both are aggregates that combine before the shuffle; documents stay rows, however many a session has."""
    mode = actions.groupBy(key).agg(F.max_by("value", F.when(F.col("action") == "mode", F.struct("at", "value"))).alias("mode"))
    cleared = actions.filter("action = 'clear'").groupBy(key).agg(F.max("at").alias("cleared"))
    added = actions.filter("action = 'add'").groupBy(key, "value").agg(F.max("at").alias("at"))
    # Keys are compared null-safe: a null key is one session, as in the aggregates.
    own = added.alias("a").join(cleared.alias("c"), F.col(f"a.{key}").eqNullSafe(F.col(f"c.{key}")), "left").filter("cleared is null or a.at >= cleared")
    return mode, own.select(f"a.{key}", F.col("a.value").alias("doc"), "a.at")


def registry_upsert(registry: DataFrame, new: DataFrame) -> DataFrame:
    """By hash, the latest name and time, and the sorted union of chunk ids."""
    both = registry.unionByName(new)
    return both.groupBy("hash").agg(F.max_by("fname", F.struct("time", "fname")).alias("fname"), F.max("time").alias("time"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks"))


def first_seen(docs: DataFrame) -> DataFrame:
    """One row for each distinct content, that of the smallest doc_id; partial aggregation comes before the shuffle."""
    return docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"))


def without(df: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """J8/J9/M4/U4."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def overlaid(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Page texts, blank ones filled from OCR."""
    found = ocr.select("page_id", F.col("text").alias("ocr_text"))
    return pages.join(found, "page_id", "left").select("page_id", F.when(strip(F.coalesce("text", F.lit(""))) == "", F.coalesce("ocr_text", F.lit(""))).otherwise(F.col("text")).alias("text"))


PAIRS = "array<struct<original:string,recognized:string>>"


def reply_pairs(raw: Column) -> Column:
    """L1: the array of pairs in a model's reply: fenced, bare, from its first [ to its last ], several arrays in a row, or its complete flat objects."""
    plain = strip(F.regexp_replace(raw, r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(plain, r"(?s)(\[.*\])", 1)
    objects = F.concat(F.lit("["), F.array_join(F.regexp_extract_all(plain, F.lit(r"\{[^{}]*\}"), F.lit(0)), ","), F.lit("]"))
    parsed = lambda c: F.when(F.startswith(c, F.lit("[")), F.from_json(c, PAIRS))
    # The parser stops after the first of several arrays, so those are joined before it sees them.
    joined = F.regexp_replace(inner, r"\]\s*[\r\n]+\s*\[", ",")
    return F.coalesce(F.when(~joined.rlike(r"\]\s*\["), parsed(joined)), parsed(objects), F.array().cast(PAIRS))


def failed_reply(c: Column) -> Column:
    """L7."""
    return (strip(F.coalesce(c, F.lit(""))) == "") | F.startswith(c, F.lit("⚠️"))


def context(rows: DataFrame, group: str, order: str, glue: str = "\n\n") -> DataFrame:
    """Texts of a group joined in order."""
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), glue).alias("context"))


def routed(mode: Column) -> Column:
    """M12."""
    return F.when(mode == "ai", "chat").when(mode == "work", "session").when(mode == "tm", "rows").otherwise("index")
