"""Queries over text functions, chunking, rows and upkeep."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexiforge.functions import analysis as A
from lexiforge.functions import text as T
from lexiforge.operators import chunking as C
from lexiforge.operators import records as P


def t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def on_docs(f, name="value"):
    return lambda s, d: t(s, d, "documents").select("doc_id", f(F.col("text")).alias(name))


def on_rows(rows, f, name="value"):
    return lambda s, d: s.createDataFrame([(k, x) for k, x in enumerate(rows)], "id int, t string").select("id", f(F.col("t")).alias(name))


def literal(values, name="value", kind="varchar"):
    quoted = lambda v: "null" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower())
    return f"select * from (values {', '.join(f'({k}, {quoted(v)}::{kind})' for k, v in enumerate(values))}) t(id, {name})"


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
NORM = STRIP.format("regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: " + STRIP.format("x") + "), lambda x: x <> '')"
PARA = "list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: " + STRIP.format("x") + "), lambda x: x <> '')"
WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda x: x <> ''))"
DATES = ["31.12.2024", "31/12/2024", "2024-12-31", "31-12-2024", "12/31/2024", "bad"]
CHECKS = [("payment", "any", ["the", "price"]), ("parties", "all", ["and", "of", "that"]), ("term", "any", ["zzz"])]
LABELS = ["no", "name", "brand", "", "type", "size"]
REPLIES = ['[{"original":"k","recognized":"l"}]\n[{"original":"m","recognized":"n"}]', '```json\n[{"original":"a","recognized":"b"}]\n```', '[{"original":"c","recognized":"d"},{"original":"e","recognized":"f"}]', 'so [{"original":"g","recognized":"h"}] it is', '[{"original":"i","recognized":"j"},{"orig', "", "none"]
#: A packer as a recursive query: the state after each paragraph.
PACK = """with recursive p as (select doc_id, {parts} ps from documents), r as (
 select doc_id, ps, 1 i, ''::varchar cur, []::varchar[] done from p
 union all select doc_id, ps, i + 1, case when cur = '' or length(cur) + {g} + length(ps[i]) > {n} then ps[i] else cur || {glue} || ps[i] end,
  case when cur <> '' and length(cur) + {g} + length(ps[i]) > {n} then list_append(done, cur) else done end from r where i <= len(ps)),
 f as (select doc_id, case when cur = '' then done else list_append(done, cur) end parts from r where i > len(ps))
 select doc_id, len(parts) n_parts, md5(array_to_string(parts, '|')) digest from f"""


def _digest(parts):
    return lambda s, d: t(s, d, "documents").select("doc_id", parts(F.col("text")).alias("p")).select("doc_id", F.size("p").cast("long").alias("n_parts"), F.md5(F.array_join("p", "|")).alias("digest"))


def jaccard_pairs(s, d):
    x = t(s, d, "documents").select("doc_id", A.word_set(F.col("text")).alias("w"))
    y = x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return x.join(y, "doc_id").select("doc_id", F.round(A.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


#: F1, the sample contract in its shape: a title in capitals, numbered and named headings, prose, a heading within a section.
CONTRACT = "ДОГОВОР ОКАЗАНИЯ УСЛУГ\nг. Город\n\nРаздел 1. Предмет\nСторона обязуется оказать услуги.\n\nРаздел 2. Оплата\nСтоимость услуг составляет 120 000 рублей.\n\n2.1. Срок оплаты составляет 5 дней.\n\nРаздел 3. Порядок\nУслуги оказаны с даты акта.\n\nРаздел 4. Ответственность\nНеустойка в размере 0,1% за день.\n\nРаздел 5. Прочее\nВступает в силу с подписания."


def with_contract(s, d):
    own = s.createDataFrame([(-1, CONTRACT)], "doc_id long, text string")
    return t(s, d, "documents").select("doc_id", "text").unionByName(own)


def section_find(s, d):
    """C1 with the strict headers, over documents and F1."""
    return C.find_sections(with_contract(s, d), C.STRICT_HEADER).select("doc_id", "section", "title", "number", "start_line", "end_line")


def section_chunks(s, d):
    """C4/C5 with the compat headers, over documents and F1 (whose lines all are headers: no chunk)."""
    rows = C.section_chunks(with_contract(s, d))
    return rows.select("doc_id", "chunk_idx", "section_title_raw", "section_number", "chunk_index_in_section", F.md5("chunk").alias("digest"))


def heading_split(s, d):
    """Documents by number, capitals and titles."""
    return C.heading_split(with_contract(s, d)).select("doc_id", "section", "title", F.md5("text").alias("digest"))


def chunk_cap(s, d):
    """C14: the first 300 chunks of each document."""
    return C.chunked(t(s, d, "documents"), A.sentences(F.col("text")), 300).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def jaccard_near_dup(s, d):
    """Of the lines of each document those that aren't near an earlier line of it."""
    @F.pandas_udf(ArrayType(StringType()))
    def kept(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: C.without_near(list(x), 0.5))

    return t(s, d, "documents").select("doc_id", F.size(kept(F.split("text", "\n"))).alias("kept"))


def window_chunks(s, d):
    return C.chunked(t(s, d, "documents"), C.windows(F.col("text"))).select("doc_id", "chunk_idx", F.md5("chunk").alias("digest"))


def chunk_overlap(s, d):
    rows = C.chunked(t(s, d, "documents"), A.sentences(F.col("text")))
    return C.with_overlap(rows, 10).select("doc_id", "chunk_idx", "chunk")


def smart_split(s, d):
    return C.smart_split(with_contract(s, d)).select("doc_id", "chunk_idx", F.length("chunk").alias("n"))


def adaptive_chunks(s, d):
    return C.adaptive_chunks(t(s, d, "documents")).select("doc_id", "chunk_idx", F.length("chunk").alias("n"))


def canonical_titles(s, d):
    aliases = s.createDataFrame([(0, "payment", "payment"), (1, "price and fee", "payment"), (2, "term", "term")], "ord int, alias string, canon string")
    titles = s.createDataFrame([("Payment.",), ("The term of it",), ("price",), ("other",)], "title string")
    return C.canonical_section(titles, aliases)


def pair_batches(s, d):
    rows = t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("original"), F.col("text").alias("recognized")))).alias("x"))
    pairs = F.transform("x", lambda p: F.struct(p["original"].alias("original"), p["recognized"].alias("recognized")))
    return rows.select("conv_id", F.concat_ws(",", C.pair_batches(pairs, 2).cast("array<string>")).alias("batches"))


def diff_pairs(s, d):
    rows = s.createDataFrame([(1, "A. B. C.", "A. X. C. D."), (2, "Same.", "Same."), (3, "", "New.")], "id long, text_a string, text_b string")
    return C.aligned(rows)


def semantic_diff(s, d):
    x = t(s, d, "documents")
    return x.select("doc_id", C.semantically_different(F.col("text"), F.upper("text")).alias("same_words"), C.semantically_different(F.col("text"), F.concat(F.col("text"), F.lit(" 7"))).alias("digit"))


def cells(s, d):
    return t(s, d, "part").select("p_partkey", F.array(F.col("p_partkey").cast("string"), "p_name", "p_brand", F.lit("x"), "p_type", F.col("p_size").cast("string")).alias("cells"))


def keyword_any_cell(s, d):
    return cells(s, d).filter(P.any_keyword(F.col("cells"), "BRAND#1 steel")).select("p_partkey")


def status_contains(s, d):
    rows = t(s, d, "orders").select("o_orderkey", F.array(*[F.lit("")] * 5, "o_orderpriority").alias("cells"))
    return rows.filter(P.has_status(F.col("cells"), "URGENT")).select("o_orderkey")


def row_format(s, d):
    return cells(s, d).select("p_partkey", P.formatted(F.col("cells"), LABELS).alias("line"))


def keyword_checklist(s, d):
    return P.checklist(t(s, d, "documents"), F.col("text"), CHECKS)


def usage_daily(s, d):
    return P.usage_daily(t(s, d, "events"))


def quota_left(s, d):
    admins = t(s, d, "events").filter("user_id % 50 = 0").select("user_id").distinct()
    return P.quota_left(P.usage_daily(t(s, d, "events")), 10, admins)


def usage_running(s, d):
    return P.usage_running(t(s, d, "events")).select("event_id", "n")


def ttl_dedup(s, d):
    return P.ttl_accepted(t(s, d, "events"), "user_id", 86400.0).select("event_id", "accepted")


def registry_upsert(s, d):
    x = t(s, d, "documents").select(F.sha2("text", 256).alias("hash"), F.col("source").alias("fname"), F.col("doc_id").alias("time"), F.array("doc_id").alias("chunks"))
    return P.registry_upsert(x.filter("time % 2 = 0"), x.filter("time % 2 = 1")).select("hash", "fname", "time", F.concat_ws(",", F.col("chunks").cast("array<string>")).alias("chunks"))


def blank_page_overlay(s, d):
    pages = t(s, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.lit(" \n")).otherwise(F.col("url")).alias("text"))
    return P.overlaid(pages, t(s, d, "pages").filter("page_id % 2 = 0").select("page_id", F.lit("scan").alias("text")))


def last_two_docs(s, d):
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy(F.col("doc_id").desc())
    return t(s, d, "documents").withColumn("n", F.row_number().over(order)).filter("n <= 2").select("source", "doc_id", "n")


def available_sections(s, d):
    return t(s, d, "documents").groupBy("lang").agg(F.concat_ws(", ", F.array_sort(F.collect_set(F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("-"))))).alias("sections"))


def json_extract(s, d):
    rows = s.createDataFrame(list(enumerate(REPLIES)), "id int, raw string")
    return rows.select("id", F.inline(P.reply_pairs(F.col("raw"))))


def index_counts(s, d):
    """M1: sanitised, sectioned (C4; sentences where no header stands), each section windowed, capped: chunks added by document."""
    from lexiforge.operators import ingest

    x = t(s, d, "documents").select(F.col("doc_id").cast("string").alias("hash"), F.lit("").alias("fname"), "text")
    rows = ingest.document_chunks(x).groupBy(F.col("hash").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return t(s, d, "documents").select("doc_id").join(rows, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("int").alias("added"))


def ingest_counts(s, d):
    """M1/M11 end to end: documents come in two batches that share texts; what the store holds in the end."""
    from uuid import uuid4

    from lexiforge.operators import ingest
    from lexiforge.sources.store import shared_dir

    x = t(s, d, "documents").select(F.sha2("text", 256).alias("hash"), F.format_string("%019d", "doc_id").alias("fname"), "text", "doc_id")
    store = ingest.Store(s, f"{shared_dir(s)}/ingest-{uuid4().hex}")
    ingest.index_documents(store, x.filter("doc_id % 2 = 0"), 1)
    ingest.index_documents(store, x, 2)
    counted = store.chunks().groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    return store.registry().join(counted, "hash", "left").select("hash", "time", F.coalesce("n", F.lit(0)).cast("int").alias("added"))


def message_split(s, d):
    return _digest(lambda c: C.messages(c))(s, d)


WINDOWS = """with recursive x as (select doc_id, STRIPPED t from documents), r as (
 select doc_id, t, 0 i, 0 k, false stop from x where t <> ''
 union all select doc_id, t, i2, k2, k2 >= length(t) from (select doc_id, t, k2, greatest(i + 1, k2 - 250) i2 from (select doc_id, t, i,
   case when j = length(t) then j when dot = 0 or length(piece) - dot + 1 > 200 then j else i + dot end k2 from (select *, case when contains(piece, '.') then length(piece) - strpos(reverse(piece), '.') + 1 else 0 end dot from (select doc_id, t, i, least(length(t), i + 1600) j, substring(t, i + 1, least(length(t), i + 1600) - i) piece from r where not stop)))) ),
 c as (select doc_id, lag(i, 1, 0) over (partition by doc_id order by k, i) s, k, t from r),
 w as (select doc_id, s, k, regexp_replace(substring(t, s + 1, k - s), '^\\s+|\\s+$', '', 'g') chunk from c where k > 0)
 select doc_id, cast(row_number() over (partition by doc_id order by s) - 1 as int) chunk_idx, md5(chunk) digest from w where length(chunk) >= 20""".replace("STRIPPED", STRIP.format("text"))

F1 = "select doc_id, text from documents union all select -1, '" + CONTRACT.replace("'", "''") + "'"
LINES = f"x as ({F1}), l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 n, len(string_split(text, chr(10))) - case when suffix(text, chr(10)) then 1 else 0 end c from x), own as (select doc_id, n, c, line, " + STRIP.format("line") + " s from l where n < c)"
STRICT_NUMBERED = r"^(?:(?i:раздел|глава|статья|section|chapter)\s+)?([0-9IVXLC]+(?:\.[0-9]+)*)[.):]?\s+(\p{Lu}[^\n]{1,120})$"
STRICT_CAPITALS = r"^[\p{Lu}\s0-9]{4,120}$"
COMPAT = r"(?i)^(?:раздел|глава|статья)?\s*([IVXLC]+|[0-9]+(?:\.[0-9]+)*)?\s*[.):\-]?\s*([A-ZА-ЯЁ][^\n]{2,120})$"
SECTION_FIND = f"""with {LINES}, h as (select *, regexp_matches(s, '{STRICT_NUMBERED}') numbered from own where length(s) >= 3 and not suffix(s, ':') and (regexp_matches(s, '{STRICT_NUMBERED}') or regexp_matches(s, '{STRICT_CAPITALS}')))
 select doc_id, cast(row_number() over w as int) section, case when numbered then trim(regexp_extract(s, '{STRICT_NUMBERED}', 2)) else s end title, case when numbered then regexp_extract(s, '{STRICT_NUMBERED}', 1) end number, cast(n as int) start_line, cast(coalesce(lead(n) over w, c) as int) end_line from h window w as (partition by doc_id order by n)"""
SECTIONS = f"""{LINES}, h as (select doc_id, n, c, trim(regexp_extract(s, '{COMPAT}', 2)) title, nullif(regexp_extract(s, '{COMPAT}', 1), '') number, coalesce(lead(n) over (partition by doc_id order by n), c) e from own where length(s) >= 3 and not suffix(s, ':') and regexp_matches(s, '{COMPAT}')),
 body as (select h.doc_id, h.n, any_value(title) title, any_value(number) number, string_agg(own.line, chr(10) order by own.n) t from h join own on own.doc_id = h.doc_id and own.n > h.n and own.n < h.e group by h.doc_id, h.n)"""
SECTION_CHUNKS = "with recursive " + SECTIONS + ", y as (select doc_id, n, title, number, " + STRIP.format("t") + """ t from body), r as (
 select doc_id, n, title, number, t, 0 i, 0 k, false stop from y where t <> ''
 union all select doc_id, n, title, number, t, i2, k2, k2 >= length(t) from (select doc_id, n, title, number, t, k2, greatest(i + 1, k2 - 250) i2 from (select *,
   case when j = length(t) then j when dot = 0 or length(piece) - dot + 1 > 200 then j else i + dot end k2 from (select *, case when contains(piece, '.') then length(piece) - strpos(reverse(piece), '.') + 1 else 0 end dot from (select *, least(length(t), i + 1600) j, substring(t, i + 1, least(length(t), i + 1600) - i) piece from r where not stop)))) ),
 cut as (select doc_id, n, title, number, lag(i, 1, 0) over (partition by doc_id, n order by k, i) s, k, t from r),
 w as (select doc_id, n, title, number, s, """ + STRIP.format("substring(t, s + 1, k - s)") + """ chunk from cut where k > 0),
 kept as (select doc_id, n, title, number, s, chunk, row_number() over (partition by doc_id, n order by s) - 1 i from w where length(chunk) >= 20 qualify i < 1000),
 plain as (select doc_id, unnest(p) chunk, generate_subscripts(p, 1) - 1 i from (select doc_id, """ + SENT + """ p from x where doc_id not in (select doc_id from h))),
 every as (select doc_id, title, number, i, chunk, n, s from kept union all select doc_id, 'generic', null, i, chunk, 0, i from plain)
 """
SECTION_COUNTS = SECTION_CHUNKS.replace(F1, "select doc_id, left(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: left(x, 10000)), chr(10)), 400000) as text from documents")
MESSAGES = """with recursive p as (select doc_id, list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda q: QSTRIP) ps from documents), r as (
 select doc_id, ps, 1 i, ''::varchar cur, []::varchar[] done from p
 union all select doc_id, ps, i + 1, case when q = '' then '' when cur <> '' and length(cur) + 2 + length(q) <= 3896 then cur || chr(10) || chr(10) || q when cur = '' and length(q) <= 3896 then q else substring(q, k * 3896 + 1) end,
  case when q <> '' and (case when cur = '' then 0 else length(cur) + 2 end) + length(q) <= 3896 then done else list_concat(done, case when cur = '' then [] else [cur] end, list_transform(range(k), lambda m: substring(q, m * 3896 + 1, 3896))) end
  from (select doc_id, ps, i, cur, done, ps[i] q, greatest(0, (length(ps[i]) + 3895) // 3896 - 1) k from r where i <= len(ps))),
 f as (select doc_id, list_filter(list_transform(case when cur = '' then done else list_append(done, cur) end, lambda q: QSTRIP), lambda q: q <> '') parts from r where i > len(ps))
 select doc_id, len(parts) n_parts, md5(array_to_string(parts, '|')) digest from f""".replace("QSTRIP", STRIP.format("q"))

CATALOGUE = {
    "sanitize_text": (on_docs(lambda c: T.sanitized(c)), "select doc_id, left(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: left(x, 10000)), chr(10)), 400000) as value from documents"),
    "normalize_ws": (on_docs(T.normalized), f"select doc_id, {NORM} as value from documents"),
    "dehyphenate": (on_rows(["won-\nder", "a\r\nb", " x​y "], T.dehyphenated), literal(["wonder", "a\nb", "xy"])),
    "key_normalize": (on_rows([" «Price»:", "A  B."], T.key), literal(["price", "a b"])),
    "query_normalize": (on_rows(["  What IS\tit "], T.query_key), literal(["what is it"])),
    "text_quality": (on_docs(lambda c: F.round(T.quality(c), 6)), "select doc_id, round(case when l = 0 then 0 else 0.5 * l / length(text) end, 6) as value from (select *, length(text) - length(regexp_replace(text, '\\p{L}', '', 'g')) l from documents)"),
    "ocr_choice": (on_rows(["abc", "привет", ""], lambda c: T.better_ocr(c, F.lit("longer"))), literal(["longer", "привет", "longer"])),
    "doc_type_guess": (on_docs(lambda c: T.document_type(c, [("ing the", "contract"), ("that", "position")])), "select doc_id, case when contains(lower(left(text, 5000)), 'ing the') then 'contract' when contains(lower(left(text, 5000)), 'that') then 'position' else 'generic' end as value from documents"),
    "token_estimate": (on_docs(lambda c: T.token_estimate(c)), "select doc_id, (length(text) + 3) // 4 as value from documents"),
    "sha256_dedup": (lambda s, d: P.first_seen(t(s, d, "documents")), "select sha256(text) hash, min(doc_id) doc_id from documents group by 1"),
    "html_escape": (lambda s, d: t(s, d, "pages").select("page_id", F.md5(T.html_escaped(F.col("html"))).alias("digest")), "select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) digest from pages"),
    "url_extract": (on_rows(["a.com,https://x.org/p.png https://x.org/p.png", "see(http://y.org/q)", ""], lambda c: F.array_join(T.urls(c), " ")), literal(["https://x.org/p.png", "http://y.org/q", ""])),
    "image_url_filter": (lambda s, d: t(s, d, "pages").filter(T.is_image_url(F.concat("url", F.when(F.col("page_id") % 2 == 0, ".PNG").otherwise(".html")))).select("page_id"), "select page_id from pages where page_id % 2 = 0 or contains(lower(url), 'googleusercontent.com') or contains(lower(url), '=download')"),
    "drive_links": (on_rows(["https://drive.google.com/file/d/AB1/view", "https://drive.google.com/open?id=Z_9", "http://a.b/?id=3"], T.direct_image_url), literal(["https://drive.google.com/uc?export=download&id=AB1", "https://drive.google.com/uc?export=download&id=Z_9", "http://a.b/?id=3"])),
    "date_multi_format": (on_rows(DATES, T.date_text), literal(["31/12/2024"] * 5 + ["bad"])),
    "order_dates": (lambda s, d: t(s, d, "orders").select("o_orderkey", T.date_text(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day")), "select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as day from orders"),
    "safe_name": (on_docs(T.safe_name), "select doc_id, left(regexp_replace(text, '[^A-Za-zА-Яа-я0-9_.-]+', '_', 'g'), 60) as value from documents"),
    "ru_extension": (on_rows(["рdf", "DOСХ"], T.latin_extension), literal(["pdf", "docx"])),
    "ru_confusables": (on_rows(["АBС", "Hет , да…"], T.confusables), literal(["АВС", "Нет, да..."])),
    "ru_ocr_normalize": (on_rows(["N 12 — аbв == г", "a  b\n\n\n\nж ."], T.ocr_normalized), literal(["№12 - авв г", "а в\n\nж."])),
    "ru_context": (on_rows(["аNб", "жnж", "аjа", "xNy"], T.context_mapped), literal(["аИб", "жпж", "айа", "xNy"])),
    "ru_regex_rules": (on_rows(["А В Т О", "«текст» ===", "( да )"], T.regex_cleaned), literal(["АВТО", "текст ", "(да)"])),
    "ru_legal": (on_rows(["2025 r. N° 5"], T.legal_fixed), literal(["2025 г. N° 5"])),
    "ru_cyrillic_only": (on_rows(["Abc text ."], T.cyrillic_only), literal(["Ас техт."])),
    "ru_mixed_words": (on_rows(["Дoм and hoуse", "Дoм30 дом3x 30"], T.mixed_repaired), literal(["Дом and ноусе".replace("се", "sе"), "Дом30 дом3x 30"])),
    "ru_postprocess": (on_rows(["ДOГОВОР  - 3аказ"], T.ru_ocr_postprocess), literal(["ДОГОВОР- Заказ"])),
    "ru_caps_heading": (on_rows(["ДОГОВОР", "Договор", "АБ"], T.is_caps_heading), literal([True, False, False], kind="boolean")),
    "sentence_split": (_digest(A.sentences), f"with x as (select doc_id, {SENT} p from documents) select doc_id, len(p) n_parts, md5(array_to_string(p, '|')) digest from x"),
    "paragraph_split": (_digest(A.paragraphs), f"with x as (select doc_id, {PARA} p from documents) select doc_id, len(p) n_parts, md5(array_to_string(p, '|')) digest from x"),
    "jaccard_pairs": (jaccard_pairs, f"with x as (select doc_id, {WORDS.format('text')} w from documents) select a.doc_id, round(case when len(a.w) = 0 or len(b.w) = 0 then 0 else len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) end, 6) jaccard from x a join x b on b.doc_id = a.doc_id + 1"),
    "section_find": (section_find, SECTION_FIND),
    "section_chunks": (section_chunks, SECTION_CHUNKS + "select doc_id, cast(row_number() over (partition by doc_id order by n, s) - 1 as int) chunk_idx, title section_title_raw, number section_number, cast(i as int) chunk_index_in_section, md5(chunk) digest from every"),
    "window_chunks": (window_chunks, WINDOWS),
    "pack_paragraphs": (_digest(lambda c: C.packed(F.split(c, "\n"), 600)), PACK.format(parts="string_split(text, chr(10))", g=2, n=600, glue="chr(10) || chr(10)")),
    "pack_sentences": (_digest(lambda c: C.packed(A.sentences(c), 400, " ")), PACK.format(parts=SENT, g=1, n=400, glue="' '")),
    "message_split": (message_split, MESSAGES),
    "chunk_overlap": (chunk_overlap, f"with x as (select doc_id, {SENT} p from documents), u as (select doc_id, unnest(p) c, generate_subscripts(p, 1) - 1 k from x) select doc_id, cast(k as int) chunk_idx, coalesce(right(lag(c) over (partition by doc_id order by k), 10), '') || c as chunk from u"),
    "smart_split": (smart_split, None),
    "heading_split": (heading_split, None),
    "jaccard_near_dup": (jaccard_near_dup, None),
    "chunk_cap": (chunk_cap, f"select doc_id, least(300, len({SENT})) n from documents where len({SENT}) > 0"),
    "adaptive_chunks": (adaptive_chunks, None),
    "index_counts": (index_counts, SECTION_COUNTS + "select d.doc_id, cast(least(300, count(e.doc_id)) as int) added from documents d left join every e on e.doc_id = d.doc_id group by d.doc_id"),
    "ingest_counts": (ingest_counts, SECTION_COUNTS + "select sha256(d.text) hash, cast(case when bool_or(d.doc_id % 2 = 0) then 1 else 2 end as bigint) as time, cast(any_value(least(300, c.n)) as int) added from documents d join (select d2.doc_id, count(e.doc_id) n from documents d2 left join every e on e.doc_id = d2.doc_id group by 1) c on c.doc_id = d.doc_id group by 1"),
    "canonical_titles": (canonical_titles, "select * from (values ('Payment.', 'payment'), ('The term of it', 'term'), ('price', 'payment'), ('other', null)) t(title, canon)"),
    "pair_batches": (pair_batches, "with x as (select conv_id, count(*) n from conversations group by 1) select conv_id, array_to_string(list_transform(range(n), lambda i: (i // 2)::varchar), ',') batches from x"),
    "diff_pairs": (diff_pairs, "select id::bigint id, n, tag, original, recognized from (values (1, 0, 'replace', 'B.', 'X.'), (1, 1, 'insert', '', 'D.'), (3, 0, 'insert', '', 'New.')) t(id, n, tag, original, recognized)"),
    "semantic_diff": (semantic_diff, "select doc_id, lower(text) <> lower(upper(text)) and regexp_replace(lower(text), '[\\s\\p{P}\\p{S}]+', '', 'g') <> regexp_replace(lower(upper(text)), '[\\s\\p{P}\\p{S}]+', '', 'g') same_words, true digit from documents"),
    "keyword_any_cell": (keyword_any_cell, "select p_partkey from part where contains(lower(concat_ws(chr(10), p_partkey, p_name, p_brand, 'x', p_type, p_size)), 'brand#1') or contains(lower(concat_ws(chr(10), p_name, p_brand, p_type)), 'steel')"),
    "status_contains": (status_contains, "select o_orderkey from orders where contains(lower(o_orderpriority), 'urgent')"),
    "row_format": (row_format, "select p_partkey, concat_ws(chr(10), '<b>no:</b> ' || p_partkey, '<b>name:</b> ' || p_name, '<b>brand:</b> ' || p_brand, '<b>type:</b> ' || p_type, '<b>size:</b> ' || p_size) line from part"),
    "keyword_checklist": (keyword_checklist, "select doc_id, 'payment' as \"check\", contains(lower(text), 'the') or contains(lower(text), 'price') ok from documents union all select doc_id, 'parties', contains(lower(text), 'and') and contains(lower(text), 'of') and contains(lower(text), 'that') from documents union all select doc_id, 'term', contains(lower(text), 'zzz') from documents"),
    "field_grab": (on_docs(lambda c: P.grabbed(c, ["price", "the "])), f"select doc_id, {STRIP.format('''coalesce(nullif(regexp_extract(text, '(?i)price[^\\n\\r]{0,200}'), ''), regexp_extract(text, '(?i)the [^\\n\\r]{0,200}'), '')''')} as value from documents"),
    "available_sections": (available_sections, "select lang, array_to_string(list_sort(list(distinct coalesce(nullif(source, ''), '-'))), ', ') sections from documents group by 1"),
    "usage_daily": (usage_daily, "select user_id, ts::date as day, count(*) n from events group by all"),
    "quota_left": (quota_left, "with x as (select user_id, ts::date as day, count(*) n from events group by all) select user_id, day, case when user_id % 50 <> 0 then greatest(0, 10 - n) end \"left\" from x"),
    "usage_running": (usage_running, "select event_id, cast(row_number() over (partition by user_id, ts::date order by ts, event_id) as int) n from events"),
    "ttl_dedup": (ttl_dedup, "with recursive e as (select event_id, user_id, epoch(ts) t, row_number() over (partition by user_id order by ts, event_id) k from events), r as (select event_id, user_id, k, t last, true accepted from e where k = 1 union all select e.event_id, e.user_id, e.k, case when e.t - r.last > 86400 then e.t else r.last end, e.t - r.last > 86400 from r join e on e.user_id = r.user_id and e.k = r.k + 1) select event_id, accepted from r"),
    "mode_route": (lambda s, d: t(s, d, "events").select("event_id", P.routed(F.when(F.col("event_id") % 3 == 0, "ai").when(F.col("event_id") % 3 == 1, "tm")).alias("route")), "select event_id, case event_id % 3 when 0 then 'chat' when 1 then 'rows' else 'index' end route from events"),
    "json_extract": (json_extract, "select * from (values (0, 'k', 'l'), (0, 'm', 'n'), (1, 'a', 'b'), (2, 'c', 'd'), (2, 'e', 'f'), (3, 'g', 'h'), (4, 'i', 'j')) t(id, original, recognized)"),
    "registry_upsert": (registry_upsert, "select sha256(text) hash, arg_max(source, doc_id) fname, max(doc_id) as time, string_agg(doc_id::varchar, ',' order by doc_id) chunks from documents group by 1"),
    "delete_document": (lambda s, d: P.without(t(s, d, "documents").select("doc_id", "lang"), t(s, d, "labels").filter("toxic = 1")), "select doc_id, lang from documents where doc_id not in (select doc_id from labels where toxic = 1)"),
    "anti_join_known": (lambda s, d: P.without(P.first_seen(t(s, d, "documents")), P.first_seen(t(s, d, "documents").filter("doc_id % 2 = 0")), "hash").select("hash", "doc_id"), "select sha256(text) hash, min(doc_id) doc_id from documents group by 1 having count(*) filter (where doc_id % 2 = 0) = 0"),
    "blank_page_overlay": (blank_page_overlay, "select page_id, case when page_id % 3 <> 0 then url when page_id % 2 = 0 then 'scan' else '' end as text from pages"),
    "last_two_docs": (last_two_docs, "select source, doc_id, cast(row_number() over (partition by source order by doc_id desc) as int) n from documents qualify n <= 2"),
    "prompt_context": (lambda s, d: P.context(t(s, d, "conversations"), "conv_id", "turn"), "select conv_id, string_agg(text, chr(10) || chr(10) order by turn) context from conversations group by 1"),
    "failed_reply": (on_rows(["", " ", "⚠️ no", "ok"], P.failed_reply), literal([True, True, True, False], kind="boolean")),
}
