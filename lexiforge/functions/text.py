"""Text normalisation as Column expressions. Russian OCR clean-up is lossy and always opt-in."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StringType

from lexiforge.functions.analysis import count_of, strip

# Fixed values of the look-alike maps: Latin letter (or digit) to Cyrillic, in pairs of strings.
BASE_FROM, BASE_TO = "AaBEeKkMmHOoPpCcTtYyXxVvWwFf03", "АаВЕеКкМмНОоРрСсТтУуХхИиШшФфОЗ"
EXTRA_FROM, EXTRA_TO = "NnrulZzJjhq", "ИпгилЗзДднд"
FULL_FROM, FULL_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "АВСДЕФГНІЙКЛМНОРКРСТИВШХУЗавсдефгнійклмноркгстившхуз"
CONFUSABLE_FROM, CONFUSABLE_TO = "ABCEHKMOPTXYaceopxyÑÍì", "АВСЕНКМОРТХУасеорхуНИи"
EXTENSION_FROM, EXTENSION_TO = "схораекмтнв", "cxopaekmthb"
CONTEXT = [("N", "И"), ("n", "п"), ("r", "г"), ("u", "и"), ("l", "л"), ("j", "й")]
CANON = [
    (r"\bJ[ji]оrо[vvb]ор\b", "Договор"),
    (r"\bJ[ji]оrо[vvb]ор[а-яA-Za-z]*", "Договор"),
    (r"\bUсnоmm?m?r?e?nb\b", "Исполнитель"),
    (r"\b3аkа3[ui]n?k\b", "Заказчик"),
    (r"АВТОНОМН[Аа][Ss]?\s+Н[еe]КОММ[еe]р[чс][еe]с[кk][аa][яy]\s+ОРГАНИЗАЦИ[Яя]", "АВТОНОМНАЯ НЕКОММЕРЧЕСКАЯ ОРГАНИЗАЦИЯ"),
    (r"Прилож[еe]н[иi][еe]\s+N[еe°º]", "Приложение № "),
    (r"С[тt]ор[оo]н[аa]", "Сторона"),
    (r"С[тt]ор[оo]н[ыy]", "Стороны"),
]
KEPT_PUNCTUATION = r",.:;!?\-—–()\[\]{}«»\"'/\\%@#&*+=_<>|^~`"


def replaced(c: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


#: Rows of a batch that are Python objects at once.
SLICE_ROWS = 64


def by_slices(one: Callable, kind: DataType) -> Callable:
    """A column function that applies one to each value. Values and results are Python objects a slice at a time; of a batch of long
    texts there is besides only the Arrow form."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        parts = [pa.array([one(v) for v in values.slice(k, SLICE_ROWS).to_pylist()], arrow) for k in range(0, len(values), SLICE_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return run


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """NFKC: Spark has no built-in for it."""
    return _nfkc(c)


def sanitized(c: Column, line_chars: int = 10_000, max_chars: int = 400_000) -> Column:
    """N1 after nfkc(): control characters become blanks, runs shrink, lines and text are cut."""
    t = replaced(c, (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"))
    return F.left(F.array_join(F.transform(F.split(t, "\n"), lambda x: F.left(x, F.lit(line_chars))), "\n"), F.lit(max_chars))


def index_text(c: Column, line_chars: int = 10_000, max_chars: int = 400_000) -> Column:
    """N1 whole, in one step: as NFKC leaves the JVM anyway, the rest goes along, and what reads the result never computes it again."""

    def one(t: str | None) -> str:
        t = t or ""
        t = t if t.isascii() else unicodedata.normalize("NFKC", t)
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ", t)))
        return "\n".join([line[:line_chars] for line in t.split("\n")])[:max_chars]

    return by_slices(one, StringType())(c)


def normalized(c: Column) -> Column:
    """N2."""
    return strip(replaced(c, (r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")))


def dehyphenated(c: Column) -> Column:
    """N2, words joined over line ends, zero-width characters dropped."""
    return strip(replaced(c, (r"\r\n?", "\n"), ("[​-‍﻿]", ""), (r"(?U)(\w)-\n(\w)", "$1$2"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")))


def key(c: Column) -> Column:
    """N4."""
    return replaced(F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " "))), (r"^[ .,:;–—\"«»()\[\]]+|[ .,:;–—\"«»()\[\]]+$", ""))


def query_key(c: Column) -> Column:
    """N5."""
    return F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def full_cyrillic(c: Column) -> Column:
    """Every Latin letter becomes Cyrillic; what isn't Cyrillic, digit, white space or listed punctuation goes."""
    return F.regexp_replace(F.translate(c, FULL_FROM, FULL_TO), r"(?U)[^Ѐ-ӿ\d\s,.;:!?—–\-()\[\]{}«»\"'/%№@&*+<>|=_]", "")


def ocr_normalized(c: Column) -> Column:
    """N6."""
    t = replaced(c, (r"(?U)(?:(?<=\s)|^)N\s*(?=\d)", "№"), ("[—–−]", "-"), (r"(?U)\s*={2,}\s*", " "), (r"(?U)\s+([,.:;!?%])", "$1"), (r"\.{3,}", "..."), (r"(?U)[^\w\sА-Яа-яЁё.,:;!?()№\-]{2,}", " "))
    t = F.regexp_replace(full_cyrillic(t), r"[ \t]+", " ")
    return strip(F.regexp_replace(F.array_join(F.transform(F.split(t, r"\r\n|\r|\n"), strip), "\n"), r"\n{3,}", "\n\n"))


def confusables(c: Column) -> Column:
    """N8."""
    return replaced(F.translate(c, CONFUSABLE_FROM, CONFUSABLE_TO), (r"(?U)\s+([,.:;!?])", "$1"), ("…", "..."))


def base_mapped(c: Column) -> Column:
    """N10."""
    return F.translate(c, BASE_FROM, BASE_TO)


def context_mapped(c: Column) -> Column:
    """One letter after another between Cyrillic neighbours, which are consumed."""
    return replaced(c, *[(f"([Ѐ-ӿ]){a}([Ѐ-ӿ])", f"$1{b}$2") for a, b in CONTEXT])


def regex_cleaned(c: Column) -> Column:
    """N12. A line of single letters is joined."""
    t = replaced(c, ("[‐‑‒–—―]+", "-"), ("[«»“”„`´•·…†‡™©®]", ""))
    spaced = r"^[A-Za-zЀ-ӿ](?:\s+[A-Za-zЀ-ӿ]){2,}$"
    t = F.array_join(F.transform(F.split(t, "\n"), lambda x: F.when(x.rlike(spaced), F.replace(x, F.lit(" "), F.lit(""))).otherwise(x)), "\n")
    return replaced(t, (r"={2,}", " "), (r"-{3,}", "-"), (r"(?U)\s+([,.;:!?])", "$1"), (r"(?U)([(\[{])\s+", "$1"), (r"(?U)\s+([)\]}])", "$1"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"))


def legal_fixed(c: Column) -> Column:
    """N13."""
    return replaced(c, (r"(?U)\bN[еe°ºoO]\b", "№"), (r"(?U)\br\.\s*", "г. "), (r"(?U)(\d{4})\s*r\.", "$1 г."), (r"(?U)([А-Яа-я])[aA][sS]\b", "$1ая"), (r"(?U)\s*=\s*", " "))


def canonical(c: Column) -> Column:
    """N14."""
    return replaced(c, *[(f"(?iuU){a}", b) for a, b in CANON])


def tidy(c: Column) -> Column:
    """N15."""
    return strip(replaced(c, (r"(?U)\s*-\s*", " - "), (r"[ \t]{2,}", " ")))


def mixed_repaired(c: Column) -> Column:
    """Runs of letters of both scripts become Cyrillic; digits are no part of a run."""
    mixed = lambda w: w.rlike("[A-Za-z]") & w.rlike("[Ѐ-ӿ]")
    letter, other = "[A-Za-zЀ-ӿ]", "[^A-Za-zЀ-ӿ]"
    parts = F.split(c, f"(?<={letter})(?={other})|(?<={other})(?={letter})")
    return F.array_join(F.transform(parts, lambda w: F.when(mixed(w), F.translate(w, BASE_FROM + EXTRA_FROM, BASE_TO + EXTRA_TO)).otherwise(w)), "")


def cyrillic_only(c: Column) -> Column:
    """N17."""
    return strip(replaced(F.translate(c, BASE_FROM + EXTRA_FROM, BASE_TO + EXTRA_TO), ("[A-Za-z]", ""), (r"[ \t]{2,}", " "), (rf"(?U)\s+([{KEPT_PUNCTUATION}])", "$1"), (r"\n{3,}", "\n\n")))


def ru_ocr_postprocess(c: Column) -> Column:
    """N9 to N17 in order."""
    return cyrillic_only(tidy(canonical(legal_fixed(regex_cleaned(context_mapped(base_mapped(F.regexp_replace(nfkc(c), r"\r\n?", "\n"))))))))


def quality(c: Column) -> Column:
    """Half the share of letters, half that of Cyrillic among them."""
    letters = count_of(c, r"\p{L}")
    return F.when(letters == 0, F.lit(0.0)).otherwise(0.5 * letters / F.length(c) + 0.5 * count_of(c, "[Ѐ-ӿ]") / letters)


def better_ocr(text: Column, other: Column, least: float = 0.3) -> Column:
    """The other text where this one has few Cyrillic letters and is shorter."""
    return F.when((count_of(text, "[Ѐ-ӿ]") / F.greatest(F.length(text), F.lit(1)) < least) & (F.length(other) > F.length(text)), other).otherwise(text)


def html_escaped(c: Column) -> Column:
    """N21."""
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")], c)


def urls(c: Column) -> Column:
    """N22."""
    own = F.filter(F.split(strip(c), r"(?U)[,\s]+"), lambda t: t != "")
    return F.array_distinct(F.flatten(F.transform(own, lambda t: F.when(t.rlike("^https?://"), F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(r"(?i)(https?://[^\s<>\")]+)"), F.lit(1))))))


def direct_image_url(c: Column) -> Column:
    """N23."""
    u = strip(c)
    by_path, by_id = F.regexp_extract(u, r"drive\.google\.com/file/d/([^/]+)/", 1), F.regexp_extract(u, r"[?&]id=([A-Za-z0-9_-]+)", 1)
    link = lambda x: F.concat(F.lit("https://drive.google.com/uc?export=download&id="), x)
    return F.when(by_path != "", link(by_path)).when((by_id != "") & F.contains(u, F.lit("drive.google.com")), link(by_id)).otherwise(u)


def is_image_url(c: Column) -> Column:
    """N24."""
    u = F.lower(c)
    return u.rlike(r"\.(png|jpg|jpeg|gif|webp)$") | F.contains(u, F.lit("googleusercontent.com")) | F.contains(u, F.lit("uc?export=download")) | F.contains(u, F.lit("=download"))


def date_text(c: Column) -> Column:
    """The first of five formats that fits, as dd/MM/yyyy; else the text."""
    formats = [r"^\d{1,2}\.\d{1,2}\.\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$"]
    masks = ["d.M.yyyy", "d/M/yyyy", "yyyy-M-d", "d-M-yyyy", "M/d/yyyy"]
    t = strip(c)
    tried = [F.when(t.rlike(f), F.try_to_timestamp(t, F.lit(m))) for f, m in zip(formats, masks)]
    return F.coalesce(*[F.date_format(x, "dd/MM/yyyy") for x in tried], t)


def safe_name(c: Column) -> Column:
    """N26."""
    return F.left(F.regexp_replace(c, "[^A-Za-zА-Яа-я0-9_.-]+", "_"), F.lit(60))


def latin_extension(c: Column) -> Column:
    """S8."""
    return F.translate(F.lower(c), EXTENSION_FROM, EXTENSION_TO)


def document_type(c: Column, kinds: list[tuple[str, str]]) -> Column:
    """The first kind whose word is in the first 5000 characters."""
    head = F.lower(F.left(c, F.lit(5000)))
    return F.coalesce(*[F.when(F.contains(head, F.lit(w)), F.lit(k)) for w, k in kinds], F.lit("generic"))


def is_caps_heading(c: Column) -> Column:
    """N29."""
    upper, letters = count_of(c, "[А-ЯЁ]"), count_of(c, "[А-Яа-яЁё]")
    return F.length(c).between(3, 120) & (upper >= F.greatest(F.lit(3), F.floor(letters * 0.7)))


def token_estimate(c: Column) -> Column:
    """N30."""
    return F.floor((F.length(c) + 3) / 4)
