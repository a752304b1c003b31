"""Text functions. Everything but HTML unescaping and NFKC runs as built-in expressions."""

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters and patterns that results depend on.
SPACES = "[\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]"
INVISIBLE = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\u00ad\\u200b-\\u200f\\u2060\\ufeff]"
DASHES = "[\\u2010-\\u2015\\u2043\\u2212\\ufe58\\ufe63\\uff0d]"
QUOTES_FROM = "“”„‟″‹›ʺ‘’‚‛′ʹ`´"
QUOTES_TO = "«»««««»«''''''''"
PUNCTUATION = "«»\"'`.,;:!?()[]{}—–-…%№*/\\|+=<>@#$^&~"
EDGE_PUNCTUATION = " .,;:!?()[]{}-—–…/\\|*#№"
NAME_QUOTES = "«»\"'„“”‘’`"
JUNK_SENTENCE = (
    r"(?iu)подписывайтесь|подписка на"
    r"|читайте\s+(также|далее|подробнее|по\s+теме|нас\s+в)"
    r"|смотрите\s+(также|видео)"
    r"|(все\s+)?материалы\s+(по\s+теме|сюжета)"
    r"|следите\s+за\s+(нами|новостями)"
    r"|(?U)наш\w*\s+(канал|телеграм|telegram|паблик)"
    r"|нашли\s+ошибку|ctrl\s*\+\s*enter"
    r"|все\s+права\s+защищены|на\s+правах\s+рекламы"
    r"|обновите\s+браузер|flash\s*-?\s*плагин|необходимо\s+обновиться"
    r"|версия\s+для\s+печати|поделиться\s+в\s+соцсетях"
    r"|^(фото|видео|инфографика|источник)\s*:"
)
SIGNATURE = r"(?iuU)фонтанка|интерфакс|лента\.ру|lenta\.ru|interfax|\bИА\b|корреспондент\s+\w+$"
SENTENCE_END = (
    r"(?U)(?<=[.!?…])"
    r"(?<!\bг\.)(?<!\bул\.)(?<!\bд\.)(?<!\bтыс\.)(?<!\bмлн\.)(?<!\bмлрд\.)(?<!\s[А-ЯЁ]\.)"
    r"\s+(?=[«(\[]?[А-ЯЁA-Z0-9])"
)
JUNK_ALIAS = r"^(\d+([.,]\d+)?\s*%|\d+-летн|[\d\s.,]+$)"
LEGAL_FORM = r"(?U)\b(пао|оао|зао|ао|ооо|нко|ано|фгуп|фгбу|гуп|муп|нао|тоо|ип|llc|ltd|inc|plc|corp|gmbh|ag|sa)\b\.?"
ABBREVIATION = r"^[A-ZА-ЯЁ][A-ZА-ЯЁ0-9-]{1,4}$"
ABBREVIATED_TYPES = ("ORG", "LOC", "GPE", "PRODUCT", "EVENT")
NEUTRAL_PLACES = ("россия", "рф", "российский", "федерация", "страна")
REGION_WORDS = ("область", "край", "округ", "район", "регион", "республика", "город", "столица", "субъект")


@F.pandas_udf(T.StringType())
def _unescape_nfkc(text: pd.Series) -> pd.Series:
    def one(s: str | None) -> str | None:
        if s is None:
            return None
        # the numero sign is kept: it would become two letters
        return "№".join(unicodedata.normalize("NFKC", part) for part in html.unescape(s).split("№"))

    return text.map(one)


def fold_quotes(s: Column) -> Column:
    """Typographic double quotes to guillemets, single ones to ', paired straight ones to guillemets."""
    return F.regexp_replace(F.translate(s, QUOTES_FROM, QUOTES_TO), '"([^"]{1,300}?)"', "«$1»")


def strip_markup(s: Column) -> Column:
    """Tags and URLs become spaces, invisible characters go, odd spaces become plain."""
    s = F.regexp_replace(s, "<[^>]{1,200}>", " ")
    s = F.regexp_replace(s, r"(?i)\(?\b(?:https?://|www\.)\S+\)?", " ")
    return F.regexp_replace(F.regexp_replace(s, INVISIBLE, ""), SPACES, " ")


def fold_dashes(s: Column) -> Column:
    """Dashes to hyphens; one to three hyphens between spaces to a dash."""
    return F.regexp_replace(F.regexp_replace(s, DASHES, "-"), r"(?<=\s)-{1,3}(?=\s)", "—")


def squeeze(s: Column) -> Column:
    """One space between words, none before punctuation or at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r" ([,.;:!?%])", "$1"))


def normalize(text: Column) -> Column:
    """Cleaned text: unescaped, NFKC, without markup, with folded quotes and dashes; null stays null."""
    return squeeze(fold_dashes(fold_quotes(strip_markup(_unescape_nfkc(text)))))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), F.trim), lambda s: s != "")


def comparison_key(s: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(s), PUNCTUATION, " " * len(PUNCTUATION)), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Words of the comparison key; empty for texts without any."""
    return let(comparison_key(text), lambda key: F.when(key == "", F.array().cast("array<string>")).otherwise(F.split(key, " ")))


def text_digest(ws: Column) -> Column:
    """sha256 of the words, null without words."""
    return F.when(F.size(ws) > 0, F.sha2(F.array_join(ws, " "), 256))


def shingles(ws: Column, k: int = 5) -> Column:
    """Distinct runs of k words; none if there are fewer."""
    starts = F.sequence(F.lit(1), F.size(ws) - (k - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(ws, i, k), " "))
    return F.when(F.size(ws) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; null if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return common.cast("double") / F.nullif((F.size(a) + F.size(b) - common).cast("double"), F.lit(0.0))


def let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once per row, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def drop_junk(text: Column, blocks: Column, boilerplate: Column) -> Column:
    """``blocks`` (sentences) without repeats, boilerplate keys, junk sentences and a short signature at the end.

    ``boilerplate`` is an array of keys. Junk is only looked for if the whole text has some.
    """

    def without_repeats(usable: Column) -> Column:
        order = F.transform(usable, lambda x: x["k"])
        return let(order, lambda ks: F.transform(F.filter(usable, lambda x, i: F.array_position(ks, x["k"]) == i + 1), lambda x: x["s"]))

    def without_signature(kept: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        signed = F.coalesce((F.length(last) <= 80) & last.rlike(SIGNATURE), F.lit(False))
        return F.array_join(F.when(signed, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept), " ")

    def usable(has_junk: Column) -> Column:
        keyed = F.transform(blocks, lambda s: F.struct(s.alias("s"), comparison_key(s).alias("k")))
        return F.filter(keyed, lambda x: (x["k"] != "") & ~F.array_contains(boilerplate, x["k"]) & ~(has_junk & x["s"].rlike(JUNK_SENTENCE)))

    has_junk = F.coalesce(text.rlike(JUNK_SENTENCE), F.lit(False))
    return let(let(let(has_junk, usable), without_repeats), without_signature)


def letter_counts(text: Column, native: str = "[а-яёА-ЯЁ]", latin: str = "[a-zA-Z]") -> tuple[Column, Column]:
    return F.regexp_count(text, F.lit(native)), F.regexp_count(text, F.lit(latin))


def model_input(title: Column, text: Column, limit: int = 1500, separator: str = "\n\n") -> Column:
    """Trimmed title and the first ``limit`` characters of the trimmed text."""
    return F.concat(F.trim(F.coalesce(title, F.lit(""))), F.lit(separator), F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, limit))


def fold_yo(s: Column) -> Column:
    return F.translate(F.lower(s), "ё", "е")


def edge_tokens(name: Column) -> Column:
    """Words of a name without quotes, punctuation stripped from both ends of each."""
    spaced = F.translate(F.translate(name, " ", " "), NAME_QUOTES, " " * len(NAME_QUOTES))
    stripped = F.transform(F.split(F.trim(spaced), r"(?U)\s+"), lambda w: F.btrim(w, F.lit(EDGE_PUNCTUATION)))
    return F.filter(stripped, lambda w: w != "")


def simple_form(name: Column) -> Column:
    return fold_yo(F.array_join(edge_tokens(name), " "))


def clean_form(name: Column, kind: Column, lemma=None) -> Column:
    """Alias key of a surface form. ``lemma`` maps a word column to its normal form, identity if None.

    Abbreviations and words of mixed script are not lemmatised; legal forms are taken off
    organisations unless nothing would remain.
    """
    simple = simple_form(name)
    bare = F.trim(F.regexp_replace(F.regexp_replace(simple, LEGAL_FORM, " "), r"\s+", " "))
    chosen = F.when((kind == "ORG") & (bare != ""), bare).otherwise(simple)
    if lemma is None:
        return chosen
    keep = F.transform(
        F.filter(edge_tokens(name), lambda w: (kind.isin(*ABBREVIATED_TYPES) & w.rlike(ABBREVIATION)) | (fold_yo(w).rlike("[а-я]") & fold_yo(w).rlike("[a-z]"))),
        fold_yo,
    )
    cyrillic = lambda w: w.rlike("[а-яё]")
    return F.array_join(F.transform(F.split(chosen, " "), lambda w: F.when(F.array_contains(keep, w) | ~cyrillic(w), w).otherwise(lemma(w))), " ")


def is_junk_alias(key: Column) -> Column:
    """Percentages, ages and plain numbers."""
    return key.rlike(JUNK_ALIAS)


def geo_marker(key: Column, places: Column, after: str = "по", regions: tuple[str, ...] = REGION_WORDS, neutral: tuple[str, ...] = NEUTRAL_PLACES) -> Column:
    """Sorted places that qualify a name: words after ``after`` if they touch a place or region word, and places."""
    ws = F.split(key, " ")
    at = F.array_position(ws, after)
    tail = F.when(at > 0, F.slice(ws, at + 1, F.size(ws))).otherwise(F.array().cast("array<string>"))
    region = F.array(*map(F.lit, regions))
    real = F.when(F.arrays_overlap(tail, places) | F.arrays_overlap(tail, region), tail).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array_union(real, F.array_intersect(ws, places)), F.array(*map(F.lit, neutral))))


def seen_in_text(name: Column, haystack: Column) -> Column:
    """Whether a name, or else the five-letter stems of all its words of four letters or more, are in a folded text."""
    n = F.trim(fold_yo(name))
    stems = F.transform(F.regexp_extract_all(n, F.lit(r"(?U)\w{4,}"), F.lit(0)), lambda w: F.substring(w, 1, 5))
    by_stem = (F.size(stems) > 0) & F.forall(stems, lambda s: F.contains(haystack, s))
    return F.coalesce((n != "") & (F.contains(haystack, n) | by_stem), F.lit(False))


def topic_tokens(text: Column, letters: str = "а-яё") -> Column:
    """Lower-cased words of ``letters`` alone, hyphens allowed inside; other characters part words."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{letters}]+(?:-[{letters}]+)*"), F.lit(0))


def canonical_json(**fields: Column) -> Column:
    """JSON of an object whose keys are sorted; null fields are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def numbered(prefix: str, number: Column, width: int) -> Column:
    """Ids like a_0000012."""
    return F.concat(F.lit(f"{prefix}_"), F.lpad(number.cast("string"), width, "0"))


def short_digest(s: Column, n: int = 8) -> Column:
    return F.substring(F.sha2(s, 256), 1, n)
