"""Text as columns: visible words, digests, folding, keys, figures, obligations, house style."""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewatch.functions import words as W

Col = str | Column


def c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words_in(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


# Bytes and pages


@F.pandas_udf(StringType())
def decode_body(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes as text: the header's charset, the page's own within 4096 bytes, UTF-8, Windows-1252; the first that decodes."""
    declared = re.compile(rb"<meta[^>]+charset=[\"']?\s*([a-zA-Z0-9_\-]+)", re.I)

    def one(raw: bytes | None, kind: str | None) -> str:
        if not raw:
            return ""
        raw = bytes(raw)
        tries = [m[1].strip() for m in [re.search(r"charset=([^;]*)", (kind or "").lower())] if m]
        tries += [m[1].decode() for m in [declared.search(raw[:4096])] if m]
        for name in (*tries, "utf-8", "cp1252"):
            try:
                if name and codecs.lookup(name):
                    return raw.decode(name)
            except (UnicodeDecodeError, LookupError, ValueError):
                continue
        return raw.decode("utf-8", "replace")

    return pd.Series([one(*x) for x in zip(body, content_type, strict=True)])


def _clean(text: Column, to: str) -> Column:
    for pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->"):
        text = F.regexp_replace(text, pattern, to)
    return text


def stable_digest(page: Col) -> Column:
    """SHA-256 of a page (text) without scripts, styles, comments, nonces and repeated white space."""
    text = _clean(c(page), "")
    text = F.regexp_replace(text, r'(?i)\s(?:nonce|data-nonce|csrf[-_]token)="[^"]*"', "")
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def raw_digest(body: Col) -> Column:
    """SHA-256 of the exact bytes."""
    return F.sha2(c(body), 256)


def page_text(page: Col) -> Column:
    """Visible words: a new line where a block closes, six character references in their order, lines trimmed, blank lines few."""
    text = _clean(c(page), " ")
    text = F.regexp_replace(text, r"(?i)</(p|div|li|h[1-6]|tr|section|article|br)\s*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", "\n")
    text = F.regexp_replace(text, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def lines(text: Col) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.split(c(text), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda x: ~x.rlike(r"(?U)^\s*$"))


# Folding and keys


#: Characters that NFKC leaves alone in whatever company: ASCII, letters and signs of Latin-1, quotes, dashes and the euro. Text of these alone needs no normalising.
_STEADY = r"\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u00FF\u2013\u2014\u2018\u2019\u201C\u201D\u20AC"
#: Accented letters that come apart into one ASCII letter and marks.
_ACCENTED = {chr(k): x for k in range(0xC0, 0x180) for x in ["".join(ch for ch in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(ch))] if len(x) == 1 and x.isascii()}


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _unmarked(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))


def _where(test: Column, changed: Callable[[Column], Column], text: Column) -> Column:
    """changed(text) where the test holds; other rows don't take part, not even as an argument."""
    return F.coalesce(changed(F.when(test, text)), text)


def _ascii(text: Column) -> Column:
    """Told by lengths, without looking at the characters."""
    return F.octet_length(text) == F.length(text)


def composed(text: Col) -> Column:
    """NFKC. Only text with characters that it may change goes to Python."""
    return _where(~_ascii(c(text)) & c(text).rlike(f"[^{_STEADY}]"), _nfkc, c(text))


def without_accents(text: Col) -> Column:
    """NFKD without combining marks. Accented Latin letters lose theirs by a table; only text with other characters goes to Python."""
    plain = F.when(c(text).rlike(r"[\u00C0-\u017F]"), F.translate(c(text), "".join(_ACCENTED), "".join(_ACCENTED.values()))).otherwise(c(text))
    return _where(plain.rlike(r"[^\x00-\x7F]"), _unmarked, plain)


def straight(text: Col) -> Column:
    """Curly quotes, long dashes and hard spaces as plain ones."""
    return F.when(_ascii(c(text)), c(text)).when(c(text).rlike("[‘’“”–—\xa0]"), F.translate(c(text), "‘’“”–—\xa0", "''\"\"-- ")).otherwise(c(text))


def squeeze(text: Col) -> Column:
    """White space as one space, none at the ends. ASCII text is gone through by bytes, and only where spaces stand side by side by a pattern."""
    plain = c(text)
    for space in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    plain = F.when(plain.contains("  "), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)
    return F.trim(F.when(_ascii(c(text)), plain).otherwise(F.regexp_replace(c(text), r"(?U)\s+", " ")))


def fold(text: Col) -> Column:
    """NFKC, plain punctuation, one space for white space: what quotes are compared in."""
    return squeeze(straight(composed(text)))


def fold_ci(text: Col) -> Column:
    return F.lower(fold(text))


def fold_plain(text: Col) -> Column:
    """fold for text that is in NFKC already: built-in functions only."""
    return squeeze(straight(text))


def name_key(name: Col) -> Column:
    """A school's name without accents, punctuation and a leading "the"."""
    key = F.trim(F.regexp_replace(F.lower(without_accents(F.coalesce(c(name), F.lit("")))), "[^a-z0-9]+", " "))
    return F.regexp_replace(key, "^the ", "")


def search_words(text: Col) -> Column:
    """Words of a search or of what is searched, without stop words."""
    plain = F.lower(F.regexp_replace(without_accents(F.coalesce(c(text), F.lit(""))), r"[^\x00-\x7F]", ""))
    return F.array_except(F.regexp_extract_all(plain, F.lit("([a-z0-9]+)"), 1), words_in(W.SEARCH_STOP))


def _plural(w: Column) -> Column:
    """Plurals only: ies to y, es and s off, where four letters stay."""
    n = F.length(w)
    return F.when(w.endswith("ies") & (n >= 7), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y"))).when(w.endswith("es") & (n >= 6), F.substring(w, F.lit(1), n - 2)).when(w.endswith("s") & (n >= 5), F.substring(w, F.lit(1), n - 1)).otherwise(w)


def role_words(text: Col) -> Column:
    """Distinct stems of the words that say what a job is."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c(text), F.lit(""))), F.lit("([a-z]+)"), 1)
    noise = words_in(W.ROLE_NOISE)
    kept = F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(noise, w))
    return F.array_except(F.transform(kept, _plural), F.transform(noise, _plural))


def story_stems(text: Col) -> Column:
    """Distinct stems of a summary's words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c(text), F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    stop = words_in(W.STORY_STOP)
    kept = F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))

    def stem(w: Column) -> Column:
        out = F.when(F.lit(False), w)
        for suffix in ("ing", "ed", "es", "s"):
            out = out.when(w.endswith(suffix) & (F.length(w) > len(suffix) + 3), F.substring(w, F.lit(1), F.length(w) - len(suffix)))
        return out.otherwise(w)

    return F.array_distinct(F.transform(kept, stem))


def significant(name: Col, noise: list[str], least: int = 1) -> Column:
    """Distinct words of a name that tell it from others."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c(name), F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= least) & ~F.array_contains(words_in(noise), w)))


# Identities


def row_id(n: int, *parts: Col, sep: str = "\n") -> Column:
    """The first n hex digits of the SHA-256 of the parts, joined."""
    return F.substring(F.sha2(F.concat_ws(sep, *(F.coalesce(c(p).cast("string"), F.lit("")) for p in parts)), 256), 1, n)


def requirement_id(url: Col, quote: Col, lane: Col) -> Column:
    return row_id(24, url, quote, lane)


def change_id(source: Col, before: Col, after: Col) -> Column:
    return row_id(24, source, before, after)


def article_id(change_ids: Col) -> Column:
    return F.substring(F.sha2(F.array_join(F.sort_array(c(change_ids)), "|"), 256), 1, 16)


def listing_id(board: Col, posting: Col) -> Column:
    return F.concat_ws("-", c(board), c(posting), row_id(10, board, posting))


def source_id(country: Col, lane: Col, url: Col) -> Column:
    """country-lane-host-tail-digest: the tail is the last 48 characters of the squeezed path, or root."""
    rest = F.regexp_replace(c(url), r"^.*?//", "")
    host = F.regexp_extract(rest, "^([^/]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/]*(.*)$", 1)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    tail = F.when(path == "", "root").otherwise(F.right(path, F.lit(48)))
    return F.concat_ws("-", F.lower(c(country)), c(lane), F.replace(host, F.lit("."), F.lit("-")), tail, F.substring(F.sha2(c(url), 256), 1, 8))


def slugify(text: Col) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, 70), "-+$", "")
    return F.when(slug == "", "article").otherwise(slug)


def ranking_slug(name: Col) -> Column:
    found = F.regexp_extract_all(F.lower(c(name)), F.lit("([a-z0-9]+)"), 1)
    return F.array_join(F.filter(found, lambda w: ~F.array_contains(words_in(W.SCHOOL_NOISE), w)), "-")


# Figures, obligations, money


_FIGURE = r"(\d[\d.,]*)"
_DUTIES = {w: kind for kind, own in (("obligation", W.OBLIGATION), ("permission", W.PERMISSION), ("negation", W.NEGATION)) for w in own}
_DUTY = rf"\b({'|'.join(sorted({*_DUTIES, W.REFUSED}, key=lambda w: (-len(w), w)))})\b"


def said(text: str) -> tuple[list[str], list[str]]:
    """numbers_in and modality_in of one text outside of a DataFrame: for state functions, which see the lines that moved."""
    figures = sorted(re.sub("[.,]", "", x) for x in re.findall(_FIGURE, text, re.A))
    found = (x.lower() for x in re.findall(_DUTY, text, re.I))
    return figures, sorted(kind for w in found for kind in (("negation", "permission") if w == W.REFUSED else (_DUTIES[w],)))


def numbers_in(text: Col) -> Column:
    """Sorted figures of a text; 1.270 and 1,270 are the same."""
    found = F.regexp_extract_all(c(text), F.lit(_FIGURE), 1)
    return F.array_sort(F.transform(found, lambda x: F.regexp_replace(x, "[.,]", "")))


def modality_in(text: Col) -> Column:
    """Sorted obligations, permissions and negations of a text, each as often as it occurs."""
    lookup = F.create_map(*(F.lit(x) for pair in _DUTIES.items() for x in pair))
    found = F.transform(F.regexp_extract_all(c(text), F.lit(f"(?iU){_DUTY}"), 1), F.lower)
    kinds = F.transform(found, lambda w: F.when(w == W.REFUSED, F.array(F.lit("negation"), F.lit("permission"))).otherwise(F.array(F.element_at(lookup, w))))
    return F.array_sort(F.flatten(kinds))


def money(text: Col) -> tuple[Column, Column]:
    """(amount, currency) of the first printed sum; null and "" where there is none that reads as a number."""
    text = F.coalesce(c(text), F.lit(""))
    pattern = rf"(?i){W.MONEY}"
    symbol = F.lower(F.regexp_extract(text, pattern, 1))
    amount = F.replace(F.regexp_extract(text, pattern, 2), F.lit(","), F.lit("")).try_cast("double")
    codes = F.create_map(*(F.lit(x) for pair in W.CURRENCIES.items() for x in pair))
    return amount, F.when(amount.isNull(), "").otherwise(F.coalesce(F.try_element_at(codes, symbol), F.lit("")))


def looks_like_text(text: Col) -> Column:
    """At least 20 characters, nine tenths printable, over a third letters."""
    text = c(text)
    n = F.length(text)
    hidden = F.length(F.regexp_replace(text, r"[\P{C}&&[^\p{Zl}\p{Zp}]&&[^\p{Zs}&&[^ ]]]|[ \n\t\r]", ""))
    letters = n - F.length(F.regexp_replace(text, r"\p{L}", ""))
    return F.coalesce((n >= 20) & ((n - hidden) / n >= 0.9) & (letters / n > 0.35), F.lit(False))


# House style


def tidy(text: Col) -> Column:
    """Dashes and curly quotes out; numbers with a dash between read "to"."""
    text = F.regexp_replace(c(text), r"(?U)(\d)\s*[–—]\s*(\d)", "$1 to $2")
    text = F.regexp_replace(text, r"(?U)\s*[—–]\s*", ", ")
    text = F.regexp_replace(text, r"(?U)\s+--\s+", ", ")
    text = F.translate(text, "“”‘’", "\"\"''")
    text = F.regexp_replace(F.regexp_replace(text, r",\s*,", ","), r"(?U)\s{2,}", " ")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), ",+$", "")


def voice_hits(text: Col) -> Column:
    """Sorted distinct words that break the house style; none is clean."""
    text = F.lower(F.coalesce(c(text), F.lit("")))
    # Single words are looked up among the text's words. Patterns of several are searched for only where their rarest words stand.
    single = [w for w in W.BANNED if re.fullmatch(r"\w+", w)]
    words = F.array_intersect(F.split(text, r"[^\p{L}\p{M}\p{N}_]+"), words_in(single))
    phrases = [F.when(text.contains(w) & text.rlike(rf"\b{re.sub(r'([-.])', r'\\\1', w)}\b"), w) for w in W.BANNED if w not in single]
    phrases += [F.when(text.contains(w), w) for w in W.INFLATION]
    phrases += [F.when(text.contains("not ") & text.contains("but") & text.rlike(W.NOT_JUST), "not just ... but"), F.when(text.contains("—") | text.contains("–"), "dash")]
    nouns = F.when(text.contains("key "), F.regexp_extract_all(text, F.lit(f"({W.KEY_NOUN})"), 1)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(words, F.array_compact(F.array(*phrases)), nouns)))


def strip_contacts(text: Col) -> Column:
    """Without e-mail addresses and telephone numbers."""
    text = F.regexp_replace(F.coalesce(c(text), F.lit("")), r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+", "")
    text = F.regexp_replace(text, r"(?U)(?:\+?\d[\d\-\s().]{7,}\d)", "")
    return F.regexp_replace(text, "^[ ,;·-]+|[ ,;·-]+$", "")


def search_queries(title: Col) -> Column:
    """What to ask a job board: the title, and what stands before its first comma if that has several words."""
    head = F.trim(F.split_part(c(title), F.lit(","), F.lit(1)))
    more = (head != "") & (F.lower(head) != F.lower(c(title))) & head.contains(" ")
    return F.when(more, F.array(c(title), head)).otherwise(F.array(c(title)))


def kind_agreement(model: Col, detected: Col) -> Column:
    """What two opinions of a document's kind come to; neither overrules the other."""
    return F.when(c(detected).isNull(), "unchecked").when(c(detected) == c(model), "agreed").otherwise("disagreed")


def read_verdict(answer: Col) -> Column:
    """A second reader's answer: agreed, disputed, or unverified where it is neither yes nor no."""
    head = F.upper(F.regexp_replace(F.element_at(F.concat(lines(F.coalesce(c(answer), F.lit(""))), F.array(F.lit(""))), 1), r"^[\s.,:;!*_]+|[\s.,:;!*_]+$", ""))
    return F.when(head.startswith("YES"), "agreed").when(head.startswith("NO"), "disputed").otherwise("unverified")


def read_share(text: Col, name: Col) -> tuple[Column, Column, Column]:
    """(share, edition, reason) of a ranking page's text for a school of that name."""
    own = lines(text)
    page = F.trim(F.element_at(F.concat(own, F.array(F.lit(""))), 1))
    figure = F.regexp_extract(c(text), r"(?i)International student percentage\s*([0-9]{1,3})\s*%", 1)
    edition = F.regexp_extract(c(text), r"World University Rankings\s*(20\d\d)", 1)
    reason = F.when(F.coalesce(c(text), F.lit("")) == "", "no readable text on the page").when(~names_match(name, page), "the page is about another institution").when(figure == "", "the page does not state an international student percentage").otherwise("read")
    ok = reason == "read"
    return F.when(ok, figure.cast("double")), F.when(ok & (edition != ""), F.concat(F.lit("World University Rankings "), edition)), reason


# Names


def _within(a: Column, b: Column) -> Column:
    """Every word of the smaller set is in the larger."""
    shared = F.size(F.array_intersect(a, b))
    return (F.least(F.size(a), F.size(b)) > 0) & (shared == F.least(F.size(a), F.size(b)))


def names_match(a: Col, b: Col) -> Column:
    return _within(significant(a, W.SCHOOL_NOISE), significant(b, W.SCHOOL_NOISE))


def same_company(a: Col, b: Col) -> Column:
    """As names_match, but one word alone has to be the whole name."""
    x, y = significant(a, W.COMPANY_NOISE, 2), significant(b, W.COMPANY_NOISE, 2)
    return _within(x, y) & ((F.least(F.size(x), F.size(y)) > 1) | (F.size(x) == F.size(y)))


def same_place(a: Col, b: Col) -> Column:
    """One shared word is enough; a side that says nothing contradicts nothing."""
    x, y = significant(a, W.COMPANY_NOISE, 2), significant(b, W.COMPANY_NOISE, 2)
    return (F.size(x) == 0) | (F.size(y) == 0) | F.arrays_overlap(x, y)


def same_story(a: Column, b: Column, threshold: float = 0.35) -> Column:
    """Two arrays of stems: enough in common, and a word among it that names the story."""
    shared = F.array_intersect(a, b)
    naming = F.exists(shared, lambda w: (F.length(w) >= 4) & ~F.array_contains(words_in(W.STORY_GENERIC), w))
    smaller = F.least(F.size(a), F.size(b))
    return (smaller > 0) & naming & (F.size(shared) / smaller >= threshold)


def admin_summary(text: Col) -> Column:
    """A summary about hours or contact details only."""
    text = F.coalesce(c(text), F.lit(""))
    return text.rlike(f"(?i){W.ADMIN_ONLY}") & ~F.regexp_replace(text, f"(?i){W.ADMIN_ONLY}", "").rlike(f"(?i){W.RULE_WORDS}")


def cosine(a: Col, b: Col) -> Column:
    """Cosine of two arrays of doubles; 0 where one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    a, b = c(a).cast("array<double>"), c(b).cast("array<double>")
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
