"""Text rules as column expressions; Python runs only where an HTML page has to be read as a whole."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions.batches import slices

#: Districts of the city.
DISTRICTS = (
    "Charlottenburg-Wilmersdorf", "Friedrichshain-Kreuzberg", "Lichtenberg", "Marzahn-Hellersdorf", "Mitte", "Neukölln",
    "Pankow", "Reinickendorf", "Spandau", "Steglitz-Zehlendorf", "Tempelhof-Schöneberg", "Treptow-Köpenick",
)


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but white space."""
    return F.length(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))) == 0


def none_if_blank(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def street_normalize(c: Column) -> Column:
    """One spelling of street names, one space between words, and enumerations spelt out."""
    for short, long in (("Strasse", "Straße"), ("Str.", "Straße"), ("strasse", "straße"), ("str.", "straße")):
        c = F.replace(c, F.lit(short), F.lit(long))
    return let(F.regexp_replace(c, r"\s+", " "), street_enumeration)


def street_enumeration(c: Column) -> Column:
    """The first "A-, B- und Cstraße" of a text becomes "Astraße, Bstraße und Cstraße"."""

    def spelt(phrase: Column) -> Column:
        out = F.replace(F.replace(phrase, F.lit("-, "), F.lit("straße, ")), F.lit("- und "), F.lit("straße und "))
        return F.when(phrase != "", F.replace(c, phrase, out)).otherwise(c)

    # few texts hold what every enumeration does; only these are searched for one
    found = let(F.regexp_extract(c, r"((?:\w*-), )*(?:\w*-) und \w*straße", 0), spelt)
    return F.when(F.contains(c, F.lit("- und ")), found).otherwise(c)


def house_number(c: Column) -> Column:
    """The number at the beginning of what follows a street name, with its letter; null if there is none."""
    found = F.regexp_extract(c, r"^(\d+(\s*[a-zA-Z])?)", 1)
    return F.when(found != "", F.upper(F.replace(found, F.lit(" "), F.lit(""))))


def strip_letter(c: Column) -> Column:
    found = F.regexp_extract(c, r"^(\d+)", 1)
    return F.when(found != "", found)


def number_normalize(c: Column) -> Column:
    """A house number as the gazetteer stores it."""
    return F.upper(F.replace(c, F.lit(" "), F.lit("")))


def kiez_variants(c: Column) -> Column:
    """A text, and the same with "viertel" for "kiez" and the other way round."""
    swap = lambda old, new: F.when(F.contains(c, F.lit(old)), F.regexp_replace(c, rf"(?U)(\w+)({old})\b", f"$1{new}")).otherwise(c)
    return F.array(c, swap("viertel", "kiez"), swap("kiez", "viertel"))


def districts_in(c: Column) -> Column:
    """The districts whose names a text contains."""
    return F.filter(F.array(*[F.lit(d) for d in DISTRICTS]), lambda d: F.contains(c, d))


def districts_of_categories(c: Column) -> Column:
    return F.flatten(F.transform(c, districts_in))


def dehyphen(c: Column) -> Column:
    """Join the trimmed lines of a text: a hyphen goes where lower-case letters stand on both sides."""
    lines = F.array_join(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n")
    joined = F.regexp_replace(lines, r"(?<=\p{Ll}{2})-\n+(?=\p{Ll}{2})", "")
    return F.regexp_replace(joined, r"-\n+", "-")


def section_title(c: Column) -> Column:
    """Up to the first blank line, as one line, or else the first line."""
    head = F.replace(F.replace(F.regexp_extract(c, r"(?s)\A(.*?)\n\s*\n", 1), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))
    return F.when(c.rlike(r"\n\s*\n"), head).otherwise(F.regexp_extract(c, r"\A([^\n]*)", 1))


def section_description(c: Column) -> Column:
    """What follows the first blank line, up to the first full stop or colon at a line's end."""
    return F.trim(F.regexp_replace(F.split(F.regexp_extract(c, r"(?s)\A.*?\n\s*\n(.*)", 1), r"[.:]\n", 2)[0], r"\A\s+|\s+\z", ""))


def page_body(c: Column) -> Column:
    """A gazette page without its header (the first line, its repeats and blanks) and its footer line."""
    lines = F.split(F.regexp_replace(c, r"\A\s+|\s+\z", ""), "\n")
    first, n = F.get(lines, F.lit(0)), F.size(lines)
    begin = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when((x != "") & (x != first), i)), lambda i: i.isNotNull()))
    end = F.when(F.trim(F.element_at(lines, -1)).rlike(r"^ABl\. Nr\. .* \d{4}$"), n - 1).otherwise(n)
    body = F.array_join(F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0))), "\n")
    return F.coalesce(F.regexp_replace(body, r"\A\s+|\s+\z", ""), F.lit(""))


def unaccent(c: Column) -> Column:
    c = F.replace(F.replace(F.replace(c, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return F.translate(c, "äöüÄÖÜáàâãéèêëíìîïóòôõúùûñçÁÀÂÃÉÈÊËÍÌÎÏÓÒÔÕÚÙÛÑÇ", "aouAOUaaaaeeeeiiiioooouuuncAAAAEEEEIIIIOOOOUUUNC")


def search_tokens(c: Column) -> Column:
    """Words of a name or a search: lower case, without accents; german_tokens() has their stems."""
    return F.filter(F.split(F.lower(unaccent(c)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


#: German words that say nothing in a search, without accents.
STOP_WORDS = (
    "aber", "alle", "als", "also", "am", "an", "ander", "auch", "auf", "aus", "bei", "bin", "bis", "bist", "da", "damit", "dann", "das", "dass", "dein", "dem",
    "den", "denn", "der", "des", "dich", "die", "dies", "diese", "diesem", "diesen", "dieser", "dieses", "dir", "doch", "dort", "du", "durch", "ein", "eine",
    "einem", "einen", "einer", "eines", "er", "es", "etwas", "euch", "euer", "fur", "gegen", "hab", "habe", "haben", "hat", "hatte", "hier", "hin", "hinter",
    "ich", "ihm", "ihn", "ihnen", "ihr", "ihre", "im", "in", "indem", "ins", "ist", "jede", "jeder", "jedes", "jener", "jetzt", "kann", "kein", "keine",
    "konnen", "machen", "man", "manche", "mein", "mich", "mir", "mit", "muss", "nach", "nicht", "nichts", "noch", "nun", "nur", "ob", "oder", "ohne", "sehr",
    "sein", "seine", "sich", "sie", "sind", "so", "sondern", "sonst", "um", "und", "uns", "unser", "unter", "viel", "vom", "von", "vor", "war", "was", "weg",
    "weil", "weiter", "welche", "wenn", "werde", "werden", "wie", "wieder", "will", "wir", "wird", "wo", "wollen", "zu", "zum", "zur", "zwar", "zwischen",
)


@functools.lru_cache(maxsize=1 << 16)
def _stem(word: str) -> str:
    """The published Snowball stemmer of German for a lower-case word without accents."""
    vowels = "aeiouy"
    w = re.sub(f"(?<=[{vowels}])([uy])(?=[{vowels}])", lambda m: m[1].upper(), word)

    def region(start: int) -> int:
        m = re.compile(f"[{vowels}][^{vowels}]").search(w, start)
        return m.end() if m else len(w)

    r1 = region(0)
    r2 = region(r1)
    r1 = max(r1, min(3, len(w)))

    def ends(*suffixes: str) -> str:
        return next((x for x in sorted(suffixes, key=len, reverse=True) if w.endswith(x)), "")

    def inside(suffix: str, begin: int) -> bool:
        return len(w) - len(suffix) >= begin

    x = ends("em", "ern", "er", "e", "en", "es", "s")
    if x and inside(x, r1) and (x != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(x)]
        if x in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    x = ends("en", "er", "est", "st")
    if x and inside(x, r1) and (x != "st" or len(w) > 5 and w[-3] in "bdfghklmnt"):
        w = w[: -len(x)]
    x = ends("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit")
    if x and inside(x, r2) and not (x in ("ig", "ik", "isch") and w[: -len(x)].endswith("e")):
        w = w[: -len(x)]
        more = {"end": ("ig",), "ung": ("ig",), "lich": ("er", "en"), "heit": ("er", "en"), "keit": ("lich", "ig")}.get(x, ())
        y = ends(*more)
        if y and inside(y, r1 if x in ("lich", "heit") else r2) and not (x in ("end", "ung") and w.endswith("eig")):
            w = w[: -len(y)]
    return w.lower()


def german_tokens(c: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """search_tokens() without stop words, as stems: the full-text form of a name or a search."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        left = frozenset(stop_words)
        return s.map(lambda words: [_stem(w) for w in words if w not in left], na_action="ignore")

    return run(search_tokens(c))


def format_query(c: Column) -> Column:
    """A search as prefix terms that all have to match: "a b" becomes "a:* & b:*"."""
    parts = F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}_]", " "), " +"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(w, F.lit(":*"))), " & ")


def weighted_levenshtein(search: Column, name: Column) -> Column:
    """Edit distance with insertions at 1, deletions at 10 and substitutions at 20.

    A substitution never beats a deletion and an insertion, so the cost follows from the longest common
    subsequence, of which one row of the table is folded over the search's characters.
    """
    a, b = F.filter(F.split(search, ""), lambda c: c != ""), F.filter(F.split(name, ""), lambda c: c != "")
    zeros = F.array_repeat(F.lit(0), F.size(b) + 1)

    def row(old: Column, ch: Column) -> Column:
        start = F.array(F.lit(0))

        def cell(new: Column, j: Column) -> Column:
            match = F.get(old, j) + F.when(F.get(b, j) == ch, F.lit(1)).otherwise(F.lit(0))
            return F.concat(new, F.array(F.greatest(match, F.get(old, j + 1), F.element_at(new, -1))))

        return F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(b) - 1, F.lit(0))), start, cell)).otherwise(start)

    lcs = F.element_at(F.aggregate(a, zeros, row), -1)
    return F.size(b) + 10 * F.size(a) - 11 * lcs


def html_unescape(c: Column) -> Column:
    """All HTML entities, by a vectorised function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return run(c)


#: Boilerplate of forum descriptions.
FORUM_PATTERNS = (r"(?i)DAF-Beitrag: \S*", r"(?i)DAF-Post: \S*", r"DAF-Thread \([^)]*\)", r"DAF-Post \([^)]*\)")
FORUM_PHRASES = (
    "Kein DAF-Beitrag vorhanden.",
    "Noch kein DAF-Beitrag vorhanden.",
    "Kein DAF-Post vorhanden.",
    "Noch kein DAF-Post vorhanden.",
)


def forum_description(c: Column) -> Column:
    """A forum description, its entities decoded, without break tags, boilerplate and a lone "nv"."""
    c = F.regexp_replace(html_unescape(c), r"(?i)<br/?>", "\n")
    for pattern in FORUM_PATTERNS:
        c = F.regexp_replace(c, pattern, "")
    for phrase in FORUM_PHRASES:
        c = F.replace(c, F.lit(phrase), F.lit(""))
    return F.regexp_replace(F.regexp_replace(c, r"\Anv\z", ""), r"\A\s+|\s+\z", "")


def without_contacts(c: Column) -> Column:
    """A press text up to the line that opens its contacts."""
    return F.regexp_replace(c, r"(?sm)^\s*(Kontakt(e)?|Ansprechpartner(\*innen)?|Pressekontakt(e)?):.*\z", "")


#: Bytes of pages that a worker parses at a time.
PIECE = 1 << 21


class _MainText(HTMLParser):
    """Text inside the elements that a tag, a class and a role choose, without scripts and styles; and links."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, tag: str, cls: str | None, role: str | None = None, link_cls: str | None = None):
        super().__init__(convert_charrefs=True)
        self.tag, self.cls, self.role, self.link_cls = tag, cls, role, link_cls
        self.open: list[tuple[str, bool, bool, bool]] = []  # elements not closed yet: tag, whether chosen, of link_cls, without text
        self.out, self.links = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes = (attrs.get("class") or "").split()
        linked = self.link_cls in classes
        if tag == "a" and attrs.get("href") and (self.link_cls is None or linked or any(e[2] for e in self.open)):
            self.links.append(attrs["href"])
        if tag not in self.VOID:
            chosen = (self.tag == "*" or tag == self.tag) and (self.cls is None or self.cls in classes) and (self.role is None or attrs.get("role") == self.role)
            self.open.append((tag, chosen, linked, tag in ("script", "style")))

    def handle_endtag(self, tag):
        """Close the last open element of the tag, and those inside it that were never closed; a stray end closes nothing."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if any(e[1] for e in self.open) and not any(e[3] for e in self.open):
            self.out.append(data)


def main_text(
    pages: DataFrame, html_col: str = "html", tag: str = "article", cls: str | None = None, role: str | None = None, link_cls: str | None = None
) -> DataFrame:
    """pages with main_text, the text of the elements of a tag, class and role, and links, the hrefs in order.

    With link_cls only links that have this class or stand in an element with it count. Null pages have null
    text and no links; pages are independent and stream through in pieces of bounded bytes.
    """

    names, at = [*pages.columns, "main_text", "links"], pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (piece for batch in batches for piece, _ in slices(batch, PIECE, at)):
            texts, links = [], []
            for page in rows.column(at).to_pylist():
                if page is None:
                    texts.append(None)
                    links.append([])
                    continue
                parser = _MainText(tag, cls, role, link_cls)
                parser.feed(page)
                texts.append(re.sub(r"[ \t]*\n\s*", "\n", "".join(parser.out)).strip())
                links.append(parser.links)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string()), pa.array(links, pa.list_(pa.string()))], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{kinds}, main_text string, links array<string>")


def download_link(pages: DataFrame, site: str, html_col: str = "html", link_cls: str = "download-btn") -> DataFrame:
    """pages with download_url: the first link in an element of the class, after the site's address; null if there is none."""
    first = F.get("links", F.lit(0))
    return main_text(pages, html_col, link_cls=link_cls).withColumn("download_url", F.concat(F.lit(site), first)).drop("main_text", "links")


def float_or(c: Column, default: float) -> Column:
    """The number a text begins with, or the default where it begins with none."""
    return F.coalesce(F.regexp_extract(c, r"^([+-]?\d+(\.\d+)?([eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(float(default)))


def text_to_html(c: Column) -> Column:
    """Paragraphs and line breaks of plain text as HTML."""
    safe = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paragraphs = F.transform(F.split(safe, r"\n{2,}"), lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>\n")), F.lit("</p>")))
    return F.array_join(paragraphs, "\n")
