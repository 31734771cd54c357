"""The gazette: pages and outline of each issue as tables, sections as news records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.functions.dates import german_issue_date
from civicspark.functions.text import dehyphen, page_body, section_description, section_title

#: Outline titles that end the editorial part, and topics that are not imported.
END_TITLES = ("Stellenausschreibungen", "Gerichte", "Nicht amtlicher Teil")
SKIPPED = r"\wkammer (zu )?Berlin|Apothekerversorgung Berlin|Lette-Verein|Versorgungswerk|\WInnung\W"


def outline(rows: DataFrame) -> DataFrame:
    """Outline rows (file, pos, level, page, title as texts) with numbers, null where empty, and clean titles."""
    number = lambda c: F.expr(f"try_cast(nullif(trim({c}), '') as int)")
    title = F.trim(F.regexp_replace("title", r"(?s)^b'(.*)'$", "$1"))
    return rows.select("file", "pos", number("level").alias("level"), number("page").alias("page_no"), title.alias("title"))


def accepted(entries: DataFrame) -> DataFrame:
    """Outline entries of issues whose first title is "Inhalt"."""
    return entries.join(entries.where("pos = 0 and title = 'Inhalt'").select("file"), "file", "left_semi")


def last_pages(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, last_page): the page before the entry that follows the first end title, or else all pages."""
    following = entries.withColumn("next_page", F.lead("page_no").over(Window.partitionBy("file").orderBy("pos")))
    ends = following.where(F.col("title").isin(*END_TITLES)).groupBy("file").agg(F.min_by("next_page", "pos").alias("next_page"))
    counts = pages.groupBy("file").agg(F.max("page_no").alias("n_pages"))
    return counts.join(ends, "file", "left").select("file", F.coalesce(F.col("next_page") - 1, F.col("n_pages")).alias("last_page"))


def issue(file: str = "file") -> tuple:
    """(number, volume) from a file name such as abl_2021_30_....pdf; the first volume is of 1951."""
    year, number = (F.regexp_extract(file, r"(\d{4})[_-](\d+)", k) for k in (1, 2))
    return F.when(number != "", number.cast("int")), F.when(year != "", year.cast("int") - 1950)


def outline_from_xml(spark: SparkSession, path: str) -> DataFrame:
    """Outline rows (file, pos, level, page, title as texts) of XML tables of contents, one file for each issue.

    An entry is an element <outline level= title=> with its page in <pageno>; pos counts from 0 in the file's order.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("xml"))
    # an entry is taken out as text, so that one without a page leaves no gap
    entries = F.regexp_extract_all("xml", F.lit(r"(?s)<outline\b[^>]*?(?:/>|>.*?</outline>)"), 0)
    one = raw.select("file", F.posexplode(entries).alias("pos", "e"))
    value = lambda what: F.xpath_string(F.col("e"), F.lit(what))
    page = F.when(F.contains(F.col("e"), F.lit("pageno")), value("/outline/pageno"))
    one = one.select("file", "pos", value("/outline/@level").alias("level"), page.alias("page"), value("/outline/@title").alias("title"))
    # an entry is parsed once for each column: nullif() of what parses would do it twice
    return one.select("file", "pos", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("level", "page", "title")])


def _title_pattern(title: Column) -> Column:
    """A regular expression for whole lines that read as the title, whatever the white space; it may run over several lines."""
    parts = F.filter(F.split(title, r"\s+"), lambda w: w != "")
    quoted = F.transform(parts, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit(r"(?m)^[^\S\n]*"), F.array_join(quoted, r"\s+"), F.lit(r"[^\S\n]*$"))


def title_places(body: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, page_no, pos, begin, end): where on their pages the titles of entries stand, as character offsets from 0.

    body: file, page_no, text; entries: file, pos, page_no, title. The titles of a page are looked for in the
    order of pos, each behind the one found before it; one that is not found has no row.
    """
    wanted = entries.groupBy("file", "page_no").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("wanted"))
    start = F.expr("named_struct('at', 0, 'found', cast(array() as array<struct<pos:int,begin:int,end:int>>))")

    def step(acc: Column, e: Column) -> Column:
        pattern, rest = _title_pattern(e.title), F.substring(F.col("text"), acc.at + 1, F.length("text"))
        place = F.when(F.trim(e.title) != "", F.regexp_instr(rest, pattern)).otherwise(0)
        begin = acc.at + place - 1
        end = begin + F.length(F.regexp_substr(rest, pattern))
        hit = F.struct(e.pos.alias("pos"), begin.cast("int").alias("begin"), end.cast("int").alias("end"))
        return F.when(place > 0, F.struct(end.cast("int").alias("at"), F.concat(acc.found, F.array(hit)).alias("found"))).otherwise(acc)

    found = body.join(wanted, ["file", "page_no"]).select("file", "page_no", F.aggregate("wanted", start, step).alias("r"))
    return found.select("file", "page_no", F.inline("r.found"))


def sections(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, pos, topic, page_no, text) from pages (file, page_no, text) and outline entries (file, pos, page_no, title).

    All titles are located first; a section is what stands between its title and the next entry's, over pages
    if need be. Where the next title is not on its page, the section ends with its own page, or with the
    page before the next entry's; the last one takes all pages that follow. Entries that are not found, and
    topics that are not imported, give no section but still end the one before. Everything is joins on
    (file, page_no); an issue's pages meet only where a section runs over them.
    """
    limit = last_pages(entries, pages)
    body = pages.select("file", "page_no", page_body(F.col("text")).alias("text")).join(limit, "file").where("page_no <= last_page")
    listed = accepted(entries).where("page_no is not null").select("file", "pos", "page_no", "title")
    places = title_places(body, listed)
    by_pos = Window.partitionBy("file").orderBy("pos")
    placed = listed.join(places, ["file", "page_no", "pos"], "left").join(limit, "file")
    for name in ("page_no", "begin"):
        placed = placed.withColumn(f"next_{name}", F.lead(name).over(by_pos))
    inside = F.col("next_page_no") <= F.col("last_page")
    placed = placed.withColumns({"next_page_no": F.when(inside, F.col("next_page_no")), "next_begin": F.when(inside, F.col("next_begin"))})
    own = placed.where(F.col("begin").isNotNull() & ~F.col("title").rlike(SKIPPED))
    stops = F.coalesce("next_page_no", F.col("last_page") + 1)  # the page that the section does not fill
    own = own.withColumn("page", F.explode(F.sequence("page_no", F.greatest("page_no", F.when(F.col("next_begin").isNull(), stops - 1).otherwise(stops)))))
    own = own.join(body.select("file", F.col("page_no").alias("page"), F.col("text").alias("body")), ["file", "page"])
    first = F.when(F.col("page") == F.col("page_no"), F.col("end")).otherwise(0)
    last = F.when(F.col("page") == F.col("next_page_no"), F.coalesce("next_begin", F.length("body"))).otherwise(F.length("body"))
    part = F.substring(F.col("body"), first + 1, F.greatest(last - first, F.lit(0)))
    cut = own.select("file", "pos", "title", "page_no", F.struct("page", part.alias("text")).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list("part")), lambda p: F.regexp_replace(p.text, r"\A\n|\n\z", ""))
    return cut.groupBy("file", "pos", "title", "page_no").agg(F.array_join(parts, "\n").alias("text")).select(
        "file", F.col("pos").cast("int").alias("pos"), F.col("title").alias("topic"), "page_no", "text"
    )


def news_records(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """News items (external_id, title, content, url, published_at, full_text, hints) of all issues."""
    cut = sections(pages, entries).withColumn("full_text", F.regexp_replace(dehyphen(F.col("text")), r"\A\s+|\s+\z", ""))
    dated = pages.where("page_no = 1").select("file", german_issue_date(F.col("text")).alias("day"))
    rows = cut.join(dated, "file").withColumns({"t": section_title(F.col("full_text")), "d": section_description(F.col("full_text"))})
    url = F.concat(
        F.lit("/view_pdf/amtsblatt/"), F.regexp_extract("file", r"([^/]*)$", 1), F.lit("?page="), F.col("page_no").cast("string"), F.lit("&title="), F.url_encode(F.substring("t", 1, 100))
    )
    short = F.when(F.length("t") > 250, F.concat(F.substring("t", 1, 247), F.lit("..."))).otherwise(F.col("t"))
    moment = F.to_timestamp(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" 13:26:08.003")))
    return rows.select(
        url.alias("external_id"), short.alias("title"), F.col("d").alias("content"), url.alias("url"), moment.alias("published_at"), "full_text", F.array("topic").alias("hints")
    )
