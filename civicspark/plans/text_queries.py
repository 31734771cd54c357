"""Registered queries of the text, search, upsert and streaming operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions import dates, text
from civicspark.operators import items, merge, retag, search, tagging
from civicspark.operators.search_index import StreetIndex
from civicspark.operators.versions import SnapshotStore
from civicspark.plans.derived import as_of, gazetteer, geo_items, haversine_sql, lat, lng, street_names, subscriptions, table, tag_gazetteer, with_tables
from civicspark.storage import over_all_cores, shared_folder, shared_table
from civicspark.streaming.jobs import alert_stream, landed, sent_alerts


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_all_cores(table(spark, sf_dir, "documents").select("doc_id", "text", F.array("source").alias("hints")))


def text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.text_hits(_docs(spark, sf_dir), gazetteer(spark, sf_dir)).select("doc_id", "name", "start", "length")


def keyed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits by keys, as for a gazetteer that no task can hold."""
    return tagging.text_hits(_docs(spark, sf_dir), gazetteer(spark, sf_dir), max_terms=0).select("doc_id", "name", "start", "length", "is_longest")


def hit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.text_hits(_docs(spark, sf_dir), gazetteer(spark, sf_dir), only_longest=True).select("doc_id", "name", "start")


def _numbered_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, in which a number follows each long word."""
    number = F.concat(F.lit("$1 "), (1 + F.col("doc_id") % 15).cast("string"), F.lit(" "))
    return _docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", F.lit(r"(\p{L}{4,}) "), number))


MENTION = ("doc_id", "kind", "target_id", "name", "district", "resolution")


def tag_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets, house numbers and places of all texts."""
    return tagging.tag_text(_numbered_docs(spark, sf_dir), *tag_gazetteer(spark, sf_dir)).select(*MENTION)


def retag_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mentions, first those of a part of the gazetteer, then by difference those of the whole one."""
    docs, new = _numbered_docs(spark, sf_dir), tag_gazetteer(spark, sf_dir)
    old = tuple(t.where("id % 40 > 0") for t in new)
    before = shared_table(tagging.tag_text(docs, *old))
    path = shared_folder(spark, "words")
    retag.store_index(retag.word_index(docs), path)
    return retag.retag(docs, before, spark.read.parquet(path), old, new).select(*MENTION)


def street_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.street_normalize(F.col("text")).alias("clean"))


def dehyphen(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.replace(F.col("text"), F.lit("ti"), F.lit("ti-\n"))  # every syllable "ti" ends a line
    return _docs(spark, sf_dir).select("doc_id", text.dehyphen(broken).alias("joined"))


def title_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n"))
    return _docs(spark, sf_dir).select("doc_id", text.section_title(spaced).alias("title"), text.section_description(spaced).alias("description"))


def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = street_names(spark, sf_dir)
    asked = names.select(F.upper(F.substring("name", 1, 2)).alias("search")).distinct()
    out = search.search_prefix(asked, names)
    return out.select("search", "name", "district", "street_number_count", F.col("rank").cast("long").alias("rank"))


def search_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = street_names(spark, sf_dir)
    asked = names.select(F.explode(F.split("name", " ")).alias("search")).distinct()
    out = search.with_duplicate_mark(search.search_contains(asked, names))
    return out.select("search", "name", "district", "street_number_count", F.col("cost").cast("long").alias("cost"), F.col("rank").cast("long").alias("rank"), "is_duplicate")


def search_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches in other inflections than the names, by a stored index that half of the names came into later and some left."""
    k = F.col("o_orderkey")
    pick = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))
    number = (k % 1000).cast("string")
    named = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(pick("Alter Garten ", "Alte Gärten ", "Neues Haus ", "Neue Häuser "), number).alias("name"), F.col("o_orderstatus").alias("district"), k.alias("street_number_count")
    )
    index = StreetIndex(spark, shared_folder(spark, "streets"), buckets=16)
    index.upsert(named.where("id % 2 = 0").withColumn("name", F.when(F.col("id") % 10 == 0, F.lit("Umbenannt")).otherwise(F.col("name"))))
    index.upsert(named.where("id % 2 = 1 or id % 10 = 0"), named.where("id % 14 = 2"))
    p = table(spark, sf_dir, "part").select(F.concat(F.element_at(F.array(F.lit("der alte Gärten "), F.lit("neuen Hauses ")), (F.col("p_partkey") % 2 + 1).cast("int")), (F.col("p_partkey") % 100).cast("string")).alias("search")).distinct()
    return index.search(p).select("search", "name", "district", "street_number_count", F.col("rank").cast("long").alias("rank"))


def _snapshot_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Finished orders are the snapshot; a batch renames those of high priority and brings the others."""
    columns = ("id", "source_id", "external_id", "title", "state", "hidden", "inserted_at")
    all_items = geo_items(spark, sf_dir).select(*columns, F.col("participation_open").alias("status"))
    old = all_items.where("not status").drop("status").withColumn("updated_at", F.col("inserted_at"))
    batch = all_items.where("status or title = '1-URGENT'").select(
        "source_id", "external_id", F.upper(F.concat("title", F.lit(" new"))).alias("title"), "state", "hidden", F.col("id").alias("seq"),
        F.when(F.col("status"), F.array(F.lit("title"), F.lit("state"), F.lit("hidden"))).otherwise(F.array(F.lit("title"))).alias("present"),
    )
    earlier = batch.withColumn("title", F.lit("overwritten")).withColumn("seq", F.col("seq") - 1)
    return old, batch.unionByName(earlier)


UPSERTED = ("source_id", "external_id", "title", "state", "hidden", "inserted_at", "updated_at")


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, batch = _snapshot_and_batch(spark, sf_dir)
    return merge.merge_snapshot(old, batch, ["source_id", "external_id"], as_of()).select(*UPSERTED)


def _store(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """A stored snapshot after three versions: the snapshot, the batch's items of source 3, and without the old items of source 4."""
    old, batch = _snapshot_and_batch(spark, sf_dir)
    store = SnapshotStore(spark, shared_folder(spark, "snapshot"), ["source_id", "external_id"], 16)
    store.store(old)
    store.merge(batch.where("source_id = 3"), as_of())
    store.delete(old.where("source_id = 4"))
    return store


def upsert_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch on a stored snapshot, item by item of one source, as the version after it has it."""
    return _store(spark, sf_dir).read(2).select(*UPSERTED)


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed from the first version of a stored snapshot to the last."""
    return _store(spark, sf_dir).changes(1).select("op", *UPSERTED)


def reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = geo_items(spark, sf_dir).withColumn("state", F.when(F.col("hidden"), F.lit("unheard of")).otherwise(F.col("state")))
    marked = marked.withColumn("title", F.when(F.col("title") == "5-LOW", F.lit("")).otherwise(F.col("title")))
    return merge.validate(marked)[1].select("id", "reason")


def quarter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    label = F.concat(F.quarter("o_orderdate").cast("string"), F.lit(". Quartal "), F.year("o_orderdate").cast("string"))
    ntz = lambda c: c.cast("timestamp_ntz")
    return o.select("o_orderkey", ntz(dates.quarter_start(label)).alias("date_start"), ntz(dates.quarter_end(label)).alias("date_end"))


def status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(F.lit("aul"), F.lit("bbg"), F.lit("imVerfahren"), F.lit("festg"), F.lit("other")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"))
    return o.select("o_orderkey", items.plan_state(F.col("code")).alias("state"), items.plan_open(F.col("code")).alias("participation_open"), items.state_label(items.plan_state(F.col("code"))).alias("label"))


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    out = text.main_text(pages)
    return out.select("page_id", text.without_contacts(F.col("main_text")).alias("main_text"), F.size("links").cast("long").alias("n_links"))


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of items against all subscriptions; what was sent is read back."""
    source = table(spark, sf_dir, "events")
    stream = landed(spark, sf_dir, source.schema, pathGlobFilter="events.parquet")
    new = stream.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("inserted_at"), lng("event_id").alias("lng"), lat("event_id").alias("lat")
    )
    folder = shared_folder(spark, "alerts")
    alert_stream(new, lambda: subscriptions(spark, sf_dir), folder).awaitTermination()
    return sent_alerts(spark, folder).select("user_id", "kind", "id")


QUERIES = {
    f.__name__: f
    for f in (
        text_hits, keyed_hits, hit_overlap, tag_mentions, retag_growth, street_normalize, dehyphen, title_description, search_prefix, search_contains, search_stems, upsert_snapshot, upsert_stored, snapshot_changes,
        reject_split, quarter_dates, status_map, main_text, stream_alerts,
    )
}

#: A hit ends where a run of letters and digits ends, and names are letters: hits are ends of runs.
_HITS = r""", runs as (
    select doc_id, text, source, unnest(string_split_regex(text, '[^\p{L}\p{Nd}]')) as run, generate_subscripts(string_split_regex(text, '[^\p{L}\p{Nd}]'), 1) as k from documents
), ended as (
    select *, cast(sum(length(run) + 1) over (partition by doc_id order by k) - 1 as bigint) as last from runs
), hits as (
    select doc_id, source, name, cast(last - n + 1 as bigint) as start, n as length from (select *, unnest(range(4, length(run) + 1)) as n from ended)
    join (select distinct name from gazetteer) on name = right(run, n) where n < length(run) or last = n or text[last - n] <> '-'
)"""
_MENTIONS = r"""
with words as (
    select distinct unnest(string_split(text, ' ')) as name from benchmark
), numbered as (
    select name, cast('0x' || md5(name)[1:12] as bigint) as n from words where regexp_full_match(name, '\p{L}{4,}')
), gazetteer as (
    select n as id, name, 'src' || (n % 20) as district, (['Park', 'School', 'LOR'])[n % 3 + 1] as type from numbered where n % 4 > 0
    union all select n + 1, name, 'src' || ((n + 7) % 20), (['Park', 'School', 'LOR'])[n % 3 + 1] from numbered where n % 12 = 3
), streets as (
    select n as id, name, 'src' || (n % 20) as district from numbered where n % 2 = 0
    union all select n + 1, name, 'src' || ((n + 3) % 20) from numbered where n % 10 = 0
), numbers as (
    select id * 16 + k as id, id as geo_street_id, k || case when k % 3 = 0 then 'A' else '' end as number from streets, range(1, 16) t(k) where k <= 2 + id % 14
), docs as (
    select doc_id, source, regexp_replace(regexp_replace(text, '(\p{L}{4,}) ', '\1 ' || (1 + doc_id % 15) || ' ', 'g'), '\s+', ' ', 'g') as text from documents
), named as (
    select name, bool_or(s) as is_street, bool_or(not s) as is_place from (select name, true as s from streets union all select name, false from gazetteer) group by name
), runs as (
    select doc_id, text, source, unnest(string_split_regex(text, '[^\p{L}\p{Nd}]')) as run, generate_subscripts(string_split_regex(text, '[^\p{L}\p{Nd}]'), 1) as k from docs
), ended as (
    select *, cast(sum(length(run) + 1) over (partition by doc_id order by k) - 1 as bigint) as last from runs
), hits as (
    select doc_id, text, source, name, is_street, is_place, cast(last - n + 1 as bigint) as start, n as length
    from (select *, unnest(range(4, length(run) + 1)) as n from ended) join named on name = right(run, n) where n < length(run) or last = n or text[last - n] <> '-'
), street_hits as (
    select doc_id, name, start, upper(replace(regexp_extract(text[start + length + 1:start + length + 10], '^(\d+(\s*[a-zA-Z])?)'), ' ', '')) as number from hits a
    where is_street and not exists (
        select 1 from hits b where b.is_street and a.doc_id = b.doc_id and a.start < b.start + b.length and b.start < a.start + a.length and (a.name, a.start) <> (b.name, b.start)
        and (b.length > a.length or b.length = a.length and (b.start, b.name) < (a.start, a.name)))
), found as (
    select h.doc_id, h.start, h.name, h.number, regexp_extract(h.number, '^\d+') as plain, s.id as street_id, s.district, count(*) over (partition by s.name, h.doc_id, h.start) as n_streets
    from street_hits h join streets s using (name)
), looked as (
    select f.*, n1.id as id1, n2.id as id2, count(n1.id) over w as c1, count(n2.id) over w as c2 from found f
    left join numbers n1 on n1.geo_street_id = f.street_id and n1.number = f.number left join numbers n2 on n2.geo_street_id = f.street_id and n2.number = f.plain
    where f.number <> '' window w as (partition by f.doc_id, f.start, f.name)
), street as (
    select doc_id, start, name, district, street_id as target, false as is_number, n_streets = 1 as sure from found where number = ''
    union all select doc_id, start, name, district, id1, true, c1 = 1 from looked where id1 is not null
    union all select doc_id, start, name, district, id2, true, c2 = 1 from looked where c1 = 0 and id2 is not null
    union all select doc_id, start, name, district, street_id, false, true from looked where c1 = 0 and c2 = 0
), counted as (
    select *, count(*) over (partition by name) as n, case type when 'Park' then 1 when 'School' then 2 when 'LOR' then 3 else 9 end as rank from gazetteer
), place as (
    select distinct h.doc_id, g.* from (select distinct doc_id, name from hits where is_place) h join counted g using (name)
), relevant as (
    select doc_id, district from place where n = 1 union select doc_id, district from street where sure union select doc_id, source from documents
), guessed as (
    select *, count(*) over (partition by doc_id, start, name, is_number) as c from street s
    where not sure and exists (select 1 from relevant r where r.doc_id = s.doc_id and r.district = s.district)
), streets_left as (
    select doc_id, name, district, target, is_number, 'certain' as resolution from street where sure
    union all select doc_id, name, district, target, is_number, 'district' from guessed where c = 1
), chosen as (
    select *, row_number() over (partition by doc_id, name order by rank, id) as best from place c
    where n > 1 and exists (select 1 from relevant r where r.doc_id = c.doc_id and r.district = c.district)
), places_left as (
    select doc_id, name, district, id as target, type, 'certain' as resolution from place where n = 1
    union all select doc_id, name, district, id, type, 'district' from chosen where best = 1
), without_lor as (
    select * from places_left p where type <> 'LOR'
        or not exists (select 1 from streets_left s where not s.is_number and s.doc_id = p.doc_id and (s.name = p.name or s.district = p.district))
)
select doc_id, kind, target as target_id, name, district, min(resolution) as resolution from (
    select doc_id, 'street' as kind, target, name, district, resolution from streets_left s
    where not is_number and not exists (select 1 from without_lor p where p.doc_id = s.doc_id and p.name = s.name)
    union all select doc_id, 'street_number', target, name, district, resolution from streets_left where is_number
    union all select doc_id, 'place', target, name, district, resolution from without_lor p
    where not exists (select 1 from streets_left s where s.is_number and s.doc_id = p.doc_id and s.name = p.name)
) group by all"""
_SPACE = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"
_LOW = "translate(lower(name), 'äöü', 'aou')"
_ENUM = "((?:[A-Za-z0-9_]*-), )*(?:[A-Za-z0-9_]*-) und [A-Za-z0-9_]*straße"

ORACLES = {
    "text_hits": with_tables("gazetteer") + _HITS + " select doc_id, name, start, length from hits",
    "keyed_hits": with_tables("gazetteer")
    + _HITS
    + """ select doc_id, name, start, length, not exists (
        select 1 from hits b where a.doc_id = b.doc_id and a.start < b.start + b.length and b.start < a.start + a.length and (a.name, a.start) <> (b.name, b.start)
        and (b.length > a.length or b.length = a.length and (b.start, b.name) < (a.start, a.name))) as is_longest from hits a""",
    "hit_overlap": with_tables("gazetteer")
    + _HITS
    + """ select doc_id, name, start from hits a where not exists (
        select 1 from hits b where a.doc_id = b.doc_id and a.start < b.start + b.length and b.start < a.start + a.length and (a.name, a.start) <> (b.name, b.start)
        and (b.length > a.length or b.length = a.length and (b.start, b.name) < (a.start, a.name)))""",
    "tag_mentions": _MENTIONS,
    "retag_growth": _MENTIONS,
    "street_normalize": r"""
with spelt as (
    select doc_id, regexp_replace(replace(replace(replace(replace(text, 'Strasse', 'Straße'), 'Str.', 'Straße'), 'strasse', 'straße'), 'str.', 'straße'), '\s+', ' ', 'g') as t
    from documents
), found as (
    select *, regexp_extract(t, '((?:[A-Za-z0-9_]*-), )*(?:[A-Za-z0-9_]*-) und [A-Za-z0-9_]*straße') as phrase from spelt
)
select doc_id, case when phrase <> '' then replace(t, phrase, replace(replace(phrase, '-, ', 'straße, '), '- und ', 'straße und ')) else t end as clean from found""",
    "dehyphen": r"""
with broken as (
    select doc_id, array_to_string(list_transform(string_split(replace(text, 'ti', 'ti-' || chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), chr(10)) as t
    from documents
), first as (
    select doc_id, regexp_replace(t, '(\p{Ll}\p{Ll})-\n+(\p{Ll}\p{Ll})', '\1\2', 'g') as t from broken
), second as (
    select doc_id, regexp_replace(t, '(\p{Ll}\p{Ll})-\n+(\p{Ll}\p{Ll})', '\1\2', 'g') as t from first
)
select doc_id, regexp_replace(t, '-\n+', '-', 'g') as joined from second""",
    "title_description": r"""
with spaced as (
    select doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) as t from documents
)
select doc_id,
       case when regexp_matches(t, '\n\s*\n') then replace(replace(regexp_extract(t, '(?s)\A(.*?)\n\s*\n', 1), chr(10), ' '), '  ', ' ') else regexp_extract(t, '\A([^\n]*)', 1) end as title,
       trim(string_split_regex(regexp_extract(t, '(?s)\A.*?\n\s*\n(.*)', 1), '[.:]\n')[1], ' ' || chr(9) || chr(10) || chr(13)) as description
from spaced""",
    "search_prefix": with_tables("street_names")
    + """, asked as (
    select distinct upper(name[1:2]) as search from street_names
)
select * from (
    select search, name, district, street_number_count, row_number() over (partition by search order by street_number_count desc, name, district) as rank
    from asked join street_names on starts_with(lower(name), lower(search))
) where rank <= 10""",
    "search_contains": with_tables("street_names")
    + """, asked as (
    select distinct unnest(string_split(name, ' ')) as search from street_names
), found as (
    select *, length(name) - length(search) as cost from asked join street_names on length(search) >= 3 and contains(lower(name), lower(search))
), ranked as (
    select search, name, district, street_number_count, cost, row_number() over (partition by search order by street_number_count desc, cost, name, district) as rank from found
)
select *, count(*) over (partition by search, name) > 1 as is_duplicate from ranked where rank <= 10""",
    "search_stems": """with n as (
    select o_orderkey as k, o_orderkey % 4 // 2 as stem, cast(o_orderkey % 1000 as varchar) as number, o_orderstatus as district,
           (['Alter Garten ', 'Alte Gärten ', 'Neues Haus ', 'Neue Häuser '])[o_orderkey % 4 + 1] || (o_orderkey % 1000) as name
    from orders where o_orderkey % 14 <> 2 or o_orderkey % 10 = 0
), s as (
    select distinct p_partkey % 2 as stem, cast(p_partkey % 100 as varchar) as number, (['der alte Gärten ', 'neuen Hauses '])[p_partkey % 2 + 1] || (p_partkey % 100) as search from part
)
select * from (select search, name, district, k as street_number_count, row_number() over (partition by search order by k desc) as rank from s join n on s.stem = n.stem and starts_with(n.number, s.number))
where rank <= 10""",
    "upsert_snapshot": with_tables("geo_items")
    + """ select source_id, external_id, case when participation_open or title = '1-URGENT' then upper(title || ' new') else title end as title, state, hidden,
       case when participation_open then timestamp '2001-08-01' else inserted_at end as inserted_at,
       case when participation_open or title = '1-URGENT' then timestamp '2001-08-01' else inserted_at end as updated_at
    from geo_items""",
    "upsert_stored": with_tables("geo_items")
    + """, told as (select *, source_id = 3 and (participation_open or title = '1-URGENT') as hit from geo_items where not participation_open or source_id = 3)
    select source_id, external_id, case when hit then upper(title || ' new') else title end as title, state, hidden,
       case when participation_open then timestamp '2001-08-01' else inserted_at end as inserted_at, case when hit then timestamp '2001-08-01' else inserted_at end as updated_at
    from told""",
    "snapshot_changes": with_tables("geo_items")
    + """, told as (select *, source_id = 3 and (participation_open or title = '1-URGENT') as hit from geo_items where source_id in (3, 4) and (not participation_open or source_id = 3))
    select case when source_id = 4 then 'delete' when participation_open then 'insert' else 'update' end as op, source_id, external_id,
       case when hit then upper(title || ' new') else title end as title, state, hidden,
       case when participation_open then timestamp '2001-08-01' else inserted_at end as inserted_at, case when hit then timestamp '2001-08-01' else inserted_at end as updated_at
    from told where hit or source_id = 4""",
    "reject_split": with_tables("geo_items")
    + """ select id, case when title = '5-LOW' then 'title is missing' else 'state is unknown' end as reason from geo_items where title = '5-LOW' or hidden""",
    "quarter_dates": """
with q as (select o_orderkey, date_trunc('quarter', o_orderdate) as s, date_trunc('quarter', o_orderdate) + interval 3 months - interval 1 day as e from orders)
select o_orderkey, (s at time zone 'Europe/Berlin') at time zone 'UTC' as date_start, (e at time zone 'Europe/Berlin') at time zone 'UTC' as date_end from q""",
    "status_map": """
with coded as (select o_orderkey, (['aul', 'bbg', 'imVerfahren', 'festg', 'other'])[o_orderkey % 5 + 1] as code from orders)
select o_orderkey, case when code in ('aul', 'bbg', 'imVerfahren') then 'in_planning' when code = 'festg' then 'finished' end as state,
       code in ('aul', 'bbg', 'imVerfahren') as participation_open,
       case when code in ('aul', 'bbg', 'imVerfahren') then 'In Planung' when code = 'festg' then 'Abgeschlossen' end as label
from coded""",
    "stream_alerts": with_tables("subscriptions")
    + f""", new as (
    select event_id as id, event_type as kind,
           cast(13.08 as double) + cast(event_id * 7919 % 10007 as double) / cast(10007 as double) * cast(0.68 as double) as lng,
           cast(52.33 as double) + cast(event_id * 104729 % 10009 as double) / cast(10009 as double) * cast(0.35 as double) as lat
    from events
)
select distinct s.user_id, i.kind, i.id from subscriptions s join new i on i.lat between s.lat - 0.03 and s.lat + 0.03 and {haversine_sql("s.lng", "s.lat", "i.lng", "i.lat")} <= s.radius_m""",
}
