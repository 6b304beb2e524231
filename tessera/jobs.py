"""Named queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.model import STATES, TIERS, TRANSITIONS
from tessera.operators import backup, blobs, cluster, lifecycle, maintain, store
from tessera.plans import query
from tessera.plans.query import AttributeRange, Query
from tessera.sources import catalog, kv

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = datetime(2024, 6, 1)
CHUNK = 1024

SHOWN = "content_hash, namespace_id, object_key, lang, bucket, n_chars, quality, ratio, tier, size_bytes, content_type, created_at, modified_at, state"


def _case(values: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({index}) % {len(values)} + 1]"


#: The catalog over ``documents`` and ``labels``, as ``sources.catalog.from_documents`` has it.
CATALOG = f"""WITH once AS (
  SELECT sha256(text) AS content_hash, max_by(struct_pack(doc_id := doc_id, lang := lang, source := source, n_chars := n_chars, size := strlen(text)), doc_id) AS d
  FROM documents WHERE text IS NOT NULL GROUP BY 1
), q AS (SELECT doc_id, max(quality)::BIGINT AS quality FROM labels GROUP BY 1),
cat AS (
  SELECT content_hash, coalesce(d.source, 'default') AS namespace_id, d.doc_id AS doc_id,
    CASE WHEN d.doc_id % 97 <> 0 THEN '/' || d.lang || '/' || lpad(d.doc_id::VARCHAR, 8, '0') || '.txt' END AS object_key,
    d.lang AS lang, (d.doc_id % 5)::VARCHAR AS bucket, d.n_chars AS n_chars, q.quality::VARCHAR AS quality,
    d.n_chars::DOUBLE / nullif(d.size::DOUBLE, 0) AS ratio, {_case(TIERS, "d.doc_id")} AS tier, d.size::BIGINT AS size_bytes, 'text/plain' AS content_type,
    TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) + to_hours(d.doc_id % 7) AS modified_at,
    {_case(STATES, "d.doc_id")} AS state
  FROM once LEFT JOIN q ON q.doc_id = d.doc_id
)
"""


def job(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def asked(name: str, q: Query, where: str) -> None:
    """A query and its WHERE."""
    job(name, f"{CATALOG} SELECT {SHOWN} FROM cat WHERE {where}")(lambda spark, sf: catalog.shown(query.filtered(catalog.from_documents(spark, sf), q)))


asked("q_ns_scan", Query("src1"), "namespace_id = 'src1'")
asked("q_full_scan", Query(None), "true")
asked("q_ns_blank", Query(""), "namespace_id = ''")
asked("q_prefix", Query("src1", key_prefix="/en/"), "namespace_id = 'src1' AND starts_with(object_key, '/en/')")
asked("q_prefix_empty", Query(None, key_prefix=""), "object_key IS NOT NULL")
asked("q_tag", Query(None, tags={"lang": "de"}), "lang = 'de'")
asked("q_tags_and", Query(None, key_prefix="/en/", tags={"lang": "en", "bucket": "1"}), "starts_with(object_key, '/en/') AND lang = 'en' AND bucket = '1'")
asked("q_attr_range", Query(None, attribute_ranges=[AttributeRange("n_chars", 500, 2000)]), "n_chars BETWEEN 500 AND 2000")
asked("q_attr_missing", Query(None, attribute_ranges=[AttributeRange("quality", 1, 1)]), "quality = '1'")
asked("q_attr_double", Query(None, attribute_ranges=[AttributeRange("ratio", 0.97, None), AttributeRange("quality", None, None)]), "ratio >= 0.97 AND quality IS NOT NULL")
asked("q_attr_kinds", Query(None, attribute_ranges=[AttributeRange("n_chars", 99.5, 1500.5)]), "n_chars BETWEEN 99.5 AND 1500.5")
asked("q_attr_mismatch", Query(None, attribute_ranges=[AttributeRange("n_chars", "a", "z")]), "false")
asked("q_tier_in", Query(None, tiers=["Cold", "Archive"]), "tier IN ('Cold', 'Archive')")
asked("q_tier_none", Query(None, tiers=[]), "false")
asked("q_state_in", Query(None, states=["Available"], tiers=["Cold"]), "state = 'Available' AND tier = 'Cold'")
asked("q_created", Query(None, created=(datetime(2024, 1, 1, 3), datetime(2024, 1, 1, 9))), "created_at BETWEEN TIMESTAMP '2024-01-01 03:00:00' AND TIMESTAMP '2024-01-01 09:00:00'")
asked("q_modified", Query(None, modified=(None, datetime(2024, 1, 1, 9))), "modified_at <= TIMESTAMP '2024-01-01 09:00:00'")
asked("q_size", Query(None, size=(1000, 100_000)), "size_bytes BETWEEN 1000 AND 100000")
asked("q_no_match", Query("src1", tags={"lang": "none"}), "false")
asked(
    "q_conjunction",
    Query("src1", key_prefix="/", tags={"lang": "en"}, attribute_ranges=[AttributeRange("n_chars", 100, None)], tiers=["Hot", "Cold", "Warm"], states=["Available", "Archived", "Stored", "Purged"], created=(datetime(2024, 1, 1), None), modified=(None, datetime(2025, 1, 1)), size=(1, None)),
    "namespace_id = 'src1' AND starts_with(object_key, '/') AND lang = 'en' AND n_chars >= 100 AND tier IN ('Hot', 'Cold', 'Warm') AND state IN ('Available', 'Archived', 'Stored', 'Purged') AND created_at >= TIMESTAMP '2024-01-01' AND modified_at <= TIMESTAMP '2025-01-01' AND size_bytes >= 1",
)


def _order(field: str, descending: bool) -> str:
    return f"{query.SORTS.get(field, 'created_at')} {'DESC NULLS LAST' if descending else 'ASC NULLS FIRST'}, content_hash ASC"


def sorted_job(field: str, descending: bool) -> None:
    q = Query("src1", sort=field, descending=descending)
    name = {"SizeBytes": "size", "ObjectKey": "key", "CreatedAt": "created", "ModifiedAt": "modified", "ContentHash": "hash", "Nonsense": "unknown"}[field]
    sql = f"{CATALOG} SELECT content_hash, row_number() OVER (ORDER BY {_order(field, descending)}) AS position FROM cat WHERE namespace_id = 'src1'"
    job(f"q_sort_{name}_{'desc' if descending else 'asc'}", sql)(lambda spark, sf: query.ranked(catalog.from_documents(spark, sf), q).select("content_hash", "position"))


for _field in ("SizeBytes", "ObjectKey", "CreatedAt", "ModifiedAt", "ContentHash"):
    for _down in (False, True):
        sorted_job(_field, _down)
sorted_job("Nonsense", False)


@job("q_page_first", f"{CATALOG} SELECT content_hash, size_bytes FROM cat WHERE namespace_id = 'src1' ORDER BY size_bytes DESC NULLS LAST, content_hash LIMIT 11")
def _page_first(spark: SparkSession, sf: str) -> DataFrame:
    return query.page_frame(catalog.from_documents(spark, sf), Query("src1", sort="SizeBytes", descending=True, page_size=10)).select("content_hash", "size_bytes")


@job("q_page_next", f"{CATALOG} SELECT content_hash, size_bytes FROM cat WHERE namespace_id = 'src1' ORDER BY size_bytes DESC NULLS LAST, content_hash LIMIT 11 OFFSET 10")
def _page_next(spark: SparkSession, sf: str) -> DataFrame:
    entries = catalog.from_documents(spark, sf)
    first = query.page(entries, Query("src1", sort="SizeBytes", descending=True, page_size=10))
    rows = entries if first.has_more else store.clear(entries)
    return query.page_frame(rows, Query("src1", sort="SizeBytes", descending=True, page_size=10, cursor=first.next_cursor)).select("content_hash", "size_bytes")


@job("q_page_walk", f"{CATALOG} SELECT content_hash, (row_number() OVER (ORDER BY {_order('ObjectKey', False)}) - 1) // 7 AS page FROM cat WHERE namespace_id = 'src1'")
def _page_walk(spark: SparkSession, sf: str) -> DataFrame:
    rows = query.ranked(catalog.from_documents(spark, sf), Query("src1", sort="ObjectKey"))
    return rows.select("content_hash", F.floor((F.col("position") - 1) / 7).cast("long").alias("page"))


@job("q_get_many", f"{CATALOG} SELECT d2.doc_id AS pos, cat.content_hash, size_bytes FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL) d2 JOIN cat ON cat.content_hash = d2.h")
def _get_many(spark: SparkSession, sf: str) -> DataFrame:
    """Every document asks for its own content."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    asks = docs.select(F.col("doc_id").alias("pos"), hashing.content_hash("text").alias("content_hash"))
    return store.get_many(catalog.from_documents(spark, sf), asks).select("pos", "content_hash", "size_bytes")


@job("q_upsert", f"{CATALOG} SELECT content_hash, CASE WHEN bucket = '1' THEN 'moved' ELSE namespace_id END AS namespace_id, CASE WHEN bucket = '1' THEN 'Purged' ELSE state END AS state, size_bytes FROM cat")
def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    entries = catalog.from_documents(spark, sf)
    new = entries.where(F.col("tags")["bucket"] == "1").withColumn("namespace_id", F.lit("moved"))
    old = new.withColumn("state", F.lit("Pending")).withColumn("seq", F.lit(1))
    new = old.unionByName(new.withColumn("state", F.lit("Purged")).withColumn("seq", F.lit(2)))
    return store.upsert(entries, new, "seq").select("content_hash", "namespace_id", "state", "size_bytes")


_PATCHED = "bucket IN ('1', '2')"


@job(
    "q_patch_merge",
    f"""{CATALOG} SELECT content_hash, namespace_id, object_key, CASE WHEN {_PATCHED} THEN 'xx' ELSE lang END AS lang, CASE WHEN {_PATCHED} THEN NULL ELSE bucket END AS bucket,
  CASE WHEN {_PATCHED} THEN 'new' END AS extra, CASE WHEN {_PATCHED} THEN NULL ELSE quality END AS quality, CASE WHEN {_PATCHED} THEN 'Cold' ELSE tier END AS tier,
  CASE WHEN {_PATCHED} THEN TIMESTAMP '2024-06-01' ELSE modified_at END AS modified_at FROM cat
  UNION ALL SELECT 'unknown', 'default', NULL, 'xx', NULL, 'new', NULL, 'Cold', TIMESTAMP '2024-06-01'""",
)
def _patch(spark: SparkSession, sf: str) -> DataFrame:
    entries = catalog.from_documents(spark, sf)
    hashes = entries.where(F.col("tags")["bucket"].isin("1", "2")).select("content_hash").unionByName(spark.createDataFrame([("unknown",)], "content_hash string"))
    change = hashes.select("content_hash", F.create_map(F.lit("lang"), F.lit("xx"), F.lit("extra"), F.lit("new")).alias("tags"), F.lit("Cold").alias("tier"), F.array(F.lit("bucket")).alias("remove_tags"), F.array(F.lit("quality")).alias("remove_attributes"))
    out = store.patch(entries, change, AS_OF)
    t = F.col("tags")
    return out.select("content_hash", "namespace_id", "object_key", t["lang"].alias("lang"), t["bucket"].alias("bucket"), t["extra"].alias("extra"), F.col("attributes")["quality"]["l"].cast("string").alias("quality"), "tier", "modified_at")


@job("q_delete", f"{CATALOG} SELECT content_hash, state FROM cat WHERE tier <> 'Hot'")
def _delete(spark: SparkSession, sf: str) -> DataFrame:
    entries = catalog.from_documents(spark, sf)
    return store.delete(entries, entries.where("tier = 'Hot'")).select("content_hash", "state")


@job("q_clear", f"{CATALOG} SELECT content_hash FROM cat WHERE false")
def _clear(spark: SparkSession, sf: str) -> DataFrame:
    return store.clear(catalog.from_documents(spark, sf)).select("content_hash")


@job("q_index_from_put", "SELECT sha256(text) AS content_hash, any_value('puts') AS namespace_id, any_value(strlen(text))::BIGINT AS size_bytes, any_value('Hot') AS tier, any_value('Available') AS state, any_value(TIMESTAMP '2024-06-01') AS created_at FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _put(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    puts = docs.select(F.lit("puts").alias("namespace_id"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("seq"))
    empty = catalog.from_documents(spark, sf).limit(0)
    _, entries, _ = lifecycle.put(empty, spark.createDataFrame([], "content_hash string, content binary"), puts, AS_OF)
    return entries.select("content_hash", "namespace_id", "size_bytes", "tier", "state", "created_at")


@job("q_kv_range", "SELECT hex(encode(url)) AS k, strlen(html)::BIGINT AS n FROM pages WHERE encode(url) >= encode('http://m') AND encode(url) < encode('https://n')")
def _kv(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("url").cast("binary").alias("key"), F.col("html").cast("binary").alias("value"))
    found = kv.scan(rows, F.lit("http://m").cast("binary"), F.lit("https://n").cast("binary"))
    return found.select(F.hex("key").alias("k"), F.octet_length("value").cast("long").alias("n"))


@job("q_sha256", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _sha(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", hashing.content_hash("text").alias("content_hash"))


def stable_sql(text: str) -> str:
    """The stable hash in DuckDB: 128-bit sums, then back to 64 bits."""
    terms = " + ".join(f"('0x' || substr(sha256({text}), {2 * k + 1}, 2))::HUGEINT * {pow(31, 15 - k, 1 << 64)}::HUGEINT" for k in range(16))
    m = f"(({terms}) % 18446744073709551616::HUGEINT)"
    return f"(CASE WHEN {m} >= 9223372036854775808::HUGEINT THEN {m} - 18446744073709551616::HUGEINT ELSE {m} END)::BIGINT"


@job("q_stable_hash", f"SELECT DISTINCT source, {stable_sql('source')} AS h FROM documents WHERE source IS NOT NULL")
def _stable(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").where("source is not null").select("source").distinct().withColumn("h", hashing.stable_hash("source"))


@job("q_paths", f"{CATALOG} SELECT content_hash, 'blocks/' || content_hash[1:2] || '/' || content_hash[3:4] || '/' || content_hash AS block, 'manifests/' || content_hash[1:2] || '/' || content_hash[3:4] || '/' || content_hash || '.manifest' AS manifest FROM cat")
def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.from_documents(spark, sf).select("content_hash", hashing.block_path("content_hash").alias("block"), hashing.manifest_path("content_hash").alias("manifest"))


def _contents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))


@job("q_dedup", "SELECT sha256(text) AS content_hash, any_value(strlen(text))::BIGINT AS size_bytes FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) GROUP BY 1")
def _dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What all documents add to a store that has every third."""
    c = _contents(spark, sf)
    return blobs.new_blobs(c, blobs.hashed(c.where("doc_id % 3 = 0"))).select("content_hash", "size_bytes")


# chunks of bytes: hex digits, two a byte, cut and turned back
_CHUNKS = f"""WITH t AS (SELECT DISTINCT sha256(text) AS content_hash, hex(encode(text)) AS x, strlen(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL),
m AS (SELECT content_hash, n AS total_size, {CHUNK}::BIGINT AS chunk_size, i::INT AS pos, (i * {CHUNK})::BIGINT AS begin, least((i + 1) * {CHUNK}, n)::BIGINT AS "end", unhex(substr(x, (i * {2 * CHUNK} + 1)::INT, {2 * CHUNK})) AS piece
  FROM (SELECT *, unnest(range(0, (n + {CHUNK - 1}) // {CHUNK})) AS i FROM t WHERE n > {CHUNK}))
"""


@job("q_chunks", f'{_CHUNKS} SELECT content_hash, total_size, chunk_size, pos, begin, "end", sha256(piece) AS chunk_hash FROM m')
def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return blobs.manifest(_contents(spark, sf).select("content").distinct(), CHUNK)


@job("q_range_read", "SELECT doc_id, substr(hex(encode(text)), 201, 100) AS slice FROM documents WHERE text IS NOT NULL")
def _range(spark: SparkSession, sf: str) -> DataFrame:
    return blobs.read_range(_contents(spark, sf), 100, 50).select("doc_id", F.hex("slice").alias("slice"))


@job("q_chunk_range", f"{_CHUNKS} SELECT content_hash, substr(x, {2 * 1021 + 1}, 18) AS slice FROM t WHERE n > {CHUNK}")
def _chunk_range(spark: SparkSession, sf: str) -> DataFrame:
    c = _contents(spark, sf).select("content").distinct()
    return blobs.read_chunked(blobs.manifest(c, CHUNK), blobs.chunk_blobs(c, CHUNK), 1021, 9).select("content_hash", F.hex("slice").alias("slice"))


@job("q_erase", f'{_CHUNKS}, gone AS (SELECT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) SELECT DISTINCT sha256(piece) AS content_hash FROM m WHERE content_hash NOT IN (SELECT h FROM gone)')
def _erase(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks left after every second document's content is erased."""
    c = _contents(spark, sf)
    gone = blobs.hashed(c.where("doc_id % 2 = 0")).select("content_hash").distinct()
    # copies go by their hashes, so that no texts are shuffled
    m, b = blobs.manifest(c, CHUNK).distinct(), blobs.chunk_blobs(c, CHUNK)
    entries = spark.createDataFrame([], "content_hash string")
    return blobs.erase(entries, b, m, gone)[1].select("content_hash")


@job("q_transitions", " UNION ALL ".join(f"SELECT '{t}' AS \"trigger\", '{a}' AS from_state, '{b}' AS to_state" for t, a, b in TRANSITIONS))
def _transitions(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.default_registry().table(spark)


_EVENTS = """WITH RECURSIVE e AS (
  SELECT user_id AS object_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
    CASE WHEN event_id %% 5 = 0 AND event_type <> 'error' THEN CASE event_type WHEN 'signup' THEN 'Restore' WHEN 'view' THEN 'Expire' WHEN 'click' THEN 'Delete' WHEN 'purchase' THEN 'Purge' END
      ELSE CASE event_type WHEN 'signup' THEN 'Put' WHEN 'view' THEN 'Index' WHEN 'click' THEN 'Audit' WHEN 'purchase' THEN 'Publish' WHEN 'error' THEN 'Archive' END END AS t
  FROM events
), tr(t, a, b) AS (VALUES %s),
walk AS (
  SELECT object_id, 0::BIGINT AS i, 'Pending' AS s FROM (SELECT DISTINCT object_id FROM e)
  UNION ALL SELECT w.object_id, e.i, coalesce(tr.b, w.s) FROM walk w JOIN e ON e.object_id = w.object_id AND e.i = w.i + 1 LEFT JOIN tr ON tr.t = e.t AND tr.a = w.s
)""" % ", ".join(f"('{t}', '{a}', '{b}')" for t, a, b in TRANSITIONS)


@job("q_state_fold", f"{_EVENTS} SELECT object_id, max_by(s, i) AS state, max(i)::BIGINT AS n_steps FROM walk GROUP BY 1")
def _fold(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.fold(lifecycle.triggers_of_events(spark.read.parquet(f"{sf}/events.parquet")))


@job("q_state_counts", f"{_EVENTS} SELECT state, count(*) AS n FROM (SELECT max_by(s, i) AS state FROM walk GROUP BY object_id) GROUP BY 1")
def _fold_counts(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["q_state_fold"](spark, sf).groupBy("state").agg(F.count("*").alias("n"))


@job("q_state_versions", "SELECT user_id::VARCHAR AS content_hash, max_by(event_type, event_id) AS state, count(*) AS version FROM events GROUP BY 1")
def _versions(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return lifecycle.versions(e.select(F.col("user_id").cast("string").alias("content_hash"), F.col("event_type").alias("state"), F.col("event_id").alias("seq")))


_AFTER = "CASE " + " ".join(f"WHEN state = '{a}' THEN '{b}'" for t, a, b in TRANSITIONS if t == "Archive") + " ELSE state END"


@job("q_index_sync", f"{CATALOG} SELECT content_hash, {_AFTER} AS state, CASE WHEN state = 'Available' THEN 'Cold' ELSE tier END AS tier, CASE WHEN state = 'Available' THEN TIMESTAMP '2024-06-01' ELSE modified_at END AS modified_at FROM cat")
def _sync(spark: SparkSession, sf: str) -> DataFrame:
    """Archive everything that can be."""
    entries = catalog.from_documents(spark, sf)
    out, _ = lifecycle.archive(entries, entries.select("content_hash"), AS_OF)
    return out.select("content_hash", "state", "tier", "modified_at")


@job("q_lifecycle_scan", f"{CATALOG} SELECT content_hash, namespace_id, CASE WHEN size_bytes > 4000 THEN 'Expire' ELSE 'Archive' END AS \"trigger\" FROM cat WHERE state = 'Available' AND (size_bytes > 4000 OR created_at < TIMESTAMP '2024-01-01 08:00:00')")
def _scan(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.scan(catalog.from_documents(spark, sf), F.col("created_at") < F.lit(datetime(2024, 1, 1, 8)).cast("timestamp_ntz"), F.col("size_bytes") > 4000)


@job("q_event_topics", f"{CATALOG} SELECT content_hash, 'object.delete' AS topic, '[state-machine] ' || state || ' --(Delete)--> Deleted' AS line FROM cat WHERE state IN ('Available', 'Archived')")
def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.transition_log(lifecycle.fire(catalog.from_documents(spark, sf), lifecycle.default_registry(), "Delete"), "Delete")


@job("q_get_content", f"{CATALOG} SELECT cat.content_hash, CASE WHEN state = 'Available' THEN least(strlen(t.text) - least(10, strlen(t.text)), 20) ELSE -1 END::BIGINT AS length, CASE WHEN state = 'Available' THEN content_type END AS content_type FROM cat JOIN (SELECT sha256(text) AS h, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1) t ON t.h = content_hash")
def _get(spark: SparkSession, sf: str) -> DataFrame:
    entries = catalog.from_documents(spark, sf)
    blocks = blobs.new_blobs(_contents(spark, sf))
    return lifecycle.get(entries, blocks, entries, 10, 20).select("content_hash", F.coalesce("length", F.lit(-1).cast("long")).alias("length"), "content_type")


# blocks of every document whose id isn't a multiple of 7, by content
_BLOCKS = "blocks AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL)"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blobs.new_blobs(_contents(spark, sf).where("doc_id % 7 <> 0"))


def _with_blocks(body: str) -> str:
    return f"{CATALOG}, {_BLOCKS} {body}"


@job("q_verify", _with_blocks("SELECT content_hash FROM cat WHERE content_hash NOT IN (SELECT content_hash FROM blocks)"))
def _verify(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.missing(catalog.from_documents(spark, sf), _blocks(spark, sf))


@job("q_verify_report", _with_blocks("SELECT count(*) AS n_entries, count(*) - count(b.content_hash) AS n_missing, count(*) = count(b.content_hash) AS is_consistent FROM cat LEFT JOIN blocks b ON b.content_hash = cat.content_hash"))
def _verify_report(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.verify(catalog.from_documents(spark, sf), _blocks(spark, sf))


@job("q_repair", _with_blocks("SELECT content_hash, state FROM cat WHERE content_hash IN (SELECT content_hash FROM blocks)"))
def _repair(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.repair(catalog.from_documents(spark, sf), _blocks(spark, sf)).select("content_hash", "state")


# the parent of a backup of src1 holds what was created by 05:00
_SCOPE = "scope AS (SELECT * FROM cat WHERE namespace_id = 'src1' AND state IN ('Available', 'Archived', 'Stored', 'Indexed')), parent AS (SELECT * FROM scope WHERE created_at <= TIMESTAMP '2024-01-01 05:00:00')"


def _scoped(body: str) -> str:
    return f"{CATALOG}, {_BLOCKS}, {_SCOPE} {body}"


def _scope(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    scope = backup.candidates(catalog.from_documents(spark, sf), "src1", ["Available", "Archived", "Stored", "Indexed"])
    return scope, backup.full(scope.where(F.col("created_at") <= F.lit(datetime(2024, 1, 1, 5)).cast("timestamp_ntz")), "b1")


@job("q_backup_candidates", _scoped("SELECT content_hash, size_bytes FROM scope"))
def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _scope(spark, sf)[0].select("content_hash", "size_bytes")


@job("q_backup_incremental", _scoped("SELECT content_hash, size_bytes FROM scope WHERE content_hash NOT IN (SELECT content_hash FROM parent)"))
def _added(spark: SparkSession, sf: str) -> DataFrame:
    return backup.added(*_scope(spark, sf)).select("content_hash", "size_bytes")


@job("q_manifest_union", _scoped("SELECT 'b2' AS backup_id, content_hash, object_key, 'blocks/' || content_hash[1:2] || '/' || content_hash[3:4] || '/' || content_hash AS block_path FROM scope"))
def _union(spark: SparkSession, sf: str) -> DataFrame:
    return backup.incremental(*_scope(spark, sf), "b2").select("backup_id", "content_hash", "object_key", "block_path")


@job("q_manifest_digest", f"{CATALOG} SELECT namespace_id AS backup_id, sha256(string_agg(content_hash, '' ORDER BY content_hash)) AS digest FROM cat GROUP BY 1")
def _digest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest for each namespace."""
    return backup.digests(catalog.from_documents(spark, sf).withColumn("backup_id", F.col("namespace_id")))


@job("q_backup_totals", f"{CATALOG} SELECT namespace_id AS backup_id, count(*) AS entry_count, sum(size_bytes)::BIGINT AS total_bytes FROM cat GROUP BY 1")
def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return backup.totals(catalog.from_documents(spark, sf).withColumn("backup_id", F.col("namespace_id")))


_POINTS = "WITH points AS (SELECT o_orderkey::VARCHAR AS backup_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Full' ELSE 'Incremental' END AS kind, o_orderdate AS created_at, 't' || (o_custkey % 4) AS target_id, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Failed' ELSE 'Running' END AS status FROM orders)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as backup points."""
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Failed").otherwise("Running")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_orderkey").cast("string").alias("backup_id"), F.when(F.col("o_orderkey") % 3 == 0, "Full").otherwise("Incremental").alias("kind"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("target_id"), status.alias("status"))


@job("q_backup_list", f"{_POINTS} SELECT * FROM points WHERE kind = 'Full' AND target_id = 't1' AND created_at >= TIMESTAMP '1995-01-01'")
def _listing(spark: SparkSession, sf: str) -> DataFrame:
    return backup.listing(_points(spark, sf), "Full", datetime(1995, 1, 1), "t1")


@job("q_latest_completed", f"{_POINTS} SELECT * FROM points WHERE status = 'Completed' ORDER BY created_at DESC, backup_id LIMIT 1")
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    return backup.latest_completed(_points(spark, sf))


@job("q_restore_subset", _scoped("SELECT content_hash, CASE WHEN content_hash IN (SELECT content_hash FROM blocks) THEN 'restored' ELSE 'failed' END AS outcome FROM scope WHERE starts_with(object_key, '/en/')"))
def _restore(spark: SparkSession, sf: str) -> DataFrame:
    manifest = backup.full(_scope(spark, sf)[0], "b1")
    return backup.restored(backup.subset(manifest, key_prefix="/en/", namespace="src1"), _blocks(spark, sf)).select("content_hash", "outcome")


@job("q_restore_report", _scoped("SELECT count_if(content_hash IN (SELECT content_hash FROM blocks))::BIGINT AS restored_count, 0::BIGINT AS skipped_count, count_if(content_hash NOT IN (SELECT content_hash FROM blocks))::BIGINT AS failed_count, count_if(content_hash NOT IN (SELECT content_hash FROM blocks)) = 0 AS succeeded FROM scope"))
def _restore_report(spark: SparkSession, sf: str) -> DataFrame:
    return backup.restore_report(backup.restored(backup.full(_scope(spark, sf)[0], "b1"), _blocks(spark, sf)))


@job("q_backup_verify", _with_blocks("SELECT namespace_id AS backup_id, count(b.content_hash) AS verified_count, count(*) - count(b.content_hash) AS missing_count, count(*) = count(b.content_hash) AS ok FROM cat LEFT JOIN blocks b ON b.content_hash = cat.content_hash GROUP BY 1"))
def _backup_verify(spark: SparkSession, sf: str) -> DataFrame:
    return backup.verify(catalog.from_documents(spark, sf).withColumn("backup_id", F.col("namespace_id")), _blocks(spark, sf))


# suppliers of the first nations as nodes and pools
_NODES = "nodes AS (SELECT 'node' || n_nationkey AS node_id, CASE WHEN n_regionkey = 0 THEN 'Storage' ELSE 'Index' END AS role, n_regionkey AS r FROM nation)"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return n.select(F.concat(F.lit("node"), F.col("n_nationkey").cast("string")).alias("node_id"), F.when(F.col("n_regionkey") == 0, "Storage").otherwise("Index").alias("role"), F.col("n_regionkey").alias("r"))


def _ring_sql(virtual: int) -> str:
    text = "node_id || ':' || i"
    return f"ring AS (SELECT {stable_sql(text)} AS point, max(node_id) AS node_id FROM (SELECT node_id, unnest(range(0, {virtual})) AS i FROM nodes) GROUP BY 1)"


@job("q_ring", f"WITH {_NODES}, {_ring_sql(96)} SELECT * FROM ring")
def _ring(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.ring(_nodes(spark, sf))


_KEYS = f"keys AS (SELECT DISTINCT 'block:' || sha256(text) AS k FROM documents WHERE text IS NOT NULL), hashed AS (SELECT k, {stable_sql('k')} AS h FROM keys)"


@job("q_disk_select", f"WITH {_NODES}, {_ring_sql(128)}, {_KEYS} SELECT substr(k, 7) AS content_hash, coalesce((SELECT min_by(node_id, point) FROM ring WHERE point >= h), (SELECT min_by(node_id, point) FROM ring)) AS pool_id FROM hashed")
def _disk(spark: SparkSession, sf: str) -> DataFrame:
    pools = _nodes(spark, sf).select(F.col("node_id").alias("pool_id"), F.lit(True).alias("enabled"))
    return cluster.select_pool(catalog.from_documents(spark, sf), pools).select("content_hash", "pool_id")


@job(
    "q_select_nodes",
    f"""WITH {_NODES}, {_ring_sql(96)}, keys AS (SELECT DISTINCT source AS k FROM documents WHERE source IS NOT NULL), hashed AS (SELECT k, {stable_sql('k')} AS h FROM keys),
  far AS (SELECT k, node_id, min(CASE WHEN point >= h THEN point::HUGEINT ELSE point::HUGEINT + 18446744073709551616::HUGEINT END) AS far_off FROM hashed, ring GROUP BY 1, 2)
  SELECT k, node_id, n FROM (SELECT k, node_id, row_number() OVER (PARTITION BY k ORDER BY far_off) AS n FROM far) WHERE n <= 3""",
)
def _select(spark: SparkSession, sf: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf}/documents.parquet").where("source is not null").select(F.col("source").alias("k")).distinct()
    placed = cluster.select_nodes(keys, "k", _nodes(spark, sf), 3)
    return placed.select("k", F.posexplode("nodes").alias("n", "node_id")).select("k", "node_id", (F.col("n") + 1).cast("long").alias("n"))


@job("q_shards", f"SELECT DISTINCT source, 'shard-' || (abs({stable_sql('source')}) % 4) AS shard_id FROM documents WHERE source IS NOT NULL")
def _shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("source is not null").select("source").distinct()
    return cluster.resolve_shard(rows, 4, "source")


@job(
    "q_capacity",
    f"""{CATALOG}, pools AS (SELECT 'src' || s_suppkey AS pool_id, (s_suppkey * 20000)::BIGINT AS capacity FROM supplier),
  p AS (SELECT pool_id, coalesce(sum(size_bytes), 0)::BIGINT AS used, any_value(capacity) AS capacity FROM pools LEFT JOIN cat ON namespace_id = pool_id GROUP BY 1),
  r AS (SELECT pool_id, sum(used)::BIGINT AS used_bytes, sum(capacity)::BIGINT AS capacity_bytes FROM p GROUP BY ROLLUP (pool_id))
  SELECT *, CASE WHEN u >= 0.95 THEN 'Full' WHEN u >= 0.85 THEN 'Critical' WHEN u >= 0.70 THEN 'Warning' ELSE 'Normal' END AS state FROM (SELECT *, u AS used_ratio FROM (SELECT *, CASE WHEN capacity_bytes = 0 THEN 0.0::DOUBLE ELSE used_bytes::DOUBLE / capacity_bytes END AS u FROM r))""".replace("SELECT *, CASE WHEN u", "SELECT pool_id, used_bytes, capacity_bytes, used_ratio, CASE WHEN u"),
)
def _capacity(spark: SparkSession, sf: str) -> DataFrame:
    """Namespaces as pools, their size by supplier number."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    pools = s.select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("pool_id"), (F.col("s_suppkey").cast("long") * 20000).alias("capacity_bytes"))
    usage = catalog.from_documents(spark, sf).select(F.col("namespace_id").alias("pool_id"), "size_bytes")
    return cluster.capacity(usage, pools)


@job("q_topology_role", f"WITH {_NODES} SELECT node_id, role FROM nodes WHERE role = 'Storage'")
def _topology(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.topology(_nodes(spark, sf), "Storage").select("node_id", "role")


@job("q_tiers", "SELECT p_brand AS tier, max_by(p_size, p_partkey) AS priority FROM part GROUP BY 1")
def _tiers(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.tiers(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("tier"), F.col("p_size").alias("priority"), F.col("p_partkey").alias("seq")))


@job("q_rebalance_moves", f"WITH {_NODES}, {_KEYS}, all_ring AS (SELECT * FROM (WITH {_ring_sql(128)} SELECT * FROM ring)), less AS (SELECT * FROM (WITH less_nodes AS (SELECT * FROM nodes WHERE r <> 1), {_ring_sql(128).replace('FROM nodes', 'FROM less_nodes')} SELECT * FROM ring)), o AS (SELECT k, coalesce((SELECT min_by(node_id, point) FROM less WHERE point >= h), (SELECT min_by(node_id, point) FROM less)) AS from_pool, coalesce((SELECT min_by(node_id, point) FROM all_ring WHERE point >= h), (SELECT min_by(node_id, point) FROM all_ring)) AS to_pool FROM hashed) SELECT substr(k, 7) AS content_hash, from_pool, to_pool FROM o WHERE from_pool <> to_pool")
def _moves(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that move when a region's nodes join."""
    pools = _nodes(spark, sf).select(F.col("node_id").alias("pool_id"), "r", F.lit(True).alias("enabled"))
    return cluster.moved(catalog.from_documents(spark, sf), pools.where("r <> 1"), pools).select("content_hash", "from_pool", "to_pool")


@job("q_hot_set", "SELECT user_id::VARCHAR AS content_hash, count(*) AS accesses, max(event_id) AS last_tick FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(*) >= 3 ORDER BY accesses DESC, last_tick DESC, content_hash LIMIT 50")
def _hot(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'view'")
    return store.hot_set(e.select(F.col("user_id").cast("string").alias("content_hash"), F.col("event_id").alias("tick")), 50)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Namespace, prefix and tag, largest first, the first page."""
    q = Query("src1", key_prefix="/en/", tags={"lang": "en"}, sort="SizeBytes", descending=True, page_size=10)
    return catalog.shown(query.page_frame(catalog.from_documents(spark, sf), q))


job("q_flagship", f"{CATALOG} SELECT {SHOWN} FROM cat WHERE namespace_id = 'src1' AND starts_with(object_key, '/en/') AND lang = 'en' ORDER BY size_bytes DESC, content_hash LIMIT 11")(flagship)
