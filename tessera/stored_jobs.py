"""Named queries over what was written before: catalogs, keys, manifests, points, targets; and over options and registries. The same in DuckDB's SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import hashing
from tessera.functions.attributes import from_json
from tessera.jobs import _BLOCKS, _EVENTS, _SCOPE, AS_OF, CATALOG, SHOWN, _blocks, _contents, _scope, _with_blocks, job
from tessera.model import STATES
from tessera.operators import backup, blobs, cluster, lifecycle, maintain, store
from tessera.plans import query
from tessera.plans.query import AttributeRange, Query
from tessera.scratch import scratch
from tessera.sources import catalog, files, json_store, kv
from tessera.streaming import lifecycle as stream

_written: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The test catalog, a fifth of it in the blank namespace, as written once a session and read back."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        path = scratch(spark, "catalog")
        entries = catalog.from_documents(spark, sf)
        blank = F.when(F.col("tags")["bucket"] == "3", "").otherwise(F.col("namespace_id"))
        catalog.write(entries.withColumn("namespace_id", blank), path)
        _written[key] = path
    return catalog.read(spark, _written[key])


STORED = f"{CATALOG}, st AS (SELECT * REPLACE (CASE WHEN bucket = '3' THEN '' ELSE namespace_id END AS namespace_id) FROM cat)"


def asked(name: str, q: Query, where: str) -> None:
    job(name, f"{STORED} SELECT {SHOWN} FROM st WHERE {where}")(lambda spark, sf: catalog.shown(query.filtered(stored(spark, sf), q)))


asked("q_stored_full_scan", Query(None), "true")
asked("q_stored_namespace", Query("src1"), "namespace_id = 'src1'")
asked("q_stored_blank", Query(""), "namespace_id = ''")
asked("q_stored_prefix", Query("src1", key_prefix="/en/"), "namespace_id = 'src1' AND starts_with(object_key, '/en/')")
asked("q_stored_blank_prefix", Query(key_prefix="/de/", tiers=["Hot", "Archive"]), "namespace_id = '' AND starts_with(object_key, '/de/') AND tier IN ('Hot', 'Archive')")
asked("q_stored_attributes", Query(None, attribute_ranges=[AttributeRange("n_chars", 500, 2000), AttributeRange("ratio", None, 0.99)]), "n_chars BETWEEN 500 AND 2000 AND ratio <= 0.99")
asked("q_stored_size", Query(None, size=(1000, 5000), states=["Available", "Stored"]), "size_bytes BETWEEN 1000 AND 5000 AND state IN ('Available', 'Stored')")


@job("q_stored_pages", f"{STORED} SELECT content_hash, (row_number() OVER (ORDER BY size_bytes DESC, content_hash) - 1) // 20 AS page FROM st WHERE namespace_id = 'src1'")
def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """All pages, by following cursors."""
    walked = query.pages(stored(spark, sf), Query("src1", sort="SizeBytes", descending=True, page_size=20))
    return spark.createDataFrame([(r["content_hash"], k) for k, page in enumerate(walked) for r in page.items], "content_hash string, page long")


@job("q_stored_null_pages", f"{STORED} SELECT content_hash, (row_number() OVER (ORDER BY object_key DESC NULLS LAST, content_hash) - 1) // 50 AS page FROM st WHERE namespace_id = ''")
def _null_pages(spark: SparkSession, sf: str) -> DataFrame:
    """By key, largest first: entries without one come last, and cursors go on among them."""
    walked = query.pages(stored(spark, sf), Query("", sort="ObjectKey", descending=True, page_size=50))
    return spark.createDataFrame([(r["content_hash"], k) for k, page in enumerate(walked) for r in page.items], "content_hash string, page long")


@job("q_point_lookup", f"{STORED} SELECT {SHOWN} FROM st WHERE content_hash = (SELECT min(content_hash) FROM st WHERE namespace_id = '')")
def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    entries = stored(spark, sf)
    return catalog.shown(store.get(entries, entries.where("namespace_id = ''").agg(F.min("content_hash")).first()[0]))


@job("q_get_many_once", f"{CATALOG} SELECT min(d2.doc_id) AS pos, cat.content_hash, any_value(size_bytes) AS size_bytes FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL) d2 JOIN cat ON cat.content_hash = d2.h GROUP BY cat.content_hash")
def _get_once(spark: SparkSession, sf: str) -> DataFrame:
    asks = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("pos"), hashing.content_hash("text").alias("content_hash"))
    return store.get_many(stored(spark, sf), asks, repeats=False).select("pos", "content_hash", "size_bytes")


@job("q_scan_hashes", f"{CATALOG} SELECT content_hash, namespace_id, lang, row_number() OVER (ORDER BY content_hash) AS n FROM cat WHERE content_hash < '1'")
def _scan_hashes(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    few = catalog.scan(catalog.from_documents(spark, sf)).where("content_hash < '1'")
    return few.select("content_hash", "namespace_id", F.col("tags")["lang"].alias("lang"), F.row_number().over(Window.orderBy("content_hash")).cast("long").alias("n"))


# counts stand for results that are empty by definition, beside one that isn't
_EMPTY = {
    "blank namespace": (Query(""), "namespace_id = ''"),
    "no such tag": (Query("src1", tags={"lang": "none"}), "false"),
    "other kind": (Query(None, attribute_ranges=[AttributeRange("n_chars", "a", "z")]), "false"),
    "no tier": (Query(None, tiers=[]), "false"),
    "no state": (Query(None, states=[]), "false"),
    "all": (Query(None), "true"),
}


@job("q_empty_results", f"{STORED} " + " UNION ALL ".join(f"SELECT '{n}' AS what, count(*) AS n FROM st WHERE {w}" for n, (_, w) in _EMPTY.items()))
def _empty(spark: SparkSession, sf: str) -> DataFrame:
    tests = [F.count_if(q.matches()).alias(n) for n, (q, _) in _EMPTY.items()]
    row = stored(spark, sf).agg(*tests)
    return row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in _EMPTY]), F.array(*[F.col(f"`{n}`") for n in _EMPTY]))).alias("what", "n"))


@job("q_clear_rebuild", f"{CATALOG} SELECT * FROM (SELECT 'before' AS what, count(*) AS n FROM cat UNION ALL SELECT 'cleared', 0 UNION ALL SELECT 'rebuilt', 0 UNION ALL SELECT 'put again', count(*) FROM cat WHERE tier = 'Hot')")
def _cleared(spark: SparkSession, sf: str) -> DataFrame:
    entries = catalog.from_documents(spark, sf)
    again = store.upsert(maintain.rebuild(entries), entries.where("tier = 'Hot'"))
    out = None
    for name, rows in (("before", entries), ("cleared", store.clear(entries)), ("rebuilt", maintain.rebuild(entries)), ("put again", again)):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_KV = """WITH t AS (SELECT lpad(page_id::VARCHAR, 8, '0') AS k, coalesce(html, '') AS v FROM pages),
n AS (SELECT k, CASE WHEN right(k, 1) = '3' THEN '' ELSE 'second' END AS v FROM t WHERE right(k, 1) IN ('0', '3') UNION ALL SELECT 'new', 'second'),
a AS (SELECT * FROM t WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n)"""


def _put_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by number, then a batch that has every key twice; a null value last for some."""
    p = spark.read.parquet(f"{sf}/pages.parquet").select(F.lpad(F.col("page_id").cast("string"), 8, "0").alias("k"), F.coalesce("html", F.lit("")).alias("v"))
    some = p.where(F.substring("k", -1, 1).isin("0", "3")).select("k").unionByName(spark.createDataFrame([("new",)], "k string"))
    last = F.when(F.substring("k", -1, 1) != "3", F.lit("second"))
    batch = some.select("k", F.lit("zzz first").alias("v"), F.lit(1).alias("seq")).unionByName(some.select("k", last.alias("v"), F.lit(2).alias("seq")))
    binary = lambda d: d.withColumns({"key": F.col("k").cast("binary"), "value": F.col("v").cast("binary")}).drop("k", "v")
    return kv.put(binary(p), binary(batch))


@job("q_kv_put", f"{_KV} SELECT k, strlen(v)::BIGINT AS n FROM a")
def _kv_put(spark: SparkSession, sf: str) -> DataFrame:
    return _put_keys(spark, sf).select(F.col("key").cast("string").alias("k"), F.octet_length("value").cast("long").alias("n"))


@job("q_kv_get_delete", f"{_KV} SELECT k, strlen(v)::BIGINT AS n, true AS kept FROM a WHERE k = 'new' UNION ALL SELECT min(k), count(*), false FROM a WHERE right(k, 1) <> '0'")
def _kv_delete(spark: SparkSession, sf: str) -> DataFrame:
    t = _put_keys(spark, sf)
    one = kv.get(t, F.lit("new").cast("binary")).select(F.col("key").cast("string").alias("k"), F.octet_length("value").cast("long").alias("n"), F.lit(kv.exists(t, F.lit("new").cast("binary"))).alias("kept"))
    left = kv.delete(t, t.where(F.col("key").cast("string").endswith("0")).select("key"))
    gone = kv.exists(left, F.lit("00000000").cast("binary"))
    return one.unionByName(left.agg(F.min(F.col("key").cast("string")).alias("k"), F.count("*").alias("n")).withColumn("kept", F.lit(gone)))


@job("q_json_round_trip", f"{CATALOG} SELECT {SHOWN} FROM cat")
def _json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "json")
    json_store.write(catalog.from_documents(spark, sf), path)
    return catalog.shown(json_store.read(spark, path))


_TOKENS = """[json_quote(lang), n_chars::VARCHAR, n_chars::VARCHAR || '.5', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END, 'null', '[1,2]', '9' || lpad(n_chars::VARCHAR, 20, '0')][doc_id % 7 + 1]"""


@job("q_json_tokens", f"WITH t AS (SELECT doc_id, doc_id % 7 AS m, lang, n_chars, {_TOKENS.replace('json_quote(lang)', 'chr(34) || lang || chr(34)')} AS token FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL) SELECT doc_id, CASE m WHEN 0 THEN 'string' WHEN 1 THEN 'long' WHEN 2 THEN 'double' WHEN 3 THEN 'bool' WHEN 5 THEN 'string' WHEN 6 THEN 'double' END AS kind, CASE m WHEN 0 THEN lang WHEN 5 THEN '[1,2]' END AS s, CASE WHEN m = 3 THEN doc_id % 2 = 0 END AS b, CASE WHEN m = 1 THEN n_chars::BIGINT END AS l, CASE WHEN m IN (2, 6) THEN token::DOUBLE END AS d FROM t")
def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and n_chars is not null")
    n = F.col("n_chars").cast("string")
    tokens = F.array(F.concat(F.lit('"'), "lang", F.lit('"')), n, F.concat(n, F.lit(".5")), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"), F.lit("null"), F.lit("[1,2]"), F.concat(F.lit("9"), F.lpad(n, 20, "0")))
    a = from_json(F.get(tokens, (F.col("doc_id") % 7).cast("int")))
    return d.select("doc_id", a.alias("a")).select("doc_id", "a.kind", "a.s", "a.b", "a.l", "a.d")


@job("q_cursors", f"""{CATALOG} SELECT content_hash, to_base64(encode('{{"v":' || size_bytes || ',"h":"' || content_hash || '"}}')) AS token, content_hash AS h FROM cat""")
def _cursors(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.from_documents(spark, sf).select("content_hash", hashing.cursor("size_bytes", "content_hash").alias("token"))
    return rows.withColumn("h", hashing.cursor_hash("token"))


@job("q_selectivity", "VALUES ('KeyPrefix', 0.2::DOUBLE, 5::BIGINT), ('Tag', 0.015625, 1), ('Tag', 0.015625, 2), ('Attribute', 0.03125, 3), ('Tier', 0.03125, 4), ('FullScan', 1.0, 6)".join(("SELECT col0 AS what, col1 AS estimate, col2 AS place FROM (", ")")))
def _selectivity(spark: SparkSession, sf: str) -> DataFrame:
    found = query.selectivity(Query(key_prefix="/en/", tags={"a": "1", "b": "2"}, attribute_ranges=[AttributeRange("n", 1, 2)], tiers=["Hot"])) + query.selectivity(Query())
    return spark.createDataFrame([(n, e, i + 1) for i, (n, e) in enumerate(found)], "what string, estimate double, place long")


# targets: the nations' names as files
_FILES = "f AS (SELECT 'n/' || n_regionkey || '/' || n_nationkey || '.txt' AS path, strlen(n_name)::BIGINT AS length, n_nationkey AS k FROM nation)"


def _target(spark: SparkSession, sf: str) -> files.Target:
    """A file for each nation, every fifth written again with a longer name."""
    t = files.Target(spark, scratch(spark, "target"))
    for r in spark.read.parquet(f"{sf}/nation.parquet").select("n_regionkey", "n_nationkey", "n_name").collect():
        for name in [r.n_name, *([r.n_name * 2] if r.n_nationkey % 5 == 0 else [])]:
            t.write(f"n/{r.n_regionkey}/{r.n_nationkey}.txt", name.encode())
    return t


@job("q_target_listing", f"WITH {_FILES} SELECT path, CASE WHEN k % 5 = 0 THEN 2 * length ELSE length END AS length FROM f WHERE starts_with(path, 'n/1/') OR starts_with(path, 'n/2/')")
def _target_listing(spark: SparkSession, sf: str) -> DataFrame:
    t = _target(spark, sf)
    return t.listing("n/1/").unionByName(t.listing("n/2/"))


@job("q_folder_size", f"WITH {_FILES} SELECT sum(CASE WHEN k % 5 = 0 THEN 2 * length ELSE length END)::BIGINT AS bytes FROM f")
def _folder_size(spark: SparkSession, sf: str) -> DataFrame:
    return files.folder_size(spark, _target(spark, sf).root)


@job("q_target_files", f"WITH {_FILES} SELECT path, k % 2 = 1 AS kept, CASE WHEN k % 2 = 1 THEN CASE WHEN k % 5 = 0 THEN 2 * length ELSE length END ELSE -1 END AS length FROM f")
def _target_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every second file deleted; then each asked for."""
    t, out = _target(spark, sf), []
    for r in spark.read.parquet(f"{sf}/nation.parquet").select("n_regionkey", "n_nationkey").collect():
        path = f"n/{r.n_regionkey}/{r.n_nationkey}.txt"
        if r.n_nationkey % 2 == 0:
            t.delete(path)
        held = t.read(path)
        out.append((path, t.exists(path), -1 if held is None else len(held)))
    return spark.createDataFrame(out, "path string, kept boolean, length long")


@job("q_target_resolver", "SELECT col0 AS target_id, col1 AS known FROM (VALUES ('disk', true), ('tape', true), ('none', false))")
def _resolver(spark: SparkSession, sf: str) -> DataFrame:
    targets = files.Targets()
    for name in ("tape", "disk"):
        targets.register(name, files.Target(spark, scratch(spark, name)))

    def known(name: str) -> bool:
        try:
            return targets.resolve(name) is not None
        except KeyError:
            return False

    return spark.createDataFrame([(n, known(n)) for n in [*targets.ids(), "none"]], "target_id string, known boolean")


@job("q_blob_exists", f"{CATALOG}, {_BLOCKS} SELECT content_hash, content_hash IN (SELECT content_hash FROM blocks) AS present FROM cat")
def _exists(spark: SparkSession, sf: str) -> DataFrame:
    return blobs.exists(_blocks(spark, sf), catalog.from_documents(spark, sf))


# a store of chunked objects, whole ones and their entries, from which every second document goes
_ERASED = """w AS (SELECT DISTINCT sha256(text) AS content_hash, hex(encode(text)) AS x, strlen(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL),
gone AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL),
c AS (SELECT content_hash, sha256(unhex(substr(x, (i * 2048 + 1)::INT, 2048))) AS chunk FROM (SELECT *, unnest(range(0, (n + 1023) // 1024)) AS i FROM w WHERE n > 1024))"""


@job("q_erase_entries", f"WITH {_ERASED} SELECT 'entry' AS what, content_hash FROM w WHERE content_hash NOT IN (SELECT h FROM gone) UNION ALL SELECT 'block', content_hash FROM (SELECT content_hash FROM w WHERE n <= 1024 AND content_hash NOT IN (SELECT h FROM gone) UNION SELECT chunk FROM c WHERE content_hash NOT IN (SELECT h FROM gone))")
def _erase_entries(spark: SparkSession, sf: str) -> DataFrame:
    c = _contents(spark, sf)
    gone = blobs.hashed(c.where("doc_id % 2 = 0")).select("content_hash").distinct()
    whole = blobs.hashed(c.where("octet_length(content) <= 1024")).select("content_hash", "content")
    # copies go by their hashes, so that no texts are shuffled
    blocks = whole.unionByName(blobs.chunk_blobs(c, 1024)).dropDuplicates(["content_hash"])
    entries, left, _ = blobs.erase(catalog.from_documents(spark, sf), blocks, blobs.manifest(c, 1024).distinct(), gone)
    return entries.select(F.lit("entry").alias("what"), "content_hash").unionByName(left.select(F.lit("block").alias("what"), "content_hash"))


# ---- lifecycle


@job("q_registry", "SELECT col0 AS \"trigger\", col1 AS from_state, col2 AS to_state, col3 AS again FROM (VALUES ('Freeze', 'Available', 'Archived', 'refused'), ('Thaw', 'Archived', 'Available', 'refused'))")
def _registry(spark: SparkSession, sf: str) -> DataFrame:
    """Transitions registered one after another; one that is there already is refused."""
    r = lifecycle.Registry()
    r.on("Freeze").from_("Available").to("Archived")
    r.on("Thaw").from_("Archived").to("Available")
    try:
        r.on("Thaw").from_("Archived").to("Stored")
        again = "taken"
    except ValueError:
        again = "refused"
    return r.table(spark).withColumn("again", F.lit(again))


@job("q_guards", f"{CATALOG} SELECT content_hash, CASE WHEN state = 'Available' AND size_bytes > 2000 THEN 'Archived' ELSE state END AS state, state = 'Available' AND size_bytes > 2000 AS moved FROM cat")
def _guards(spark: SparkSession, sf: str) -> DataFrame:
    guarded = lifecycle.default_registry(archive=F.col("size_bytes") > 2000)
    return lifecycle.fire(catalog.from_documents(spark, sf), guarded, "Archive").select("content_hash", "state", "moved")


@job("q_observers", f"{CATALOG} SELECT count(*) AS heard, 1::BIGINT AS failed, true AS failed_fast, 3::BIGINT AS tries FROM cat WHERE state = 'Available'")
def _observers(spark: SparkSession, sf: str) -> DataFrame:
    """One observer fails and another hears all the same; a save works at the third try."""
    moved, heard, tries = lifecycle.fire(catalog.from_documents(spark, sf), lifecycle.default_registry(), "Archive"), [], []

    def fails(rows: DataFrame) -> None:
        raise RuntimeError("deaf")

    def save() -> None:
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")

    failed = lifecycle.observe(moved, [fails, lambda rows: heard.append(rows.count())])
    try:
        lifecycle.observe(moved, [fails], fail_fast=True)
        fast = False
    except RuntimeError:
        fast = True
    return spark.createDataFrame([(heard[0], len(failed), fast, lifecycle.persist(save, backoff=0))], "heard long, failed long, failed_fast boolean, tries long")


@job("q_load_states", f"{CATALOG} SELECT content_hash, CASE WHEN bucket IN ('1', '2') THEN state ELSE 'Pending' END AS state FROM cat")
def _load(spark: SparkSession, sf: str) -> DataFrame:
    entries = catalog.from_documents(spark, sf)
    return lifecycle.load_states(entries.select("content_hash"), entries.where(F.col("tags")["bucket"].isin("1", "2"))).select("content_hash", "state")


@job("q_sync_index", f"{CATALOG} SELECT content_hash, CASE WHEN bucket = '1' THEN 'Expired' ELSE state END AS state, CASE WHEN bucket = '1' THEN 'Archive' ELSE tier END AS tier FROM cat")
def _sync(spark: SparkSession, sf: str) -> DataFrame:
    """States and tiers from elsewhere; a blank hash is skipped."""
    entries = catalog.from_documents(spark, sf)
    moved = entries.where(F.col("tags")["bucket"] == "1").select("content_hash", F.lit("Expired").alias("state"), F.lit("Archive").alias("tier"))
    moved = moved.unionByName(spark.createDataFrame([(" ", "Purged", "Hot")], moved.schema))
    return lifecycle.sync_index(entries, moved, AS_OF).select("content_hash", "state", "tier")


def _after(trigger: str) -> str:
    pairs = {"Delete": {"Available": "Deleted", "Archived": "Deleted"}, "Restore": {"Archived": "Available"}, "Purge": {"Deleted": "Purged", "Expired": "Purged"}}[trigger]
    return "CASE " + " ".join(f"WHEN state = '{a}' THEN '{b}'" for a, b in pairs.items()) + " ELSE state END"


def _command(trigger: str) -> None:
    target = {"Delete": "Deleted", "Restore": "Available", "Purge": "Purged"}[trigger]
    unknown = {"Delete": "Deleted", "Restore": "Available", "Purge": "Available"}[trigger]
    sql = f"{CATALOG} SELECT content_hash, {_after(trigger)} AS state, {_after(trigger)} = '{target}' AS succeeded FROM cat UNION ALL SELECT 'unknown', '{unknown}', '{unknown}' = '{target}'"

    @job(f"q_command_{trigger.lower()}", sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """For all entries and a hash that has none, which counts as available."""
        entries = catalog.from_documents(spark, sf)
        asks = entries.select("content_hash").unionByName(spark.createDataFrame([("unknown",)], "content_hash string"))
        return lifecycle.command(entries, asks, trigger, AS_OF)[1]


for _trigger in ("Delete", "Restore", "Purge"):
    _command(_trigger)


@job("q_put_moderated", "WITH p AS (SELECT sha256(text) AS content_hash, strlen(text)::BIGINT AS size_bytes, doc_id, lang IS NOT DISTINCT FROM 'en' AS ok FROM documents WHERE text IS NOT NULL), known AS (SELECT DISTINCT content_hash FROM p WHERE doc_id % 7 <> 0) SELECT 'result' AS what, p.content_hash, size_bytes, ok AS succeeded, p.content_hash IN (SELECT content_hash FROM known) AS deduplicated FROM p UNION ALL SELECT 'entry', content_hash, any_value(size_bytes), true, false FROM p WHERE ok GROUP BY content_hash UNION ALL SELECT 'block', content_hash, any_value(size_bytes), true, false FROM p GROUP BY content_hash")
def _moderated(spark: SparkSession, sf: str) -> DataFrame:
    """Puts of which English ones pass: the others leave their block, and no entry."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    puts = docs.select(F.lit("puts").alias("namespace_id"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("seq"), "lang")
    known = _blocks(spark, sf).select("content_hash", "content")
    blocks, entries, result = lifecycle.put(catalog.from_documents(spark, sf).limit(0), known, puts, AS_OF, F.col("lang") == "en")
    as_rows = lambda d, what: d.select(F.lit(what).alias("what"), "content_hash", "size_bytes", F.lit(True).alias("succeeded"), F.lit(False).alias("deduplicated"))
    out = result.select(F.lit("result").alias("what"), "content_hash", "size_bytes", "succeeded", "deduplicated")
    return out.unionByName(as_rows(entries, "entry")).unionByName(as_rows(blocks.withColumn("size_bytes", F.octet_length("content").cast("long")), "block"))


@job("q_stream_states", f"{_EVENTS} SELECT object_id, max_by(s, i) AS state, max(i)::BIGINT AS n_steps FROM walk GROUP BY 1")
def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files in the order of time, a micro-batch each; the last state of every object."""
    source, out, checkpoint = (scratch(spark, n) for n in ("steps", "states", "stream"))
    steps = lifecycle.triggers_of_events(spark.read.parquet(f"{sf}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = steps.agg(F.min("ts"), F.max("ts")).first()
    for k in range(3):
        a, b = (low + (high - low) * i / 3 for i in (k, k + 1))
        part = steps.where((F.col("ts") >= a) & ((F.col("ts") < b) | F.lit(k == 2)))
        part.coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.states(rows).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema("object_id long, state string, n_steps long").parquet(*[f"{out}/batch={n}" for n in range(3)])
    return seen.groupBy("object_id").agg(F.max_by("state", "n_steps").alias("state"), F.max("n_steps").alias("n_steps"))


# ---- backups


def _scoped(body: str) -> str:
    return f"{CATALOG}, {_BLOCKS}, {_SCOPE} {body}"


@job("q_manifest_saved", _scoped("SELECT 'b1' AS backup_id, content_hash, size_bytes, tags['lang'] AS lang FROM (SELECT *, MAP {'lang': lang} AS tags FROM scope)"))
def _saved(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest saved twice beside another, then read by its id."""
    scope, parent = _scope(spark, sf)
    path, whole = scratch(spark, "manifests"), backup.full(scope, "b1")
    for m in (parent, backup.full(scope.limit(5), "b0"), whole):
        backup.write_manifests(m, path)
    return backup.read_manifest(spark, path, "b1", whole.schema).select("backup_id", "content_hash", "size_bytes", F.col("tags")["lang"].alias("lang"))


@job("q_manifest_override", _scoped("SELECT content_hash, CASE WHEN content_hash IN (SELECT content_hash FROM parent) AND tier = 'Hot' THEN 'moved' ELSE object_key END AS object_key FROM scope WHERE content_hash IN (SELECT content_hash FROM parent)"))
def _override(spark: SparkSession, sf: str) -> DataFrame:
    """Of a hash in both manifests, the new entry."""
    _, parent = _scope(spark, sf)
    new = parent.where("tier = 'Hot'").withColumn("object_key", F.lit("moved"))
    return backup.united(parent, new, "b2").select("content_hash", "object_key")


_RUNS = "SELECT {id} AS backup_id, {kind} AS kind, {parent} AS parent_id, 'Completed' AS status, count(*) AS entry_count, sum(size_bytes)::BIGINT AS total_bytes, sha256(string_agg(content_hash, '' ORDER BY content_hash)) AS digest, {blocks} AS blocks FROM {rows}"


@job("q_backup_run", _scoped(_RUNS.format(id="'b1'", kind="'Full'", parent="NULL", rows="scope WHERE starts_with(object_key, '/en/')", blocks="count_if(content_hash IN (SELECT content_hash FROM blocks))") + " UNION ALL " + _RUNS.format(id="'b2'", kind="'Incremental'", parent="'b1'", rows="scope", blocks="count_if(content_hash IN (SELECT content_hash FROM blocks))")))
def _backup_run(spark: SparkSession, sf: str) -> DataFrame:
    """A full backup of a prefix, run twice, then an incremental one of the whole: points, and the blocks at the target."""
    entries, blocks, root = catalog.from_documents(spark, sf), _blocks(spark, sf), scratch(spark, "backup")
    states, out = ["Available", "Archived", "Stored", "Indexed"], None
    for backup_id, prefix, parent in (("b1", "/en/", None), ("b1", "/en/", None), ("b2", None, "b1")):
        point = backup.run(entries, blocks, root, backup_id, AS_OF, "t", "src1", states, prefix, parent)
        held = backup.target_blocks(spark, root).agg(F.count("*").alias("blocks")).first().blocks
        one = point.select("backup_id", "kind", "parent_id", "status", "entry_count", "total_bytes", "digest", F.lit(held).alias("blocks"))
        out = one if out is None or backup_id == "b1" else out.unionByName(one)
    return out


_POINTS25 = "p AS (SELECT 'b' || n_nationkey AS backup_id, CASE WHEN n_nationkey % 3 = 0 THEN 'Full' ELSE 'Incremental' END AS kind, 't' || n_regionkey AS target_id, n_nationkey AS k FROM nation)"


def _points25(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    k, at = F.col("n_nationkey"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(n_nationkey as int))")
    values = {"backup_id": F.concat(F.lit("b"), k.cast("string")), "kind": F.when(k % 3 == 0, "Full").otherwise("Incremental"), "parent_id": F.lit(None).cast("string"), "target_id": F.concat(F.lit("t"), F.col("n_regionkey").cast("string")), "created_at": at, "status": F.lit("Running"), "namespace_id": F.lit(None).cast("string"), "key_prefix": F.lit(None).cast("string"), "entry_count": k.cast("long"), "total_bytes": k.cast("long") * 10, "digest": F.lit(None).cast("string"), "completed_at": at}
    return n.select(*[v.alias(c) for c, v in values.items()])


@job("q_points_saved", f"WITH {_POINTS25} SELECT backup_id, kind, target_id, CASE WHEN k % 2 = 0 THEN 'Completed' ELSE 'Running' END AS status, k::BIGINT * 10 AS total_bytes FROM p WHERE k % 5 <> 4")
def _points_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Points saved, half of them again as completed, some deleted."""
    path, points = scratch(spark, "points"), _points25(spark, sf)
    backup.write_points(points, path)
    backup.write_points(points.where("entry_count % 2 = 0").withColumn("status", F.lit("Completed")), path)
    left = backup.read_points(spark, path)
    for k in (4, 9, 14, 19, 24):
        left, _ = backup.delete_backup(left, left, f"b{k}")
    return left.select("backup_id", "kind", "target_id", "status", "total_bytes")


@job("q_cancel", f"WITH {_POINTS25} SELECT backup_id, CASE WHEN k = 7 THEN 'Failed' ELSE 'Running' END AS status, CASE WHEN k = 7 THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2024-01-01' + to_days(k::INT) END AS completed_at FROM p")
def _cancel(spark: SparkSession, sf: str) -> DataFrame:
    points = backup.cancel(_points25(spark, sf), "b7", AS_OF)
    return backup.cancel(points, "unknown", AS_OF).select("backup_id", "status", "completed_at")


@job("q_restore_skips", _scoped("SELECT content_hash, CASE WHEN content_hash NOT IN (SELECT content_hash FROM blocks) THEN 'failed' WHEN tier = 'Hot' THEN 'skipped' ELSE 'restored' END AS outcome FROM scope WHERE bucket <> '4'"))
def _restore_skips(spark: SparkSession, sf: str) -> DataFrame:
    """A subset by hashes; blocks that are there already are skipped."""
    scope, _ = _scope(spark, sf)
    wanted = backup.subset(backup.full(scope, "b1"), hashes=scope.where(F.col("tags")["bucket"] != "4").select("content_hash"))
    there = scope.where("tier = 'Hot'").select("content_hash")
    return backup.restored(wanted, _blocks(spark, sf), there).select("content_hash", "outcome")


@job("q_restore_counts", _scoped("SELECT count_if(ok AND tier <> 'Hot')::BIGINT AS restored_count, count_if(ok AND tier = 'Hot')::BIGINT AS skipped_count, count_if(NOT ok)::BIGINT AS failed_count, count_if(NOT ok) = 0 AS succeeded FROM (SELECT *, content_hash IN (SELECT content_hash FROM blocks) AS ok FROM scope WHERE bucket <> '4')"))
def _restore_counts(spark: SparkSession, sf: str) -> DataFrame:
    scope, _ = _scope(spark, sf)
    wanted = backup.subset(backup.full(scope, "b1"), hashes=scope.where(F.col("tags")["bucket"] != "4").select("content_hash"))
    return backup.restore_report(backup.restored(wanted, _blocks(spark, sf), scope.where("tier = 'Hot'").select("content_hash")))


@job("q_restored_entries", _scoped("SELECT cat.content_hash, namespace_id, object_key, state FROM cat WHERE tier = 'Cold' OR content_hash IN (SELECT content_hash FROM scope WHERE content_hash IN (SELECT content_hash FROM blocks))"))
def _restored_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Into a catalog that has lost all but its cold entries."""
    scope, _ = _scope(spark, sf)
    left = catalog.from_documents(spark, sf).where("tier = 'Cold'")
    outcomes = backup.restored(backup.full(scope, "b1"), _blocks(spark, sf))
    return backup.restored_entries(left, outcomes, AS_OF).select("content_hash", "namespace_id", "object_key", "state")


@job("q_garbage", _scoped("SELECT content_hash FROM blocks WHERE content_hash NOT IN (SELECT content_hash FROM scope)"))
def _garbage(spark: SparkSession, sf: str) -> DataFrame:
    return backup.garbage(_blocks(spark, sf), backup.full(_scope(spark, sf)[0], "b1"))


@job("q_rehash", _with_blocks("SELECT content_hash FROM cat WHERE content_hash IN (SELECT content_hash FROM blocks) AND size_bytes % 2 = 0"))
def _rehash(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of an even size have lost a byte."""
    short = F.expr("case when octet_length(content) % 2 = 0 then substring(content, 1, octet_length(content) - 1) else content end")
    whole = _blocks(spark, sf).where("octet_length(content) > 0")
    return backup.rehash(catalog.from_documents(spark, sf), whole.select("content_hash", short.alias("content")).unionByName(_blocks(spark, sf).where("octet_length(content) = 0").select("content_hash", F.lit(b"x").alias("content"))))


_SCHEDULES = "SELECT 's' || s_suppkey AS schedule_id, CASE WHEN s_suppkey % 4 = 0 THEN '0 3 * * *' ELSE '0 1 * * 0' END AS cron, 't' || (s_nationkey % 5) AS target_id FROM supplier WHERE s_suppkey <> 3"


def _schedules(spark: SparkSession, sf: str) -> DataFrame:
    """One for each supplier, every fourth registered again with another time, one taken out."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("schedule_id"), F.lit("0 1 * * 0").alias("cron"), F.concat(F.lit("t"), (F.col("s_nationkey") % 5).cast("string")).alias("target_id"))
    again = s.where("cast(substring(schedule_id, 2) as int) % 4 = 0").withColumn("cron", F.lit("0 3 * * *"))
    return backup.unschedule(backup.schedule(s, again), "s3")


@job("q_schedules", _SCHEDULES)
def _schedule_listing(spark: SparkSession, sf: str) -> DataFrame:
    return backup.schedule_listing(_schedules(spark, sf))


@job("q_schedule_targets", f"SELECT schedule_id, target_id FROM ({_SCHEDULES}) WHERE target_id NOT IN ('t0', 't2')")
def _unknown(spark: SparkSession, sf: str) -> DataFrame:
    return backup.unknown_targets(_schedules(spark, sf), spark.createDataFrame([("t0",), ("t2",)], "target_id string")).select("schedule_id", "target_id")


# ---- cluster, hot set, options


@job("q_pools", "SELECT 'pool' || s_suppkey AS pool_id, s_suppkey % 3 <> 0 AS enabled, false AS chosen FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'pool' || s_suppkey, true, true FROM supplier WHERE s_suppkey % 3 <> 0")
def _pools(spark: SparkSession, sf: str) -> DataFrame:
    """Pools, and which of them a ring over enabled ones can choose."""
    pools = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("pool"), F.col("s_suppkey").cast("string")).alias("pool_id"), (F.col("s_suppkey") % 3 != 0).alias("enabled"))
    chosen = cluster.ring(pools.where("enabled").select(F.col("pool_id").alias("node_id"))).select(F.col("node_id").alias("pool_id"), F.lit(True).alias("on")).distinct()
    return pools.join(chosen, "pool_id", "left").select("pool_id", "enabled", F.coalesce("on", F.lit(False)).alias("chosen"))


@job("q_capacity_changes", "WITH p AS (SELECT 'p' || s_suppkey AS pool_id, least(s_suppkey, 100)::DOUBLE / 100 AS before, least(s_suppkey + 7, 100)::DOUBLE / 100 AS after FROM supplier), s AS (SELECT pool_id, " + ", ".join(f"CASE WHEN {c} >= 0.95 THEN 'Full' WHEN {c} >= 0.85 THEN 'Critical' WHEN {c} >= 0.70 THEN 'Warning' ELSE 'Normal' END AS {a}" for c, a in (("before", "was"), ("after", "state"))) + " FROM p) SELECT pool_id, was, state FROM s WHERE was <> state")
def _changes(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("pool_id"), "s_suppkey")
    state = lambda more: s.select("pool_id", cluster.capacity_state(F.least(F.col("s_suppkey") + more, F.lit(100)).cast("double") / 100).alias("state"))
    return cluster.state_changes(state(0), state(7))


@job("q_topology_version", "SELECT 'node' || n_nationkey AS node_id, 1 AS version FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'node' || n_nationkey, 2 FROM nation")
def _version(spark: SparkSession, sf: str) -> DataFrame:
    nodes = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("node"), F.col("n_nationkey").cast("string")).alias("node_id"), F.when(F.col("n_regionkey") == 1, "Storage").otherwise("Index").alias("role"))
    t = cluster.Topology(nodes)
    first = t.list("Storage")
    return first.select("node_id", "version").unionByName(t.list().select("node_id", "version"))


@job("q_shard_listing", "SELECT 'shard-' || i AS shard_id FROM range(16) t(i)")
def _shard_listing(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.shards(spark, 16)


@job("q_hot_warm", f"{CATALOG}, a AS (SELECT sha256(text) AS h, count(*) AS n, max(doc_id) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, t DESC, h LIMIT 20) SELECT content_hash, size_bytes, tier FROM cat WHERE content_hash IN (SELECT h FROM a) AND tier <> 'Archive'")
def _warm(spark: SparkSession, sf: str) -> DataFrame:
    """The hot set is written, and a catalog without some of it starts warm from the file."""
    reads = _contents(spark, sf).select(hashing.content_hash("content").alias("content_hash"), F.col("doc_id").alias("tick"))
    path = scratch(spark, "hot")
    store.persist_hot(store.hot_set(reads, 20, 2), path)
    return store.warm(catalog.from_documents(spark, sf).where("tier <> 'Archive'"), path).select("content_hash", "size_bytes", "tier")


_WRONG = ("state_machine", "transition_timeout"), ("storage", "pools"), ("index", "default_page_size"), ("backup", "schedules"), ("cluster", "replication"), ("cluster", "node_id"), ("lifecycle", "archive_after")


def _wrong() -> config.Options:
    o = config.Options()
    o.state_machine.transition_timeout = timedelta(0)
    o.index.default_page_size = 5000
    o.backup.schedules = [config.BackupScheduleOptions("s", target_id="none")]
    o.cluster.replication.write_quorum = 1
    o.lifecycle.archive_after = o.lifecycle.delete_after = timedelta(days=1)
    return o


def _right() -> config.Options:
    o = config.Options()
    o.storage.pools = [config.PoolOptions("p", "/data")]
    o.cluster.node_id = "n"
    return o


def _twins() -> config.Options:
    o = _right()
    o.storage.pools.append(config.PoolOptions("p", "/more"))
    return o


@job("q_option_validation", "SELECT col0 AS options, col1 AS domain, col2 AS field FROM (VALUES ('none', 'root', 'options'), ('twins', 'storage', 'pool_id'), " + ", ".join(f"('wrong', '{d}', '{f}')" for d, f in _WRONG) + ")")
def _validation(spark: SparkSession, sf: str) -> DataFrame:
    found = {"none": config.validate(None), "twins": config.validate(_twins()), "wrong": config.validate(_wrong()), "right": config.validate(_right())}
    return spark.createDataFrame([(n, p.domain, p.field) for n, problems in found.items() for p in problems], "options string, domain string, field string")


@job("q_option_reload", "SELECT col0 AS heard, col1 AS problems, col2 AS page_size FROM (VALUES (2::BIGINT, 7::BIGINT, 50::BIGINT))")
def _reload(spark: SparkSession, sf: str) -> DataFrame:
    """Two reloads that hold and one that doesn't; one subscriber leaves after the first."""
    told: list[str] = []
    notifier = config.Notifier(_right())
    leave = notifier.subscribe(lambda o: told.append("a"))
    small = _right()
    small.index.default_page_size = 50
    notifier.reload(small)
    leave()
    notifier.subscribe(lambda o: told.append("b"))
    problems = notifier.reload(_wrong())
    notifier.reload(notifier.current)
    return spark.createDataFrame([(len(told), len(problems), notifier.current.index.default_page_size)], "heard long, problems long, page_size long")


@job("q_initial_states", "WITH e AS (SELECT DISTINCT user_id AS object_id FROM events) SELECT object_id, ([" + ", ".join(repr(s) for s in STATES) + "])[object_id % 9 + 1] AS state FROM e")
def _initial(spark: SparkSession, sf: str) -> DataFrame:
    """A fold over triggers that nothing knows leaves every object where it was."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("object_id"), "ts", F.col("event_id").alias("seq"), F.lit("Nothing").alias("trigger"))
    was = e.select("object_id").distinct().withColumn("state", catalog.pick(STATES, F.col("object_id")))
    return lifecycle.fold(e, was).select("object_id", "state")

