"""Works, masters and commentary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.operators import enrich, masters
from listingmill.registry.base import query, sql
from listingmill.sources import testdata as td


def selected(spark, d) -> DataFrame:
    return masters.select_master_works(td.seeds(spark, d), td.works(spark, d))


def catalogue_of_masters(spark, d) -> DataFrame:
    return masters.master_catalogue(td.seeds(spark, d), selected(spark, d), td.commentary(spark, d))


@query(
    "select_master_works",
    sql("sel", "SELECT master_id, source || '-' || oid AS work_id, CAST(rank AS BIGINT) AS rank, CASE WHEN source = 'aic' AND oid IN (SELECT CAST(k0 AS VARCHAR) FROM seed WHERE id = master_id) THEN 'Renamed ' || oid ELSE title END AS title FROM sel"),
)
def select_master_works(spark, d):
    return selected(spark, d).select("master_id", "work_id", F.col("rank").cast("long").alias("rank"), "title")


@query(
    "masters_selection_report",
    sql("sel", "SELECT seed.id AS master_id, count(sel.oid) AS works, count(sel.oid) = 0 AS dropped FROM seed LEFT JOIN sel ON seed.id = sel.master_id GROUP BY seed.id"),
)
def masters_selection_report(spark, d):
    return masters.selection_report(td.seeds(spark, d), selected(spark, d))


@query(
    "fetch_works_by_id",
    sql(
        "w seed",
        """SELECT DISTINCT s.id AS master_id, CAST(p.pos AS BIGINT) AS pos, w.oid AS object_id, w.title FROM seed s CROSS JOIN (VALUES (0), (1)) p(pos)
        JOIN w ON w.source = 'aic' AND w.k = CASE p.pos WHEN 0 THEN s.k1 ELSE s.k0 END""",
    ),
)
def fetch_works_by_id(spark, d):
    wanted = td.seeds(spark, d).select(F.col("id").alias("master_id"), F.posexplode("sources").alias("list_pos", "s"))
    wanted = wanted.select("master_id", "list_pos", "s.source", F.transform("s.object_ids", lambda o: F.concat(F.lit("id_"), o)).alias("object_ids"))
    aliases = td.table(spark, d, "part").selectExpr("concat('id_', p_partkey) AS from_id", "CAST(p_partkey AS STRING) AS to_id")
    rows = masters.works_by_id(wanted.filter(F.size("object_ids") > 0), td.works(spark, d), aliases)
    return rows.select("master_id", F.col("pos").cast("long").alias("pos"), F.col("source_object_id").alias("object_id"), "title")


@query(
    "dedupe_works_by_image",
    sql("w", "SELECT master_id, image_url, min(seq) AS seq FROM w GROUP BY master_id, image_url"),
)
def dedupe_works_by_image(spark, d):
    """All works of all masters; those without an image count as one image."""
    return masters.dedupe_by_image(td.works(spark, d)).select("master_id", "image_url", "seq")


def finds(spark, d) -> DataFrame:
    """Search hits per brand: files of the brand's parts crediting several people."""
    return td.table(spark, d, "part").selectExpr(
        "p_brand AS master_id", "p_partkey AS seq",
        """CASE p_partkey % 8 WHEN 0 THEN concat('File:Portrait of Ann ', p_brand, '.jpg') WHEN 1 THEN concat('File:Ann ', p_brand, ' (c. 1899).jpg')
           WHEN 2 THEN concat('File:Ann ', p_brand, ' - ', p_name, '.jpg') ELSE concat('File:', p_name, ' ', p_brand, '.png') END AS file_name""",
        "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '<a>Someone Else</a>' ELSE concat('<b>Ann ', p_brand, '</b>') END AS artist",
        "IF(p_partkey % 7 = 0, 'Paintings of cats', 'Photographs') AS categories",
        "CASE p_partkey % 3 WHEN 0 THEN 'CC0' WHEN 1 THEN 'Public domain' ELSE 'CC BY 4.0' END AS licence",
        "concat('https://img.example.org/', p_partkey) AS image_url",
    )


@query(
    "artist_credit_match",
    """SELECT * FROM (SELECT p_brand AS master_id, p_partkey AS seq, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part
    WHERE p_partkey % 5 <> 1 AND p_partkey % 8 > 1 AND p_partkey % 7 <> 0 AND p_partkey % 3 <> 2) WHERE rank <= 10""",
)
def artist_credit_match(spark, d):
    who = td.table(spark, d, "part").select("p_brand").distinct().selectExpr("p_brand AS master_id", "concat('Ann ', p_brand) AS query", "p_brand AS needle")
    return masters.credit_match(finds(spark, d), who).select("master_id", "seq", F.col("rank").cast("long").alias("rank"))


@query(
    "work_title_year",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' & co' WHEN 1 THEN p_name || ' x' ELSE 'Untitled' END AS title,
    CASE WHEN p_partkey % 2 = 0 THEN CAST(1800 + p_partkey % 200 AS VARCHAR) END AS year, p_partkey % 4 <> 3 AS pd FROM part""",
)
def work_title_year(spark, d):
    name = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('<i>', p_name, '</i> &amp; co') WHEN 1 THEN repeat('long ', 40) ELSE '' END")
    file = F.expr("CASE p_partkey % 3 WHEN 1 THEN concat('File:', replace(p_name, ' ', '_'), '_x.jpeg') ELSE 'File:.jpg' END")
    taken = F.expr("IF(p_partkey % 2 = 0, concat('<time>circa ', 1800 + p_partkey % 200, '</time>'), 'n.d. 2011')")
    licence = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Public Domain' WHEN 1 THEN 'CC0 1.0' WHEN 2 THEN 'PD-old' ELSE 'CC BY-SA' END")
    return td.table(spark, d, "part").select(
        "p_partkey", masters.file_title(name, file).alias("title"), masters.work_year(taken).alias("year"), masters.is_public_domain(licence).alias("pd")
    )


@query(
    "unify_works",
    """SELECT 'the_met-' || p_partkey AS work_id, 'Untitled' AS title, CAST(NULL AS VARCHAR) AS image_url, 'https://t/' || p_partkey AS thumb_url, 'The Metropolitan Museum of Art' AS credit, p_size > 10 AS pd, p_size > 40 AS hl FROM part
    UNION ALL SELECT 'aic-' || p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'https://www.artic.edu/iiif/2/i' || p_partkey || '/full/843,/0/default.jpg' END,
      CASE WHEN p_partkey % 2 = 0 THEN 'https://www.artic.edu/iiif/2/i' || p_partkey || '/full/200,/0/default.jpg' END, 'Art Institute of Chicago · CC0', p_size > 10, false FROM part WHERE p_partkey % 9 <> 0
    UNION ALL SELECT 'wikimedia-' || p_partkey, p_name, 'https://c/' || p_partkey, 'https://c/' || p_partkey, 'Wikimedia Commons · Public domain', p_partkey % 2 = 1, false FROM part WHERE p_partkey % 5 <> 0""",
)
def unify_works(spark, d):
    part = td.table(spark, d, "part")
    met = part.selectExpr(
        "p_brand AS master_id", "p_partkey AS objectID", "'' AS title", "'1900' AS objectDate", "p_type AS medium", "'' AS primaryImage",
        "concat('https://t/', p_partkey) AS primaryImageSmall", "CAST(NULL AS STRING) AS objectURL", "'' AS creditLine",
        "p_size > 10 AS isPublicDomain", "IF(p_size > 40, true, NULL) AS isHighlight", "p_partkey AS seq",
    )
    aic = part.selectExpr(
        "p_brand AS master_id", "IF(p_partkey % 9 = 0, NULL, p_partkey) AS id", "p_name AS title", "'' AS date_display", "p_type AS medium_display",
        "IF(p_partkey % 2 = 0, concat('i', p_partkey), '') AS image_id", "p_size > 10 AS is_public_domain", "p_partkey AS seq",
    )
    commons = part.selectExpr(
        "p_brand AS master_id", "p_partkey AS pageid", "p_name AS object_name", "'File:x.jpg' AS file_name", "'1890' AS taken",
        "IF(p_partkey % 5 = 0, 'video/ogg', 'image/jpeg') AS mime", "concat('https://c/', p_partkey) AS thumburl", "CAST(NULL AS STRING) AS url",
        "CAST(NULL AS STRING) AS descriptionurl", "IF(p_partkey % 2 = 1, 'pd-old', 'CC BY') AS licence", "p_partkey AS seq",
    )
    return masters.unify_works(met, aic, commons).select(
        masters.work_id(F.col("source"), F.col("source_object_id")).alias("work_id"), "title", "image_url", "thumb_url", "credit",
        F.col("is_public_domain").alias("pd"), F.col("is_highlight").alias("hl"),
    )


_CACHE = """cache AS (SELECT 'work:aic-' || p_partkey AS key, p_partkey AS k, CASE WHEN p_size > 10 THEN sha256('work|' || p_name || ' ' || (p_partkey % 7) || '|' ||
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(1850 + p_partkey % 100 AS VARCHAR) END || '|' || p_type)[1:16] ELSE 'stale' END AS h FROM part)"""


@query(
    "commentary_cache_lookup",
    sql(
        "w seed",
        """SELECT key, CASE WHEN ko IS NULL THEN 'miss' ELSE 'hit' END AS found, ko FROM (
          SELECT DISTINCT 'work:' || source || '-' || oid AS key, CASE WHEN source = 'aic' AND p_size > 10 THEN 'ko ' || oid END AS ko FROM w JOIN part ON p_partkey = k
          UNION ALL SELECT 'master:' || id, CASE WHEN k0 % 2 = 0 THEN 'ko ' || id END FROM seed)""",
    ),
)
def commentary_cache_lookup(spark, d):
    """The works of all museums and the masters, against texts for the works of one museum, some stale, and for every second master."""
    people = masters.master_facts(td.seeds(spark, d))
    items = masters.work_facts(td.works(spark, d)).select("key", "facts_hash").distinct().unionByName(people.select("key", "facts_hash"))
    of = F.struct(*[(F.concat(F.lit("ko "), F.col("id")) if n == "ko" else F.lit("")).alias(n) for n in ("ko", "en", "ja", "ko_tagline", "en_tagline", "ja_tagline")])
    written = people.filter(F.col("seq") % 2 == 0).select("key", "facts_hash", of.alias("text"))
    cache = td.commentary(spark, d).select("key", "facts_hash", "text").unionByName(written)
    hits = enrich.cache_hits(items, cache).select("key", F.lit("hit").alias("found"), F.col("text.ko").alias("ko"))
    return hits.unionByName(enrich.cache_misses(items, cache).select("key", F.lit("miss").alias("found"), F.lit(None).cast("string").alias("ko")))


@query(
    "master_catalogue",
    sql(
        "sel",
        """SELECT seed.id, CAST(seed.birth_year AS BIGINT) AS birth_year, CAST(sel.rank AS BIGINT) AS rank, sel.source || '-' || sel.oid AS work_id,
        CASE WHEN sel.source = 'aic' AND p.p_size > 10 AND sel.oid <> CAST(seed.k0 AS VARCHAR) THEN 'ko ' || sel.oid ELSE '' END AS commentary,
        '' AS bio FROM sel JOIN seed ON seed.id = sel.master_id JOIN part p ON p.p_partkey = sel.k""",
    ),
)
def master_catalogue(spark, d):
    rows = catalogue_of_masters(spark, d).select("id", "birth_year", "bio", F.explode("works").alias("w"))
    return rows.select(
        "id", F.col("birth_year").cast("long").alias("birth_year"), F.col("w.rank").cast("long").alias("rank"), F.col("w.id").alias("work_id"),
        "w.commentary", "bio",
    )


@query(
    "master_images",
    sql(
        "sel",
        """SELECT seed.id, coalesce(seed.portrait_url, arg_min(coalesce(thumb_url, ''), rank)) AS face_raw, arg_min(image_url, rank) AS hero FROM sel JOIN seed ON seed.id = sel.master_id GROUP BY seed.id, seed.portrait_url""",
    ),
)
def master_images(spark, d):
    rows = masters.master_images(catalogue_of_masters(spark, d))
    return rows.select("id", F.coalesce("face", F.lit("")).alias("face_raw"), "hero")


@query("sort_masters", sql("seed", "SELECT id, CAST(birth_year AS BIGINT) AS birth_year, CAST(row_number() OVER (ORDER BY coalesce(birth_year, 9999), k0) AS BIGINT) AS position FROM seed"))
def sort_masters(spark, d):
    return masters.sort_masters(td.seeds(spark, d)).select("id", F.col("birth_year").cast("long").alias("birth_year"), F.col("position").cast("long").alias("position"))


@query(
    "rehost_image_match",
    sql(
        "w",
        """SELECT master_id, source || '-' || oid AS work_id, CASE WHEN source = 'wikimedia' THEN image_url ELSE 'https://up/' || k || '/' || CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END END AS image_url
        FROM (SELECT DISTINCT master_id, source, oid, k, image_url FROM w) WHERE source = 'wikimedia' OR k % 4 <> 0""",
    ),
)
def rehost_image_match(spark, d):
    """Three candidate files per work: a non-image, one that may credit someone else, one that credits the master."""
    works = td.works(spark, d).withColumns(
        {"work_id": masters.work_id(F.col("source"), F.col("source_object_id")), "master_name": F.concat(F.lit("Ann "), "master_id", F.lit(" (studio)"))}
    ).drop("seq").distinct()
    files = works.filter("source <> 'wikimedia'").select("work_id", F.col("source_object_id").cast("long").alias("k"), "master_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("candidate_seq"))
    files = files.selectExpr(
        "work_id", "candidate_seq", "IF(candidate_seq = 0, 'application/pdf', 'image/png') AS mime", "IF(k % 4 = 0, 'CC BY', 'public domain') AS licence",
        "CAST('File:a.png' AS STRING) AS file_name", "IF(candidate_seq = 1 AND k % 3 = 0, 'Bob', upper(concat('ann ', master_id))) AS artist",
        "concat('https://up/', k, '/', candidate_seq) AS thumburl", "CAST(NULL AS STRING) AS descriptionurl", "concat('https://page/', k) AS url",
    )
    return masters.rehost(works, files).select("master_id", "work_id", "image_url")
