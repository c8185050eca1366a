"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows.

The tables hold no source trees, so facts, entities and references are made from
their columns by the same rule on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions import identity, text
from lodegraph.operators import capnp, gomod, html, symbol_db, workflow
from lodegraph.operators.parsing import earliest, fact
from lodegraph.plans import coverage, extract, report, resolve, similarity
from lodegraph.sources.files import FILES

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# --- synthetic facts -------------------------------------------------------------


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image facts: every part produces, those of odd size under a name that no line item uses, and every line item consumes."""
    part, item = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    image = F.lit("reg.example.com/part/")
    made = part.select(
        F.lit("producer").alias("role"),
        F.lit("container_image").alias("kind"),
        F.concat(F.when(F.col("p_size") % 2 == 0, image).otherwise(F.lit("reg.example.com/spare/")), F.col("p_partkey"), F.lit(":v"), F.col("p_size") % 3).alias("ref"),
        F.concat(F.lit("root"), F.col("p_partkey") % 5, F.lit("/Dockerfile")).alias("file"),
        F.col("p_size").cast("int").alias("line"),
    )
    tag = F.when(F.col("l_linenumber") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(":v"), F.col("l_linenumber") % 3))
    used = item.select(
        F.lit("consumer").alias("role"),
        F.lit("container_image").alias("kind"),
        F.concat(image, F.col("l_partkey"), tag).alias("ref"),
        F.concat(F.lit("root"), F.col("l_suppkey") % 5, F.lit("/Dockerfile")).alias("file"),
        F.col("l_linenumber").cast("int").alias("line"),
    )
    return made.unionByName(used)


_FACTS = """
p AS (SELECT 'container_image' AS kind, 'reg.example.com/' || CASE WHEN p_size % 2 = 0 THEN 'part/' ELSE 'spare/' END || p_partkey || ':v' || (p_size % 3) AS ref, 'root' || (p_partkey % 5) || '/Dockerfile' AS file, p_size AS line,
             'reg.example.com/' || CASE WHEN p_size % 2 = 0 THEN 'part/' ELSE 'spare/' END || p_partkey AS ikey, 'v' || (p_size % 3) AS version FROM part),
c AS (SELECT 'container_image' AS kind, 'reg.example.com/part/' || l_partkey || CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE ':v' || (l_linenumber % 3) END AS ref,
             'root' || (l_suppkey % 5) || '/Dockerfile' AS file, l_linenumber AS line,
             'reg.example.com/part/' || l_partkey AS ikey, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE 'v' || (l_linenumber % 3) END AS version FROM lineitem),
e AS (SELECT p.kind, p.ref AS p_ref, p.file AS p_file, p.line AS p_line, c.ref AS c_ref, c.file AS c_file, c.line AS c_line,
             CASE WHEN p.version = c.version THEN 'exact' WHEN p.version = '' OR c.version = '' THEN 'unknown' ELSE 'mismatch' END AS version_match
      FROM p JOIN c ON p.ikey = c.ikey),
x AS (SELECT * FROM c WHERE ikey NOT IN (SELECT ikey FROM p)),
d AS (SELECT * FROM p WHERE ikey NOT IN (SELECT ikey FROM c))"""


@_query(f"WITH {_FACTS} SELECT kind, p_ref, p_file, CAST(p_line AS BIGINT) AS p_line, c_ref, c_file, CAST(c_line AS BIGINT) AS c_line, version_match FROM e")
def resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved_edges(facts(spark, sf_dir)).withColumns({"p_line": _long("p_line"), "c_line": _long("c_line")})


@_query(f"WITH {_FACTS} SELECT kind, ref, file, CAST(line AS BIGINT) AS line FROM x")
def resolve_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.external(facts(spark, sf_dir)).withColumn("line", _long("line"))


@_query(f"WITH {_FACTS} SELECT kind, ref, file, CAST(line AS BIGINT) AS line FROM d")
def resolve_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.dangling(facts(spark, sf_dir)).withColumn("line", _long("line"))


@_query(
    f"""WITH {_FACTS} SELECT 'resolved' AS bucket, version_match, count(*) AS n FROM e GROUP BY ALL
UNION ALL SELECT 'external', '', count(*) FROM x UNION ALL SELECT 'dangling', '', count(*) FROM d"""
)
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.bucket_counts(facts(spark, sf_dir))


_ROOTS = ("root0", "root1", "root2", "root3", "x/root4", "root4/")


@_query(
    f"""WITH {_FACTS} SELECT split_part(c_file, '/', 1) AS from_label, split_part(p_file, '/', 1) AS to_label, count(*) AS n
FROM e WHERE c_file NOT LIKE 'root4%' AND p_file NOT LIKE 'root4%' GROUP BY ALL"""
)
def repo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([(r,) for r in _ROOTS], "root string")
    return resolve.repo_edges(facts(spark, sf_dir), roots)


_SITES = ("https:", "https://site0.example.com", "https://site1.example.com", "https://site1.example.com/p", "https://www.example.com")


@_query(
    f"""WITH r AS (SELECT unnest([{", ".join(f"'{s}'" for s in _SITES)}]) AS root), f AS (SELECT DISTINCT url AS file FROM pages)
SELECT file, arg_max(root, length(root)) AS root FROM f JOIN r ON file = root OR starts_with(file, root || '/') GROUP BY file"""
)
def root_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([(s,) for s in _SITES], "root string")
    return resolve.longest_roots(table(spark, sf_dir, "pages").select(F.col("url").alias("file")), roots)


@_query(
    f"""WITH {_FACTS}, a AS (SELECT kind, p_ref AS ref, 'resolved' AS bucket FROM e UNION SELECT kind, c_ref, 'resolved' FROM e
UNION SELECT kind, ref, 'external' FROM x UNION SELECT kind, ref, 'dangling' FROM d) SELECT * FROM a"""
)
def artifact_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.artifacts(facts(spark, sf_dir))


@_query(
    f"""WITH {_FACTS}, a AS (SELECT kind, p_ref AS ref, 0 AS r FROM e UNION ALL SELECT kind, c_ref, 0 FROM e UNION ALL SELECT kind, ref, 1 FROM x UNION ALL SELECT kind, ref, 2 FROM d)
SELECT kind, ref, CASE min(r) WHEN 0 THEN 'resolved' WHEN 1 THEN 'external' ELSE 'dangling' END AS bucket FROM a GROUP BY kind, ref"""
)
def node_bucket_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.nodes(resolve.artifacts(facts(spark, sf_dir)))


@_query(
    f"""WITH {_FACTS}, a AS (SELECT kind, ref FROM p UNION SELECT kind, ref FROM c)
SELECT ref, 'n' || substr(sha1(kind || chr(0) || ref), 1, 12) AS node_id, 'k' || substr(sha1('kind:' || kind), 1, 8) AS kind_id FROM a"""
)
def mermaid_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = facts(spark, sf_dir).select("kind", "ref").distinct()
    return ids.select("ref", identity.node_id(F.col("kind"), F.col("ref")).alias("node_id"), identity.kind_node_id(F.col("kind")).alias("kind_id"))


_JSON_ITEM = """'    {' || chr(10) || '      "kind": "' || kind || '",' || chr(10) || '      "ref": "' || ref || '",' || chr(10) || '      "bucket": "' || bucket || '"' || chr(10) || '    }'"""


@_query(
    f"""WITH {_FACTS}, a AS (SELECT kind, p_ref AS ref, 'resolved' AS bucket FROM e UNION SELECT kind, c_ref, 'resolved' FROM e
UNION SELECT kind, ref, 'external' FROM x UNION SELECT kind, ref, 'dangling' FROM d) SELECT ref, {_JSON_ITEM} AS text FROM a"""
)
def artifact_json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each artifact in the JSON report."""
    return report.artifact_rows(facts(spark, sf_dir)).df.select("ref", "text")


@_query(f"WITH {_FACTS} SELECT p.version AS p_version, c.version AS c_version, CASE WHEN p.version = c.version THEN 'exact' WHEN p.version = '' OR c.version = '' THEN 'unknown' ELSE 'mismatch' END AS version_match, count(*) AS n FROM p JOIN c ON p.ikey = c.ikey GROUP BY ALL")
def version_match_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = resolve.canonical(facts(spark, sf_dir)).groupBy("role", "kind", "identity_key", "version").agg(F.count("*").alias("n"))
    p = known.filter("role = 'producer'").select("kind", "identity_key", F.col("version").alias("p_version"), F.col("n").alias("np"))
    c = known.filter("role = 'consumer'").select("kind", "identity_key", F.col("version").alias("c_version"), F.col("n").alias("nc"))
    match = identity.version_match(F.col("p_version"), F.col("c_version"))
    return p.join(c, ["kind", "identity_key"]).groupBy("p_version", "c_version", match.alias("version_match")).agg(F.sum(F.col("np") * F.col("nc")).alias("n"))


@_query(
    """SELECT role, kind, count(*) AS n, count(DISTINCT ref) AS refs FROM (
SELECT 'producer' AS role, 'container_image' AS kind, 'img/' || p_brand AS ref FROM part UNION ALL
SELECT 'producer', 'service', s_name FROM supplier UNION ALL SELECT 'consumer', 'service', c_name FROM customer) GROUP BY ALL"""
)
def facts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    def extractor(t: str, role: str, kind: str, ref: Column) -> extract.Extractor:
        return lambda files: table(spark, sf_dir, t).select(F.lit(role).alias("role"), F.lit(t).alias("root"), F.lit(kind).alias("kind"), ref.alias("ref"), F.lit(t).alias("file"), F.lit(1).alias("line"))

    extra = {
        "parts": extractor("part", "producer", "container_image", F.concat(F.lit("img/"), "p_brand")),
        "suppliers": extractor("supplier", "producer", "service", F.col("s_name")),
        "customers": extractor("customer", "consumer", "service", F.col("c_name")),
    }
    registry = extract.Registry(unavailable=dict.fromkeys(extract.Registry().extractors(), "no files"), extra=extra)
    every = registry.gather(spark.createDataFrame([], FILES)).facts
    return every.groupBy("role", "kind").agg(F.count("*").alias("n"), F.count_distinct("ref").alias("refs"))


@_query(
    """WITH c AS (SELECT 'root' || c_nationkey AS root, CASE c_custkey % 4 WHEN 0 THEN 'service' WHEN 1 THEN 'cargo_crate' WHEN 2 THEN 'servce' ELSE 'go_modul' END AS kind, c_name AS ref, c_mktsegment AS file, c_custkey AS line FROM customer),
u AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY file, line, ref) AS r FROM c WHERE kind IN ('servce', 'go_modul'))
SELECT 'customers' AS extractor, root, 'unknown kind ' || kind || ' of ' || ref AS error FROM u WHERE r = 1"""
)
def kind_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as facts, half of them of kinds that there aren't, by roots: what the registry lists as failed."""
    kind = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'service' WHEN 1 THEN 'cargo_crate' WHEN 2 THEN 'servce' ELSE 'go_modul' END")

    def customers(_: DataFrame) -> DataFrame:
        return table(spark, sf_dir, "customer").select(F.lit("consumer").alias("role"), F.concat(F.lit("root"), "c_nationkey").alias("root"), kind.alias("kind"), F.col("c_name").alias("ref"), F.col("c_mktsegment").alias("file"), F.col("c_custkey").cast("int").alias("line"))

    registry = extract.Registry(unavailable=dict.fromkeys(extract.Registry().extractors(), "no files"), extra={"customers": customers})
    return registry.gather(spark.createDataFrame([], FILES)).failed


_REQUIRED = """CASE p_partkey % 5 WHEN 0 THEN 'example.com/m' || p_partkey WHEN 1 THEN 'example.com/m' || p_partkey || '/v2' WHEN 2 THEN 'gopkg.in/m.v' || (p_size % 3) WHEN 3 THEN 'example.com/m/v' || (p_size % 4) ELSE 'gopkg.in/m' || p_size END AS path,
CASE p_size % 7 WHEN 0 THEN 'v1.' || p_size || '.0' WHEN 1 THEN 'v2.0.' || p_size WHEN 2 THEN 'v0' || p_size WHEN 3 THEN 'v' || (p_size % 3) WHEN 4 THEN 'v2.1.0+incompatible' WHEN 5 THEN 'v1.2-rc' ELSE 'v0.0.0-rc.' || p_size || '+a' END AS version"""


@_query(
    f"""WITH q AS (SELECT p_partkey, {_REQUIRED} FROM part),
o AS (SELECT *, CASE WHEN path LIKE 'gopkg.in/%' THEN nullif(regexp_extract(path, '\\.v(0|[1-9][0-9]*)$'), '') WHEN regexp_matches(path, '/v[0-9.]+$') AND NOT regexp_matches(path, '/v([2-9]|[1-9][0-9]+)$') THEN NULL ELSE regexp_extract(path, '/v[0-9]+$') END AS own, regexp_extract(version, '^v[0-9]+') AS major FROM q)
SELECT p_partkey, path, version, CASE WHEN own IS NULL THEN path || ': invalid module path'
WHEN NOT regexp_full_match(version, 'v(0|[1-9][0-9]*)([.](0|[1-9][0-9]*)([.](0|[1-9][0-9]*)(-[0-9A-Za-z-]+([.][0-9A-Za-z-]+)*)?([+][0-9A-Za-z-]+)?)?)?') THEN version || ': must be of the form v1.2.3'
WHEN own = '' AND major NOT IN ('v0', 'v1') AND NOT suffix(version, '+incompatible') THEN path || '@' || version || ': invalid version: should be v0 or v1, not ' || major
WHEN own <> '' AND major <> substr(own, 2) AND NOT (own = '.v1' AND starts_with(version, 'v0.0.0-')) THEN path || '@' || version || ': invalid version: should be ' || substr(own, 2) || ', not ' || major END AS fault FROM o"""
)
def required_version_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as required modules with versions: what a full reading of go.mod finds wrong with each."""
    required = table(spark, sf_dir, "part").selectExpr("p_partkey", *(f"{x} AS {n}" for x, n in zip((p.rsplit(" AS ", 1)[0] for p in _REQUIRED.split(",\n")), ("path", "version"), strict=True)))
    return required.withColumn("fault", gomod.version_fault(F.col("path"), F.col("version")))


@_query("SELECT l_orderkey % 97 AS file, l_partkey AS ref, CAST(min(l_linenumber) AS BIGINT) AS line FROM lineitem GROUP BY ALL")
def earliest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"root": F.lit("r"), "file": F.col("l_orderkey") % 97, "line": F.col("l_linenumber"), "key": F.col("l_partkey").cast("string")})
    found = earliest(rows.select(*fact("consumer", "cargo_crate", "key")))
    return found.select("file", _long("ref").alias("ref"), _long("line").alias("line"))


# --- identities ------------------------------------------------------------------

_PART_REFS = "CASE p_size % 4 WHEN 0 THEN 'reg.io:5000/a/' || p_partkey || ':v' || p_size WHEN 1 THEN 'b/' || p_partkey WHEN 2 THEN 'c/' || p_partkey || ':t@sha256:' || p_size ELSE 'localhost:80/' || p_partkey END"


def _part_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(_PART_REFS).alias("ref"))


@_query(
    f"""WITH r AS (SELECT {_PART_REFS} AS ref FROM part) SELECT ref,
CASE WHEN contains(ref, '@') THEN split_part(ref, '@', 1) ELSE regexp_replace(ref, ':[^/:]*$', '') END AS identity_key,
CASE WHEN contains(ref, '@') THEN substr(ref, instr(ref, '@') + 1) ELSE regexp_extract(ref, ':([^/:]*)$', 1) END AS version FROM r"""
)
def identity_canonical_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit("container_image")
    return _part_refs(spark, sf_dir).select("ref", identity.identity_key(kind, F.col("ref")).alias("identity_key"), identity.version(kind, F.col("ref")).alias("version"))


_MODULES = "'example.com/' || replace(p_brand, '#', '') || '/m' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '@v1.' || p_size ELSE '' END"


@_query(
    f"""WITH r AS (SELECT {_MODULES} AS ref FROM part) SELECT ref, split_part(ref, '@', 1) AS identity_key,
CASE WHEN contains(ref, '@') THEN substr(ref, instr(ref, '@') + 1) ELSE '' END AS version FROM r"""
)
def identity_canonical_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit("go_module")
    refs = table(spark, sf_dir, "part").select(F.expr(_MODULES).alias("ref"))
    return refs.select("ref", identity.identity_key(kind, F.col("ref")).alias("identity_key"), identity.version(kind, F.col("ref")).alias("version"))


_URL_REFS = "CASE page_id % 3 WHEN 0 THEN upper(replace(url, 'https://', '')) || ':tag' WHEN 1 THEN ' ' || replace(replace(url, 'https://', ''), '/', '') || '@sha256:ab ' ELSE replace(url, 'https://', '') END"


def _url_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.expr(_URL_REFS).alias("raw"))


_STRIPPED = "regexp_replace(split_part(trim(raw), '@', 1), ':[^/:]*$', '')"


@_query(
    f"""WITH r AS (SELECT {_URL_REFS} AS raw FROM pages), s AS (SELECT raw, {_STRIPPED} AS ref FROM r),
t AS (SELECT *, split_part(ref, '/', 1) AS first, contains(ref, '/') AND (regexp_matches(split_part(ref, '/', 1), '[.:]') OR split_part(ref, '/', 1) = 'localhost') AS hosted FROM s)
SELECT raw, CASE WHEN trim(raw) = '' THEN '' WHEN hosted THEN lower(first) || '/' || CASE WHEN lower(first) = 'docker.io' AND NOT contains(substr(ref, length(first) + 2), '/') THEN 'library/' ELSE '' END || substr(ref, length(first) + 2)
ELSE 'docker.io/' || CASE WHEN contains(ref, '/') THEN ref ELSE 'library/' || ref END END AS image FROM t"""
)
def normalize_image_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url_refs(spark, sf_dir).select("raw", identity.normalized_image(F.col("raw")).alias("image"))


@_query(
    f"""WITH r AS (SELECT {_URL_REFS} AS raw FROM pages), s AS (SELECT raw, trim(raw) AS whole, {_STRIPPED} AS ref FROM r)
SELECT raw, CASE WHEN whole <> '' AND NOT regexp_matches(whole, '[ \t]') AND contains(ref, '/') AND (regexp_matches(split_part(ref, '/', 1), '[.:]') OR split_part(ref, '/', 1) = 'localhost')
THEN lower(split_part(ref, '/', 1)) || substr(ref, instr(ref, '/')) END AS image FROM s"""
)
def ci_image_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url_refs(spark, sf_dir).select("raw", identity.workflow_image(F.col("raw")).alias("image"))


@_query(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'example.com/' ELSE 'github.com/' END || source || '/' || lang || CASE WHEN doc_id % 2 = 0 THEN '/' || doc_id ELSE '' END AS path FROM documents)
SELECT doc_id, path AS ref FROM d UNION SELECT doc_id, array_to_string(string_split(path, '/')[1:3], '/') FROM d WHERE path LIKE 'github.com/%'"""
)
def owning_repo_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'example.com/' ELSE 'github.com/' END || source || '/' || lang || CASE WHEN doc_id % 2 = 0 THEN '/' || doc_id ELSE '' END")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(identity.module_refs(path)).alias("ref"))


# --- tokens and similarity -------------------------------------------------------


def _sql_tokens(x: str) -> str:
    """Lower-case tokens by passes that mark borders with a separator, as DuckDB's regular expressions don't look around."""
    for pattern in (r"(\p{Ll})(\p{Lu})", r"(\p{L})(\p{Nd})", r"(\p{Nd})(\p{L})", r"(\p{Lu})(\p{Lu}\p{Ll})"):
        for _ in range(2):
            x = f"regexp_replace({x}, '{pattern}', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_transform(list_filter(regexp_split_to_array({x}, '[._\\- /:()' || chr(1) || ']+'), lambda t: t <> ''), lambda t: lower(t))"


def _sql_set(x: str) -> str:
    return f"list_distinct(list_filter({_sql_tokens(x)}, lambda t: strlen(t) > 1))"


def _sql_trigrams(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(range(1, greatest(1, length({x}) - 1)), lambda i: substr(lower({x}), i, 3)), lambda t: NOT regexp_matches(t, '[ \\t\\n]')))"


@_query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) SELECT doc_id, CAST(len({_sql_tokens('text')}) AS BIGINT) AS n_tokens, CAST(len({_sql_set('text')}) AS BIGINT) AS n_distinct FROM d")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return told.select("doc_id", _long(F.size("tokens")).alias("n_tokens"), _long(F.size(text.distinct_tokens(F.col("tokens")))).alias("n_distinct"))


@_query(f"WITH d AS (SELECT coalesce(text, '') AS text FROM documents), t AS (SELECT unnest({_sql_set('text')}) AS token FROM d) SELECT token, count(*) AS docs FROM t GROUP BY token")
def token_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(text.token_set(F.coalesce("text", F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("docs"))


@_query(f"SELECT p_partkey, CAST(len({_sql_trigrams('p_name')}) AS BIGINT) AS n, array_to_string(list_sort({_sql_trigrams('p_name')}), '|') AS trigrams FROM part")
def trigram_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = text.trigrams(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", _long(F.size(grams)).alias("n"), F.array_join(F.sort_array(grams), "|").alias("trigrams"))


def _items(df: DataFrame, key: str, column: Column) -> DataFrame:
    return df.select(_long(key).alias("id"), column.alias("items"))


_JACCARD_SQL = f"""
a AS (SELECT item_id AS left_id, {_sql_set("coalesce(text, '')")} AS x FROM benchmark), b AS (SELECT doc_id AS right_id, {_sql_set("coalesce(text, '')")} AS y FROM documents),
ax AS (SELECT left_id, len(x) AS na, unnest(x) AS t FROM a), bx AS (SELECT right_id, len(y) AS nb, unnest(y) AS t FROM b),
pairs AS (SELECT left_id, right_id, count(*) / (any_value(na) + any_value(nb) - count(*)) AS sim FROM ax JOIN bx USING (t) GROUP BY left_id, right_id)"""


def _benchmark_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    side = lambda t, key: _items(table(spark, sf_dir, t), key, text.token_set(F.coalesce("text", F.lit(""))))
    return side("benchmark", "item_id"), side("documents", "doc_id")


@_query(f"WITH {_JACCARD_SQL} SELECT left_id, right_id, round(sim, 6) AS sim FROM pairs WHERE sim >= 0.1")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(*_benchmark_sides(spark, sf_dir), "jaccard", 0.1).withColumn("sim", F.round("sim", 6))


@_query(f"WITH {_JACCARD_SQL} SELECT left_id, right_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY sim DESC, right_id) AS r FROM pairs) WHERE r = 1 AND sim >= 0.1")
def jaccard_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.best_matches(*_benchmark_sides(spark, sf_dir), "jaccard", 0.1).withColumn("sim", F.round("sim", 6))


_NAMES_SQL = f"""
n AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name),
g AS (SELECT id, len(s) AS size, unnest(s) AS t FROM (SELECT id, {_sql_trigrams('name')} AS s FROM n))"""


@_query(f"WITH {_NAMES_SQL} SELECT a.id AS left_id, b.id AS right_id, round(2.0 * count(*) / (any_value(a.size) + any_value(b.size)), 6) AS sim FROM g a JOIN g b USING (t) GROUP BY a.id, b.id HAVING 2.0 * count(*) / (any_value(a.size) + any_value(b.size)) >= 0.7")
def dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    side = _items(names, "id", text.trigrams(F.col("p_name")))
    return similarity.similar_pairs(side, side, "dice", 0.7).withColumn("sim", F.round("sim", 6))


# --- coverage --------------------------------------------------------------------


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities, their words in camel case; every third with a comment."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("Q"), F.col("p_partkey"))).otherwise(F.lit(""))).alias("name"),
        F.concat(F.lit("kind"), F.col("p_size") % 3).alias("kind"),
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.lower(F.regexp_replace("p_brand", "#", ""))).alias("package"),
        F.concat(F.lit("src"), F.col("p_partkey") % 7, F.lit("/f.go")).alias("file"),
        F.lit(True).alias("exported"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_type", "p_brand", F.col("p_partkey") % 50)).otherwise(F.lit("")).alias("doc_comment"),
    )


def doc_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as references: names of parts whole, qualified, as single words, or part types."""
    part = entities(spark, sf_dir).select("ord", "name", "package", "doc_comment")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    joined = c.join(part, F.col("c_custkey") == F.col("ord"), "left")
    said = (
        F.when(F.col("c_custkey") % 6 == 0, F.concat("name", F.lit("()")))
        .when(F.col("c_custkey") % 6 == 1, F.concat_ws(".", "package", "name"))
        .when(F.col("c_custkey") % 6 == 2, F.concat(F.lit(" x"), F.col("name")))
        .when(F.col("c_custkey") % 6 == 3, F.col("doc_comment"))
        .when(F.col("c_custkey") % 6 == 4, F.concat(F.expr("substring(name, 2)"), F.lit("s")))
        .otherwise(F.col("c_name"))
    )
    return joined.select(F.col("c_custkey").alias("ord"), F.coalesce(said, "c_name").alias("text"), F.lit("code_span").alias("kind"), F.concat(F.lit("doc"), F.col("c_nationkey"), F.lit(".md")).alias("file"), F.col("c_custkey").cast("int").alias("line"))


_INITCAP = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || CASE WHEN p_size % 7 = 0 THEN 'Q' || p_partkey ELSE '' END"
_COVERAGE = f"""
ent AS MATERIALIZED (SELECT p_partkey AS ord, {_INITCAP} AS name, 'kind' || (p_size % 3) AS kind, CASE WHEN p_size % 5 = 0 THEN '' ELSE lower(replace(p_brand, '#', '')) END AS package,
        'src' || (p_partkey % 7) || '/f.go' AS file, CASE WHEN p_partkey % 3 = 0 THEN concat_ws(' ', p_type, p_brand, p_partkey % 50) ELSE '' END AS doc FROM part),
refs AS MATERIALIZED (SELECT c_custkey AS ord, coalesce(CASE c_custkey % 6 WHEN 0 THEN name || '()' WHEN 1 THEN concat_ws('.', package, name) WHEN 2 THEN ' x' || name WHEN 3 THEN doc WHEN 4 THEN substr(name, 2) || 's' ELSE c_name END, c_name) AS text,
        'doc' || c_nationkey || '.md' AS file FROM customer LEFT JOIN ent ON c_custkey = ord),
norms AS MATERIALIZED (SELECT DISTINCT regexp_replace(trim(text), '\\(\\)$', '') AS norm FROM refs),
keys AS (SELECT name AS key, ord, 0 AS v, name FROM ent UNION ALL SELECT package || '.' || name, ord, 1, name FROM ent WHERE package <> ''),
byname AS (SELECT key, arg_max(ord, ord * 2 + v) AS ord, arg_max(name, ord * 2 + v) AS name FROM keys GROUP BY key),
l1 AS MATERIALIZED (SELECT norm, 'exact' AS layer, ord, name FROM norms JOIN byname ON norm = key),
o1 AS MATERIALIZED (SELECT norm FROM norms WHERE norm NOT IN (SELECT norm FROM l1)),
et AS MATERIALIZED (SELECT ord, name, len(s) AS n, unnest(s) AS t FROM (SELECT ord, name, {_sql_set('name')} AS s FROM ent)),
rt AS MATERIALIZED (SELECT norm, len(s) AS n, unnest(s) AS t FROM (SELECT norm, {_sql_set('norm')} AS s FROM norms)),
s2 AS (SELECT norm, ord, any_value(name) AS name, count(*) / (any_value(rt.n) + any_value(et.n) - count(*)) AS sim FROM rt JOIN et USING (t) WHERE norm IN (SELECT norm FROM o1) GROUP BY norm, ord),
l2 AS MATERIALIZED (SELECT norm, 'jaccard' AS layer, ord, name FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY sim DESC, ord) AS r FROM s2) WHERE r = 1 AND sim >= 0.4),
o2 AS MATERIALIZED (SELECT norm FROM o1 WHERE norm NOT IN (SELECT norm FROM l2)),
eg AS MATERIALIZED (SELECT ord, name, len(s) AS n, unnest(s) AS t FROM (SELECT ord, name, {_sql_trigrams('name')} AS s FROM ent)),
rg AS MATERIALIZED (SELECT norm, len(s) AS n, unnest(s) AS t FROM (SELECT norm, {_sql_trigrams('norm')} AS s FROM o2)),
s3 AS (SELECT norm, ord, any_value(name) AS name, 2.0 * count(*) / (any_value(rg.n) + any_value(eg.n)) AS sim FROM rg JOIN eg USING (t) GROUP BY norm, ord),
l3 AS MATERIALIZED (SELECT norm, 'trigram' AS layer, ord, name FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY sim DESC, ord) AS r FROM s3) WHERE r = 1 AND sim >= 0.3),
o3 AS MATERIALIZED (SELECT norm FROM o2 WHERE norm NOT IN (SELECT norm FROM l3)),
ed AS MATERIALIZED (SELECT ord, name, len(s) AS n, unnest(s) AS t FROM (SELECT ord, name, {_sql_set('doc')} AS s FROM ent)),
s4 AS (SELECT norm, ord, any_value(name) AS name, count(*) / (any_value(rt.n) + any_value(ed.n) - count(*)) AS sim FROM rt JOIN ed USING (t) WHERE norm IN (SELECT norm FROM o3) GROUP BY norm, ord),
l4 AS (SELECT norm, 'doc' AS layer, ord, name FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY sim DESC, ord) AS r FROM s4) WHERE r = 1 AND sim >= 0.4),
m AS MATERIALIZED (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4),
stale AS (SELECT * FROM refs WHERE regexp_replace(trim(text), '\\(\\)$', '') NOT IN (SELECT norm FROM m))"""


def _coverage(spark: SparkSession, sf_dir: str) -> coverage.Coverage:
    return coverage.compute(entities(spark, sf_dir), doc_refs(spark, sf_dir))


@_query(f"WITH {_COVERAGE} SELECT norm, ord, name FROM l1")
def exact_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.match_refs(entities(spark, sf_dir), doc_refs(spark, sf_dir), 0).drop("layer")


@_query(f"WITH {_COVERAGE} SELECT norm, layer, ord, name FROM m")
def coverage_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).matches


@_query(f"WITH {_COVERAGE} SELECT ord, name, name IN (SELECT name FROM m) AS covered FROM ent")
def covered_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _coverage(spark, sf_dir)
    mark = lambda df, v: df.select("ord", "name", F.lit(v).alias("covered"))
    return mark(c.covered, True).unionAll(mark(c.uncovered, False))


@_query(f"WITH {_COVERAGE} SELECT ord, text, file FROM stale")
def stale_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).stale.select("ord", "text", "file")


@_query(
    f"""WITH {_COVERAGE}, k AS (SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM ent WHERE name IN (SELECT name FROM m)) AS covered, (SELECT count(*) FROM refs) AS refs, (SELECT count(*) FROM stale) AS stale)
SELECT *, round(covered / entities, 6) AS coverage, round(stale / refs, 6) AS staleness, (SELECT count(DISTINCT coalesce(nullif(package, ''), split_part(file, '/', 1))) FROM ent) AS packages, (SELECT count(DISTINCT file) FROM refs) AS doc_files FROM k"""
)
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).summary().withColumns({c: F.round(c, 6) for c in ("coverage", "staleness")})


@_query(
    f"""WITH {_COVERAGE}, q AS (SELECT CASE WHEN package <> '' THEN package || '.' || name ELSE name END AS q FROM ent WHERE name NOT IN (SELECT name FROM m)), f AS (SELECT q FROM q ORDER BY q LIMIT 10)
SELECT (SELECT count(*) FROM q) AS n, coalesce((SELECT string_agg(q, ', ' ORDER BY q) FROM f), '') || CASE WHEN (SELECT count(*) FROM q) > 10 THEN ' (+' || ((SELECT count(*) FROM q) - 10) || ' more)' ELSE '' END AS names"""
)
def gate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.gate_names(_coverage(spark, sf_dir).uncovered)


@_query(
    """WITH c AS (SELECT conv_id * 1000 + turn AS ord, text, role AS kind, 'c' || (conv_id % 9) AS file, turn AS line FROM conversations),
r AS (SELECT 0 AS source, * FROM c UNION ALL SELECT 1, ord, text, kind, CASE WHEN line % 2 = 0 THEN file ELSE 'docs/' || file END, line FROM c)
SELECT source, ord, text, kind, file, line FROM (SELECT *, row_number() OVER (PARTITION BY text, file, line ORDER BY source, ord) AS n FROM r) WHERE n = 1"""
)
def merge_refs_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is in both sources; those of even number name the same file in both."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text", F.col("role").alias("kind"), F.concat(F.lit("c"), F.col("conv_id") % 9).alias("file"), F.col("turn").alias("line"))
    return coverage.merge_refs(rows, rows.withColumn("file", F.when(F.col("line") % 2 == 0, F.col("file")).otherwise(F.concat(F.lit("docs/"), "file"))))


# --- scans and predicates --------------------------------------------------------


@_query("SELECT page_id, h.level AS level, trim(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h.inner_html, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), chr(160), ' ')) AS heading FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>(?s:(.*?))</h[1-6]>', 1)) AS level, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>(?s:(.*?))</h[1-6]>', 2)) AS inner_html FROM pages) h")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.claims(_page_files(spark, sf_dir)).filter("kind = 'heading'")
    return found.select(_long("file").alias("page_id"), F.substring("tag", 2, 1).alias("level"), F.col("text").alias("heading"))


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter("html is not null").select(F.lit("pages").alias("root"), F.col("page_id").cast("string").alias("rel"), F.encode("html", "UTF-8").alias("content"))


@_query(
    """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6]|code|tt)[^>]*>(?s:(.*?))</(?:h[1-6]|code|tt)>', 1)) AS tag, unnest(regexp_extract_all(html, '<(h[1-6]|code|tt)[^>]*>(?s:(.*?))</(?:h[1-6]|code|tt)>', 2)) AS inner_html FROM pages),
t AS (SELECT page_id, tag, trim(regexp_replace(inner_html, '<[^>]*>', '', 'g'), chr(9) || chr(10) || chr(13) || ' ') AS text FROM h)
SELECT page_id, text, CASE WHEN tag LIKE 'h%' THEN 'heading' ELSE 'code_span' END AS kind FROM t
WHERE CASE WHEN tag LIKE 'h%' THEN regexp_full_match(text, '[A-Za-z][A-Za-z0-9._]*') ELSE text <> '' AND NOT regexp_matches(text, '^[-/~]| ') END"""
)
def html_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.refs(_page_files(spark, sf_dir)).select(_long("file").alias("page_id"), "text", "kind")


_WORDS_SQL = "SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))


@_query(
    f"""WITH w AS ({_WORDS_SQL}) SELECT doc_id, count(*) FILTER (WHERE regexp_full_match(word, '[A-Za-z][A-Za-z0-9._]*')) AS identifiers,
count(*) FILTER (WHERE regexp_matches(word, '^[-/~]| ')) AS others FROM w GROUP BY doc_id"""
)
def identifier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return _words(spark, sf_dir).groupBy("doc_id").agg(F.count_if(text.looks_like_identifier(w)).alias("identifiers"), F.count_if(text.common_non_identifier(w)).alias("others"))


@_query(
    f"""WITH w AS ({_WORDS_SQL}), b AS (SELECT word, CASE WHEN word = '' THEN 0 ELSE CAST('0x' || substr(hex(encode(word)), 1, 2) AS INTEGER) END AS byte FROM w)
SELECT word, count(*) AS n FROM b WHERE byte BETWEEN 65 AND 90 OR (byte BETWEEN 192 AND 222 AND byte <> 215) GROUP BY word"""
)
def exported_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).filter(text.exported(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@_query("SELECT conv_id, turn, CAST(i AS BIGINT) AS line, lines[i] AS text FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations WHERE text IS NOT NULL)) WHERE lines[i] <> ''")
def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.filter("text <> ''").select("conv_id", "turn", _long(F.col("i") + 1).alias("line"), "text")


@_query(
    r"""WITH d AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM conversations WHERE text IS NOT NULL),
l AS (SELECT conv_id, turn, nth, i, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS lines FROM d))),
m AS (SELECT *, coalesce(lag(regexp_matches(line, '\\[ \t]*$')) OVER (PARTITION BY conv_id, turn, nth ORDER BY i), false) AS continues FROM l),
s AS (SELECT *, max(CASE WHEN continues THEN NULL ELSE i END) OVER (PARTITION BY conv_id, turn, nth ORDER BY i ROWS UNBOUNDED PRECEDING) AS start FROM m),
w AS (SELECT conv_id, turn, nth, start, trim(string_agg(regexp_replace(line, '\\[ \t]*$', ' '), '' ORDER BY i), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS said FROM s GROUP BY conv_id, turn, nth, start),
b AS (SELECT conv_id, turn, nth, start AS line, regexp_replace(said, '^((sudo|[^\s=/.:$]+=[^\s$(`"'']*)(\s+|$))+', '') AS bare FROM w WHERE said <> '' AND NOT starts_with(said, '#'))
SELECT conv_id, turn, nth, CAST(line AS BIGINT) AS line, array_to_string(regexp_split_to_array(bare, '\s+'), ' ') AS command FROM b WHERE regexp_split_to_array(bare, '\s+')[1] <> ''"""
)
def script_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as scripts: commands with their continued lines joined. Of rows with one turn, `nth` is the place by text; each counts."""
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("text"))
    turns = table(spark, sf_dir, "conversations").filter("text is not null").withColumn("nth", nth)
    runs = turns.select(F.col("conv_id").alias("root"), F.struct("turn", "nth").alias("file"), F.lit(1).alias("line"), F.col("text").alias("value"))
    return workflow.commands(runs).select(F.col("root").alias("conv_id"), F.col("file")["turn"].alias("turn"), _long(F.col("file")["nth"]).alias("nth"), _long("line").alias("line"), F.array_join("fields", " ").alias("command"))


@_query(
    """SELECT o_orderkey AS token, c_custkey AS node_id, c_name AS source_file, CAST(CASE WHEN n_nationkey IS NULL THEN 0 ELSE n_regionkey + 1 END AS BIGINT) AS line
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 100 END"""
)
def symbol_db_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tokens at customers' nodes; nations are syntax rows, and customers of odd key ask for a row that isn't there."""
    defs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("node_id"))
    wanted = F.col("c_nationkey") + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(100)
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("source_file"), wanted.alias("ast_id"))
    ast = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ast"), F.col("n_regionkey").alias("start_row"))
    placed = nodes.join(ast, F.col("ast_id") == F.col("ast"), "left").select("id", "source_file", "start_row")
    return symbol_db.provenance(defs, placed.select("id", "source_file"), placed.select(F.col("id").alias("node_id"), "start_row")).select("token", "node_id", F.col("file").alias("source_file"), _long("line").alias("line"))


@_query(
    """WITH k AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_id,
CASE event_id % 5 WHEN 0 THEN 'name' WHEN 1 THEN 'worker' WHEN 2 THEN 'service' ELSE 'other' END AS key FROM events),
s AS (SELECT *, max(CASE WHEN key <> 'other' THEN pos END) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT s.file, 'n' || n.event_id AS ref, n.pos AS line FROM s JOIN k n ON n.file = s.file AND n.pos = s.before WHERE s.key = 'worker' AND n.key = 'name'"""
)
def pending_name_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the fields of a file."""
    key = F.expr("CASE event_id % 5 WHEN 0 THEN 'name' WHEN 1 THEN 'worker' WHEN 2 THEN 'service' ELSE 'other' END")
    fields = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("line"), F.lit(0).alias("pos"), key.alias("key"), F.concat(F.lit("n"), "event_id").alias("value"))
    return capnp.pending_names(fields, ["file"]).select("file", F.col("value").alias("ref"), "line")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
